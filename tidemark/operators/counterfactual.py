"""Counterfactual items: two streams of one episode cut at one onset, the context from the one, the truth from the other.

Both streams are rows of one table, told apart by a column. An episode's windows come from one aggregation of it; items meet
the rows of both streams in one join by episode and one grouped pass, in which each row counts for the context or for the
truth by its stream and place. Rows of one stream are never joined to rows of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, draw, draw_between
from tidemark.functions.values import python_number, rounded

Cols = Sequence[str]

#: Events whose effects are sudden; they make no predictive items.
COLLISIONS = (16, 17, 18, 19)


def pair_windows(rows: DataFrame, key: Cols, seq: str, stream: str, event: str, names: tuple[str, str] = ("baseline", "counterfactual"), least: int = 32, most: int = 64, margin: int = 5) -> DataFrame:
    """key, onset, event, start, length, n_after: per episode a drawn window of the first stream around the second's onset.

    The onset is the first row of the second stream with an event; the window holds it with `margin` rows on both sides, and
    the second stream has as many rows up to the onset. Episodes without an event or room go.
    """
    base, other = F.col(stream) == names[0], F.col(stream) == names[1]
    hit = F.when(other & (F.coalesce(F.col(event), F.lit(0)) != 0), F.col(seq))
    e = rows.groupBy(*key).agg(F.count_if(base).alias("n"), F.count_if(other).alias("n_other"), F.min(hit).alias("onset"), F.min_by(event, hit).alias("event")).where("onset IS NOT NULL")
    at, n = F.col("onset"), F.col("n")
    low, high = F.lit(max(least, 2 * margin + 1)), F.least(F.lit(most), n)
    starts = lambda length: (F.greatest(F.lit(0), at + margin - length + 1), F.least(at - margin, n - length))
    fits = F.filter(F.sequence(low, F.greatest(low, high)), lambda x: (x <= high) & (x <= at + 1) & (starts(x)[0] <= starts(x)[1]))
    e = e.withColumn("__fits", fits).where("size(__fits) > 0 AND onset < n")
    e = e.withColumn("length", F.get("__fits", draw(F.size("__fits"), "pair-n", *key).cast("int")))
    lo, hi = starts(F.col("length"))
    return e.select(*key, "onset", "event", draw_between(lo, hi, "pair-at", *key).alias("start"), "length", (F.col("n_other") - at).alias("n_after"))


def predictive(items: DataFrame) -> DataFrame:
    """Items whose event can be foreseen at all."""
    return items.where(~F.col("event").isin(*COLLISIONS))


def segment_items(rows: DataFrame, items: DataFrame, key: Cols, seq: str, line: Column, sizes: tuple[int, int] = (5, 7), n: int = 4) -> DataFrame:
    """items with options (letter -> chunk) and answer: n back-to-back chunks after the onset, of one drawn length, at a drawn place, under drawn letters.

    rows: the stream that has the event; line: a row as text. Items without room for n shortest chunks go.
    """
    least, most = sizes
    room = items.where(F.col("n_after") >= n * least)
    size = draw_between(F.lit(least), F.least(F.lit(most), F.floor(F.col("n_after") / n)).cast("int"), "chunk-n", *key)
    room = room.withColumn("__size", size).withColumn("__from", F.col("onset") + draw(F.col("n_after") - n * F.col("__size") + 1, "chunk-at", *key))
    own = rows.join(room.select(*key, "__size", "__from"), list(key)).where((F.col(seq) >= F.col("__from")) & (F.col(seq) < F.col("__from") + n * F.col("__size")))
    own = own.withColumn("__chunk", F.floor((F.col(seq) - F.col("__from")) / F.col("__size")))
    texts = own.groupBy(*key, "__chunk", "__size").agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), line.alias("l")))).alias("x")).where(F.size("x") == F.col("__size"))
    texts = texts.select(*key, "__chunk", F.array_join(F.transform("x", lambda x: x["l"]), " | ").alias("text"))
    w = Window.partitionBy(*key)  # n rows an item
    texts = texts.withColumn("__all", F.count(F.lit(1)).over(w)).where(F.col("__all") == n).withColumn("letter", F.chr(64 + F.row_number().over(w.orderBy(digest("letter", *key, "__chunk")))))
    out = texts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "letter"))), lambda x: x["letter"]), "").alias("answer"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "text")))).alias("options"))
    return room.drop("__size", "__from").join(out, list(key))


def value_items(rows: DataFrame, items: DataFrame, key: Cols, seq: str, stream: str, t: str, signals: Cols, names: tuple[str, str] = ("baseline", "counterfactual"), steps: tuple[int, int] = (1, 10), factor: float = 0.75) -> DataFrame:
    """items with `steps`, `ahead` (milliseconds from the onset) and, per signal i, v{i} (its value that many rows after the onset, in the second stream), std{i} and margin{i} (over the context, in the first).

    Items whose target row, or a value of it, is missing go. For one signal v0 is the answer; tensor_answer() joins several.
    """
    asked = items.withColumn("steps", draw_between(F.lit(steps[0]), F.lit(steps[1]), "steps", *key)).where("steps < n_after")
    own = rows.join(asked.select(*key, "onset", "start", "length", "steps"), list(key))
    context = (F.col(stream) == names[0]) & (F.col(seq) >= F.col("start")) & (F.col(seq) < F.col("start") + F.col("length"))
    other = F.col(stream) == names[1]
    target, anchor = other & (F.col(seq) == F.col("onset") + F.col("steps")), other & (F.col(seq) == F.col("onset"))
    aggs = [(F.max(F.when(target, F.col(t))) - F.max(F.when(anchor, F.col(t)))).alias("ahead")]
    for i, s in enumerate(signals):
        aggs += [rounded(F.max(F.when(target, F.col(s))), 6).alias(f"v{i}"), F.stddev_pop(F.when(context, F.col(s))).alias(f"__s{i}")]
    out = own.where(context | target | anchor).groupBy(*key).agg(*aggs).where(" AND ".join(f"v{i} IS NOT NULL" for i in range(len(signals))))
    std = [F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i in range(len(signals))]
    # with several signals margins are made of rounded deviations, in whole millionths: their halves would fall either way
    millionths = lambda s: F.round(s * 1_000_000, 0).cast("decimal(20,0)")
    margin = lambda s: F.round(F.lit(str(factor)).cast("decimal(9,6)") * millionths(s), 0).cast("double") / 1_000_000 if len(std) > 1 else rounded(factor * s, 6)
    shown = [x for i, s in enumerate(std) for x in (f"v{i}", rounded(s, 6).alias(f"std{i}"), margin(s).alias(f"margin{i}"))]
    return asked.join(out.select(*key, "ahead", *shown), list(key))


def tensor_answer(n: int) -> Column:
    """[v0,v1,...] of value_items()."""
    return F.concat(F.lit("["), F.concat_ws(",", *[python_number(f"v{i}") for i in range(n)]), F.lit("]"))
