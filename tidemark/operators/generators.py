"""Question items made of windows of episodes: what is asked, the options, the answer and the bounds of acceptance.

Each generator is a plan of the verbs beside it (windows, runs, draws, statements) and gives one row per item; contexts are
joined to the items that are kept, so rows of episodes are shuffled once by episode. Draws are digests of ids: reruns repeat
them, and no seeded state is shared between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.draws import digest, draw, shuffled
from tidemark.functions.values import Name, col, rounded
from tidemark.operators.counterfactual import value_items
from tidemark.operators.predicates import comparative
from tidemark.operators.relevance import context_rows
from tidemark.operators.sequence import chunks, inner_runs, runs

Cols = Sequence[str]


def phase_isolation(rows: DataFrame, windows: DataFrame, key: Cols, seq: str, t: str, phase: str, near: int = 3, least: int = 3, phases: int = 1) -> DataFrame:
    """When does the phase begin? Up to `phases` drawn phases per window: answer is the time of the first row, bounds those of `near` rows to each side inside the window.

    A phase must end within the window (first and last run go, if there are three or more) and hold `least` rows. Several
    phases of a window are several items; of runs of one phase only one is asked for.
    """
    inside = context_rows(rows, windows, key, seq)
    found = inner_runs(runs(inside.select(*key, "at", phase), key, ["at"], phase), key, least)
    one = found.groupBy(*key, phase).agg(F.min(F.struct(digest("phase", *key, "start").alias("d"), F.col("start"), F.col("n"), F.col(phase))).alias("p"))
    picked = one.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list("p")), 1, phases).alias("__p")).select(*key, F.explode("__p").alias("p"))
    items = inside.join(picked, list(key)).where(F.col("at").between(F.col("p.start") - near, F.col("p.start") + near))
    return items.groupBy(*key, F.col(f"p.{phase}").alias(phase), F.col("p.n").alias("phase_length")).agg(F.max(F.when(F.col("at") == F.col("p.start"), F.col(t))).alias("answer"), F.min(t).alias("low"), F.max(t).alias("high"))


def single_select(items: DataFrame, by: Cols, correct: str, options: Name, salt: str = "options") -> DataFrame:
    """items with options (letter -> text) in drawn order and the letter of the correct one; where that is not offered the item goes."""
    out = items.withColumn("__o", shuffled(col(options), salt, *by)).withColumn("__at", F.array_position("__o", F.col(correct))).where("__at > 0")
    letters = F.transform(F.col("__o"), lambda x, i: F.chr(65 + i))
    return out.withColumn("answer", F.chr(F.col("__at") + 64)).withColumn("options", F.map_from_arrays(letters, F.col("__o"))).drop("__o", "__at")


def distractors(correct: Name, pool: Column, by: Cols, n: int = 3, salt: str = "distractor") -> Column:
    """The correct text and n drawn others."""
    c = col(correct)
    return F.concat(F.array(c), F.slice(shuffled(F.array_remove(pool, c), salt, *by), 1, n))


def comparison(pairs: DataFrame, robot: Sequence[str], fault: Sequence[str], task: Sequence[str], phase: Sequence[str]) -> DataFrame:
    """Pairs of windows with the four comparative statements as T and F; pairs that differ in nothing go."""
    c = lambda p: (F.col(p[0]), F.col(p[1]))
    return pairs.withColumn("answer", comparative(c(robot), c(fault), c(task), c(phase))).where("answer IS NOT NULL")


def scalar_prediction(rows: DataFrame, windows: DataFrame, key: Cols, seq: str, t: str, signal: str, steps: Name, factor: float = 0.75) -> DataFrame:
    """What is the signal `steps` rows after the window? Answer, milliseconds ahead, and a margin of factor standard deviations inside the window.

    One pass over the episode's rows: window and target are told apart by their place. Windows without the target row go.
    """
    steps = F.lit(steps) if isinstance(steps, int) else col(steps)
    own = rows.join(windows.withColumn("__steps", steps).select(*key, "start", "length", "__steps"), list(key))
    at, end = F.col(seq) - F.col("start"), F.col("length")
    inside = (at >= 0) & (at < end)
    target = at == end + F.col("__steps") - 1
    out = own.where(inside | target).groupBy(*key).agg(
        rounded(F.max(F.when(target, F.col(signal))), 4).alias("answer"),
        (F.max(F.when(target, F.col(t))) - F.max(F.when(inside, F.col(t)))).alias("ahead"),
        rounded(factor * F.stddev_pop(F.when(inside, F.col(signal))), 6).alias("margin"),
    )
    return out.where("answer IS NOT NULL")


def tensor_prediction(rows: DataFrame, windows: DataFrame, key: Cols, seq: str, signals: Cols, steps: int, factor: float = 0.75) -> DataFrame:
    """As scalar_prediction for the joints of one signal at once: answer "[v0,v1,...]" and a list of margins; all joints must be there."""
    own = rows.join(windows.select(*key, "start", "length"), list(key))
    at = F.col(seq) - F.col("start")
    inside, target = (at >= 0) & (at < F.col("length")), at == F.col("length") + steps - 1
    aggs = [x for i, s in enumerate(signals) for x in (F.round(F.max(F.when(target, F.col(s))), 6).alias(f"v{i}"), rounded(factor * F.stddev_pop(F.when(inside, F.col(s))), 6).alias(f"m{i}"))]
    out = own.where(inside | target).groupBy(*key).agg(*aggs).where(" AND ".join(f"v{i} IS NOT NULL" for i in range(len(signals))))
    n = range(len(signals))
    return out.select(*key, F.concat(F.lit("["), F.concat_ws(",", *[F.format_string("%.6f", f"v{i}") for i in n]), F.lit("]")).alias("answer"), F.array(*[f"m{i}" for i in n]).alias("margins"))


def event_values(rows: DataFrame, windows: DataFrame, key: Cols, seq: str, t: str, signals: Cols, steps: tuple[int, int] = (1, 10), factor: float = 0.75) -> DataFrame:
    """What are the signals some rows after the event that ends the window? As counterfactual.value_items(), of one stream: a drawn number of rows after the event's row, milliseconds counted from it, six decimals.

    windows: key, onset, start, length (the window ends right before the onset) and n_after, the rows from the onset on.
    """
    return value_items(rows.withColumn("__stream", F.lit("own")), windows, key, seq, "__stream", t, signals, ("own", "own"), steps, factor)


def segment_ranking(rows: DataFrame, onsets: DataFrame, key: Cols, seq: str, value: str, size: int = 5, n: int = 4) -> DataFrame:
    """In which order did the segments come? n back-to-back chunks after each onset under drawn letters: options (letter -> text) and the order as letters.

    onsets: key and onset. Episodes without n whole chunks after it go. A chunk's text is bounded by its size.
    """
    after = rows.join(onsets.select(*key, "onset"), list(key)).where(F.col(seq) >= F.col("onset")).withColumn("__at", F.col(seq) - F.col("onset"))
    cut = chunks(after, key, "__at", size, most=n)
    lines = cut.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(value).cast("string").alias("x")))).alias("x"))
    lines = lines.select(*key, "chunk", F.array_join(F.transform("x", lambda s: s["x"]), " | ").alias("text"))
    w = Window.partitionBy(*key)
    lettered = lines.withColumn("letter", F.chr(64 + F.row_number().over(w.orderBy(digest("segment", *key, "chunk"), "chunk")))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") == n)
    out = lettered.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "letter", "text"))).alias("x"))
    return out.select(*key, F.array_join(F.transform("x", lambda s: s["letter"]), "").alias("answer"), F.map_from_arrays(F.transform("x", lambda s: s["letter"]), F.transform("x", lambda s: s["text"])).alias("options"))


def ranking_items(blocks: DataFrame, key: Cols, label: str, metric: str, descending: bool = False) -> DataFrame:
    """Letters of a block's episodes in the order of a metric (severity, duration, energy); blocks where two tie go."""
    w = Window.partitionBy(*key)
    distinct = blocks.withColumn("__n", F.size(F.collect_set(metric).over(w))).withColumn("__all", F.count(F.lit(1)).over(w)).where("__n = __all")
    m = -F.col(metric) if descending else F.col(metric)
    out = distinct.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(m.alias("m"), F.col(label).alias("l")))).alias("x"))
    return out.select(*key, F.array_join(F.transform("x", lambda s: s["l"]), "").alias("answer"))


def cause_items(episodes: DataFrame, causes: DataFrame, fault: str, cause: str, text: str) -> DataFrame:
    """Troubleshooting: each episode with its fault's cause, and the remedy as answer; episodes without one go."""
    return episodes.join(causes.select(F.col(fault), F.col(cause).alias("root_cause"), F.col(text).alias("answer")), fault)


def correction_items(episodes: DataFrame, fault: str, faults: Sequence[int], pairs: Sequence[tuple[str, str, str]], key: Cols) -> DataFrame:
    """Optimisation: of the faults given, the settings that differ from the right ones, as one sentence per episode.

    pairs: (name, configured column, correct column). Episodes without a difference go.
    """
    said = [F.when(~F.col(a).eqNullSafe(F.col(b)) & F.col(b).isNotNull(), F.concat(F.lit(f"set {name} from "), F.coalesce(F.col(a).cast("string"), F.lit("unset")), F.lit(" to "), F.col(b).cast("string"))) for name, a, b in pairs]
    return episodes.where(F.col(fault).isin(*faults)).select(*key, fault, F.concat_ws("; ", *said).alias("answer")).where("answer <> ''")


def combinations(templates: DataFrame, episodes: DataFrame, done: DataFrame, key: Cols, most: int = 1000) -> DataFrame:
    """Each template with each episode, less the combinations done; templates are a catalogue whose size is checked."""
    if templates.limit(most + 1).count() > most:
        raise ValueError(f"over {most} templates")
    every = episodes.crossJoin(F.broadcast(templates))  # a row per item wanted
    return every.join(done.select(*key).distinct(), list(key), "left_anti")


def inject(rows: DataFrame, spans: DataFrame, key: Cols, seq: str, signal: str, sign: int = 1) -> DataFrame:
    """rows with a spike (or, by sign, a dip) of spans' delta on the signal while one is active; spans: key, first, last, delta, few per episode and not overlapping.

    The span that may be active is the last one begun, found in one sorted pass of spans and rows together.
    """
    s = spans.select(*key, F.col("first").alias(seq), F.struct("last", "delta").alias("__s"))
    both = rows.withColumn("__s", F.lit(None).cast(s.schema["__s"].dataType)).withColumn("__row", F.lit(1)).unionByName(s.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(seq, "__row").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__a", F.last("__s", ignorenulls=True).over(w)).where("__row = 1")
    active = F.coalesce(F.col("__a.last") >= F.col(seq), F.lit(False))
    return out.withColumn(signal, F.when(active, F.col(signal) + sign * F.col("__a.delta")).otherwise(F.col(signal))).withColumn("injected", active).select(*rows.columns, "injected")


def event_spans(episodes: DataFrame, key: Cols, n: str, ids: Sequence[int], share: float, least: int, most: int, grid: int | None = None) -> DataFrame:
    """Runs of drawn events: key, first, last, event. The episode is cut into cells of `grid` rows (twice the longest run); in a drawn share of them one run of least to most rows stands at a drawn place.

    So runs never touch, any cell can be made alone, and a retried task repeats it. (A chain of draws per row would need the whole episode in one task.)
    """
    grid = grid or 2 * most
    cells = episodes.select(*key, n, F.explode(F.sequence(F.lit(0), F.floor(F.col(n) / grid))).alias("cell"))
    cells = cells.where(draw(1_000_000, "on", *key, "cell") < int(share * 1_000_000)).withColumn("__d", F.lit(least) + draw(most - least + 1, "duration", *key, "cell"))
    cells = cells.withColumn("first", F.col("cell") * grid + draw(F.lit(grid) - F.col("__d"), "place", *key, "cell")).withColumn("last", F.col("first") + F.col("__d") - 1)
    event = F.get(F.array(*map(F.lit, ids)), draw(len(ids), "event", *key, "cell").cast("int"))
    return cells.where(F.col("last") < F.col(n)).select(*key, "first", "last", event.alias("event"))


def event_chain(episodes: DataFrame, key: Cols, n: str, ids: Sequence[int], share: float, least: int, most: int, block: int = 4096) -> DataFrame:
    """Runs of drawn events as a chain along each episode leaves them: key, first, last, event.

    Row by row, an idle row starts a run with probability `share` if at least `least` rows remain, of least to most rows but
    not past the end; a row inside a run starts none. Rows are drawn by digests of episode and row, so the chain can be cut:
    each block of rows is a map from the rows its first run still holds on entry to those held on exit (both under `most`);
    the maps of an episode are composed in order, and each block is then run once more from its true entry. The result
    doesn't depend on the block's size, and no task sees more of an episode than a block's rows or one number per block.
    """
    i, blocks = F.col("__from"), episodes.where(F.col(n) >= least).select(*key, F.col(n).alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / block))).alias("__block"))
    blocks = blocks.withColumn("__from", F.col("__block") * block).withColumn("__to", F.least(F.col("__n"), i + block))

    def candidate(at: Column) -> Column:
        longest = F.least(F.lit(most), F.col("__n") - at)
        on = (longest >= least) & (draw(1_000_000, "start", *key, at) < int(share * 1_000_000))
        return F.when(on, F.struct(at.alias("i"), (F.lit(least) + draw(longest - least + 1, "run", *key, at)).alias("n"), draw(len(ids), "which", *key, at).cast("int").alias("e")))

    blocks = blocks.withColumn("__c", F.array_compact(F.transform(F.sequence(i, F.col("__to") - 1), candidate)))
    leave = lambda held: F.aggregate("__c", i + held, lambda free, c: F.when(c["i"] >= free, c["i"] + c["n"]).otherwise(free))
    maps = blocks.select(*key, "__block", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda h: F.greatest(F.lit(0), leave(h) - F.col("__to")).cast("int")).alias("__exits"))

    def entries(group: pa.Table) -> pa.Table:
        at, exits = group.column("__block").to_numpy(), group.column("__exits").combine_chunks()
        table = exits.flatten().to_numpy(zero_copy_only=False).reshape(len(at), most)
        held, now = np.zeros(len(at), dtype=np.int32), 0
        for j in np.argsort(at):
            held[j], now = now, table[j, now]
        return group.drop_columns(["__exits"]).append_column("__held", pa.array(held))

    shape = StructType([*[maps.schema[k] for k in key], maps.schema["__block"], StructField("__held", IntegerType())])
    entered = maps.groupBy(*key).applyInArrow(entries, shape)
    state = F.struct((i + F.col("__held")).cast("long").alias("free"), F.array().cast("array<struct<first:bigint,last:bigint,e:int>>").alias("runs"))

    def step(s: Column, c: Column) -> Column:
        run = F.array(F.struct(c["i"].cast("long").alias("first"), (c["i"] + c["n"] - 1).cast("long").alias("last"), c["e"].alias("e")))
        return F.when(c["i"] >= s["free"], F.struct((c["i"] + c["n"]).cast("long").alias("free"), F.concat(s["runs"], run).alias("runs"))).otherwise(s)

    found = blocks.join(entered, [*key, "__block"]).select(*key, F.explode(F.aggregate("__c", state, step, lambda s: s["runs"])).alias("r"))
    return found.select(*key, "r.first", "r.last", F.get(F.array(*map(F.lit, ids)), F.col("r.e")).alias("event"))


def signal_bits(rows: DataFrame, key: Cols, seq: str, signals: Sequence[str]) -> DataFrame:
    """key and bits: bit i is set if the episode's first row has a number for signal i; up to 63 signals, one aggregation for all."""
    if len(signals) > 63:
        raise ValueError("63 signals at most in one word")
    word = F.lit(0).cast("long")
    for i, s in enumerate(signals):
        word = word.bitwiseOR(F.when(F.col(s).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.groupBy(*key).agg(F.min_by(word, seq).alias("bits"))


def pick_signal(bits: Name, signals: Sequence[str], wanted: Name | None, by: Cols, salt: str = "signal") -> Column:
    """A drawn signal of those an episode has and a template wants (an array of names; null: all, by name); null if there is none."""
    known = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(1 << i).cast("long").alias("b")) for i, s in sorted(enumerate(signals), key=lambda x: x[1])])
    have = F.transform(F.filter(known, lambda k: col(bits).bitwiseAND(k["b"]) != 0), lambda k: k["s"])
    fit = have if wanted is None else F.when(col(wanted).isNull(), have).otherwise(F.filter(col(wanted), lambda w: F.array_contains(have, w)))
    return F.get(fit, draw(F.size(fit), salt, *by).cast("int"))


def feature_key(features: Name, by: Cols, hidden: Sequence[str] = ("timestamp_ms", "fault_label", "event")) -> Column:
    """A drawn feature of a map that has a number and is no bookkeeping; feature_0 if there is none."""
    names = F.array_sort(F.map_keys(F.map_filter(col(features), lambda k, v: v.isNotNull() & ~k.isin(*hidden))))
    return F.coalesce(F.get(names, draw(F.size(names), "feature", *by).cast("int")), F.lit("feature_0"))


def event_labels(rows: DataFrame, key: Cols, seq: str, event: str, t: str, signal: str, payload: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 2.5)) -> DataFrame:
    """Each run of an event with its label "id_X_Y_delta_rate_L_T": value before the run, at its end, their difference, per row, length, start time; and a payload by id and length.

    Runs go by the parsed id, so neighbouring tokens of one id are one run. id 0 and null make none.
    """
    w = Window.partitionBy(*key).orderBy(seq)
    own = rows.withColumn("__before", F.lag(signal).over(w)).withColumn("__e", F.nullif(F.coalesce(F.col(event), F.lit(0)), F.lit(0)))
    own = own.withColumn("__i", F.row_number().over(w) - 1)
    found = own.withColumn("__new", (~F.col("__e").eqNullSafe(F.lag("__e").over(w)) | (F.col("__i") == 0)).cast("long")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = found.where("__e IS NOT NULL").groupBy(*key, "run").agg(
        F.first("__e").alias("event"), F.min(seq).alias("first"), F.count(F.lit(1)).alias("n"), F.min(t).alias("onset_time"),
        F.coalesce(F.min_by("__before", seq), F.min_by(signal, seq)).alias("x"), F.max_by(signal, seq).alias("y"),
    )
    out = out.withColumn("delta", F.abs(F.col("y") - F.col("x"))).withColumn("rate", (F.col("y") - F.col("x")) / F.greatest(F.lit(1), F.col("n")))
    out = out.withColumn("payload", F.get(F.array(*map(F.lit, payload)), ((F.col("event") + F.col("n")) % len(payload)).cast("int")))
    parts = ["event", trimmed("x"), trimmed("y"), trimmed("delta"), trimmed("rate"), "n", "onset_time"]
    return out.withColumn("label", F.concat_ws("_", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts])).drop("run")


def trimmed(x: Name) -> Column:
    """Six decimals without trailing zeros: 3.0 -> 3, 0.25 -> 0.25."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(x).cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)
