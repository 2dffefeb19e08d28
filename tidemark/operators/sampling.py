"""Ranking, sampling, splitting and peak-preserving downsampling. Draws are by hash, so reruns and retries repeat them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, shuffled
from tidemark.functions.scoring import hash_split, split_name

Cols = Sequence[str]


def stratified(df: DataFrame, strata: Cols, by: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each stratum, those of least hash of seed and id. Spark keeps k rows per stratum before it shuffles."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")), 256), by)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def top_k(df: DataFrame, key: Cols, by: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page(df: DataFrame, order: Cols, offset: int, n: int) -> DataFrame:
    """Rows offset to offset + n of the sorted table: a top-k per task, not a total sort."""
    return df.orderBy(*order).offset(offset).limit(n)


def limit_groups(df: DataFrame, key: Cols, first_seen: str, n: int) -> DataFrame:
    """Rows of the n keys seen first."""
    seen = df.groupBy(*key).agg(F.min(first_seen).alias("__first")).orderBy("__first", *key).limit(n)
    return df.join(seen.drop("__first"), list(key), "left_semi")


def with_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("split", split_name(hash_split(F.col(key).cast("string"), seed)))


def hermetic(items: DataFrame, item: str, episodes: str, seed: int = 42) -> DataFrame:
    """item and split of those items all of whose episodes fall in one split; without episodes an item goes."""
    each = items.select(item, F.explode(episodes).alias("__e"))
    each = with_split(each, "__e", seed)
    agg = each.groupBy(item).agg(F.min("split").alias("split"), F.max("split").alias("__other"))
    return agg.where(F.col("split") == F.col("__other")).drop("__other")


def downsample(df: DataFrame, key: Cols, seq: str, score: str, features: Cols, budget: int, anchors: Column | None = None, seed: int = 42) -> DataFrame:
    """At most about budget rows of each episode, in place: its ends, anchors, extremes of each feature, half the budget by score, the rest by hash.

    Episodes within the budget stay whole. One shuffle by key serves all windows.
    """
    whole = Window.partitionBy(*key)
    rows = df.withColumn("__n", F.count(F.lit(1)).over(whole))
    must = (F.col(seq) == F.min(seq).over(whole)) | (F.col(seq) == F.max(seq).over(whole))
    for f in features:
        must |= (F.col(seq) == F.min_by(seq, F.struct(F.col(f), F.col(seq))).over(whole)) | (F.col(seq) == F.max_by(seq, F.struct(F.col(f), -F.col(seq))).over(whole))
    if anchors is not None:
        must |= F.coalesce(anchors, F.lit(False))
    rows = rows.withColumn("__must", must)
    rows = rows.withColumn("__top", F.row_number().over(whole.orderBy(F.desc(score), seq)) <= budget // 2)
    rows = rows.withColumn("__in", F.col("__must") | F.col("__top")).withColumn("__taken", F.sum(F.col("__in").cast("int")).over(whole))
    draw = F.row_number().over(Window.partitionBy(*key, "__in").orderBy(digest(f"fill-{seed}", *key, seq), seq))
    rows = rows.withColumn("__draw", draw)
    keep = (F.col("__n") <= budget) | F.col("__in") | (F.col("__draw") <= budget - F.col("__taken"))
    return rows.where(keep).drop("__n", "__must", "__top", "__in", "__taken", "__draw")


def rank_letters(df: DataFrame, key: Cols, label: str, metric: str, descending: bool = False) -> DataFrame:
    """Labels of each group in the order of the metric, joined to one string; ties by label. Groups are small by design (blocks of options)."""
    m = -F.col(metric) if descending else F.col(metric)
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(m.alias("m"), F.col(label).alias("l")))).alias("x"))
    return rows.select(*key, F.array_join(F.transform("x", lambda s: s["l"]), "").alias("answer"))


def severity(explicit: Column, levels: Column, scale: Sequence[str] = ("none", "low", "medium", "high", "critical")) -> Column:
    """An explicit rank, or else the highest of the levels on the scale."""
    table = F.create_map(*[x for i, s in enumerate(scale) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(explicit, F.array_max(F.transform(levels, lambda v: F.element_at(table, F.lower(v)))), F.lit(0))


def shuffled_options(correct: Column, pool: Column, by: Column, n: int = 3, seed: int = 42) -> Column:
    """Map A.. -> option: the correct one and n of the pool, both drawn by hash."""
    others = F.slice(shuffled(F.array_except(pool, F.array(correct)), f"pool-{seed}", by), 1, n)
    every = shuffled(F.concat(F.array(correct), others), f"order-{seed}", by)
    return F.map_from_arrays(F.slice(F.array(*[F.lit(chr(65 + i)) for i in range(n + 1)]), F.lit(1), F.size(every)), every)


def latest(df: DataFrame, key: Cols, ts: str, tie: Cols = ()) -> DataFrame:
    """The last row written for each key: hash aggregation of one struct, no sort."""
    best = df.groupBy(*key).agg(F.max(F.struct(ts, *tie, F.struct(*[c for c in df.columns if c not in key]).alias("__row"))).alias("__b"))
    return best.select(*key, "__b.__row.*")
