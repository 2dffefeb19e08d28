"""Joins that need more than a key: nearest, interval, ordered rules, resumption, maps of votes, self pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, draw
from tidemark.operators.sequence import both_sides

Cols = Sequence[str]


def nearest(left: DataFrame, right: DataFrame, key: Cols, at: str, values: Cols) -> DataFrame:
    """left with the row of right nearest in `at`, ties to the smaller position: one sorted union, no pairs."""
    both = both_sides(left, right, key, at, values)
    first = F.col("after").isNull() | (F.col(at) - F.col("before.t") <= F.col("after.t") - F.col(at))
    hit = F.when(first, F.col("before")).otherwise(F.col("after"))
    return both.withColumn("__hit", hit).select(*left.columns, F.col("__hit.t").alias(f"{at}_found"), *[F.col(f"__hit.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, key: Cols, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with every span of the key that holds them (low <= at <= high).

    Both sides go by buckets of width, a span once per bucket that it touches, so that an equi-join on key and bucket finds
    all pairs and only those near: a hot key is spread over its buckets. Choose width near the usual span.
    """
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, [*key, "__bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")


def rename_clashes(df: DataFrame, taken: Cols, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c in taken})


def enrich(replies: DataFrame, items: DataFrame, key: Cols, prefer: dict[str, str]) -> DataFrame:
    """replies left-joined to items by key; of a column that both have the preferred side wins, the other fills nulls ("left" or "right")."""
    shared = [c for c in items.columns if c in replies.columns and c not in key]
    joined = replies.join(rename_clashes(items, shared, "__item_"), list(key), "left")
    for c in shared:
        a, b = F.col(c), F.col(f"__item_{c}")
        joined = joined.withColumn(c, F.coalesce(b, a) if prefer.get(c, "left") == "right" else F.coalesce(a, b)).drop(f"__item_{c}")
    return joined


def first_rule(rows: DataFrame, rules: DataFrame, matches: Column, rank: str, keep: Cols, row_key: Cols, most: int = 10_000) -> DataFrame:
    """rows with the columns of the first rule (least rank) for which `matches` holds; rows without one keep nulls.

    rules is a small dimension: its size is checked against most, then it is broadcast, so rows aren't shuffled for the comparison.
    """
    n = rules.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} rules: join on a key instead")
    found = rows.join(F.broadcast(rules), matches).groupBy(*row_key).agg(F.min_by(F.struct(*keep), rank).alias("__hit"))
    return rows.join(found, list(row_key), "left").select(*rows.columns, *[F.col(f"__hit.{k}").alias(k) for k in keep])


def remaining(wanted: DataFrame, done: DataFrame, key: Cols) -> DataFrame:
    """What is not done yet."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def needed(rows: DataFrame, *ids: DataFrame, key: Cols) -> DataFrame:
    """Rows whose key is in any of the id tables."""
    every = ids[0].select(*key)
    for x in ids[1:]:
        every = every.unionByName(x.select(*key))
    return rows.join(every.distinct(), list(key), "left_semi")


def pair_with_baseline(rows: DataFrame, baseline_of: str, own: str) -> DataFrame:
    """(baseline, candidate) of rows that name their baseline, where that baseline exists."""
    base = rows.where(F.col(baseline_of).isNull()).select(F.col(own).alias("baseline"))
    cand = rows.where(F.col(baseline_of).isNotNull()).select(F.col(baseline_of).alias("baseline"), F.col(own).alias("candidate"))
    return cand.join(base, "baseline")


def positional_zip(left: DataFrame, right: DataFrame, key: Cols, left_order: Cols, right_order: Cols) -> DataFrame:
    """The i-th row of left with the i-th of right, per key, as far as both go."""
    number = lambda df, order: df.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*key, "__i"]).drop("__i")


def other_of_group(rows: DataFrame, key: Cols, order: Cols, values: Cols, prefix: str = "other_") -> DataFrame:
    """Each row paired with another one of the key: the next in order, the last with the first; rows alone go. No self-join."""
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*values)
    out = rows.withColumn("__o", F.coalesce(F.lead(row).over(w), F.first(row).over(whole))).withColumn("__n", F.count(F.lit(1)).over(whole))
    return out.where("__n > 1").select(*rows.columns, *[F.col(f"__o.{v}").alias(f"{prefix}{v}") for v in values])


def partner(rows: DataFrame, key: Cols, group: str, by: Cols, values: Cols, prefix: str = "other_", salt: str = "partner") -> DataFrame:
    """Each row with another one of its key, from another group (data set) if there is any, else from its own; rows that are alone go.

    Groups stand in a ring by name and rows in a ring by draw: a row of group g and place r takes the row of place r (round
    the ring) of the next group. One row meets one row, by group and place; the ring of groups has a row per group.
    """
    ring = Window.partitionBy(*key).orderBy(group)
    groups = rows.groupBy(*key, group).agg(F.count(F.lit(1)).alias("__n"))
    onward = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    groups = groups.withColumn("__next", onward(group)).withColumn("__size", onward("__n"))
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key, group).orderBy(digest(salt, *by), *by)) - 1)
    alone = F.col("__next") == F.col(group)
    asks = placed.join(groups, [*key, group]).withColumn("__at", F.when(alone, (F.col("__r") + 1) % F.col("__size")).otherwise(F.col("__r") % F.col("__size"))).where(~(alone & (F.col("__size") == 1)))
    others = placed.select(*key, F.col(group).alias("__next"), F.col("__r").alias("__at"), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    return asks.join(others, [*key, "__next", "__at"]).select(*rows.columns, *[f"{prefix}{v}" for v in values])


def blocks_of(rows: DataFrame, key: Cols, size: int, by: Cols, seed: int = 42) -> DataFrame:
    """Disjoint groups of size rows per key, in an order drawn by a hash; a last short group goes."""
    w = Window.partitionBy(*key).orderBy(digest(f"block-{seed}", *by), *by)
    out = rows.withColumn("block", F.floor((F.row_number().over(w) - 1) / size)).withColumn("label", F.char(65 + (F.row_number().over(w) - 1) % size))
    return out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key, "block"))).where(F.col("__n") == size).drop("__n")


def merge_votes(old: DataFrame, new: DataFrame, key: Cols, votes: str) -> DataFrame:
    """Full outer join of two vote maps; a new vote replaces one of the same judge."""
    a, b = old.select(*key, F.col(votes).alias("__a")), new.select(*key, F.col(votes).alias("__b"))
    empty = lambda c: F.coalesce(F.col(c), F.map_from_arrays(F.array(), F.array()).cast(old.schema[votes].dataType))
    kept = F.map_filter(empty("__a"), lambda k, v: ~F.array_contains(F.map_keys(empty("__b")), k))
    return a.join(b, list(key), "full_outer").select(*key, F.map_concat(kept, empty("__b")).alias(votes))


def reply_of(turns: DataFrame, key: Cols, order: Cols, role: str, text: str, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """Each answer with the question that stands right before it."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = turns.withColumn("__r", F.lag(role).over(w)).withColumn("question", F.lag(text).over(w))
    return rows.where((F.col(role) == answers) & (F.col("__r") == asks)).drop("__r")


def selected_variants(episodes: DataFrame, own: str, selected: str, is_variant: str) -> DataFrame:
    """(baseline, variant) of baselines that name a chosen variant; a variant is not asked for its own choice, and one that is missing makes no pair."""
    base = episodes.where((F.coalesce(F.col(is_variant), F.lit(0)) < 1) & F.col(selected).isNotNull() & (F.col(selected).cast("string") != ""))
    pairs = base.select(F.col(own).alias("baseline"), F.col(selected).alias("variant"))
    return pairs.join(episodes.select(F.col(own).alias("variant")).distinct(), "variant").select("baseline", "variant")


def with_fallback_rule(rows: DataFrame, dim: DataFrame, key: str, value: str, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """rows with a dimension's value by key, else by the first name rule (condition, value) that holds, else null."""
    joined = rows.join(dim.select(key, F.col(value).alias("__v")), key, "left")
    rule = F.lit(None).cast(dim.schema[value].dataType)
    for condition, v in reversed(rules):
        rule = F.when(condition, v).otherwise(rule)
    return joined.withColumn(value, F.coalesce("__v", rule)).drop("__v")


def or_any(rows: DataFrame, dim: DataFrame, key: str, columns: Cols, by: Cols, most: int = 1000) -> DataFrame:
    """rows with the columns of the dimension's row of the same key, else of one drawn by the columns `by`. The dimension's size is checked."""
    n = dim.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} rows")
    listed = dim.agg(F.array_sort(F.collect_list(F.struct(key, *columns))).alias("__all"))  # at most `most` small rows
    joined = rows.join(dim.select(key, F.struct(*columns).alias("__hit")), key, "left").crossJoin(F.broadcast(listed))
    pick = F.get("__all", draw(F.size("__all"), "any", *by).cast("int"))
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__hit.{c}"), pick[c]).alias(c) for c in columns])


def judge_items(replies: DataFrame, questions: DataFrame, key: Cols, judges: Sequence[str], templates: Sequence[int] = (1, 2), rescore: bool = False) -> DataFrame:
    """Free-text replies of judged templates that some judge has not voted on validly yet, with their question.

    replies: key, answer_format, answer, votes (map of judge to score); questions: key, template_id, question, reference.
    """
    wanted = replies.where("answer_format = 'free_form'").join(questions.where(F.col("template_id").isin(*templates)), list(key))
    votes = F.coalesce(F.col("votes"), F.create_map().cast(replies.schema["votes"].dataType))
    open_ = F.exists(F.array(*map(F.lit, judges)), lambda j: F.try_element_at(votes, j).isNull()) if judges else F.size(votes) == 0
    return wanted if rescore else wanted.where(open_)
