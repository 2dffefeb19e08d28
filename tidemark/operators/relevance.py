"""Context windows that show what they should: uniform, around an event, cumulative, within a phase; by a table of specs.

An episode is a row with its number of rows; windows are drawn by digests of seed and episode, so a rerun repeats them.
Only aggregates per episode are shuffled, never rows of windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, draw_between
from tidemark.functions.values import Name, col
from tidemark.operators.sequence import runs

Cols = Sequence[str]


def phase_ids(by_task: Name, task: Name) -> Column:
    """The list of the task; without it, the only list there is; else none."""
    m = col(by_task)
    alone = F.when(F.size(m) == 1, F.element_at(F.map_values(m), 1))
    return F.coalesce(F.try_element_at(m, col(task)), alone, F.array().cast("array<int>"))


def with_defaults(specs: Column, defaults: Column) -> Column:
    """A spec map on top of its locality's defaults: the spec wins."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(specs, k)), specs)


def uniform_windows(episodes: DataFrame, key: Cols, n: str, least: int, most: int, salt: str = "uniform") -> DataFrame:
    """key, start, length: any window of least to most rows; shorter episodes have none."""
    out = episodes.where(F.col(n) >= least).select(*key, n, draw_between(F.lit(least), F.least(F.lit(most), F.col(n)), f"{salt}-n", *key).alias("length"))
    return out.select(*key, draw_between(F.lit(0), F.col(n) - F.col("length"), f"{salt}-at", *key).alias("start"), "length")


def event_windows(episodes: DataFrame, key: Cols, n: str, anchor: str, least: Name, most: int) -> DataFrame:
    """Windows that hold the anchor, a row with a real event; the least length is each episode's own."""
    required = col(least)
    own = episodes.where((F.col(n) >= required) & F.col(anchor).isNotNull()).withColumn("length", draw_between(required, F.least(F.lit(most), F.col(n)), "event-n", *key))
    low, high = F.greatest(F.lit(0), F.col(anchor) - F.col("length") + 1), F.least(F.col(n) - F.col("length"), F.col(anchor))
    return own.select(*key, draw_between(low, high, "event-at", *key).alias("start"), "length")


def cumulative_windows(episodes: DataFrame, key: Cols, n: str, floor: str, least: Name, most: int) -> DataFrame:
    """Windows that start no earlier than the floor; an episode too short after it, or without it, starts anywhere."""
    required = col(least)
    first = F.coalesce(F.col(floor), F.lit(0))
    own = episodes.where(F.col(n) >= required).withColumn("__floor", F.when(F.col(n) - first >= required, first).otherwise(F.lit(0)))
    own = own.withColumn("length", draw_between(required, F.least(F.lit(most), F.col(n) - F.col("__floor")), "cumulative-n", *key))
    return own.select(*key, draw_between(F.col("__floor"), F.col(n) - F.col("length"), "cumulative-at", *key).alias("start"), "length")


def phase_windows(rows: DataFrame, episodes: DataFrame, key: Cols, n: str, seq: str, phase: str, wanted: Column, overlap: Name, least: int, most: int) -> DataFrame:
    """Windows that share min(run, overlap) rows with a run of a wanted phase; the run is drawn among those where the drawn length fits. overlap: a column of episodes."""
    own = runs(rows.withColumn("__in", wanted), key, [seq], "__in").where("__in").select(*key, F.col("start").alias("run_start"), F.col("n").alias("run_n"))
    own = own.join(episodes.where(F.col(n) >= least), list(key))
    own = own.withColumn("length", draw_between(F.lit(least), F.least(F.lit(most), F.col(n)), "phase-n", *key, "run_start"))
    shared = F.least(F.col("run_n"), col(overlap))
    low = F.greatest(F.lit(0), F.col("run_start") + shared - F.col("length"))
    high = F.least(F.col(n) - F.col("length"), F.col("run_start") + F.col("run_n") - shared)
    own = own.withColumn("start", draw_between(low, high, "phase-at", *key, "run_start")).where("start IS NOT NULL")
    best = own.groupBy(*key).agg(F.min(F.struct(digest("run", *key, "run_start").alias("d"), "start", "length")).alias("b"))
    return best.select(*key, "b.start", "b.length")


def sample_windows(rows: DataFrame, key: Cols, seq: str, event: str, phase: str, spec: DataFrame, least: int, most: int, fallback: bool = True, idle: Sequence[int] = (0, 1)) -> DataFrame:
    """One window per episode by its locality, with the sampler's name.

    spec: key, locality (global, event, cumulative, phase_gated; others and null count as global), min_length, min_overlap
    (null: 5), start_phases and phases (arrays). A spec's least length raises the caller's, as far as the caller's most
    allows; windows by events and cumulative ones have it. With fallback an episode whose locality can't be honoured gets a
    uniform window. One aggregation finds every episode's rows, anchor and floor; only rows of gated episodes are put in order.
    """
    locality = F.when(F.col("locality").isin("event", "cumulative", "phase_gated"), F.col("locality")).otherwise("global")
    specs = spec.withColumn("locality", locality).withColumn("__least", F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce("min_length", F.lit(0))))).withColumn("__overlap", F.coalesce("min_overlap", F.lit(5)))
    own = rows.join(specs.select(*key, "locality", "start_phases", "phases"), list(key), "left")
    has = lambda c: F.array_contains(F.coalesce(c, F.array().cast("array<int>")), F.col(phase).cast("int"))
    real = (F.col("locality") == "event") & F.col(event).isNotNull() & ~F.col(event).isin(*idle)
    episodes = own.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.when(real, F.struct(digest("anchor", *key, seq).alias("d"), F.col(seq).alias("at"))))["at"].alias("anchor"),
        F.min(F.when((F.col("locality") == "cumulative") & has("start_phases"), F.col(seq))).alias("floor"),
    ).join(specs.select(*key, "locality", "__least", "__overlap"), list(key), "left").withColumn("locality", F.coalesce("locality", F.lit("global")))
    of = lambda kind: episodes.where(F.col("locality") == kind)
    found = [
        event_windows(of("event"), key, "n_rows", "anchor", "__least", most).withColumn("sampler", F.lit("event")),
        cumulative_windows(of("cumulative"), key, "n_rows", "floor", "__least", most).withColumn("sampler", F.lit("cumulative")),
        phase_windows(own.where("locality = 'phase_gated'"), of("phase_gated"), key, "n_rows", seq, phase, F.coalesce(has("phases"), F.lit(False)), "__overlap", least, most).withColumn("sampler", F.lit("phase_gated")),
    ]
    strict = reduce(DataFrame.unionByName, found)
    anywhere = uniform_windows(episodes, key, "n_rows", least, most)
    both = anywhere.join(strict.select(*key, F.col("start").alias("s"), F.col("length").alias("l"), "sampler"), list(key), "left").join(episodes.select(*key, "locality"), list(key))
    name = F.when(F.col("locality") == "global", "uniform").otherwise("uniform_fallback")
    out = both.select(*key, "locality", F.coalesce("s", "start").alias("start"), F.coalesce("l", "length").alias("length"), F.coalesce("sampler", name).alias("sampler"))
    return out if fallback else out.where("sampler <> 'uniform_fallback'")


def relevance_report(windows: DataFrame, rows: DataFrame, key: Cols, seq: str, phase: str, spec: DataFrame) -> DataFrame:
    """windows with phase_overlap (rows of the wanted phases inside) and validated: long enough for event and cumulative, overlap enough for phase_gated."""
    inside = rows.join(windows.select(*key, "start", "length"), list(key)).where((F.col(seq) >= F.col("start")) & (F.col(seq) < F.col("start") + F.col("length")))
    inside = inside.join(spec.select(*key, "phases"), list(key), "left")
    hit = F.coalesce(F.array_contains("phases", F.col(phase).cast("int")), F.lit(False))
    counts = inside.groupBy(*key).agg(F.count_if(hit).alias("phase_overlap"))
    out = windows.join(counts, list(key), "left").join(spec.select(*key, "min_length", "min_overlap"), list(key), "left")
    enough = F.col("length") >= F.coalesce("min_length", F.lit(0))
    valid = F.when(F.col("locality").isin("event", "cumulative"), enough).when(F.col("locality") == "phase_gated", F.coalesce("phase_overlap", F.lit(0)) >= F.coalesce("min_overlap", F.lit(5))).otherwise(F.lit(True))
    return out.select(*windows.columns, F.coalesce("phase_overlap", F.lit(0)).alias("phase_overlap"), valid.alias("validated"))


def context_rows(rows: DataFrame, windows: DataFrame, key: Cols, seq: str) -> DataFrame:
    """The rows of each window, with `at`, their place in it."""
    both = rows.join(windows.select(*key, "start", "length"), list(key))
    return both.where((F.col(seq) >= F.col("start")) & (F.col(seq) < F.col("start") + F.col("length"))).withColumn("at", F.col(seq) - F.col("start"))


def not_overlapping(candidates: DataFrame, key: Cols, start: str, length: int, k: int) -> DataFrame:
    """k drawn windows of one length per key, none overlapping: the grid of that length is shifted by a drawn offset, then cells are drawn."""
    cell = F.floor((F.col(start) - draw_between(F.lit(0), F.lit(length - 1), "offset", *key)) / length)
    once = candidates.where(F.pmod(F.col(start) - draw_between(F.lit(0), F.lit(length - 1), "offset", *key), F.lit(length)) == 0).withColumn("cell", cell)
    w = Window.partitionBy(*key).orderBy(digest("cell", *key, "cell"), "cell")
    return once.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
