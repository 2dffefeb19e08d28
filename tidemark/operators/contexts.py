"""Contexts of items: drawn windows before an event, what follows a window, several streams side by side, segments to rank.

Texts are made of windows and chunks, which are as long as a prompt allows; rows of whole episodes are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, draw_between
from tidemark.functions.values import Name, col
from tidemark.operators.relevance import context_rows
from tidemark.operators.sequence import windows_before_event

Cols = Sequence[str]

#: Fixed value: the answer where nothing is wrong.
NOTHING_WRONG = "No anomalous behavior detected in the sensor stream. The machine is operating normally; no remediation is required."


def drawn_before_event(rows: DataFrame, key: Cols, seq: str, event: str, least: int, most: int, after: int) -> DataFrame:
    """key, onset, start, length: one drawn window per episode that ends right before a drawn onset, of least to most rows, as many as there are before it."""
    hits = windows_before_event(rows, key, seq, event, least, most, after)
    one = hits.groupBy(*key).agg(F.min_by(F.struct("onset", "n"), digest("onset", *key, "onset")).alias("w")).select(*key, "w.onset", draw_between(F.lit(least), F.col("w.n"), "before-n", *key).alias("length"))
    return one.select(*key, "onset", (F.col("onset") - F.col("length")).alias("start"), "length")


def remaining_rows(rows: DataFrame, windows: DataFrame, key: Cols, seq: str) -> DataFrame:
    """The rows after each window, with `at`, their place from 0."""
    end = F.col("start") + F.col("length")
    return rows.join(windows.select(*key, "start", "length"), list(key)).where(F.col(seq) >= end).withColumn("at", F.col(seq) - end)


def texts_of_windows(rows: DataFrame, windows: DataFrame, key: Cols, seq: str, line: Column, name: str = "lines") -> DataFrame:
    """windows with an array of their rows as text, in order."""
    inside = context_rows(rows, windows, key, seq)
    lines = inside.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))).alias("__x")).select(*key, F.transform("__x", lambda x: x["l"]).alias(name))
    return windows.join(lines, list(key))


def side_by_side(members: DataFrame, block: Cols, label: str, lines: str) -> DataFrame:
    """block and streams (label -> lines): shorter streams repeat their last line up to the longest of the block. Members without lines have an empty stream."""
    found = members.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.coalesce(F.col(lines), F.array().cast("array<string>")).alias("lines")))).alias("__m"))
    longest = F.array_max(F.transform("__m", lambda m: F.size(m["lines"])))
    padded = lambda x: F.when(F.size(x) > 0, F.concat(x, F.array_repeat(F.element_at(x, -1), longest - F.size(x)))).otherwise(x)
    return found.select(*block, F.map_from_arrays(F.transform("__m", lambda m: m["label"]), F.transform("__m", lambda m: padded(m["lines"]))).alias("streams"))


def severity_segments(members: DataFrame, block: Cols, label: str, rank: str, lines: str, size: int = 4) -> DataFrame:
    """block, options (label -> segment) and answer: labels from the least severe to the most. Blocks that are not whole, lack a segment, or have two of one rank go."""
    found = members.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(label).alias("label"), F.array_join(lines, " | ").alias("text")))).alias("__m"))
    whole = (F.size("__m") == size) & (F.size(F.array_distinct(F.transform("__m", lambda m: m["rank"]))) == size) & F.forall("__m", lambda m: m["rank"].isNotNull() & (F.coalesce(m["text"], F.lit("")) != ""))
    options = F.map_from_entries(F.array_sort(F.transform("__m", lambda m: F.struct(m["label"].alias("k"), m["text"].alias("v")))))
    return found.where(whole).select(*block, options.alias("options"), F.array_join(F.transform("__m", lambda m: m["label"]), "").alias("answer"))


def troubleshooting(windows: DataFrame, causes: DataFrame, fault: str, cause: str, remedy: str) -> DataFrame:
    """windows (with a fault, null or 0 for none) with root_cause and answer: the cause's remedy, or that nothing is wrong; faults without a remedy make no item."""
    known = causes.select(F.col(fault).alias("__fault"), F.col(cause).alias("root_cause"), F.col(remedy).alias("__remedy"))
    well = F.coalesce(F.col(fault), F.lit(0)) == 0
    out = windows.join(known, (F.col(fault) == F.col("__fault")) & ~well, "left")
    answer = F.when(well, NOTHING_WRONG).otherwise(F.nullif(F.trim("__remedy"), F.lit("")))
    return out.withColumn("answer", answer).where("answer IS NOT NULL").drop("__fault", "__remedy")


def severity_ranks(documents: DataFrame, text: Name) -> DataFrame:
    """(fault_id, rank) of texts {"ranking_least_to_most_severe": [{"fault_id": 3, "rank": 1}, ...]}; entries without either go, of a fault named twice the last counts."""
    entries = F.from_json(col(text), "ranking_least_to_most_severe array<struct<fault_id:double,rank:double>>")["ranking_least_to_most_severe"]
    each = documents.select(F.posexplode(entries).alias("__at", "e")).where("e.fault_id IS NOT NULL AND e.rank IS NOT NULL")
    return each.groupBy(F.col("e.fault_id").cast("int").alias("fault_id")).agg(F.max_by(F.col("e.rank").cast("int"), "__at").alias("rank"))


def simulated_rows(df: DataFrame, key: Cols, clock: str = "sim_time_s", event: str = "event_id", params: str = "event_params", phase: str = "task_phase") -> DataFrame:
    """Recorder rows of a simulator with timestamp_ms (from the episode's first row), event (null, id, or id_params), fault_label and task_phase.

    The first time of an episode is an aggregate; its rows are not put in order.
    """
    first = df.groupBy(*key).agg(F.min(F.col(clock).try_cast("double")).alias("__first"))
    number = F.col(event).try_cast("double").cast("int")
    more = F.coalesce(F.trim(F.col(params).cast("string")), F.lit("")) if params in df.columns else F.lit("")
    token = F.when(F.coalesce(number, F.lit(0)) != 0, F.when(more != "", F.concat_ws("_", number.cast("string"), more)).otherwise(number.cast("string")))
    out = df.join(first, list(key)).withColumn("timestamp_ms", (F.col(clock).try_cast("double") * 1000 - F.col("__first") * 1000).cast("long"))
    shown = F.col(phase).cast("string") if phase in df.columns else F.lit(None).cast("string")
    return out.withColumn("event", token).withColumn("fault_label", F.coalesce(number, F.lit(0))).withColumn("task_phase", shown).drop("__first")
