"""Streaming forms: windowed counts with a watermark, onsets with state, an idempotent shard sink, resumption."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """n and total per window and key; windows close once the watermark passes them."""
    w = F.window(F.col(ts), width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def onsets(stream: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """Rows where the event starts, per key, across micro-batches: state is the last event alone.

    Rows of a key must arrive in order between batches; within one they are sorted.
    """
    kind = stream.schema

    def run(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = rows[event].shift(1)
        before.iloc[0] = last
        state.update((int(rows[event].iloc[-1]),))
        yield rows.loc[(rows[event] != 0) & (before == 0), [f.name for f in kind]]

    return stream.groupBy(key).applyInPandasWithState(run, kind, "last long", "append", GroupStateTimeout.NoTimeout)


def shard_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch replaces its own folder, so a batch that is run again leaves no copies."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there and gives the appended rows."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def finished(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Keys that a sink holds already, for an anti-join on restart."""
    return spark.read.parquet(path).select(*key).distinct()
