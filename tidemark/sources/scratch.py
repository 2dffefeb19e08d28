"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast unasked.
FEW = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
    return f"{where.rstrip('/')}/tables-{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written and read again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_once(rows: DataFrame, by: Sequence[str], make: Callable[[DataFrame], DataFrame], few: int = FEW) -> DataFrame:
    """rows with the columns that make adds to a table of the columns by, which sees each combination of values once, however many rows have it.

    For costly expressions over texts that repeat. Where more than `few` combinations differ, rows and results are both dealt by them.
    """
    made = kept(rows.sparkSession, make(rows.select(*by).distinct()), "made")
    keys = {c: f"__{c}" for c in by}
    match = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    own = made.withColumnsRenamed(keys).hint("merge" if made.count() > few else "broadcast")
    return rows.join(own, match).drop(*keys.values())
