"""Pieces the corpus operators share: table access, shared scratch tables, vectorised hashing, distributed union-find."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where the session has none, as in tests, one is set for it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark, "_tidemark_scratch", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = spark._tidemark_scratch = tempfile.mkdtemp(prefix="tidemark-")
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


_held: dict[str, dict] = {}


def held(make: Callable) -> Callable:
    """Keeps make's results in a Python worker from task to task, as long as tasks of make's own module run there.

    Workers serve one stage after another, so what a cache keeps for good would stand beside every later stage's memory.
    """

    @functools.wraps(make)  # pickled by name, so that workers share the module's table
    def get(*key):
        own = _held.setdefault(make.__module__, {})
        if (make.__name__, key) not in own:
            own[make.__name__, key] = make(*key)
        return own[make.__name__, key]

    return get


def release(module: str) -> None:
    """Drops what other modules hold."""
    others = [m for m in _held if m != module]
    for m in others:
        del _held[m]
    if others:
        gc.unfreeze()
        gc.collect()
    trim()


def trim() -> None:
    """Gives freed memory back to the machine, where the C library can: arrays of one task would stay with the worker."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


#: Most bytes and rows of one Arrow batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2048


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches, never raises them: texts are long, and the JVM and the worker each hold whole batches of input and of output."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(fn.__module__)
        for b in batches:
            if b.num_rows:
                for start in range(0, b.num_rows, 512):  # bounds what one call holds
                    out = fn(b.slice(start, 512))
                    if out is not None and out.num_rows:
                        yield out
        trim()

    return df.mapInArrow(run, schema)


def lookup(rows: DataFrame, values: DataFrame, on: list[str], hot: str) -> DataFrame:
    """rows with the columns of values, whose keys are unique and hold every key of rows; nulls are equal to nulls.

    Where the column `hot` is true, values are broadcast and their rows stay where they are; the caller proves a bound on
    how many these are. Only the rows of other keys are shuffled, so a key that holds a large share of all rows never meets in a task.
    """
    values = values.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in values.columns if c not in on])
    match = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    own = rows.columns
    new = [c for c in values.columns if c != hot and not c.startswith("__")]
    tried = rows.join(F.broadcast(values.where(hot)), match, "left")
    rest = tried.where(F.col(hot).isNull()).select(*own)
    return tried.where(hot).select(*own, *new).union(rest.join(values.where(~F.col(hot)), match).select(*own, *new))


def spread(df: DataFrame) -> DataFrame:
    """df for a join that deals both sides by key, never a broadcast: for tables that grow with the input.

    Spark takes exploded rows for no more than those they come from, so a table of millions of rows can seem small enough
    to pass through the driver.
    """
    return df.hint("merge")


def repeats(docs: DataFrame) -> DataFrame | None:
    """(doc_id, t, n): the ids and text hashes that n > 1 rows share; None if no row repeats another's id and text. Texts are read only if some id repeats."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    found = docs.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    return None if found.isEmpty() else found


def without_repeats(docs: DataFrame, found: DataFrame | None) -> DataFrame:
    """docs with one row for each id and text; only the rows found to repeat are shuffled to be told apart."""
    if found is None:
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__of"))
    keys = found.select(F.col("doc_id").alias("__id"), F.col("t").alias("__of"))
    hashed = docs.withColumn("__t", F.xxhash64("text"))
    once = hashed.join(keys, same, "left_semi").dropDuplicates(["doc_id", "__t"])
    return hashed.join(keys, same, "left_anti").unionByName(once).select(*docs.columns)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept and doubled as needed."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        h *= factor
        h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] for each span, by prefix sums: equal spans hash equally wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, sep: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~sep[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; shorter input gives one hash of all of it, empty input none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * BASE + words[i : n - k + 1 + i]
    return mix(h)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Distributed union-find by alternating large-star and small-star contractions.

    edges: columns a, b of one orderable type, in any direction and with repeats; self-links and nulls are ignored.
    Returns (node, component) for every node that has an edge, component the smallest node reachable.
    Each round contracts the link table through hash aggregation and joins and writes it to the shared folder;
    nothing is collected but two counts.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, f"{name}-0")
    for i in range(1, 100):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(least), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = scratch.keep(small.where("u <> v").distinct(), f"{name}-{i}")
        # a forest of stars: each node has one link, and no centre is a leaf
        leaves = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(e.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")).distinct())
        bad = leaves.groupBy("n").agg(F.sum("leaf").alias("l"), F.max("centre").alias("c")).where("l > 1 OR (l > 0 AND c > 0)").limit(1).count()
        scratch.drop(f"{name}-{i - 1}")
        if not bad:
            break
    else:
        raise RuntimeError("union-find did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


