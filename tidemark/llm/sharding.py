"""Shards by a K-d tree over metadata: cells are split at weighted medians along their widest dimension.

Each dimension becomes a whole-number key per row: the value's place in the dimension's range, in VALUE_BITS bits, and below
it a hash of the row, so that rows of one value (a hot source) can be split too. The tree grows level by level. A level
takes two passes over a narrow table: per cell the bytes and the extent of each dimension, then, per round, a histogram of
bytes over BINS parts of the interval that the median is still in. A round only shuffles one partial sum per cell, bin and
task; a window over the BINS rows of a cell finds the bin, and one row per cell comes to the driver. Rounds go on until the
bin holds one key, or no more than `slack` of the target.

The tree (one node per shard) is all that the driver holds. Rows find their cell by one lookup per level in it. Their place
in the shard is counted in buckets of about BUCKET rows, whose sizes are summed up first; no task gets a whole shard.

A cell that is to become k shards is cut at floor(k/2)/k of its bytes, so shards come out near equal: within one row, or
slack, per cut. Shards are numbered from the left of the tree.

Defined cases: a null value of a dimension counts as the dimension's least; a dimension without values, or of one value, has
no width. Cells of no width (by value) are cut by the hash alone. Repeated rows are rows of their own; more shards than rows
leave empty shards, which have no number gaps in between but no rows. An empty table gives no rows. Input columns of any
name are carried along but `shard` and `slot`, which replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

VALUE_BITS, TIE_BITS = 32, 30
BINS = 4096
BUCKET = 50_000
SLACK = 1e-4
MOST_SHARDS = 1 << 17


@dataclass
class Split:
    """One inner node: rows of `node` whose key of dimension `dim` is `cut` or more go right."""

    node: int
    dim: int
    cut: int


def small_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Numbers that the driver holds, as a table in the plan itself."""
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], names=names))


def text_bytes(text: str = "text") -> Column:
    """Size of a document: UTF-8 bytes of its text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefix_number(value: Column) -> Column:
    """A string's first six bytes as a number that keeps their order; null stays null."""
    padded = F.rpad(F.substring(F.hex(value.cast("binary")), 1, 12), 12, "0")
    return F.conv(padded, 16, 10).cast("double")


def metadata_dimensions() -> dict[str, Column]:
    """Dimensions of `documents`: language, source, length and id."""
    return {"lang": prefix_number(F.col("lang")), "source": prefix_number(F.col("source")), "n_chars": F.col("n_chars").cast("double"), "doc_id": F.col("doc_id").cast("double")}


def _keyed(rows: DataFrame, dimensions: dict[str, Column], size: Column, scratch: Scratch) -> DataFrame:
    """(rid, row, size, keys) over a written table, of which passes that need no row read the narrow columns only."""
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")])
    values = F.array(*[F.when(~F.isnan(v), v) for v in dimensions.values()])
    raw = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), carried.alias("row"), size.alias("size"), values.alias("values")), "values")
    n = len(dimensions)
    spans = raw.agg(*[f(F.get("values", F.lit(i))) for i in range(n) for f in (F.min, F.max)]).first()

    def key(i: int) -> Column:
        low, high = spans[2 * i], spans[2 * i + 1]
        if low is None or high <= low:
            place = F.lit(0).cast("long")
        else:
            share = F.coalesce((F.get("values", F.lit(i)) - F.lit(low)) / F.lit(high - low), F.lit(0.0))
            place = F.floor(share * F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
        tie = F.shiftrightunsigned(F.xxhash64("rid", F.lit(i)), 64 - TIE_BITS)
        return F.shiftleft(place, TIE_BITS).bitwiseOR(tie)

    return raw.select("rid", "row", "size", F.array(*[key(i) for i in range(n)]).alias("keys"))


def _find(rows: DataFrame, levels: list[list[Split]]) -> DataFrame:
    """rows with `node`, their cell in the tree so far (root 1, children 2n and 2n + 1); at most one row per node is looked up."""
    spark = rows.sparkSession
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    for splits in levels:
        tree = small_table(spark, [(s.node, s.dim, s.cut) for s in splits], ["at", "dim", "cut"])
        met = rows.join(F.broadcast(tree), rows["node"] == tree["at"], "left")
        right = F.get("keys", F.col("dim").cast("int")) >= F.col("cut")
        rows = met.withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("long"))).drop("at", "dim", "cut")
    return rows


def _cuts(cells: DataFrame, goals: list[tuple[int, int, float, int, int]], slack: float) -> list[Split]:
    """The splits of cells (node, size, keys). goals: node, dimension, bytes to the left, least and largest key."""
    spark, out = cells.sparkSession, []
    # what is left to search: the bytes before the interval, and its keys from low to high, both included
    open_ = {node: (dim, goal, low, high) for node, dim, goal, low, high in goals}
    while open_:
        asked = small_table(spark, [(n, *x) for n, x in open_.items()], ["at", "dim", "goal", "low", "high"])
        met = cells.join(F.broadcast(asked), cells["node"] == asked["at"]).withColumn("key", F.get("keys", F.col("dim").cast("int"))).where("key >= low AND key <= high")
        met = met.withColumn("bin", F.expr(f"(key - low) div ((high - low) div {BINS} + 1)"))
        sums = met.groupBy("node", "goal", "bin").agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
        running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        reached = sums.withColumn("upto", F.sum("bytes").over(running)).withColumn("last", F.max("bin").over(Window.partitionBy("node")))
        crossing = reached.where("upto >= goal OR bin = last").groupBy("node").agg(F.min_by(F.struct("goal", "bytes", "least", "most", "upto"), "bin").alias("x"))
        for r in crossing.select("node", "x.*").collect():  # one row per cell
            before = r["upto"] - r["bytes"]
            dim = open_.pop(r["node"])[0]
            if r["least"] == r["most"] or r["bytes"] <= slack:
                # the bin goes to the side that leaves the sizes nearer to the goal
                left = r["upto"] - r["goal"] <= r["goal"] - before
                out.append(Split(r["node"], dim, r["most"] + 1 if left else r["least"]))
            else:
                open_[r["node"]] = (dim, r["goal"] - before, r["least"], r["most"])
    return out


def grow(keyed: DataFrame, shards: int, slack: float = SLACK) -> list[list[Split]]:
    """The splits of each level of the tree with `shards` leaves over rows (size, keys)."""
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards")
    levels: list[list[Split]] = []
    leaves = {1: shards}
    n = len(keyed.select("keys").limit(1).collect()[0]["keys"]) if shards > 1 and not keyed.isEmpty() else 0
    while n and any(k > 1 for k in leaves.values()):
        cells = _find(keyed.select("size", "keys"), levels)
        place = lambda i: F.shiftright(F.get("keys", F.lit(i)), TIE_BITS)
        extents = [F.struct((F.max(place(i)) - F.min(place(i))).alias("width"), F.lit(-i).alias("dim"), F.min(F.get("keys", F.lit(i))).alias("low"), F.max(F.get("keys", F.lit(i))).alias("high")) for i in range(n)]
        found = cells.groupBy("node").agg(F.sum("size").alias("bytes"), F.greatest(*extents).alias("widest") if n > 1 else extents[0].alias("widest"))
        goals, total = [], 0
        for r in found.collect():  # one row per cell
            k = leaves.get(r["node"], 1)
            total += r["bytes"]
            if k > 1:
                w = r["widest"]
                goals.append((r["node"], -w["dim"], r["bytes"] * (k // 2) / k, w["low"], w["high"]))
        if not goals:
            break
        levels.append(_cuts(cells, goals, slack * total / shards))
        split = {s.node for s in levels[-1]}
        leaves = {child: part for node, k in leaves.items() for child, part in ([(2 * node, k // 2), (2 * node + 1, k - k // 2)] if node in split else [(node, k)])}
    return levels


def _numbers(levels: list[list[Split]], shards: int) -> list[tuple[int, int]]:
    """(node, shard) of all leaves, from left to right."""
    inner = {s.node for level in levels for s in level}
    out: list[tuple[int, int]] = []
    stack = [(1, 0, shards)]
    while stack:
        node, first, k = stack.pop()
        if node in inner:
            stack += [(2 * node, first, k // 2), (2 * node + 1, first + k // 2, k - k // 2)]
        else:
            out.append((node, first))
    return out


def shard(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None, size: Column | None = None, dimensions: dict[str, Column] | None = None, slack: float = SLACK) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard), for a number of shards or as many as hold target_bytes at most each.

    size and dimensions are expressions over rows, metadata of `documents` if left out.
    """
    scratch = Scratch(rows.sparkSession)
    keyed = _keyed(rows, metadata_dimensions() if dimensions is None else dimensions, text_bytes() if size is None else size, scratch)
    if shards is None:
        if not target_bytes or target_bytes <= 0:
            raise ValueError("a number of shards or their target bytes")
        shards = max(1, math.ceil((keyed.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    levels = grow(keyed, shards, slack)
    leaves = small_table(rows.sparkSession, _numbers(levels, shards), ["leaf", "shard"])
    placed = _find(keyed, levels).join(F.broadcast(leaves), F.col("node") == F.col("leaf")).select("rid", "row", F.col("shard").cast("int").alias("shard"))
    return _with_slots(placed, shards).select("row.*", "shard", "slot")


def _with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """placed (rid, row, shard) with slot: places in hashed buckets, on top of the sizes of the shard's buckets before."""
    buckets = max(1, math.ceil(placed.count() / shards / BUCKET))
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid")) - 1)
    return inside.join(first, ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("place")).cast("long"))


def write(rows: DataFrame, path: str, **how) -> DataFrame:
    """Writes sharded rows as one folder of Parquet files per shard (shard=N/), in slot order by file, and reads them back."""
    placed = shard(rows, **how)
    piece = F.floor(F.col("slot") / BUCKET)
    placed.withColumn("__piece", piece).repartition("shard", "__piece").sortWithinPartitions("shard", "slot").drop("__piece").write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.parquet(path)
