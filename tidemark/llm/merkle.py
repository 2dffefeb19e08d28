"""A Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots, and proofs for every row.

Rows become leaves (digests of their fields), numbered per group by a range sort whose partitions are counted first, so no
group meets in one task. Trees are then built by events, as combineByKey would: a task reads nodes, and a partial parent
gathers the digests of its children by index; as soon as it holds as many as the sizes say (ARITY, fewer at the end of a
level), it becomes a node and an event of its own. Children whose parent is still partial when the task ends are the
frontier: they are dealt anew by a range of leaves SPAN levels wider, and the next round merges them. Each round therefore
climbs SPAN levels at least, and a task holds at most ARITY**SPAN of them per range.

Proofs go the other way, along reverse links from parents to children: per stage of SPAN levels, each range of nodes meets
the one tail (the siblings above it) its ancestor got from the stage before. Leaves take their proofs from the last stage,
so a tail is shuffled once per ARITY**SPAN leaves and not once per leaf.

Digests are binary in tables; a node is the lowercase hex SHA-256 of its children's hex digests, concatenated.

Defined cases: a null field is `-`; a null group is a group of its own, before all others; null ids come first in theirs.
Rows that repeat an id are ordered by their leaves, and equal rows are leaves side by side, with proofs of their own. A
group of one row has that leaf as its root, and a single group's root is the root of all. An empty table has no root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Scratch, bound_batches

ARITY_BITS, SPAN = 4, 3
ARITY = 1 << ARITY_BITS
RANGE_BITS = ARITY_BITS * SPAN
NODE = "tree string, level int, at long, total long, digest binary"


def leaf_digest(fields: list[Column]) -> Column:
    """Binary SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:`, and it."""
    said = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]), 256))


def tree_key(group: Column) -> Column:
    """A group as a name that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (with tree) and at, total: the place in its tree by `order`, and the tree's size. Equal rows keep their places in the input.

    The order of equal rows is part of the sort key, so that even they spread over partitions.
    """
    key = ["tree", *order, "__row"]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = scratch.keep(ranged.drop("__row").withColumn("__sorted", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__sorted", 33)), f"{name}-sorted")
    runs = ranged.groupBy("tree", "__part").agg(F.min("__sorted").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("tree")  # one row per partition that the tree has rows in
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "__part", (F.col("__first") - before).alias("__first"), F.sum("__n").over(whole).alias("total"))
    return ranged.join(runs, ["tree", "__part"]).withColumn("at", F.col("__sorted") - F.col("__first")).drop("__sorted", "__part", "__first")


def climb(nodes: Iterator[tuple[str, int, int, int, bytes]]) -> Iterator[tuple[str, int, int, int, bytes, bool]]:
    """Nodes that the given ones complete, then the children left under partial parents (marked open).

    Nodes are (tree, level, at, total, digest), total the nodes of that level; a node of total 1 is a root.
    """
    partial: dict[tuple[str, int, int], dict[int, tuple]] = {}
    for event in nodes:
        while True:
            tree, level, at, total, _ = event
            if total == 1:
                break
            key = (tree, level + 1, at >> ARITY_BITS)
            children = partial.setdefault(key, {})
            children[at & (ARITY - 1)] = event
            if len(children) < min(ARITY, total - (key[2] << ARITY_BITS)):
                break
            del partial[key]
            event = (*key, -(-total >> ARITY_BITS), parent([children[i][4] for i in range(len(children))]))
            yield (*event, False)
    for children in partial.values():
        for child in children.values():
            yield (*child, True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("total", pa.int64()), ("digest", pa.binary()), ("open", pa.bool_())])


def ancestors(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """All nodes above the leaves (tree, at, total, leaf) of trees of more than one leaf."""
    bound_batches(leaves.sparkSession)
    frontier = leaves.where("total > 1").select("tree", F.lit(0).alias("level"), "at", "total", F.col("leaf").alias("digest"))
    rounds: list[DataFrame] = []
    while True:
        bits = RANGE_BITS * (len(rounds) + 1)
        # the leaves that all nodes of a range of this round stand over, at every level
        reach = F.expr(f"shiftright(shiftleft(at, {ARITY_BITS} * level), {bits})") if bits < 63 else F.lit(0).cast("long")
        dealt = frontier.withColumn("reach", reach).repartition("tree", "reach").sortWithinPartitions("tree", "level", "at").select("tree", "level", "at", "total", "digest")
        found = scratch.keep(dealt.mapInArrow(lambda b: _batches(climb(_rows(b)), _NODE), NODE + ", open boolean"), f"{name}-round-{len(rounds)}")
        rounds.append(found.where("NOT open").drop("open"))
        frontier = found.where("open").drop("open")
        if frontier.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, level, digest) of each tree's root."""
    return leaves.where("total = 1").select("tree", F.lit(0).alias("level"), F.col("leaf").alias("digest")).unionByName(nodes.where("total = 1").select("tree", "level", "digest"))


class Tail:
    """Siblings from one level up to the root: per level the own place, the run's size, and the other digests."""

    def __init__(self, packed: bytes):
        self.packed, self.levels, i = packed, [], 0
        while i < len(packed):
            place, size = packed[i], packed[i + 1]
            others = [packed[j : j + 32] for j in range(i + 2, i + 2 + 32 * (size - 1), 32)]
            self.levels.append((place, others))
            i += 2 + 32 * len(others)
        self.said = "".join([s.hex() for _, others in self.levels for s in others])

    def fold(self, digest: bytes) -> bytes:
        for place, others in self.levels:
            digest = parent([*others[:place], digest, *others[place:]])
        return digest


def step(run: list[bytes], place: int) -> bytes:
    """One level of a packed tail."""
    return bytes([place, len(run)]) + b"".join(run[:place] + run[place + 1 :])


TAIL, INNER, CHILD, ALONE = 0, 1, 2, 3  # kinds of rows a stage reads, in the order it needs them
_STAGE = ["tree", "reach", "kind", "level", "at", "digest", "tail", "id", "changed"]


def _range_paths(root: bytes, tail: bytes, inner: dict[int, dict[int, bytes]], children: list[tuple]) -> Iterator[tuple]:
    """(row, root, run, place, tail above the run) of each child of one range; a tree's only leaf has no run."""
    own = {r[4]: r[5] for r in children}

    def run_of(level: dict[int, bytes], at: int) -> list[bytes]:
        first = at >> ARITY_BITS << ARITY_BITS
        return [level[j] for j in range(first, first + ARITY) if j in level]

    now, run, above = None, [], Tail(tail)
    for r in children:
        if r[2] == ALONE:
            yield r, root, None, 0, above
            continue
        if r[4] >> ARITY_BITS != now:
            now = at = r[4] >> ARITY_BITS
            run, packed = run_of(own, r[4]), b""
            for level in sorted(inner):
                packed += step(run_of(inner[level], at), at & (ARITY - 1))
                at >>= ARITY_BITS
            above = Tail(packed + tail)
        yield r, root, run, r[4] & (ARITY - 1), above


def _paths(rows: Iterator[tuple]) -> Iterator[tuple]:
    """_range_paths of each range of the sorted rows of a stage."""
    for _, of_range in itertools.groupby(rows, key=lambda r: r[:2]):
        root, tail, inner, children = None, None, {}, []
        for r in of_range:
            if r[2] == TAIL:
                root, tail = r[5], r[6]
            elif r[2] == INNER:
                inner.setdefault(r[3], {})[r[4]] = r[5]
            else:
                children.append(r)
        if children:
            yield from _range_paths(root, tail, inner, children)


def _tails(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, tree, at, root, tail) for the next stage."""
    for r, root, run, place, above in _paths(rows):
        yield r[7], r[0], r[4], root, (b"" if run is None else step(run, place)) + above.packed


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, leaf, tree's root, digest of the proof, root folded from the changed leaf, else the leaf, and the siblings)."""
    for r, root, run, place, above in _paths(rows):
        leaf, changed = r[5], r[8] or r[5]
        others = [] if run is None else run[:place] + run[place + 1 :]
        said = "".join([s.hex() for s in others]) + above.said
        folded = changed if run is None else parent([*run[:place], changed, *run[place + 1 :]])
        yield r[7], leaf, root, hashlib.sha256(said.encode()).digest(), above.fold(folded)


def descend(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, emit: Callable, out: list[tuple[str, str, pa.DataType]], scratch: Scratch, name: str) -> DataFrame:
    """What emit makes of the leaves' paths; tops: (tree, level, digest, tail) of the roots."""
    c, none = F.col, F.lit(None)
    kind = leaves.schema["id"].dataType
    bound_batches(leaves.sparkSession)

    def tagged(df: DataFrame, reach: Column, tag: Column, tail: Column = none, id: Column = none, changed: Column = none) -> DataFrame:
        return df.select("tree", reach.cast("long").alias("reach"), tag.alias("kind"), "level", "at", "digest", tail.cast("binary").alias("tail"), id.cast(kind).alias("id"), changed.cast("binary").alias("changed"))

    inner = nodes.where("total > 1")
    highest = tops.agg(F.max("level")).first()[0] or 0
    above = None
    for stage in range(max(0, -(-highest // SPAN) - 1), -1, -1):
        base = stage * SPAN
        own = tops.where(F.greatest(F.lit(0), F.ceil(c("level") / SPAN).cast("int") - 1) == stage)
        rows = tagged(own.withColumn("at", F.lit(0).cast("long")), F.lit(0), F.lit(TAIL), c("tail"))
        if above is not None:
            rows = rows.union(tagged(above.withColumn("level", F.lit(base + SPAN)), c("at"), F.lit(TAIL), c("tail")))
        rows = rows.union(tagged(inner.where((c("level") > base) & (c("level") < base + SPAN)), F.expr(f"shiftright(at, {ARITY_BITS} * ({base + SPAN} - level))"), F.lit(INNER)))
        if stage:
            rows = rows.union(tagged(inner.where(c("level") == base), F.shiftright("at", RANGE_BITS), F.lit(CHILD)))
        else:
            own = leaves.withColumn("level", F.lit(0)).withColumn("digest", c("leaf"))
            rows = rows.union(tagged(own, F.shiftright("at", RANGE_BITS), F.when(c("total") == 1, ALONE).otherwise(CHILD), none, c("id"), c("changed")))
        dealt = rows.repartition("tree", "reach").sortWithinPartitions("tree", "reach", "kind", "level", "at").select(*_STAGE)
        if stage:
            above = dealt.mapInArrow(lambda b: _batches(_tails(_rows(b)), _UP), "id string, tree string, at long, digest binary, tail binary")
            above = scratch.keep(above, f"{name}-tails-{stage}")
    schema = pa.schema([(n, t) for n, _, t in out])
    return dealt.mapInArrow(lambda b: _batches(emit(_rows(b)), schema), ", ".join(f"{n} {t}" for n, t, _ in out))


_UP = pa.schema([("id", pa.string()), ("tree", pa.string()), ("at", pa.int64()), ("digest", pa.binary()), ("tail", pa.binary())])


@dataclass
class Manifest:
    """Numbered leaves (tree, id, leaf, changed, at, total), inner nodes, and the roots of the groups' trees; likewise the tree over these."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    subroots: DataFrame
    top_nodes: DataFrame
    root: bytes | None
    scratch: Scratch


def build(docs: DataFrame, fields: list[Column], group: str = "source", doc_id: str = "doc_id", changed: Column | None = None) -> Manifest:
    """The manifest of all rows. changed: null, or the binary digest of a leaf after a change that proofs are tried against."""
    scratch = Scratch(docs.sparkSession)
    leaves = docs.select(tree_key(F.col(group)).alias("tree"), F.col(doc_id).alias("id"), leaf_digest(fields).alias("leaf"), (F.lit(None) if changed is None else changed).cast("binary").alias("changed"))
    leaves = scratch.keep(numbered(scratch.keep(leaves, "leaves"), ["id", "leaf"], scratch, "leaves"), "numbered")
    nodes = ancestors(leaves, scratch, "nodes")
    groups = scratch.keep(roots(leaves, nodes), "groups")
    subroots = groups.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("changed"))
    subroots = scratch.keep(numbered(subroots, ["id"], scratch, "groups"), "subroots")
    top_nodes = ancestors(subroots, scratch, "top")
    top = roots(subroots, top_nodes).first()
    return Manifest(leaves, nodes, groups, subroots, top_nodes, None if top is None else bytes(top["digest"]), scratch)


def prove(m: Manifest) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root (hex) and verified: whether the fold gives the root."""
    top = roots(m.subroots, m.top_nodes).withColumn("tail", F.lit(b""))
    tails = descend(m.subroots, m.top_nodes, top, _tails, [("id", "string", pa.string()), ("top", "string", pa.string()), ("at", "long", pa.int64()), ("digest", "binary", pa.binary()), ("tail", "binary", pa.binary())], m.scratch, "top")
    tails = m.scratch.keep(tails.select(F.col("id").alias("tree"), "tail"), "tails")
    kind = m.leaves.schema["id"].dataType
    out = [("id", kind.simpleString(), to_arrow_type(kind)), *[(n, "binary", pa.binary()) for n in ("leaf", "subroot", "proof_sha256", "folded_root")]]
    found = descend(m.leaves, m.nodes, m.groups.join(tails, "tree"), _digests, out, m.scratch, "proofs")
    said = lambda c: F.lower(F.hex(c)).alias(c)
    root = F.lit(None if m.root is None else m.root.hex()).cast("string")
    return found.select("id", said("leaf"), said("subroot"), root.alias("root"), said("proof_sha256"), said("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
