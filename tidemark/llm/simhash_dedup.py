"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints within three bits differ in at most one bit of some
segment, so each fingerprint is stored in one table per segment and looks up the small Hamming ball (the value and its 32
one-bit changes) around its own segment. What the tables give is verified over all 64 bits. Only distinct fingerprints
take part: exact copies and equal fingerprints are one row, however many there are.

Classes are the connected components of the links, by distributed union-find.

Defined cases: null and empty texts, and texts of white space alone, have fingerprint 0, linked like any other; a text of
fewer words than a shingle is one shingle of all its words; rows that repeat an id share its class; an empty table gives
no rows. Documents with a null id are fingerprinted and linked; their class is the smallest id of the others, or null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import line_dedup
from tidemark.llm.common import Scratch, connected_components, map_batches, repeats, spread, without_repeats

RADIUS = 3
SEGMENT = 32
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is set if it is set in over half the XXH64 values of the text's word shingles, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:])]
    else:
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x or "", words) for x in b.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) at most RADIUS bits apart. A pair may come twice."""
    segments = F.array(
        F.struct(F.lit(0).alias("s"), F.shiftrightunsigned("fp", SEGMENT).alias("v")),
        F.struct(F.lit(1).alias("s"), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("v")),
    )
    own = distinct.select("fp", F.explode(segments).alias("x")).select("fp", "x.s", "x.v")
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(SEGMENT)]).cast("array<bigint>")
    ball = own.select(F.col("fp").alias("a"), "s", F.col("v").alias("w"), F.explode(flips).alias("flip")).select("a", "s", F.col("w").bitwiseXOR(F.col("flip")).alias("v"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS
    return ball.join(spread(own), ["s", "v"]).where((F.col("a") < F.col("fp")) & near).select("a", F.col("fp").alias("b"))


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the class."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, words), "prints")
    least = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = connected_components(links(least.select("fp")), scratch)
    # classes of linked fingerprints take the smallest id of all their documents
    members = least.join(spread(linked.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = scratch.keep(members.join(spread(smallest), "component").select("fp", "component_id"), "classes")
    return prints.join(spread(classes), "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, in order."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))}) if w else [], dtype=np.uint64)


def _banded(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, t, fp, h, keys): the text's hash, the fingerprint, a hash of the set of shingles, and its band keys. Sets themselves are far larger and not kept."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        sets = [shingles(x, words) for x in texts]
        keys: list[list[int]] = [[] for _ in sets]
        for start, stop in line_dedup.pieces_by_size([len(x) for x in sets]):
            own = sets[start:stop]
            at, key = line_dedup.band_keys(np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64))
            for i, k in zip(at.tolist(), key.view(np.int64).tolist()):
                keys[start + i].append(k)
        fps = np.array([fingerprint(x or "", words) for x in texts], dtype=np.uint64).view(np.int64)
        hs = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array(hs), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "fp", "h", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("t"), "text"), run, f"doc_id {kind}, t long, fp long, h long, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(h, shingles) of (h, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, words).view(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["h", "shingles"])

    return map_batches(texts.select("h", "text"), run, "h long, shingles array<long>")


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one row after the other, and where each row's begin (and the end)."""
    offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets


def _set_sketches(sets: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *line_dedup.sketch_columns([line_dedup.sketch_rows(*_ragged(b.column(1)))])], line_dedup.SKETCH_NAMES)

    return map_batches(sets.select("h", "shingles"), run, line_dedup.SKETCHED)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose exact Jaccard similarity is high enough."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = line_dedup.similarities(_ragged(b.column(2)), _ragged(b.column(3))) >= line_dedup.SIMILARITY
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    x, y = (sets.select(F.col("h").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    return map_batches(pairs.join(spread(x), "a").join(spread(y), "b").select("a", "b", "s_a", "s_b"), run, "a long, b long")


def similar_components(docs: DataFrame, words: int = 5, unique: bool = False) -> DataFrame:
    """(doc_id, component_id) by the links of fingerprints and those of exact Jaccard similarity of 0.8 or more.

    A pair of similarity 0.8 differs by ten bits on average, which no table of fingerprints finds without pairing most
    documents, so candidates come from MinHash bands (probability 0.99 at 0.8, 0.9999 at 0.9), as for lines; each is verified by its shingle sets.
    unique: no two rows have the same id and text, as the caller knows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = scratch.keep(_banded(docs, words), "prints")
    # one document stands for all of equal sets; only sets that some band pairs are made again, from its text
    sets = scratch.keep(every.groupBy("h").agg(F.min(F.struct("doc_id", "t")).alias("of"), F.first("keys").alias("keys")), "distinct-sets")
    once = docs if unique else without_repeats(docs, repeats(docs))

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = sets.join(spread(wanted), "h", "left_semi").select("h", F.col("of.doc_id").alias("__id"), F.col("of.t").alias("__of"))
        texts = once.withColumn("__t", F.xxhash64("text")).join(spread(chosen), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__of")))
        return _sets(texts, words)

    near = line_dedup.linked(sets.select(F.explode("keys").alias("key"), "h"), sets_of, _similar, _set_sketches, scratch)
    least = scratch.keep(every.groupBy("fp", "h").agg(F.min("doc_id").alias("first")), "distinct")
    # one set stands for all of a fingerprint
    one = scratch.keep(least.groupBy("fp").agg(F.min("h").alias("one")), "one")
    equal = least.join(spread(one), "fp").select(F.col("h").alias("a"), F.col("one").alias("b"))
    x, y = (one.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}")) for c in "ab")
    close = links(one.select("fp")).join(spread(x), "a").join(spread(y), "b").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))
    label = connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(equal).union(close), scratch, "all-cc")
    members = least.groupBy("h").agg(F.min("first").alias("first")).join(spread(label.withColumnRenamed("node", "h")), "h", "left").withColumn("component", F.coalesce("component", "h"))
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = scratch.keep(members.join(spread(smallest), "component").select("h", "component_id"), "classes")
    return every.select("doc_id", "h").join(spread(classes), "h").select("doc_id", "component_id")


def one_per_class(docs: DataFrame, words: int = 3, similar: bool = False) -> DataFrame:
    """One document of each class by fingerprints or (similar) by similar_components: that of the smallest id, null ids last, and of one id that of the smallest text hash. Of rows that repeat id and text one stays."""
    docs = without_repeats(docs, repeats(docs))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("doc_id"), "text")
    found = similar_components(keyed, words, unique=True) if similar else components(keyed, words)
    keep = found.where("doc_id = component_id").select(F.col("doc_id.id").alias("__kept"), F.col("doc_id.t").alias("__t"))
    return docs.join(spread(keep), F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.xxhash64("text") == F.col("__t")), "left_semi")
