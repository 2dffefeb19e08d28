"""Benchmark passages in documents.

Words are runs of ASCII letters and digits (A-Z lower-cased) and characters beyond ASCII; shingles are five words (a
shorter item is one shingle of all its words), weighted by their letters and by how often they stand.

1. For each distinct item length, a document's windows of as many words (a document with fewer words is one window) are
   taken where they can match at all: the share of a window's weight in shingles that some item has bounds its similarity
   to every item, so windows under the threshold are left out without loss.
2. Windows and items get weighted SimHash fingerprints of 64 bits. They are cut into BLOCKS blocks; within RADIUS bits some
   block differs by RADIUS // BLOCKS at most, so items stored under the Hamming ball of each block are found by a
   window's own blocks, all of them, and verified over all bits. (A window as similar as the threshold is within RADIUS
   with probability above 0.99; copies have distance 0.)
3. Candidates are verified by the exact weighted Jaccard similarity of their shingles.

Equal windows are compared once, however many documents hold them. Items are a stated query set; their shingles are
broadcast in blocks of at most MAX_SHINGLES, each block against all documents.

Defined cases: null and empty texts have no windows, items without words match nothing; repeated items give a row each
with their own item_id (of any type), repeated rows of one are one; rows that repeat a doc_id are one document (so are all without
an id); empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_batches, span_hashes, window_hashes, word_spans
from tidemark.llm.license_scan import _SEP

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
BLOCKS = 6
MAX_SHINGLES = 4_000_000
_CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size in bytes of each word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    starts, ends = word_spans(data, _SEP)
    return span_hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64), ends - starts


def shingles_of(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each k consecutive words."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    return window_hashes(words, k), sums[k:] - sums[:-k]


def fingerprint(h: np.ndarray, weight: np.ndarray) -> int:
    """Weighted SimHash: a bit is set if the shingles that have it weigh over half."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * (bits * weight[:, None]).sum(axis=0) > weight.sum()).tobytes(), "big")


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard of shingle -> weight."""
    shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def weights(h: np.ndarray, weight: np.ndarray) -> dict[int, int]:
    out: Counter[int] = Counter()
    for s, w in zip(h.tolist(), weight.tolist()):
        out[s] += w
    return dict(out)


class Items:
    """A block of items: lengths, their shingles, fingerprints."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.lengths: dict[int, list[np.ndarray]] = {}
        self.lightest: dict[int, int] = {}  # of the items of a length, the least weight
        self.table: list[tuple[object, int, int, list[int], list[int]]] = []
        for item, text in rows:
            words, sizes = words_of(text or "")
            n = len(words)
            if n:
                h, w = shingles_of(words, sizes, min(SHINGLE, n))
                self.lengths.setdefault(n, []).append(h)
                self.lightest[n] = min(int(w.sum()), self.lightest.get(n, int(w.sum())))
                self.table.append((item, n, fingerprint(h, w), h.view(np.int64).tolist(), w.tolist()))
        every = [x for v in self.lengths.values() for x in v]
        self.known = {k: np.unique(np.concatenate([x for n, v in self.lengths.items() for x in v if min(SHINGLE, n) == k])) for k in {min(SHINGLE, n) for n in self.lengths}} if every else {}
        # which lengths the items that hold a shingle have: an index into sets of lengths
        sets: dict[tuple[int, ...], int] = {}
        self.held = {}
        for k, v in self.known.items():
            of: dict[int, set[int]] = {}
            for n, hs in self.lengths.items():
                if min(SHINGLE, n) == k:
                    for x in np.unique(np.concatenate(hs)).tolist():
                        of.setdefault(x, set()).add(n)
            self.held[k] = np.array([sets.setdefault(tuple(sorted(of[x])), len(sets)) for x in v.tolist()], dtype=np.int64)
        self.length_sets = [np.array(x, dtype=np.int64) for x in sets]
        self.has_length = {n: np.array([n in x for x in sets], dtype=bool) for n in self.lengths}
        # a small table of hash bits tells most shingles of no item
        self.maybe = {k: np.zeros(1 << 22, dtype=bool) for k in self.known}
        for k, v in self.known.items():
            self.maybe[k][(v & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def windows(self, text: str) -> list[tuple[int, int, int, int, int, list[int], list[int]]]:
        """(start, item length, length, identity, fingerprint, shingles, weights) of the windows that may match."""
        words, sizes = words_of(text)
        out = []
        for k, known in self.known.items():
            if len(words) < k:
                continue
            h, w = shingles_of(words, sizes, k)
            hit = self.maybe[k][(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            if not len(at):
                continue
            total = np.concatenate(([0], np.cumsum(w)))
            lengths = self.held[k][np.searchsorted(known, h[at])]
            for n in np.unique(np.concatenate([self.length_sets[i] for i in np.unique(lengths).tolist()])).tolist():
                size = min(n, len(words))  # a document shorter than the item is one window
                # only shingles of items of this length count
                own = np.zeros(len(h) + 1, dtype=np.int64)
                mine = at[self.has_length[n][lengths]]
                own[mine + 1] = w[mine]
                hits = np.cumsum(own)
                m = size - k + 1
                ok = hits[m:] - hits[:-m] >= SIMILARITY * (total[m:] - total[:-m])
                if size < n:
                    ok &= hits[m:] - hits[:-m] >= SIMILARITY * self.lightest[n]
                for i in np.flatnonzero(ok).tolist():
                    own_h, own_w = h[i : i + m], w[i : i + m]
                    same = int(window_hashes(words[i : i + size], size).view(np.int64)[0])
                    out.append((i, n, size, same, fingerprint(own_h, own_w), own_h.view(np.int64).tolist(), own_w.tolist()))
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]


def _blocks(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(_CUTS, _CUTS[1:]))])


def _find(docs: DataFrame, rows: list[tuple[object, str]], id_type: str, scratch: Scratch, tag: str) -> DataFrame:
    spark = docs.sparkSession
    items = Items(rows)
    shared = spark.sparkContext.broadcast(items)  # at most MAX_SHINGLES shingles

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in shared.value.windows(t)]
        if not found:
            return None
        d, start, n, size, same, fp, h, w = zip(*found)
        kinds = [b.schema.field(0).type, *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((d, start, n, size, same, [_signed(x) for x in fp], h, w), kinds)], ["doc_id", "start", "n_words", "size", "same", "fp", "h", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = scratch.keep(map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, n_words long, size long, same long, fp long, h array<long>, w array<long>"), f"windows-{tag}")
    distinct = windows.select("n_words", "same", "fp", "h", "w").dropDuplicates(["n_words", "same"])
    stored = spark.createDataFrame([(i, n, _signed(fp), h, w) for i, n, fp, h, w in items.table], f"item_id {id_type}, n_words long, item_fp long, item_h array<long>, item_w array<long>")
    balls = F.array(*[F.array(*map(F.lit, _ball(hi - lo, RADIUS // BLOCKS))).cast("array<bigint>") for lo, hi in zip(_CUTS, _CUTS[1:])])
    keys = stored.select("item_id", "n_words", "item_fp", F.explode(_blocks("item_fp")).alias("x")).select("item_id", "n_words", "item_fp", "x.block", "x.value", F.explode(F.element_at(balls, F.col("x.block") + 1)).alias("flip"))
    keys = keys.select("item_id", "n_words", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    looked = distinct.select("n_words", "same", "fp", F.explode(_blocks("fp")).alias("x")).select("n_words", "same", "fp", "x.block", "x.value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = looked.join(keys, ["n_words", "block", "value"]).where(near).select("n_words", "same", "item_id").distinct()

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        sims = []
        for h, w, ih, iw in zip(*(b.column(i).to_pylist() for i in range(3, 7))):
            x, y = Counter(), Counter()
            for s, v in zip(h, w):
                x[s] += v
            for s, v in zip(ih, iw):
                y[s] += v
            sims.append(similarity(x, y))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sims, pa.float64())], ["n_words", "same", "item_id", "similarity"])

    rows_ = pairs.join(distinct.drop("fp"), ["n_words", "same"]).join(stored.select("item_id", "item_h", "item_w"), "item_id").select("n_words", "same", "item_id", "h", "w", "item_h", "item_w")
    verified = map_batches(rows_, verify, f"n_words long, same long, item_id {id_type}, similarity double").where(F.col("similarity") >= SIMILARITY)
    hits = windows.select("doc_id", "start", "n_words", "size", "same").join(verified, ["n_words", "same"])
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("size").alias("n_words"))).alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds."""
    scratch = Scratch(docs.sparkSession)
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = items.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z[^\x00-\x7F]]+"))).alias("n")).first()["n"] or 0  # an item has no more shingles than words
    blocks = -(-int(n) // max_shingles) or 1
    found = []
    for i in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).distinct().collect()]
        found.append(_find(docs, sorted(rows), id_type, scratch, str(i)))
    out = reduce(DataFrame.unionByName, found)
    return out.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), F.col("best.n_words").alias("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage. Rows of one id, or of none, are told apart by their texts' hashes."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("doc_id"), "text")
    bad = contaminated(keyed, benchmark).select(F.col("doc_id.id").alias("__bad"), F.col("doc_id.t").alias("__t")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
