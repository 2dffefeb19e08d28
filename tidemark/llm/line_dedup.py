"""Fuzzy deduplication of lines by MinHash.

1. Every non-blank line, trimmed, is known by its XXH64 value; equal lines are one from here on.
2. A line's character shingles go to a MinHash signature of BANDS bands of ROWS values: SHORT shingles or more by one
   permutation, whose bins without a shingle borrow from bins drawn by a hash; fewer by independent hashes. Lines with a
   number near SHORT get both, so a similar pair always has one kind in common. Bands are hashed: lines that share one are
   candidates. A pair of Jaccard similarity 0.8 is found with probability 0.99, of 0.85 with 0.999.
3. In each band bucket every line is verified against HUBS of its lines (the first by a hash of band and line), by the
   exact Jaccard similarity of their shingle sets; buckets of up to HUBS + 1 lines are compared whole. Union-find over these
   links labels the lines.
4. What is left are pairs of two lines of one bucket, no hub among them, with different labels, one of them not the most
   common one there. They are compared as well, each pair in one of its buckets: by sketches of SKETCH one-bit MinHash values,
   which leave out a pair of similarity 0.8 with probability below 1e-5; by bitmaps of MAP bits, one set for each shingle, in
   which similar lines can't differ in more bits than their sets do in shingles (no loss); then exactly. So every pair of every
   bucket either has one label or was compared, and a bucket of near copies gives HUBS rows per line and hardly more than a
   row per pair that is similar but not yet known to be in one class.
5. Union-find over the labels these links join; of each component the first line, by (doc_id, line number), stays.

Defined cases: null text has no lines; blank lines are never compared and stay; lines shorter than a shingle are one
shingle, so only equal ones match; rows that repeat a doc_id and its text share its fate, other texts under one doc_id are
told apart (the first is the one of the smallest XXH64 value of the text); null ids come first; an empty table gives no
rows; further columns of docs are never read. Two different lines share an XXH64 value with probability 2**-64.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, Scratch, connected_components, map_batches, mix, repeats, without_repeats

SHINGLE = 6
BANDS = 12
ROWS = 5
SIMILARITY = 0.8
BLANK = " \t\n\x0b\x0c\r"
SKETCH = 512
SHORT = 64
HUBS = 4
MAP = 4096
_BINS = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def line_key(line: Column) -> Column:
    """The XXH64 value of a trimmed line, as bits of a long; Spark's hash has seed 42."""
    return F.xxhash64(line)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of all lines, one after the other, and where each line's begin (and the end)."""
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    ends = np.cumsum(sizes)
    offsets = np.zeros(len(lines) + 1, dtype=np.int64)
    np.cumsum(np.maximum(1, sizes - k + 1), out=offsets[1:])
    values = np.zeros(len(raw) + k, dtype=np.uint64)
    np.add(raw, np.uint64(1), out=values[: len(raw)])
    # polynomials of the k characters from each place on; the last places of a line reach into the next one and are left out
    sums = values[k - 1 : len(raw) + k - 1].copy()
    for i in range(k - 2, -1, -1):
        sums *= BASE
        sums += values[i : len(raw) + i]
    inside = np.ones(len(raw), dtype=bool)
    for i in range(1, k):
        inside[(ends - i)[sizes >= i + 1]] = False  # a line's first place always counts
    out = sums[inside]
    if len(out) < offsets[-1]:  # empty lines have one shingle of no characters
        out = np.insert(out, np.searchsorted(np.flatnonzero(inside), ends[sizes == 0]), np.uint64(0))
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        starts, own = (ends - sizes)[short], np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 2, -1, -1):
            own = np.where(i < sizes[short], own * BASE + values[starts + i], own)
        out[offsets[short]] = own
    return mix(out), offsets


@functools.lru_cache(maxsize=4)
def _probes(size: int, tries: int = 8) -> np.ndarray:
    """Which bin an empty one borrows from, try by try."""
    i = np.arange(size * size * tries, dtype=np.uint64).reshape(size * tries, size)
    return (mix(i + np.uint64(0x51ED270B)) % np.uint64(size)).astype(np.int64)


def signatures(h: np.ndarray, offsets: np.ndarray, size: int = _BINS) -> np.ndarray:
    """One row of MinHash values per line (or other set), from hashes as of shingle_hashes."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    sig = np.full(n * size, _EMPTY, dtype=np.uint64)
    np.minimum.at(sig, row * size + bins, h)
    sig = sig.reshape(n, size)
    full = sig != _EMPTY
    at = np.argwhere(~full)
    out = sig.copy()
    for probe in _probes(size):
        if not len(at):
            break
        lender = probe[at[:, 1]]
        ok = full[at[:, 0], lender]
        out[at[ok, 0], at[ok, 1]] = sig[at[ok, 0], lender[ok]]
        at = at[~ok]
    return out


def _band_hashes(sig: np.ndarray, kind: int) -> np.ndarray:
    """(lines, BANDS) hashes of signatures, different for different bands and kinds of signature."""
    sig = sig.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(BANDS * kind), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
    return key


def independent_signatures(h: np.ndarray, offsets: np.ndarray, size: int = _BINS) -> np.ndarray:
    """MinHash values of size hash functions; work grows with size times shingles, so for small sets."""
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64))
    return np.minimum.reduceat(mix(h[:, None] ^ seeds[None, :]), offsets[:-1], axis=0)


def band_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): which set (by position) has which band key; repeats count once."""
    n = _counts(h, offsets, round(SHORT / SIMILARITY))
    few, many = np.flatnonzero((n > 0) & (n < SHORT / SIMILARITY)), np.flatnonzero(n >= SHORT)
    at, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for kind, rows, sign in ((1, few, independent_signatures), (0, many, signatures)):
        for start in range(0, len(rows), 256):  # bounds what is held at once
            own = rows[start : start + 256]
            sets = [h[offsets[i] : offsets[i + 1]] for i in own.tolist()]
            if kind:  # repeats don't change a minimum; they are only left out where they cost work
                sets = [np.unique(x) if len(x) > 2 * SHORT else x for x in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            at.append(np.repeat(own, BANDS))
            keys.append(_band_hashes(sign(np.concatenate(sets), ends), kind).reshape(-1))
    return np.concatenate(at), np.concatenate(keys)


def _counts(h: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """How many distinct hashes each row has; for rows of `most` or more, any number from `most` on; at most 1024 rows.

    The slots of a small table that a row's hashes name are no more than its distinct hashes, so only rows with fewer slots than `most` are sorted.
    """
    sizes = np.diff(offsets)
    slots = np.zeros((len(sizes), 1024), dtype=bool)
    slots.reshape(-1)[(h & np.uint64(1023)).view(np.int64) + np.repeat(np.arange(len(sizes)) * 1024, sizes)] = True
    n = np.count_nonzero(slots, axis=1)
    unsure = np.flatnonzero((n < most) & (sizes > 1))
    if len(unsure):
        own = np.zeros(len(sizes), dtype=bool)
        own[unsure] = True
        n[unsure] = distinct_rows(h[np.repeat(own, sizes)], np.concatenate(([0], np.cumsum(sizes[unsure]))))[1]
    return n


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(lines, SKETCH / 64): one bit of each of SKETCH MinHash values."""
    bits = (mix(signatures(h, offsets, SKETCH)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def distinct_rows(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, row) values, sorted: a row's number in the low 10 bits, the hash in the others; and how many each row has."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = np.sort(mix(h) & np.uint64(0xFFFFFFFFFFFFFC00) | rows)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key, np.bincount((key & np.uint64(1023)).astype(np.int64), minlength=len(offsets) - 1)


def similarities(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity, row by row, of sets of hashes (values, offsets), at most 1024 rows; 53 bits tell hashes of a row apart."""
    n = len(x[1]) - 1
    side = np.arange(2 * n, dtype=np.uint64).reshape(n, 2)
    of = np.concatenate((np.repeat(side[:, 0], np.diff(x[1])), np.repeat(side[:, 1], np.diff(y[1]))))
    key = mix(np.concatenate((x[0], y[0]))) & np.uint64(0xFFFFFFFFFFFFF800) | of
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    sizes = np.bincount((key & np.uint64(2047)).view(np.int64), minlength=2 * n).reshape(n, 2).sum(axis=1)
    both = key[1:][key[1:] ^ key[:-1] == 1]  # a hash of both sides stands at both, one after the other
    shared = np.bincount((both & np.uint64(2047)).view(np.int64) >> 1, minlength=n)
    return shared / np.maximum(1, sizes - shared)


def pieces_by_size(sizes: list[int], most: int = 120_000) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` in all (one row at least) and 512 rows: bounds what one call holds."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start == 512):
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes))] if sizes else out


def _sketched(texts: DataFrame) -> DataFrame:
    """The SKETCHED row of each line."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lines = b.column(1).to_pylist()
        parts = [sketch_rows(*shingle_hashes(lines[i:j])) for i, j in pieces_by_size([len(x) for x in lines])]
        return pa.RecordBatch.from_arrays([b.column(0), *sketch_columns(parts)], SKETCH_NAMES)

    return map_batches(texts.select("h", "line"), run, SKETCHED)


#: n: number of distinct shingles; sketch: one bit of each of SKETCH MinHash values; map: MAP bits; keys: those of the bands.
SKETCHED = "h long, n int, sketch array<long>, map array<long>, keys array<long>"
SKETCH_NAMES = ["h", "n", "sketch", "map", "keys"]


def bitmaps(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, MAP / 64): the bits that the hashes of a set name."""
    out = np.zeros((len(offsets) - 1, MAP), dtype=bool)
    out[np.repeat(np.arange(len(out)), np.diff(offsets)), (mix(h) >> np.uint64(65 - MAP.bit_length())).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.int64)


def sketch_rows(h: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list, list]:
    """n, sketch, map and keys of each set; at most 1024 sets."""
    at, keys = band_keys(h, offsets)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(len(offsets)))
    keys = keys[order].view(np.int64).tolist()
    return distinct_rows(h, offsets)[1].tolist(), sketches(h, offsets).tolist(), bitmaps(h, offsets).tolist(), [keys[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]


def sketch_columns(parts: list[tuple[list, list, list, list]]) -> list[pa.Array]:
    lists = pa.list_(pa.int64())
    return [pa.array([v for p in parts for v in p[k]], t) for k, t in enumerate((pa.int32(), lists, lists, lists))]


def _alike() -> Column:
    """Whether sketches leave it open that lines x and y are similar: expected differing bits and 4.5 deviations, for as many independent values as the line of fewer distinct shingles has; and their numbers, which bound the similarity."""
    differ = sum((F.bit_count(F.col("x_sketch")[i].bitwiseXOR(F.col("sketch")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col("x_sketch")[0].bitwiseXOR(F.col("sketch")[0])))
    share = (1 - SIMILARITY) / 2
    return (F.least("n", "x_n") + 1e-9 >= SIMILARITY * F.greatest("n", "x_n")) & (differ <= SKETCH * (F.lit(share) + 4.5 * F.sqrt(F.lit(share * (1 - share)) / F.least(F.lit(SKETCH), "n", "x_n"))))


def _near_maps() -> Column:
    """Whether bitmaps leave it open that x and y are similar: sets of n and m shingles differ in (n + m) (1 - s) / (1 + s) at most."""
    differ = F.aggregate(F.zip_with("x_map", "map", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, v: acc + v)
    return differ <= (F.col("n") + F.col("x_n")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def jaccard(a: str, b: str) -> float:
    """The definition: similarity of the sets of shingles."""
    x, y = ({line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))} for line in (a, b))
    return len(x & y) / len(x | y)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, line, h) of every non-blank line, trimmed; t, the text's XXH64 value, tells texts under one id apart."""
    at = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # trimming walks a whole line, so only lines with something to trim are
    edges = functools.reduce(lambda a, b: a | b, [f(F.col("line"), F.lit(c)) for c in BLANK for f in (F.startswith, F.endswith)])
    at = at.select("doc_id", "t", "line_no", F.when(edges, F.expr("trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM line)")).otherwise(F.col("line")).alias("line"))
    return at.where("line <> ''").withColumn("h", line_key(F.col("line")))


def _bands(docs: DataFrame) -> DataFrame:
    """(key, h) for every band of every line. A worker leaves out lines it met lately, so a hot line costs little."""
    met: set[int] = set()

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        fresh: dict[int, str] = {}
        for text in b.column(0).to_pylist():
            for line in (text or "").split("\n"):
                line = line.strip(BLANK)
                if line:
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if h not in met:
                        met.add(h)
                        fresh[h] = line
        if len(met) > 300_000:
            met.clear()
        if not fresh:
            return None
        lines, hs = list(fresh.values()), np.array(list(fresh), dtype=np.uint64).view(np.int64)
        keys, owners = [], []
        for start, stop in pieces_by_size([len(x) for x in lines]):
            at, key = band_keys(*shingle_hashes(lines[start:stop]))
            keys.append(key)
            owners.append(hs[start:stop][at])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "h"])

    return map_batches(docs.select("text"), run, "key long, h long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
        keep = [similarities(shingle_hashes(x[i:j]), shingle_hashes(y[i:j])) >= SIMILARITY for i, j in pieces_by_size([len(p) + len(q) for p, q in zip(x, y)])]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.concatenate(keep)))

    x = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"))
    y = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "line_a", "line_b")
    return map_batches(rows, run, "a long, b long")


def linked(bands: DataFrame, texts_of: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame, DataFrame], DataFrame], sketched: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """The components (node, component) of similar lines, or other sets, from bands (key, h).

    texts_of gives the texts of a table of h, verified the pairs (a, b) that are similar, sketched the SKETCHED rows of texts.
    """
    by_key = Window.partitionBy("key").orderBy(F.xxhash64("key", "h"), "h")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    # most rows are alone in their bucket; they go before the others are put in order
    met = bands.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("rows > 1").drop("rows")
    once = met.withColumn("own", F.when(F.lag("h").over(by_key).eqNullSafe(F.col("h")), None).otherwise(F.col("h")))
    hubs = once.select("key", "h", "own", *[F.nth_value("own", i + 1, True).over(so_far).alias(f"hub{i}") for i in range(HUBS)])
    # a line meets the hubs before it; the first line of a bucket has none
    members = scratch.keep(hubs.where("own IS NOT NULL AND h <> hub0").drop("own"), "members")
    pairs = members.select("h", F.explode(F.array(*[f"hub{i}" for i in range(HUBS)])).alias("hub")).where("hub <> h")
    pairs = scratch.keep(pairs.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct(), "pairs")
    texts = scratch.keep(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()), "texts")
    label = scratch.keep(connected_components(verified(pairs, texts), scratch, "first-cc"), "labels")
    # lines of large buckets beside their hubs, where labels differ still
    rest = members.where(f"h <> hub{HUBS - 1}").select("key", "h").join(label.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("label"))
    sizes = scratch.keep(rest.groupBy("key", "label").agg(F.count("*").alias("n")), "label-sizes")
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    rest = scratch.keep(rest.join(main, "key").select("key", "h", "label", "main"), "rest")
    scratch.drop("members", "pairs", "label-sizes")
    known = scratch.keep(sketched(texts.join(rest.select("h").distinct(), "h", "left_semi")), "sketches")
    rest = rest.join(known, "h")
    odd = rest.where("label <> main").select("key", "main", *[F.col(c).alias(f"x_{c}") for c in ("h", "label", *SKETCH_NAMES[1:])])
    # a pair of two odd lines is met from both sides, and taken from one; of its common buckets one counts
    new = (F.col("label") != F.col("x_label")) & ((F.col("label") == F.col("main")) | (F.col("x_h") < F.col("h")))
    more = odd.join(rest.drop("main"), "key").where(new & _alike() & (F.col("key") == F.array_min(F.array_intersect("x_keys", "keys"))) & _near_maps())
    more = scratch.keep(more.select(F.least("x_h", "h").alias("a"), F.greatest("x_h", "h").alias("b")).distinct(), "more")
    second = verified(more, texts)
    names = [label.select(F.col("node").alias(c), F.col("component").alias(f"label_{c}")) for c in "ab"]
    second = second.join(names[0], "a", "left").join(names[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = scratch.keep(connected_components(second, scratch, "second-cc"), "joined")
    scratch.drop("rest", "sketches", "more", "texts")
    both = label.withColumnRenamed("component", "label").unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
    return both.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lines, components): each line's place and h; and (h, component) of the lines that have a near copy."""
    docs = docs.select("doc_id", "text")
    all_lines = lines_of(docs)
    found = linked(_bands(docs), lambda wanted: all_lines.join(wanted, "h", "left_semi").select("h", "line").dropDuplicates(["h"]), _verified, _sketched, scratch)
    return scratch.keep(all_lines.select("doc_id", "t", "line_no", "h"), "lines"), found


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, class_id, kept) of every line of rows that don't repeat id and text."""
    scratch = Scratch(docs.sparkSession)
    lines, found = classes(docs, scratch)
    place = F.struct("doc_id", "t", "line_no")
    firsts = scratch.keep(lines.groupBy("h").agg(F.min(place).alias("place")), "places")
    # only lines with near copies meet those of their class; the others are classes of their own
    near = scratch.keep(firsts.join(found.select(F.col("node").alias("h"), F.col("component").alias("class_id")), "h"), "near")
    best = near.groupBy("class_id").agg(F.min("place").alias("best"))
    near = scratch.keep(near.join(best, "class_id").select("h", "class_id", "best"), "classes")
    scratch.drop("labels", "joined", "near")
    known = firsts.join(near, "h", "left").select("h", F.coalesce("class_id", "h").alias("class_id"), F.coalesce("best", "place").alias("best"))
    return lines.join(known, "h").select("doc_id", "t", "line_no", "class_id", place.eqNullSafe(F.col("best")).alias("kept"))


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: doc_id, line_no, class_id (the smallest XXH64 value of its component) and kept.

    Of rows that repeat id and text the lines of one can be kept; the others' have the same classes and are not.
    """
    again = repeats(docs)
    placed = _placed(without_repeats(docs, again))
    if again is not None:
        copies = placed.join(again.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "n"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")))
        copies = copies.withColumn("kept", F.lit(False)).withColumn("__copy", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
        placed = placed.unionByName(copies.select(*placed.columns))
    return placed.drop("t")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines cut that are not the first of their class; a column n_chars follows the text.

    Documents that had lines and keep none go; documents without lines stay as they are. Of rows that repeat id and text one stays.
    """
    docs = without_repeats(docs, repeats(docs))
    cut = _placed(docs).where("NOT kept").groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("line_no").alias("__cut"))
    joined = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left").drop("__id", "__t")
    numbers = F.array_sort("__cut")
    lines = F.split("text", "\n", -1)
    # the lines between the cut ones, as slices: linear in their number
    edges = F.concat(F.array(F.lit(-1)), numbers, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(0), F.size("__cut")), lambda i: F.slice(lines, F.element_at(edges, i + 1) + 2, F.element_at(edges, i + 2) - F.element_at(edges, i + 1) - 1))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = joined.withColumn("__text", text).where("__cut IS NULL OR trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM __text) <> ''")
    cols = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
