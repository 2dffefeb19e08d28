"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, in whole numbers.

A component x becomes floor(scale * x). Vectors are cut into equal consecutive parts; equal parts at one position are one
weighted row, so Lloyd's rounds run over distinct values: a task assigns its rows to the nearest entries and sums them with
their weights, and only one row of sums per entry and task is shuffled. The driver holds codebooks (parts x entries) alone.
Codes and errors of distinct parts are then joined back to the vectors.

A part that a large share of all vectors holds is one row while codebooks are made. On the way back, parts of at least one
HOT-th of the vectors (at most HOT per position) are broadcast, and the others joined by shuffle, so no task gets them all.

Defined cases: rows whose vector is null, or holds null, NaN or an infinity, are dropped; empty vectors are kept. Shorter
vectors, and lengths that the number of parts doesn't divide, count as filled with zeros up to the next multiple that holds
the longest vector. Components beyond LIMIT (after scaling) are held at LIMIT, so that sums of squares fit 64 bits. The
codebooks start from the vectors of smallest id (null ids last, equal ids by their components); fewer vectors give fewer
entries. Repeated rows are vectors of their own. An empty table gives no rows. Columns of any name are carried along but
`code` and `error`, which replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.common import Scratch, bound_batches, lookup, map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 27
HOT = 64
BLOCK = 512


def finite(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, held at LIMIT."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def parts_of(vector: str, parts: int, width: int) -> Column:
    """The parts of a whole-number vector, in order, the last filled with zeros."""
    filled = F.concat(F.col(vector), F.array_repeat(F.lit(0), F.lit(parts * width) - F.size(vector)))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(filled, p * width + 1, width))


def nearest(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each value's own codebook (ties to the lower index), and the squared distance."""
    d = np.zeros(books.shape[:2], dtype=np.int64)
    for i in range(values.shape[1]):  # component by component: no array of all differences
        step = books[:, :, i] - values[:, i, None]
        d += step * step
    code = d.argmin(axis=1)
    return code, d[np.arange(len(code)), code]


def _values(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, width)


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, code, n, s0, s1, ...): weights and weighted sums of the components of each entry's values."""
    n_parts, entries, width = books.shape
    names = ["n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts * entries, 1 + width), dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                pos, weight, values = b.column("pos").to_numpy(), b.column("weight").to_numpy(), _values(b, width)
                key = pos * entries + nearest(values, books[pos])[0]
                np.add.at(total, key, np.column_stack([weight, values * weight[:, None]]))
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array((at // entries).astype(np.int32)), pa.array((at % entries).astype(np.int32)), *(pa.array(total[at, i]) for i in range(1 + width))], ["pos", "code", *names])

    bound_batches(distinct.sparkSession)
    partial = distinct.select("pos", "part", "weight").mapInArrow(run, "pos int, code int, " + ", ".join(f"{c} long" for c in names))
    return partial.groupBy("pos", "code").agg(*[F.sum(c).alias(c) for c in names])


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) after some rounds over weighted distinct parts; entries nothing is nearest to stay."""
    for _ in range(rounds):
        books = books.copy()
        for row in _sums(distinct, books).collect():  # at most parts x entries rows
            books[row["pos"], row["code"]] = [s // row["n"] for s in row[3:]]
    return books


def assign(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, part, weight, code, err) of distinct parts."""
    width = books.shape[2]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        code, err = nearest(_values(b, width), books[b.column("pos").to_numpy()])
        return pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), b.column("weight"), pa.array(code.astype(np.int32)), pa.array(err)], ["pos", "part", "weight", "code", "err"])

    return map_batches(distinct.select("pos", "part", "weight"), run, "pos int, part array<int>, weight long, code int, err long")


def compress(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The kept rows with code (two hex digits a part) and error (squared distances over all parts), and the codebooks.

    The vector itself is not carried along; select other wide columns away first, they are shuffled with the codes.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    scratch = Scratch(rows.sparkSession)
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (vector, "code", "error")])
    kept = rows.where(finite(vector)).select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).alias("id"), carried.alias("row"), whole_numbers(vector, scale).alias("ints"))
    kept = scratch.keep(kept, "vectors")
    total, longest = kept.agg(F.count("*"), F.max(F.size("ints"))).first()
    width = -(-(longest or 0) // parts)
    cut = parts_of("ints", parts, width)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select(cut.alias("parts")).collect()
    books = np.array([r["parts"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    spread = kept.select("rid", "row", F.posexplode(cut).alias("pos", "part"))
    distinct = scratch.keep(spread.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    if len(first):
        books = lloyd(distinct, books, rounds)
    coded = scratch.keep(assign(distinct, books), "coded")
    found = lookup(spread, coded.select("pos", "part", "code", "err", (F.col("weight") * HOT >= total).alias("__hot")), ["pos", "part"], "__hot")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))
    out = found.groupBy("rid").agg(F.first("row").alias("row"), F.array_join(digits, "").alias("code"), F.sum("err").alias("error"))
    return out.select("row.*", "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: error summed over the rows of an equal label, nulls together; sums past 64 bits are held at the largest long."""
    scratch = Scratch(coded.sparkSession)
    coded = scratch.keep(coded, "codes")
    total = coded.count()
    held = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit((1 << 63) - 1).cast("decimal(29,0)")).cast("long")
    sums = coded.groupBy(F.col(label).alias(label)).agg(held.alias("label_error"), (F.count("*") * HOT >= total).alias("__hot"))
    return lookup(coded, sums, [label], "__hot")


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE, code: str = "code", out: str = "decoded") -> DataFrame:
    """Adds the approximate vector of a code, the middles of its entries' cells, as array<double>. A null code gives null."""
    middle, at = (books + 0.5) / scale, coded.columns.index(code)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [None if c is None else middle[np.arange(len(books)), np.frombuffer(bytes.fromhex(c), dtype=np.uint8)].ravel().tolist() for c in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], [*b.schema.names, out])

    return map_batches(coded, run, StructType([*coded.schema.fields, StructField(out, ArrayType(DoubleType()))]))
