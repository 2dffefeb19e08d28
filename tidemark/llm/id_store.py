"""A content-addressed store of token ids.

Layout under one folder:
    data/kind=chunk    hash, n, payload: each distinct chunk once; payload is its ids, little-endian, `width` bytes each
    data/kind=recipe   one row per document: the hashes and sizes of its chunks, in order (as written, unordered)
    recipes            the recipes in ascending doc_id order, with `start`, the ids of all documents before, and `leaf`
    manifest           Merkle tree over the leaves: level, at, hash; a node covers FAN nodes of the level below

Ids come from the tokenizers library. Each document's ids, closed by an end id, are cut where a rolling hash of WINDOW ids
meets a mask (content-defined, so copies that are shifted still share chunks), between LEAST and MOST ids. A chunk's
address is the SHA-256 of its ids as little-endian unsigned 32-bit integers; a document's leaf is that of its addresses.

Chunks are made distinct within a task before they are shuffled by address, so a chunk that a third of all documents hold
reaches its task once per batch. Reading back checks every chunk against its address and every leaf against the manifest.

Defined cases: null text is the empty text, one chunk of the end id alone; rows that repeat a doc_id are documents of
their own, in the order of their leaves; null ids come first; an empty table gives an empty store whose manifest is empty.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held, map_batches, mix, powers, span_hashes, texts_of
from tidemark.llm.pretokenize import pieces_of_all

WINDOW = 16
AVERAGE_BITS = 9
LEAST, MOST = 128, 4096
FAN = 4096
#: Most characters (one text at least) encoded together, and most pieces handed to the model together.
BLOCK, GROUP = 2_000_000, 10
#: Most ids (one document at least) cut into chunks together.
ROOM = 500_000


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable bytes are themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The library's tokenizer behind a table of the pieces met lately.

    Where the file describes a plain byte-level BPE, texts are cut by its pattern, block by block, and each new piece goes to
    the library's model alone; texts that hold one of its added tokens, and all texts for any other file, go to the library
    whole. New pieces travel to the model GROUP at a time, parted by a byte that no merge holds: nothing merges across it.
    """

    def __init__(self, path: str, max_pieces: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path) as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        self.alphabet, self.max_pieces = _byte_alphabet(), max_pieces
        self._forget()
        merged = {c for m in model.get("merges") or () for c in (m if isinstance(m, str) else "".join(m))}
        special = any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        free = [c for b, c in self.alphabet.items() if b < 0x80 and c not in merged and c in (model.get("vocab") or {})]
        self.parting = free[0] if free and model.get("type") == "BPE" and not special else None

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        block: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not self.plain or any(t in text for t in self.added):
                out[i] = self._whole(text)
                continue
            if block and size + len(text) >= BLOCK:
                self._encode_block(texts, block, out)
                block, size = [], 0
            block.append(i)
            size += len(text) + 1
        if block:
            self._encode_block(texts, block, out)
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _encode_block(self, texts: list[str], block: list[int], out: list[np.ndarray | None]) -> None:
        text, chars, at, ends = pieces_of_all([texts[i] for i in block])
        stop = np.append(at[1:], len(text))
        codes = self._codes(text, chars, at, stop)
        # equal hashes say no more than that pieces may be equal: each is held against the one known by its hash
        if not (stop - at == self.sizes[codes]).all() or not (chars == self.chars[spans(self.at[codes], stop - at)]).all():
            for i in block:
                out[i] = self._whole(texts[i])
            return
        n = self.n_ids[codes]
        n[ends] = 0
        ids = self.ids[spans(self.ids_at[codes], n)]
        last = 0
        for i, end in zip(block, np.cumsum(n)[ends].tolist()):
            out[i] = ids[last:end]
            last = end

    def _codes(self, text: str, chars: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each piece's hash in the table, which takes in the new ones."""
        if len(self.hashes) > self.max_pieces or len(self.chars) > 16 * self.max_pieces:
            self._forget()
        have = len(self.hashes)
        found = pa.array(np.concatenate((self.hashes, span_hashes(chars, at, stop)))).dictionary_encode()
        codes = found.indices.to_numpy()[have:]
        new = np.flatnonzero(codes >= have)
        if len(new):
            first = np.empty(len(found.dictionary) - have, dtype=np.int64)
            first[codes[new[::-1]] - have] = new[::-1]
            at, stop = at[first], stop[first]
            self.at = np.append(self.at, len(self.chars) + np.cumsum(stop - at) - (stop - at))
            self.sizes = np.append(self.sizes, (stop - at).astype(np.int32))
            self.chars = np.append(self.chars, chars[spans(at, stop - at)])
            ids, n = self._tokenized([text[a:b] for a, b in zip(at.tolist(), stop.tolist())])
            self.ids_at = np.append(self.ids_at, len(self.ids) + np.cumsum(n) - n)
            self.n_ids = np.append(self.n_ids, n)
            self.ids = np.append(self.ids, ids)
            self.hashes = found.dictionary.to_numpy()
        return codes

    def _forget(self) -> None:
        """Empties the table: hashes of pieces, where their characters and ids begin and how many these are."""
        self.hashes, self.chars, self.ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=self.kind)
        self.at, self.ids_at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.sizes, self.n_ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of all pieces, one after the other, and how many each has."""
        spelt = [w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        tokenize, part = self.tokenizer.model.tokenize, self.parting
        if part is None or any(part in x for x in spelt):
            each = [[t.id for t in tokenize(x)] for x in spelt]
            return np.array([i for x in each for i in x], dtype=self.kind), np.array([*map(len, each)], dtype=np.int32)
        ids: list[int] = []
        for start in range(0, len(spelt), GROUP):
            ids += [t.id for t in tokenize(part.join(spelt[start : start + GROUP]) + part)]
        flat = np.array(ids, dtype=self.kind)
        between = flat == self.tokenizer.model.token_to_id(part)
        return flat[~between], np.diff(np.flatnonzero(between), prepend=-1).astype(np.int32) - np.int32(1)


def spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions at, at + 1, ... of n each, one after the other."""
    stop = np.cumsum(n, dtype=np.int64)
    return np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


@held
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    """The mixed values of all ids of two bytes."""
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def cuts(docs: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream; streams share one pass, ROOM ids or a stream at a time."""
    out: list[list[int]] = []
    sizes = [len(x) for x in docs]
    i = 0
    while i < len(docs):
        j, total = i + 1, sizes[i]
        while j < len(docs) and total + sizes[j] <= ROOM:
            total += sizes[j]
            j += 1
        begin = 0
        marks = _marks(np.concatenate(docs[i:j]))
        for n in sizes[i:j]:
            out.append(_chunks(n, [] if n <= LEAST else [m - begin for m in marks[bisect_left(marks, begin + WINDOW) : bisect_right(marks, begin + n)]]))
            begin += n
        i = j
    return out


def _marks(ids: np.ndarray) -> list[int]:
    """Ends of the windows of WINDOW ids whose rolling hash meets the mask; it is the same wherever a window stands."""
    n = len(ids)
    if n < WINDOW:
        return []
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_mixed()[ids] if ids.dtype.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(1))) * up[:n], out=sums[1:])
    rolling = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1]) & np.uint64((1 << AVERAGE_BITS) - 1)
    return (np.flatnonzero(rolling == 0) + WINDOW).tolist()


def _chunks(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids with these marks."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Writes the texts of docs (doc_id, text) as a store."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(vocabulary)
        chunks: dict[bytes, tuple[int, bytes]] = {}
        hashes, sizes = [], []
        end = np.array([end_id], dtype=e.kind)
        docs_ids = [np.append(own, end) for own in e.encode_all(texts_of(b.column(2)))]
        for ids, stops in zip(docs_ids, cuts(docs_ids)):
            wide = ids.astype("<u4")
            own_h, own_n, last = [], [], 0
            for stop in stops:
                h = hashlib.sha256(wide[last:stop]).digest()
                if h not in chunks:
                    chunks[h] = (stop - last, ids[last:stop].tobytes())
                own_h.append(h)
                own_n.append(stop - last)
                last = stop
            hashes.append(own_h)
            sizes.append(own_n)
        d, c = b.num_rows, len(chunks)
        uid = b.column(0).to_pylist()
        none = [None] * c
        columns = [
            pa.array(["recipe"] * d + ["chunk"] * c),
            pa.array([b"doc" + u.to_bytes(8, "big") for u in uid] + list(chunks), pa.binary()),
            pa.array(uid + none, pa.int64()),
            pa.concat_arrays([b.column(1), pa.nulls(c, b.schema.field(1).type)]),
            pa.array([None] * d + [n for n, _ in chunks.values()], pa.int32()),
            pa.array([None] * d + [p for _, p in chunks.values()], pa.binary()),
            pa.array(hashes + none, pa.list_(pa.binary())),
            pa.array(sizes + none, pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kind", "hash", "uid", "doc_id", "n", "payload", "hashes", "sizes"])

    rows = map_batches(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), run, f"kind string, hash binary, uid long, doc_id {kind}, n int, payload binary, hashes array<binary>, sizes array<int>")
    once = rows.withColumn("i", F.row_number().over(Window.partitionBy("hash").orderBy("kind"))).where("i = 1").drop("i")
    once.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/data")

    recipes = _data(spark, path, "recipe", f"uid long, doc_id {kind}, hashes array<binary>, sizes array<int>")
    ranged = recipes.withColumn("leaf", _leaf()).repartitionByRange("doc_id", "leaf", "uid").sortWithinPartitions("doc_id", "leaf", "uid").withColumn("part", F.spark_partition_id())
    ranged.withColumn("n_tokens", F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, n: acc + n)).write.mode("overwrite").parquet(f"{path}/sorted")
    ordered = spark.read.parquet(f"{path}/sorted")
    # a running sum inside each range, on top of the sums of the ranges before it
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs"))
    before = parts.select("part", *[F.coalesce(F.sum(c).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before") for c in ("ids", "docs")])
    inside = Window.partitionBy("part").orderBy("doc_id", "leaf", "uid")
    out = ordered.join(F.broadcast(before), "part")  # one row per range of a sort
    out = out.withColumn("start", F.col("ids_before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).withColumn("at", F.col("docs_before") + F.row_number().over(inside) - 1)
    out.select("at", "uid", "doc_id", "start", "n_tokens", "leaf", "hashes", "sizes").write.mode("overwrite").parquet(f"{path}/recipes")

    level = spark.read.parquet(f"{path}/recipes").select(F.col("at").alias("at"), F.col("leaf").alias("hash"))
    n, i = level.count(), 0
    while n > 1 or (i == 0 and n):
        _above(level).select(F.lit(i + 1).alias("level"), "at", "hash").write.mode("overwrite").parquet(f"{path}/manifest/level={i + 1}/")
        i += 1
        level = spark.read.parquet(f"{path}/manifest/level={i}/").select("at", "hash")
        n = -(-n // FAN)


def _leaf() -> Column:
    """The leaf of a recipe: the SHA-256 of its addresses."""
    return F.sha2(F.hex(F.aggregate("hashes", F.lit(b"").cast("binary"), lambda acc, h: F.concat(acc, h))), 256)


def _above(level: DataFrame) -> DataFrame:
    """(at, hash) of the nodes over the nodes (at, hash) of a level."""
    children = F.sort_array(F.collect_list(F.struct("at", "hash")))
    return level.groupBy(F.floor(F.col("at") / FAN).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["hash"]), ""), 256).alias("hash")).select(F.col("up").alias("at"), "hash")


def _data(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/kind={kind}") if _exists(spark, f"{path}/data/kind={kind}") else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(level, at, hash) of all nodes above the leaves; the root is the one of the highest level."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "level int, at long, hash string")
    return spark.read.parquet(f"{path}/manifest").select(F.col("level").cast("int").alias("level"), "at", "hash")


def proven(spark: SparkSession, path: str) -> DataFrame:
    """(group, proven) of each FAN recipes: whether their leaves, computed anew, give the stored node over them, and the stored nodes above give one another up to one root.

    A changed, lost or added recipe fails its group; a group lost whole fails all groups under the same node.
    """
    nodes = manifest(spark, path)
    found = _above(spark.read.parquet(f"{path}/recipes").select("at", _leaf().alias("hash")))
    top = nodes.agg(F.max("level").alias("top")).first()["top"] or 0
    stored = [nodes.where(F.col("level") == i).select("at", "hash") for i in range(1, top + 1)]
    if not top or stored[-1].count() != 1:
        return found.select(F.col("at").alias("group"), F.lit(False).alias("proven"))
    out = found.join(stored[0].withColumnRenamed("hash", "want"), "at", "left").select(F.col("at").alias("group"), F.coalesce(F.col("hash") == F.col("want"), F.lit(False)).alias("proven"))
    level = stored[0].join(found.select("at"), "at", "left_semi")
    for i in range(1, top):
        found = _above(level)
        ok = found.join(stored[i].withColumnRenamed("hash", "want"), "at").where("hash = want").select(F.col("at").alias("above"), F.lit(True).alias("ok"))
        out = out.join(ok, F.floor(F.col("group") / FAN**i) == F.col("above"), "left").select("group", (F.col("proven") & F.coalesce("ok", F.lit(False))).alias("proven"))
        level = stored[i].join(found.select("at"), "at", "left_semi")
    return out


def _with_proof(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows (with at) and proven; one row per FAN documents is sent to all tasks."""
    return rows.join(F.broadcast(proven(spark, path)), F.floor(F.col("at") / FAN) == F.col("group"), "left").drop("group").withColumn("proven", F.coalesce("proven", F.lit(False)))


def chunk_digests(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """Reads each chunk file: (hash, n, crc, sound): the crc32 of the ids, and whether address and size hold."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = encoder(vocabulary).kind
        crc, sound = [], []
        for h, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            ids = np.frombuffer(p, dtype=kind).astype("<u4")
            crc.append(zlib.crc32(ids))
            sound.append(len(ids) == n and hashlib.sha256(ids).digest() == h)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64()), pa.array(sound)], ["hash", "n", "crc", "sound"])

    return map_batches(_data(spark, path, "chunk", "hash binary, n int, payload binary"), run, "hash binary, n int, crc long, sound boolean")


_ZEROS = bytes(4 * MOST)


def crc32_of_parts(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its parts: the checksum is linear in what went before."""
    crc = 0
    for own, size in parts:
        zeros = _ZEROS[:size] if size <= len(_ZEROS) else bytes(size)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
    return crc


def read_digests(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and verified (chunks, sizes and leaf hold, and the manifest proves the leaf)."""
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("at", F.posexplode_outer("hashes").alias("ord", "hash"))
    parts = uses.join(chunk_digests(spark, path, vocabulary), "hash", "left").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("ord", "hash", "n", "crc", "sound"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, crc, ok = [], [], []
        for want, leaf, parts, sure in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            whole = all(p["sound"] for p in parts)
            n.append(sum(p["n"] or 0 for p in parts))
            crc.append(crc32_of_parts([(p["crc"], 4 * p["n"]) for p in parts]) if whole else None)
            ok.append(bool(whole and sure) and n[-1] == want and hashlib.sha256(b"".join(p["hash"] for p in parts).hex().upper().encode()).hexdigest() == leaf)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok)], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    rows = _with_proof(recipes.select("at", "doc_id", "start", "n_tokens", "leaf"), spark, path).join(parts, "at").select("doc_id", "start", "n_tokens", "leaf", "parts", "proven")
    return map_batches(rows, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """(doc_id, start, ids, verified): the documents rebuilt from recipes and chunks; ids are null where a chunk is lost."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _data(spark, path, "chunk", "hash binary, n int, payload binary")
    parts = recipes.select("at", F.posexplode_outer("hashes").alias("ord", "hash")).join(chunks, "hash", "left").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("ord", "hash", "payload"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, ok = [], []
        for parts, sure in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            own = None if any(p["payload"] is None for p in parts) else [np.frombuffer(p["payload"], dtype=encoder(vocabulary).kind) for p in parts]
            ids.append(None if own is None else np.concatenate(own).tolist())
            ok.append(own is not None and sure and all(hashlib.sha256(x.astype("<u4")).digest() == p["hash"] for x, p in zip(own, parts)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(ok, pa.bool_())], ["doc_id", "start", "ids", "verified"])

    rows = _with_proof(recipes.select("at", "doc_id", "start"), spark, path).join(parts, "at").select("doc_id", "start", "parts", "proven")
    return map_batches(rows, run, f"doc_id {kind}, start long, ids array<int>, verified boolean")
