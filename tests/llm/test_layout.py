"""Vector codes, shards and Merkle manifests against brute force."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries, sharding, simhash_dedup, vector_codes
from tidemark.llm.common import Scratch, lookup

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_merkle"])
def test_like_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    want = db.sql(queries.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    mine = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    assert mine == sorted(want.select(*cols).fetchall(), key=repr)


def test_lookup_by_hot_and_rare_keys(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([None, None, "a", "a", "b", "c"])], "i int, k string")
    values = spark.createDataFrame([(None, 1, True), ("a", 2, False), ("b", 3, True), ("c", 4, False)], "k string, v int, hot boolean")
    assert sorted((r.i, r.v) for r in lookup(rows, values, ["k"], "hot").collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)]


# 11 vector codes


def codes_by_hand(rows, parts, entries, rounds, scale=256):
    """rows (vec_id, vector); the code and error of each kept row, and the codebooks, with Python's whole numbers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // parts)
    cut = [(i, [tuple((v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in kept]
    cut.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    books = [[c[1][p] for c in cut[:entries]] for p in range(parts)]

    def near(p, value):
        return min((sum((a - b) ** 2 for a, b in zip(value, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            members = {}
            for _, v in cut:
                members.setdefault(near(p, v[p])[1], []).append(v[p])
            fresh.append([tuple(sum(c) // len(c) for c in zip(*members[i])) if i in members else e for i, e in enumerate(books[p])])
        books = fresh
    out = []
    for i, v in cut:
        found = [near(p, x) for p, x in enumerate(v)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(e for e, _ in found)))
    return out, books


def test_codes_by_hand(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 2, 32).round(1)], int(i) % 3 or None) for i in rng.permutation(200)]
    rows += [(500 + i, rows[0][1], 1) for i in range(150)]  # a third of all rows share their parts
    rows += [(None, rows[1][1], None), (7, rows[2][1], 2), (900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [float("nan")] * 32, 1), (904, [float("inf")] * 32, 1), (905, [-0.001] * 5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("pos", F.lit(1)).withColumn("__hot", F.lit(1)).withColumn("code", F.lit("x"))
    coded, books = vector_codes.compress(df.repartition(5), entries=20)
    want, want_books = codes_by_hand([r[:2] for r in rows], 16, 20, 2)
    assert books.tolist() == [[list(e) for e in b] for b in want_books]
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=repr) == sorted(want, key=repr)
    assert coded.columns == ["vec_id", "label", "pos", "__hot", "code", "error"]
    labels = {r.vec_id: r.label_error for r in vector_codes.with_label_error(coded.drop("__hot")).where("vec_id IS NOT NULL").collect()}
    by_label = {}
    for r in coded.collect():
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert labels[905] == by_label[None] and labels[500] == by_label[1]
    decoded = vector_codes.decode(coded, books).where("vec_id = 500").first().decoded
    assert len(decoded) == 32 and sum((math.floor(a * 256) - math.floor(b * 256)) ** 2 for a, b in zip(decoded, rows[0][1])) == next(e for i, _, e in want if i == 500)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert vector_codes.with_label_error(coded).count() == 0 and books.size == 0
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], schema))
    assert [(r.code, r.error) for r in coded.collect()] == [("00" * 16, 0)] * 2
    coded, _ = vector_codes.compress(spark.createDataFrame([(1, [3e38], 1), (2, [-3e38], 1)], schema), entries=1)
    out = vector_codes.with_label_error(coded).collect()
    assert all(r.error >= 0 and r.label_error >= r.error for r in out)


# 12 shards


def check_slots(placed):
    seen = {}
    for r in placed:
        seen.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())


def test_sharding_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    placed = queries.op12_sharding(spark, DATA).collect()
    assert sorted(r.doc_id for r in placed) == sorted(docs)
    for r in placed:
        text = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    check_slots(placed)
    sums = [sum(r["size"] for r in placed if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= max(r["size"] for r in placed)


def tree_by_hand(rows, shards):
    """rows (rid, size, keys): the shard of each rid by exact weighted medians over sorted keys."""
    out = {}

    def split(cell, first, k):
        if k == 1 or not cell:
            out.update((rid, first) for rid, _, _ in cell)
            return
        widths = [(max(x[2][d] >> sharding.TIE_BITS for x in cell) - min(x[2][d] >> sharding.TIE_BITS for x in cell), -d) for d in range(len(cell[0][2]))]
        dim = -max(widths)[1]
        cell = sorted(cell, key=lambda x: x[2][dim])
        goal = sum(x[1] for x in cell) * (k // 2) / k
        before, n = 0, 0
        while before + cell[n][1] < goal:
            before += cell[n][1]
            n += 1
        if before + cell[n][1] - goal <= goal - before:
            n += 1
        split(cell[:n], first, k // 2)
        split(cell[n:], first + k // 2, k - k // 2)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_tree_by_hand(spark, shards):
    rng = np.random.default_rng(shards)
    rows = [(i, int(rng.pareto(1.2) * 50) + 1, "src0" if rng.random() < 0.4 else f"src{rng.integers(9)}", float(rng.integers(5))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, size long, source string, v double").repartition(3)
    dims = {"source": sharding.prefix_number(F.col("source")), "v": F.col("v")}
    keyed = sharding._keyed(df, dims, F.col("size"), Scratch(spark)).collect()
    want = tree_by_hand([(r.rid, r["size"], r["keys"]) for r in keyed], shards)
    want = {r.row.id: want[r.rid] for r in keyed}
    placed = sharding.shard(df, shards=shards, size=F.col("size"), dimensions=dims, slack=0).collect()
    assert {r.id: r.shard for r in placed} == want
    check_slots(placed)


def test_shards_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, node int"
    rows = [(None, None, None, None, None, "x", 1)] * 40 + [(1, "é" * 30, "en", "s", 30, "x", 1)] * 60
    docs = spark.createDataFrame(rows, schema)
    placed = sharding.shard(docs, shards=4).collect()
    assert len(placed) == 100 and placed[0].asDict().keys() == {*docs.columns, "slot"}
    check_slots(placed)
    sums = [sum(len((r.text or "").encode()) + 1 for r in placed if r.shard == s) for s in range(4)]
    assert max(sums) - min(sums) <= 122  # equal rows are split by their hash
    assert sharding.shard(docs.limit(0), shards=8).count() == 0
    assert sharding.shard(docs.limit(0), target_bytes=10).count() == 0
    assert {r.slot for r in sharding.shard(docs.limit(1), shards=8).collect()} == {0}
    back = sharding.write(docs, str(tmp_path / "out"), target_bytes=1000)
    assert back.count() == 100 and back.select("shard").distinct().count() == math.ceil((40 + 60 * 61) / 1000)
    with pytest.raises(ValueError):
        sharding.shard(docs)


# 13 Merkle


def manifest_by_hand(rows):
    """rows (group, id, leaf hex, changed hex or None): leaf row, subroot, root, proof digest and folded root."""
    H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // 16 * 16
            yield i - first, level[first : first + 16]
            i //= 16

    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            fold, proof = r[3] or r[2], ""
            for place, run in [*path(trees[g], i), *path(top, at)]:
                proof += "".join(run[:place] + run[place + 1 :])
                fold = H([*run[:place], fold, *run[place + 1 :]])
            out.append((r[1], r[2], trees[g][-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), fold, fold == top[-1][0]))
    return out


def test_manifest_by_hand(spark):
    """A group of five levels (two stages of proofs), groups of one row, a null group, repeated and null ids, equal rows."""
    rows = [("hot", i) for i in range(70_000)] + [(f"s{i}", i) for i in range(40)] + [(None, i) for i in range(17)] + [("", 5), ("é", 6), ("é", 6), ("é", None), ("é", None)]
    docs = spark.createDataFrame(rows, "source string, doc_id long").repartition(7)
    fields = [F.col("source"), F.col("doc_id")]
    changed = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest([F.lit("other"), F.col("doc_id")]))
    got = merkle.prove(merkle.build(docs, fields, changed=changed)).collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    H = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = manifest_by_hand([(s, i, H(said(s) + said(i)), H(said("other") + said(i)) if i is not None and i % 5 == 0 else None) for s, i in rows])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.verified for r in got) == sum(1 for _, i in rows if i is None or i % 5)


def test_manifest_of_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, None)], "doc_id long, source string, text string")
    one = merkle.prove(merkle.build(docs.limit(1), [F.col("text")])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].verified
    assert one[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    two = merkle.prove(merkle.build(docs, [F.col("text")], doc_id="doc_id")).collect()
    assert {r.leaf for r in two} == {hashlib.sha256(t).hexdigest() for t in (b"1:x", b"-")} and all(r.verified for r in two)
    assert merkle.prove(merkle.build(docs.limit(0), [F.col("text")])).count() == 0


def test_partial_parents_wait_for_their_children():
    """Events in any order and split over tasks give the same nodes; what is left open is dealt again."""
    digest = lambda i: hashlib.sha256(b"%d" % i).digest()
    leaves = [("t", 0, i, 300, digest(i)) for i in range(300)]
    whole = {n[:3]: n[4] for n in merkle.climb(iter(leaves)) if not n[5]}
    assert sorted(k[1] for k in whole) == [1] * 19 + [2] * 2 + [3]
    rng = np.random.default_rng(0)
    mixed = [leaves[i] for i in rng.permutation(300)]
    parts = [[*merkle.climb(iter(mixed[i::4]))] for i in range(4)]
    again = [*merkle.climb(n[:5] for p in parts for n in p if n[5])]
    assert {n[:3]: n[4] for p in [*parts, again] for n in p if not n[5]} == whole and not [n for n in again if n[5]]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_not_broadcast(spark):
    """A ball is 33 rows a segment, which Spark's estimate of a small table leaves out."""
    plan = planned(simhash_dedup.links(spark.range(10).select(F.col("id").alias("fp"))))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shingle_sets_are_not_broadcast(spark):
    sets = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "h long, shingles array<long>")
    plan = planned(simhash_dedup._similar(spark.createDataFrame([(1, 2)], "a long, b long"), sets))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
