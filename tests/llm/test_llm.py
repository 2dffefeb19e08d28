"""Corpus operators against brute force, libraries and round trips."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat_format, decontaminate, html_extract, id_store, language_id, license_scan, line_dedup, queries, quality_rules, simhash_dedup
from tidemark.llm.common import Scratch, connected_components

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "ab ab ab", "x" * 5000, "naïve café 日本語 \U0001f600 e\u0301", "</s>[INST] \\ok", "a\tb\x0bc\r\nd"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, `key` int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, nulls in every column, repeats, and columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "c", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, None, None, None, None, None, None), (None, "ab ab ab", None, None, None, None, None)], DOCS)


def components_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    want = components_of(600, pairs)
    got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.component for r in got} == {i: want[i] for a, b in pairs if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# 1 chat formatting


def test_chat_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = queries.op1_chat_format(spark, DATA)
    want = con.sql(queries.ORACLES["op1_chat_format"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_chat_escapes_and_order(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("user", "</s>[INST] x"), ("assistant", "[\\INST] <s></s> \\[/INST]"), ("user", None), (None, "a")])]
    out = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = out.select(chat_format.parse_chats(F.col("formatted")).alias("t"), "valid", "first_bad_turn", "segments").first()
    assert [(x.role, x.text) for x in back.t] == [(r or "", t or "") for _, _, r, t in turns]
    assert not back.valid and back.first_bad_turn == 3
    assert "".join(s.text for s in back.segments if not s.loss).count("</s>") == 4
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_rejects_unsafe_templates():
    with pytest.raises(ValueError):
        chat_format.check_template(chat_format.INSTRUCT | {"turn_open": "<<s"})


# 2 line dedup


def brute_lines(rows):
    lines = [(d, i, x.strip(line_dedup.BLANK)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANK)]
    texts = sorted({x for *_, x in lines})
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if line_dedup.jaccard(texts[i], texts[j]) >= 0.8]
    label = dict(zip(texts, components_of(len(texts), links)))
    best = {}
    for d, i, x in sorted(lines):
        best.setdefault(label[x], (d, i))
    return {(d, i): (d, i) == best[label[x]] for d, i, x in lines}


def test_line_dedup_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seventeen small birds are watching from the old wooden fence near the river"
    texts = [base, base + " bank", "  " + base + "\t", base.replace("seventeen", "eighteen") + "\nsomething else entirely here", "", None, "short\nshort\nshorx", "tiny"]
    rows = list(enumerate(texts))
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line_no): r.kept for r in got.collect()} == brute_lines(rows)


def near_pairs(texts):
    """All pairs of similarity 0.8 or more, by an inverted index over shingles (any such pair shares one of its rarest)."""
    sets = [frozenset(x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))) for x in texts]
    often = collections.Counter(s for x in sets for s in x)
    index, pairs = collections.defaultdict(list), []
    for j, x in enumerate(sets):
        rare = sorted(x, key=lambda s: (often[s], s))[: len(x) - -(-8 * len(x) // 10) + 1]
        met = {i for s in rare for i in index[s]}
        pairs += [(i, j) for i in met if len(sets[i] & x) >= 0.8 * len(sets[i] | x)]
        for s in rare:
            index[s].append(j)
    return pairs


def same_class(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in line_dedup.line_classes(rows).collect()}
    return [of[i] for i in range(len(texts))]


def test_line_dedup_recall_on_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts = sorted({x.strip(line_dedup.BLANK) for r in rows for x in (r.text or "").split("\n") if x.strip(line_dedup.BLANK)})
    pairs, of = near_pairs(texts), same_class(spark, texts)
    assert len(pairs) > 100 and sum(of[i] == of[j] for i, j in pairs) >= 0.97 * len(pairs)
    want = components_of(len(texts), pairs)
    assert all(want[i] == want[j] for i, j in enumerate({c: i for i, c in enumerate(of)}[c] for c in of))


def test_line_dedup_recall_of_short_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(n)).strip() for n in range(8, 110) for _ in range(8)]
    texts = sorted({*base, *(x[:-1] for x in base), *(x + "q" for x in base), *(x[:3] + x[4:] for x in base)} - {""})
    pairs, of = near_pairs(texts), same_class(spark, texts)
    short = [(i, j) for i, j in pairs if len(texts[i]) < 40]
    assert len(short) > 100 and sum(of[i] == of[j] for i, j in short) >= 0.97 * len(short)
    assert sum(of[i] == of[j] for i, j in pairs) >= 0.97 * len(pairs)


def test_line_dedup_large_group_is_whole(spark):
    """A bucket with far more lines than hubs, some of them similar to a few others only."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    texts = sorted({" ".join(w if rng.random() > rate else w[::-1] for w in words) for rate in (0.02, 0.05, 0.08, 0.12, 0.2) for _ in range(60)})
    pairs, of = near_pairs(texts), same_class(spark, texts)
    assert sum(of[i] == of[j] for i, j in pairs) >= 0.99 * len(pairs)
    want = components_of(len(texts), pairs)
    assert sum(a == b for a, b in zip(components_of(len(texts), [(i, {c: i for i, c in enumerate(of)}[of[i]]) for i in range(len(texts))]), want)) >= 0.97 * len(texts)


def test_dedup_lines_tells_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "first of all\nshared line of both"), (1, "another unique line\nshared line of both"), (2, "shared line of both\nlast")], "doc_id long, text string")
    got = sorted(r.text for r in line_dedup.dedup_lines(docs).collect())
    assert sum(t.count("shared line of both") for t in got) == 1 and all(any(x in t for t in got) for x in ("first of all", "another unique line", "last"))


def test_line_dedup_lines_of_f(spark):
    base = "or the wolf that lived beyond the seven hills came down to the village every winter to look at the people and the roo"
    texts = ["f" + base + "f", base, "\x0cf" + base + "f\x0c", "f" + base + "fs\nfff\n\x0c\nor x", "for x\nff", base[:60] + "f"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_classes(docs).collect()} == brute_lines(rows)
    assert {r.line for r in line_dedup.lines_of(docs).collect()} == {x.strip(line_dedup.BLANK) for _, t in rows for x in t.split("\n") if x.strip(line_dedup.BLANK)}


def test_line_dedup_places_come_from_one_pass(spark, tmp_path):
    """Lines are cut and hashed once for their places: what is returned reads the kept places, not the texts again; edges of every blank kind are trimmed."""
    base = "a line that is long enough to have many shingles of its own and some more words behind them"
    texts = [base, *(f"{a}{base} {i}{b}" for i, (a, b) in enumerate([(" ", ""), ("", "\t"), ("\x0b", "\x0c"), ("\r", "\r"), ("\t \x0c", " \x0b")])), "\u00a0" + base + "\u3000", " \t\x0b\x0c\r\nalone\nquite different from all others", None, "", base + "\n" + base]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = line_dedup.line_classes(docs)
    assert not set(out.inputFiles()) & set(docs.inputFiles())
    assert {(r.doc_id, r.line_no): r.kept for r in out.collect()} == brute_lines(rows)


def test_line_dedup_sorts_only_lines_near_the_bound(monkeypatch):
    """Whether a line has few or many distinct shingles is sorted out only where it is open; pairs are compared in one sort."""
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(400)) for _ in range(50)]
    sorted_hashes, plain = [], line_dedup.distinct_rows
    monkeypatch.setattr(line_dedup, "distinct_rows", lambda h, offsets: sorted_hashes.append(len(h)) or plain(h, offsets))
    at, keys = line_dedup.band_keys(*line_dedup.shingle_hashes(lines))
    assert np.bincount(at).tolist() == [line_dedup.BANDS] * 50 and sorted_hashes == []
    assert line_dedup.similarities(line_dedup.shingle_hashes(lines), line_dedup.shingle_hashes(lines)).tolist() == [1.0] * 50 and sorted_hashes == []
    line_dedup.band_keys(*line_dedup.shingle_hashes([*lines, "ab" * 300]))
    assert sorted_hashes == [595]


def test_line_dedup_hashes_counts_and_similarities_like_their_definitions():
    rnd = random.Random(6)
    lines = ["", "a", "abcde", "abcdef", "abcdefg", "", "é\U0001f600日", "\ud800ab", "=" * 500, "ab" * 200]
    lines += ["".join(rnd.choice("ab") for _ in range(n)) for n in range(0, 300, 7)] + ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in range(60, 110)]
    h, offsets = line_dedup.shingle_hashes(lines)
    shingles = [[x[i : i + 6] for i in range(max(1, len(x) - 5))] for x in lines]
    assert np.diff(offsets).tolist() == [len(x) for x in shingles]
    of = {}
    for shingle, value in zip(itertools.chain.from_iterable(shingles), h.tolist()):
        assert of.setdefault(shingle, value) == value
    assert len(set(of.values())) == len(of)
    distinct = [len(set(x)) for x in shingles]
    assert [min(n, 80) for n in line_dedup._counts(h, offsets, 80).tolist()] == [min(n, 80) for n in distinct]
    at, _ = line_dedup.band_keys(h, offsets)
    assert np.bincount(at, minlength=len(lines)).tolist() == [line_dedup.BANDS * ((n < 80) + (n >= 64)) for n in distinct]
    others = [*lines[1:], lines[0]]
    got = line_dedup.similarities((h, offsets), line_dedup.shingle_hashes(others)).tolist()
    assert got == pytest.approx([line_dedup.jaccard(a, b) for a, b in zip(lines, others)])


def test_line_dedup_repeated_shingles(spark):
    texts = ["-" * 20, "-" * 60, "ha " * 12 + "x", "ha " * 30 + "x", "=" * 300, "-=" * 9, "-=" * 40, "-----", "------", "--=---", "=" * 6 + "\n" + "ab" * 3]
    rows = list(enumerate(texts))
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line_no): r.kept for r in got.collect()} == brute_lines(rows)


def test_dedup_lines_keeps_columns(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() >= 3
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 3 language


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = got.where("held_out AND lang IS NOT NULL AND length(text) > 40").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)


def test_language_edges(spark, odd):
    model = language_id.fit(["the cat and the dog"] * 5 + ["le chat et le chien"] * 5, ["en"] * 5 + ["fr"] * 5)
    got = language_id.identify(odd, model)
    assert {r.lang_pred for r in got.where("text IS NULL OR NOT text RLIKE '[a-z]'").collect()} == {"und"}
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert language_id.fit([], []).predict(["a"])[0] == ["und"]
    assert language_id.fit(["a b"], ["en"]).predict(["zzz", "1"])[0] == ["en", "und"]


def test_codewords_differ():
    for k in (2, 4, 5, 9):
        code = language_id.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k < 3 else 2)


# 4 byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, docs, odd, library):
    rng = np.random.default_rng(1)
    noise = ["".join(chr(c) for c in rng.choice([32, 10, 97, 98, 101, 233, 0x4E00, 0x1F600, 39, 49], 200)) for _ in range(30)]
    every = docs.select("text").union(odd.select("text")).union(spark.createDataFrame([(x,) for x in noise], "text string"))
    every = every.withColumn("doc_id", F.monotonically_increasing_id())
    for r in bpe.decode_documents(bpe.encode_documents(every, VOCABULARY), VOCABULARY).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "")


def test_bpe_digests(spark, odd, library):
    want = sorted((hashlib.sha256(np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in [*ODD, ODD[5], None, ODD[5]])
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(odd, VOCABULARY).collect()) == want


# 5 decontamination


def brute_contaminated(docs, items):
    out = set()
    for item, text in items:
        words, sizes = decontaminate.words_of(text or "")
        n = len(words)
        if n:
            k = min(decontaminate.SHINGLE, n)
            want = decontaminate.weights(*decontaminate.shingles_of(words, sizes, k))
            for d, t in docs:
                w, s = decontaminate.words_of(t or "")
                if any(decontaminate.similarity(decontaminate.weights(*decontaminate.shingles_of(w[i : i + n], s[i : i + n], k)), want) >= 0.8 for i in range(len(w) - n + 1)):
                    out.add((d, item))
    return out


def test_decontamination_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    passage = [word() for _ in range(40)]
    near = [*passage]
    near[20] = "changed"
    far = [w if i % 4 else word() for i, w in enumerate(passage)]
    noise = lambda n: [word() for _ in range(n)]
    texts = [noise(30) + passage + noise(30), noise(9) + near + noise(3), noise(5) + far, noise(80), passage[:20], ["Two", "Words", "here"]]
    rows = [*enumerate(" ".join(x) for x in texts), (6, None), (7, ""), (0, " ".join(texts[0]))]
    items = [(1, " ".join(passage)), (2, " ".join(passage).upper()), (3, "words HERE"), (4, ""), (5, None)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_contaminated(rows[:8], items)
    small = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_shingles=30)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == brute_contaminated(rows[:8], items)


def test_decontamination_of_documents_shorter_than_the_item(spark):
    def brute(docs, items):
        out = set()
        for item, text in items:
            words, sizes = decontaminate.words_of(text)
            n, k = len(words), min(decontaminate.SHINGLE, len(words))
            want = decontaminate.weights(*decontaminate.shingles_of(words, sizes, k))
            for d, t in docs:
                w, s = decontaminate.words_of(t)
                m = min(n, len(w))
                if m >= k and any(decontaminate.similarity(decontaminate.weights(*decontaminate.shingles_of(w[i : i + m], s[i : i + m], k)), want) >= 0.8 for i in range(len(w) - m + 1)):
                    out.add((d, item))
        return out

    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    passage = [word() for _ in range(40)]
    texts = [passage[:-1], passage[1:], passage[:2] + passage[3:], passage[:33], passage[:32], passage[:20], passage[:4], [word() for _ in range(39)], passage[:-1] + [word()], [word(), *passage[:38]]]
    docs = [(i, " ".join(x)) for i, x in enumerate(texts)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:36])), (3, " ".join(passage[5:9]))]
    want = brute(docs, items)
    assert {(0, 1), (1, 1), (2, 1), (3, 1)} <= want and (5, 1) not in want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(r.first_word, r.n_words) for r in got if (r.doc_id, r.item_id) == (0, 1)} == {(0, 39)}
    assert {r.doc_id for r in decontaminate.remove_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, spark.createDataFrame([(1, "ab ab ab")], "item_id long, text string")).count() == odd.count() - 3  # of the two rows without an id one has the words


# 6 licenses


def test_license_base(spark, docs, odd):
    def naive(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        at = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({v for _, v in at}))

    extra = spark.createDataFrame([(900, "Under the MIT License, under-the mit license; CC BY NC"), (901, "under the mitt license")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    want = sorted(repr(naive(r.text)) for r in every.collect())
    assert sorted(repr((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in license_scan.scan(every).collect()) == want


def test_license_edits(spark):
    texts = ["code is licensed under the gnu generel public licence version 3 today", "released undr the mit license", "nothing here"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "gpl-3" and got[0].spans[0].edits == 2 and got[0].spans[0].first_word == 2
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0 < got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0


def brute_spans(joined, notice, edits):
    """The span of fewest edits among all runs of words, then those before and after it; and how many edits."""
    ends = [*(i for i, c in enumerate(joined) if c == " "), len(joined)]
    starts = [0, *(i + 1 for i in ends[:-1])]
    found = []
    for start in starts:
        row = list(range(len(notice) + 1))
        for at in range(start, min(len(joined), start + len(notice) + edits)):
            last, row = row, [row[0] + 1]
            for j, c in enumerate(notice):
                row.append(min(last[j] + (c != joined[at]), last[j + 1] + 1, row[j] + 1))
            if at + 1 in ends and row[-1] <= edits:
                found.append((row[-1], start, at + 1))
    kept = []
    for e, start, end in sorted(found):
        if all(end < a or b < start for a, b, _ in kept):
            kept.append((start, end, e))
    return sorted(kept)


def test_license_adjacent_notices():
    mit, gpl = license_scan.NOTICES[0], license_scan.NOTICES[4]
    texts = [
        "released under the mit licens released under the mit license",
        "released under the mit license released under the mit licens",
        "relased undr the mit license released under the mitt license x released under the mit license",
        "a released under the mit licenses released under the mit licens and released under the mit license released",
        "released under the mit licence the mit license released under the mit licensexyz",
    ]
    rng = np.random.default_rng(6)
    for notice, _, edits in (mit, gpl):
        for _ in range(30):
            copies = []
            for _ in range(int(rng.integers(2, 5))):
                x = list(notice)
                for at in rng.choice(len(x), int(rng.integers(0, edits)), replace=False):
                    x[at] = "q" if x[at] != " " else " "
                copies.append("".join(x))
            texts.append(" ".join(copies))
    s = license_scan.Scanner()
    for text in texts:
        for notice, label, edits in (mit, gpl):
            got = [(a, b, e) for a, b, e, v in s.spans(text) if v == label]
            assert got == brute_spans(text, notice, edits), text


# 7 quality


def test_quality_counts(spark, docs, odd):
    def naive(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 3000 else None
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, covered and len(covered) or 0

    every = docs.where("length(text) < 8000").select("doc_id", "text").union(odd.select("doc_id", "text"))
    assert sorted(naive(r.text) for r in every.collect()) == sorted(tuple(r)[1:6] for r in quality_rules.statistics(every).collect())


def test_quality_rules_learn(spark):
    rng = np.random.default_rng(0)
    x = {k: rng.random(2000) for k in quality_rules.RATIOS}
    bad = (x["symbol_share"] > 0.7) & (x["mean_word"] < 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(2000, dtype=bool)
    for rule in rules:
        hit |= np.logical_and.reduce([t.holds(x) for t in rule])
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(2000, dtype=bool)) == []
    assert quality_rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


# 8 SimHash


def test_simhash_brute_force(spark, docs, odd):
    def naive(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    prints = [naive(t) for _, t in rows]
    ids = [d for d, _ in rows]
    label = components_of(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for d, c in zip(ids, label):
        least[c] = min(d, least.get(c, d))
    want = {d: (f"{p:016x}", least[c]) for d, p, c in zip(ids, prints, label)}
    got = simhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want
    assert simhash_dedup.one_per_class(odd).columns == odd.columns


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.int64)]
    prints = sorted({x ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in base for k in range(6)})
    got = {tuple(sorted((r.a, r.b))) for r in simhash_dedup.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}


def test_similar_documents_brute_force(spark, odd):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(60, 160)))]
        for k in (0, 0, 1, 2, 3, 6):
            x = [*base]
            for i in rng.choice(len(x), k, replace=False):
                x[i] = word()
            rows.append((len(rows), " ".join(x)))
    rows += [(len(rows) + i, t) for i, t in enumerate(ODD)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    prints = [simhash_dedup.fingerprint(t or "", 5) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3
    label = components_of(len(rows), [p for p in itertools.combinations(range(len(rows)), 2) if alike(*p)])
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))
    assert len(set(label)) < len(set(components_of(len(rows), [p for p in itertools.combinations(range(len(rows)), 2) if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3])))
    assert simhash_dedup.one_per_class(odd, 5, similar=True).columns == odd.columns


# 9 id store


def test_store_round_trip(spark, docs, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    every = docs.select("doc_id", "text").union(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    id_store.write(every, str(tmp_path / "s"), path)
    start, want = 0, []
    for r in every.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = id_store.read_digests(spark, str(tmp_path / "s"), path)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want
    assert got.where("NOT verified").count() == 0


def test_store_proves_recipes_by_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_store, "FAN", 2)
    path, where = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "s")
    id_store.write(spark.createDataFrame([(i, f"document number {i}") for i in range(7)], "doc_id long, text string"), where, path)
    recipes = spark.createDataFrame(spark.read.parquet(f"{where}/recipes").collect(), spark.read.parquet(f"{where}/recipes").schema)

    def bad(rows):
        rows.write.mode("overwrite").parquet(f"{where}/recipes")
        ids = {r.doc_id for r in id_store.read_ids(spark, where, path).where("NOT verified").collect()}
        assert ids == {r.doc_id for r in id_store.read_digests(spark, where, path).where("NOT verified").collect()}
        return ids

    assert bad(recipes) == set()
    other = recipes.where("doc_id = 0").select(*[F.col(c).alias(f"o_{c}") for c in ("leaf", "hashes", "sizes", "n_tokens")])
    swapped = recipes.where("doc_id = 3").crossJoin(other).select("at", "uid", "doc_id", "start", F.col("o_n_tokens").alias("n_tokens"), F.col("o_leaf").alias("leaf"), F.col("o_hashes").alias("hashes"), F.col("o_sizes").alias("sizes"))
    assert bad(recipes.where("doc_id <> 3").union(swapped)) == {2, 3}
    assert bad(recipes.where("doc_id <> 5")) == {4}
    assert bad(recipes.where("doc_id NOT IN (4, 5)")) == {6}
    assert bad(recipes.union(recipes.where("doc_id = 6").withColumn("at", F.lit(7).cast("long")).withColumn("doc_id", F.lit(9).cast("long")))) == {6, 9}


# 10 HTML


def test_html(spark):
    body = "".join(f"<p>Paragraph number {i} tells a long story about the sea &amp; the old harbour, with many words in it.</p>" for i in range(6))
    page = f"<html><head><title>x</title><script>var a=1;</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav><article><h1>The sea</h1>{body}</article><footer>Copyright 2024 All rights reserved</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<<<>>><p"), (1, "u", page)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "harbour" in got[1].text and "&amp;" not in got[1].text and "var a" not in got[1].text and "Copyright" not in got[1].text
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)


def test_html_keeps_math_svg_and_object():
    page = (
        "<p>The area <math><mi>pi</mi><mo>*</mo><msup><mi>r</mi><mn>2</mn></msup></math> of a disc.</p><svg viewBox='0 0 1 1'><path d='M0 0'/><g><text>Harbour map</text></g></svg>"
        "<p>One <script>var a</script>two <object data='x'>a fallback</object> three.</p><object><p>Still here<p>and here"
    )
    got = [t for _, t, _ in html_extract.blocks(page)]
    assert got == ["The area pi*r2 of a disc.", "Harbour map", "One", "two a fallback three.", "Still here", "and here"]
    paths = [p for p, *_ in html_extract.blocks("<div><svg><path/><rect/></svg><p>x</p></div>")]
    assert paths == [("div", "p")]


# pipeline


def test_pipeline(spark, library):
    import corpus_pipeline

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows and rows.keys() <= before.keys()
    assert all(r.ids == library.encode_ordinary(r.text or "") and r.round_trip and r.n_chars == len(r.text) for r in rows.values())
    assert all(set(r.text.split("\n")) <= set(before[d].split("\n")) for d, r in rows.items())
    assert not brute_contaminated([(d, r.text) for d, r in rows.items() if len(r.text) < 4000], items)
    prints = [simhash_dedup.fingerprint(r.text, 5) for r in rows.values()]
    assert all((a ^ b).bit_count() > 3 for a, b in itertools.combinations(prints, 2))


def test_quality_training_sample_is_the_rows_of_smallest_hash(spark):
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).alias("bad"), *[(F.col("id") + i).alias(c) for i, c in enumerate(quality_rules.COUNTS)])
    x, bad = quality_rules.as_arrays(rows, 500)
    ids = [r["doc_id"] for r in rows.orderBy(F.xxhash64(F.col("doc_id").cast("string"), "bad", *[F.expr(e) for e in quality_rules.RATIOS.values()]), "doc_id").limit(500).collect()]
    assert x["n_words"].tolist() == ids and bad.tolist() == [i % 3 == 0 for i in ids]
    assert len(quality_rules.as_arrays(rows.where("false"))[1]) == 0
