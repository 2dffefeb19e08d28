"""Odd input for every corpus operator: empty tables, null ids, repeats, names that operators use inside."""

import time
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat_format, decontaminate, html_extract, id_store, language_id, license_scan, line_dedup, quality_rules, simhash_dedup
from tidemark.llm.pretokenize import pieces

STORE = public_tokenizers.path("byte_bpe_50k.json")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, component long, h long, ids string, score string, lang_pred string, label string, `key` string, line_no string, item_id string, best string"


@pytest.fixture(scope="module")
def clash(spark):
    long_text = "a long line of words that goes on and on " * 400 + "\n" + "x" * 30000
    texts = ["one two three four five six seven", "one two three four five six seven", long_text, None, "", "under the mit license"]
    rows = [(i, t, "en", "s", 1, 1, 1, 1, "i", "s", "l", "l", "k", "n", "i", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, *rows[0][1:])], CLASH)


def test_empty_tables(spark, clash):
    none = clash.limit(0)
    assert line_dedup.line_classes(none).count() == 0
    assert language_id.training_sample(none) == ([], [])
    assert language_id.identify(none, language_id.fit([], [])).count() == 0
    assert bpe.encode_documents(none, BPE, round_trip="ok").count() == 0 and bpe.digest_documents(none, BPE).count() == 0
    assert license_scan.scan(none).count() == 0
    assert quality_rules.statistics(none).count() == 0
    assert simhash_dedup.components(none).count() == 0 and simhash_dedup.one_per_class(none, 5, similar=True).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.digest_chats(chat_format.format_chats(turns)).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_names(spark, clash):
    n = clash.count()
    for out in (line_dedup.dedup_lines(clash), simhash_dedup.one_per_class(clash), simhash_dedup.one_per_class(clash, 5, similar=True)):
        assert out.columns == clash.columns and 0 < out.count() < n
    found = language_id.identify(clash, language_id.fit(["the cat", "le chat"], ["en", "fr"]))
    assert found.count() == n and found.schema["score"].dataType.simpleString() == "double"
    encoded = bpe.encode_documents(clash, BPE, round_trip="key")
    assert encoded.count() == n and encoded.where("NOT `key`").count() == 0 and encoded.schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.decode_documents(encoded, BPE, out="text").count() == n
    items = spark.createDataFrame([("x-1", "three four five six seven")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(clash, items).collect()} == {(0, "x-1"), (1, "x-1"), (None, "x-1")}
    assert decontaminate.remove_contaminated(clash, items).columns == clash.columns
    assert {r.doc_id for r in license_scan.scan(clash).where("base_labels = 'mit'").collect()} == {5}
    assert quality_rules.statistics(clash).count() == n
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert html_extract.extract(pages).count() == 1


def test_components_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "lonely words of one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash_dedup.components(docs).where("doc_id IS NOT NULL").collect())
    assert got == [(4, 4)] and simhash_dedup.components(docs).count() == 3


def test_chat_repeats_and_null_ids(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None)]
    out = {r.conv_id: r for r in chat_format.digest_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert out[None].n_turns == 2 and out[1].n_turns == 3 and out[None].loss_chars == 1


def test_many_languages_are_all_learned(spark):
    """Far more languages than earlier bounds allowed; the rare ones have one row each."""
    words = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q{chr(97 + (i * 7) % 26)}" for _ in range(20))
    rows = [(i, words(i % 300), f"l{i % 300:03d}") for i in range(900)] + [(1000, "zzyzx " * 30, "rare")]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({*langs}) == 301 and len(texts) <= language_id.MAX_ROWS
    model = language_id.fit(texts, langs, steps=60)
    found, score, _ = model.predict([words(5), words(280), "zzyzx " * 10])
    assert found == ["l005", "l280", "rare"] and (score >= 0).all() and (score <= 1).all()
    with pytest.raises(ValueError):
        language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=100)


def test_loss_is_the_weighted_sum_over_bits():
    model = language_id.fit(["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 3, ["en", "fr", "de"] * 3)
    x, _ = language_id.features(["the dog et katze"])
    margin = (x @ model.w + model.b)[0]
    loss = [(model.bit_weight * np.logaddexp(0, -margin * model.code[i])).sum() for i in range(3)]
    near = np.exp(-(np.array(loss) - min(loss)))
    found, score, _ = model.predict(["the dog et katze"])
    assert found == [model.langs[int(np.argmin(loss))]] and abs(score[0] - (near / near.sum()).max()) < 1e-5


def test_store_of_odd_rows(spark, clash, tmp_path):
    docs = clash.select("doc_id", "text").union(spark.createDataFrame([(7, "a <|endoftext|> b"), (8, "<|endoftext|>")], "doc_id long, text string"))
    id_store.write(docs, str(tmp_path / "odd"), STORE)
    t = Tokenizer.from_file(STORE)
    got = id_store.read_ids(spark, str(tmp_path / "odd"), STORE)
    assert got.where("NOT verified").count() == 0 and got.count() == docs.count()
    of = {}
    for r in got.collect():
        of.setdefault(r.doc_id, []).append(r.ids)
    assert of[7] == [[*t.encode("a <|endoftext|> b", add_special_tokens=False).ids, 0]] and 50256 in of[7][0]
    assert len(of[0]) == 2 and of[None] == [of[0][0]]
    starts = [(r.start, r.n_tokens) for r in id_store.read_digests(spark, str(tmp_path / "odd"), STORE).orderBy("start").collect()]
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


ODD_TEXTS = ["", " ", "a", "it's he'll' 'tis 's", "  two  spaces  ", "\n\n x\n", " lead", "tail ", "tail \t", "'", "'s", "s", "x'", "re-do", "12 345", "\x00 nul\x00", "\u3000wide\u3000 \u00a0", "naïve Ünïcode 漢字 😀😀", "a <|endoftext|> b", "it's he'll' 'tis 's"]


def test_store_encoder_takes_texts_together(monkeypatch):
    """Texts encoded together get the ids that the library gives each alone, also where hashes of pieces clash; each new piece goes to the model once, several at a time."""
    t = Tokenizer.from_file(STORE)
    want = [t.encode(x, add_special_tokens=False).ids for x in ODD_TEXTS]
    for block in (1, 20, 1 << 20):
        monkeypatch.setattr(id_store, "BLOCK", block)
        for most in (0, 10, 1000):
            e = id_store.Encoder(STORE, most)
            for _ in range(2):
                assert [x.tolist() for x in e.encode_all(ODD_TEXTS)] == want
    e = id_store.Encoder(STORE)
    calls = []
    real = e.tokenizer.model
    e.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda x: calls.append(x) or real.tokenize(x), token_to_id=real.token_to_id))
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(j, j + 100)) for j in range(0, 200, 10)]
    assert [x.tolist() for x in e.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(calls) <= 40 and sum(x.count("word") for x in calls) == len({p for x in texts for p in pieces(x) if "word" in p})
    e.encode_all(texts[::-1])
    assert len(calls) <= 40
    monkeypatch.setattr(id_store, "span_hashes", lambda chars, at, stop: (stop - at).astype(np.uint64))
    assert [x.tolist() for x in id_store.Encoder(STORE).encode_all(ODD_TEXTS)] == want


def test_store_cuts_streams_together(monkeypatch):
    """Chunks end where they do in each stream alone."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50000, n).astype("<u2") for n in (1, 5, 16, 127, 128, 129, 3000, 2, 20000, 700)] + [np.zeros(9000, dtype="<u2")]
    alone = [id_store.cuts([x])[0] for x in docs]
    assert [x[-1] for x in alone] == [*map(len, docs)] and len(alone[8]) > 10 and all(0 < b - a <= id_store.MOST for x in alone for a, b in zip([0, *x], x))
    for room in (1, 3000, 1 << 20):
        monkeypatch.setattr(id_store, "ROOM", room)
        assert id_store.cuts(docs) == alone == id_store.cuts([x.astype("<u4") for x in docs])


def test_empty_store(spark, tmp_path):
    id_store.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), STORE)
    assert id_store.read_digests(spark, str(tmp_path / "none"), STORE).count() == 0
    assert id_store.read_ids(spark, str(tmp_path / "none"), STORE).count() == 0 and id_store.manifest(spark, str(tmp_path / "none")).count() == 0


def test_quality_verdicts_follow_the_rules_in_order(spark):
    """`kept` of the query is the first rule that fires, applied by hand to the same statistics."""
    from tidemark.llm import queries

    stats = queries.op7_quality_rules(spark, "/root/testdata/sf0.001")
    rows = stats.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.rule == 0)


def test_pages_of_other_shapes(spark):
    """Comments, sidebars, forms and notices beside an article of long paragraphs."""
    para = lambda i: f"<p>Paragraph {i}: the harbour lay quiet that morning, and the boats, which had come in overnight, rocked gently while the crews slept below the deck.</p>"
    page = (
        "<html><body><div class='cookie-notice'><p>We use cookies. <a href='#'>Accept</a></p></div><header><a href='/'>Home</a> <a href='/n'>News</a></header>"
        "<aside class='sidebar'><ul><li><a href='/1'>Most read one</a></li><li><a href='/2'>Most read two</a></li></ul></aside>"
        f"<article><h1>The harbour</h1>{''.join(map(para, range(5)))}</article>"
        "<form><label>E-mail</label><input><button>Subscribe</button></form>"
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>Nice!</p></div></section><footer>Copyright 2024</footer></body></html>"
    )
    text = html_extract.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    assert all(f"Paragraph {i}:" in text for i in range(5))
    assert not any(x in text for x in ("cookies", "Most read", "Subscribe", "Copyright"))


def test_sequence_of_text_for_pages_of_the_tables(spark):
    """Every page of the tables against its <article>, read by structure."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    want = {}
    for r in pages.where(F.col("html").contains("<article")).collect():
        body = re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html)
        if body:
            inner = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", body[1])
            inner = re.sub(r"</?(?:b|i|em|strong|a|span|u|code)\b[^>]*>", "", inner)
            want[r.page_id] = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
    assert len(want) > 100 and sum(got[k] == v for k, v in want.items()) >= 0.95 * len(want)


# rows that repeat an id, a text, or both


def test_copies_do_not_fill_a_languages_share(spark):
    rows = [(1, "aa aa aa", "aa")] * 6000 + [(i, f"bb {i}", "bb") for i in range(10, 20)] + [(i, f"cc {i}", "cc") for i in range(100, 5000)]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=60)
    assert sorted(langs) == ["aa"] + ["bb"] * 10 + ["cc"] * 20 and len({*texts}) == 31


def test_clean_rows_that_share_an_id_stay(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, passage), (1, "a clean text"), (None, passage + " and more"), (None, "another clean text"), (None, None), (2, passage)]
    items = spark.createDataFrame([("x", passage)], "item_id string, text string")
    kept = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, "a clean text"), (None, "another clean text"), (None, None)], key=repr)


@pytest.mark.parametrize("similar", [False, True])
def test_one_row_of_each_class_stays(spark, similar):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "nothing like the other text at all but long enough to be one"
    rows = [(3, a, "x"), (3, a, "y"), (1, b, "z"), (None, a, "n"), (1, a, "w"), (None, b, "m"), (None, "words of a third kind stand here alone", "k"), (None, "words of a third kind stand here alone", "l"), (9, None, "e"), (9, None, "f"), (8, "", "g")]
    kept = simhash_dedup.one_per_class(spark.createDataFrame(rows, "doc_id long, text string, tag string"), 5, similar=similar).collect()
    got = sorted(((r.doc_id, r.text or "") for r in kept), key=repr)
    assert got == sorted([(1, a), (1, b), (None, "words of a third kind stand here alone"), (8, "")], key=repr)


def test_lines_of_repeated_rows_are_kept_once(spark):
    rows = [(1, "first line here\nsecond line there")] * 3 + [(2, "second line there\nthird one"), (None, "fourth")] + [(None, "fourth")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.line_classes(df).collect()
    assert len(out) == 10 and sorted((r.doc_id, r.line_no) for r in out if r.kept and r.doc_id) == [(1, 0), (1, 1), (2, 1)]
    kept = {}
    for r in out:
        kept[r.class_id] = kept.get(r.class_id, 0) + r.kept
    assert set(kept.values()) == {1} and len(kept) == 4
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=repr) == sorted([(1, rows[0][1]), (2, "third one"), (None, "fourth")], key=repr)


def test_quality_sample_of_repeated_ids(spark):
    counts = [F.col("id").cast("long").alias(c) for c in quality_rules.COUNTS]
    one_id = spark.range(40000).select(F.lit(1).alias("doc_id"), (F.col("id") % 2 == 0).alias("bad"), *counts)
    assert len(quality_rules.as_arrays(one_id, 1000)[1]) == 1000
    equal = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit(True).alias("bad"), *[F.lit(7).cast("long").alias(c) for c in quality_rules.COUNTS])
    assert len(quality_rules.as_arrays(equal, 300)[1]) == 300 and len(quality_rules.as_arrays(equal.limit(20), 300)[1]) == 20


# long texts: ten times the input takes some ten times as long


def linear(run, make, sizes=(2000, 20000)):
    """Time for the larger input over that for the smaller, the least of three runs each."""

    def least(n):
        text, best = make(n), float("inf")
        for _ in range(3):
            start = time.perf_counter()
            run(text)
            best = min(best, time.perf_counter() - start)
        return best

    return least(sizes[1]) / max(least(sizes[0]), 1e-4)


@pytest.mark.parametrize("piece", ["<div>x ", "<x y='a ", '<a b="c ', "< a <b ", "<a b=\"c' d>e", "<![x ", "<ul><li>x", "<div class=a{}>x "])
def test_pages_left_open_take_linear_time(piece):
    assert linear(html_extract.blocks, lambda n: "".join(piece.replace("{}", "bcdefg"[i % 6] * (i % 9)) for i in range(n))) < 25


def test_deep_pages_keep_their_texts():
    found = html_extract.blocks("<div class='a'>" * 3000 + "inside" + "</div>" * 2999 + "after" + "</div>" + "<p>end")
    assert [t for _, t, _ in found] == ["inside", "after", "end"] and [p for p, *_ in found] == [("div", ".a"), ("div", ".a"), ("p",)]
    quoted = html_extract.blocks('<p title="a > b">one</p><p title="never closed>two</p><p>three <b')
    assert [t for _, t, _ in quoted] == ["one", "two", "three <b"]


def test_many_misspelt_notices_take_linear_time():
    s = license_scan.scanner()
    notices = [n.replace("license", "licemse").replace("with", "wiht") for n, *_ in license_scan.NOTICES]
    make = lambda n: s.words(" ".join(notices[i % len(notices)] for i in range(n)))[0]
    assert linear(s.spans, make, (60, 600)) < 25
    found = s.spans(make(36))
    assert len({x[0] for x in found}) == 36 and {x[3] for x in found} == {label for _, label, _ in license_scan.NOTICES}
