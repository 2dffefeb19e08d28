"""Hand-computed cases of scoring layers, filters, names, readers and sinks that no table covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import baselines, encode, scoring, values
from tidemark.operators import generators, joins, questions, relevance, sampling
from tidemark.operators import sequence as seq
from tidemark.sources import tables

SINGLE, MULTI, NUMBER, RANK, TENSOR = "multiple_choice_single_select", "multiple_choice_multi_select", "numerical", "ranking", "tensor"


@pytest.mark.parametrize(
    ("kind", "truth", "reply", "score", "provenance"),
    [
        (SINGLE, "B", "b", 1.0, "strict"),
        (SINGLE, "B", "Final answer: **B**", 1.0, "lenient"),
        (SINGLE, "C", "So the right answer is C, not A.", 1.0, "lenient"),
        (SINGLE, "B", "I take **b** here", 1.0, "lenient"),
        (SINGLE, "D", "first\n D.\nthat is all", 1.0, "lenient"),
        (SINGLE, "A", "probably A or maybe C", 0.0, "lenient"),
        (SINGLE, "A", "it drew 0.4 A of current", None, "unparseable"),
        (MULTI, "TFFT", "TFFT", 1.0, "strict"),
        (MULTI, "TFFT", "Answer: TFFF", 0.5, "lenient"),
        (MULTI, "TFFT", "so **FFFF**", 0.0, "lenient"),
        (MULTI, "TFFT", "TF", None, "unparseable"),
        (NUMBER, "12.5", "12.5", 1.0, "strict"),
        (NUMBER, "12.5", "12.5 mm", 1.0, "lenient"),
        (NUMBER, "12.5", "we get\nanswer = 12.6", 0.0, "lenient"),
        (NUMBER, "12.5", "first 3 then\nabout 12.5 in all", 1.0, "lenient"),
        (NUMBER, "12.5", "no idea", None, "unparseable"),
        (RANK, "ABCD", "ABDC", 5 / 6, "strict"),
        (RANK, "ABCD", "The order is DCBA", 0.0, "lenient"),
        (RANK, "ABCD", "AABC", 0.0, "strict"),
        (TENSOR, "[1.0, 2.0]", "[1.0, 2.0]", 1.0, "strict"),
        (TENSOR, "1_2", "x=1_y=2", 1.0, "strict"),
        (TENSOR, "1_2", "thus\n1.0_2.5", 0.0, "lenient"),
        (TENSOR, "1_2", "Answer: [1, 2] done", 1.0, "lenient"),
    ],
)
def test_cascade_layers(spark, kind, truth, reply, score, provenance):
    row = spark.createDataFrame([(kind, truth, reply)], "kind string, truth string, reply string").select(scoring.cascade("reply", "truth", "kind").alias("r")).first().r
    assert row.provenance == provenance and (row.score is None if score is None else row.score == pytest.approx(score))


def test_judge_answers_what_no_layer_reads(spark):
    row = spark.createDataFrame([("no idea", "B", SINGLE, "B")], "reply string, truth string, kind string, judged string")
    got = row.select(scoring.cascade("reply", "truth", "kind", "judged").alias("r")).first().r
    assert (got.score, got.provenance) == (1.0, "judge")


def test_missing_scores_stay_missing(spark):
    row = spark.createDataFrame([(None, "gibberish")], "s double, t string")
    got = row.select(scoring.chance_corrected("s", F.lit(0.25)), scoring.verdict("t"), values.ten_point_score("s")).first()
    assert tuple(got) == (None, None, 0.0)


def direct(sections, x):
    """The recursion itself, row by row."""
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        y, z1, z2 = np.empty_like(x), (gain - b0) * x[0], (b2 - a2 * gain) * x[0]
        for i, v in enumerate(x):
            y[i] = o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
        x = y
    return x


@pytest.mark.parametrize("q", [2, 4, 12])
def test_smoothing_is_the_recursion(q):
    x = np.random.default_rng(q).normal(size=(400, 2)).cumsum(axis=0)
    sections, pad = seq.chebyshev_sections(8, 0.05, 0.8 / q), 27
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    want = direct(sections, direct(sections, ext)[::-1])[::-1][pad : pad + len(x)]
    assert np.abs(want - seq.smooth(x, q)).max() < 1e-9


def test_chebyshev_is_flat_below_and_small_above_its_cut():
    h = seq.impulse_response(4)
    gain = lambda f: abs(np.sum(h * np.exp(-1j * np.pi * f * np.arange(len(h)))))
    low, ripple = 10 ** (-0.05 / 20), [gain(f) for f in np.linspace(0, 0.2, 60)]
    assert min(ripple) >= low - 1e-6 and max(ripple) <= 1 + 1e-6 and gain(0.2) == pytest.approx(low, abs=1e-6) and gain(0.4) < 1e-3


def test_decimate_counts_values_of_the_whole_episode(spark):
    """A column known only in the first block is filtered in all of them, or in none."""
    rows = spark.createDataFrame([(1, i, float(i % 7), float(i) if i < 10 else None) for i in range(400)], "e long, seq long, x double, y double")
    small = {r.seq: (r.x, r.y) for r in seq.decimate(rows, ["e"], "seq", 4, ["x", "y"], block=30, overlap=60).collect()}
    whole = {r.seq: (r.x, r.y) for r in seq.decimate(rows, ["e"], "seq", 4, ["x", "y"]).collect()}
    assert small.keys() == whole.keys() == set(range(0, 400, 4))
    assert max(abs(small[k][0] - whole[k][0]) for k in small) < 1e-3


def test_names_and_texts(spark):
    row = spark.createDataFrame([("cf_Local_Set ", "'2024-01-01T00:00:01Z'", "t=1: a=1, b=2.5, c=-3", "just words")], "d string, t string, e string, w string")
    got = row.select(values.dataset_stem("d"), values.iso_ms(F.translate("t", "'", '"')), encode.looks_encoded("e"), encode.looks_encoded("w"), values.fits_prompt("w", 1)).first()
    assert tuple(got) == ("local_set", 1704067201000, True, False, False)
    assert values.joint_bases([*(f"pos_{i}" for i in range(6)), *(f"cur_{i}" for i in range(5)), *(f"joint_temp_{i}" for i in range(6))]) == ["pos"]
    assert questions.joint_count(["v_0", "v_1", "v_3"], ["w_", "v_"]) == 2


def test_literal_dictionaries(spark):
    texts = ["{'a': 1, 'b': 'x, y', 'c': None, 'd': [1, 2]}", "{}", "not a dict", None, "{'a': 1, 'a': 2}"]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(values.literal_dict("t").alias("m")).collect()]
    assert got == [{"a": "1", "b": "x, y", "c": None, "d": "[1, 2]"}, {}, None, None, {"a": "2"}]


def test_columns_and_groups(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, None, "b")], "i int, n string, g string")
    assert tables.drop_empty_columns(df).columns == ["i", "g"]
    assert {r.i for r in sampling.limit_groups(df, ["g"], "i", 1).collect()} == {1, 3}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "level2").mkdir()
    (tmp_path / "level2" / "q_1.json").write_text('{"question": "why?", "answer": "T"}')
    (tmp_path / "level2" / "q_2.json").write_text('{"question": ')
    got = tables.json_documents(spark, str(tmp_path), "question string, answer string").collect()
    assert [tuple(r) for r in got] == [(2, "q_1", "why?", "T")]
    assert tables.preferred_inputs(spark, str(tmp_path), [["none"], ["level2", "level3"]]) == [f"{tmp_path}/level2"]
    with pytest.raises(FileNotFoundError):
        tables.preferred_inputs(spark, str(tmp_path), [["none"]])
    df = spark.createDataFrame([("a", [1, 2])], "id string, xs array<int>")
    for _ in range(2):
        tables.append_verdicts(df, str(tmp_path / "verdicts"))
        tables.write_traces(df, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "verdicts")).count() == 2 and spark.read.parquet(str(tmp_path / "traces")).first().xs == "[1,2]"


def test_dimension_bounds(spark):
    rows, dim = spark.createDataFrame([(1,), (9,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {(r.k, r.v is not None) for r in joins.or_any(rows, dim, "k", ["v"], ["k"]).collect()} == {(1, True), (9, True)}
    with pytest.raises(ValueError):
        joins.or_any(rows, dim, "k", ["v"], ["k"], most=1)
    with pytest.raises(ValueError):
        generators.combinations(dim, rows.withColumnRenamed("k", "e"), spark.createDataFrame([], "k int, e int"), ["k", "e"], most=1)


def test_windows_hold_what_they_should(spark):
    """Anchors stand inside event windows; cumulative ones start after their phase; gated ones share enough rows."""
    rows = spark.createDataFrame([(e, i, 5 if i in (20, 33) else 0, (i // 10) % 4) for e in range(40) for i in range(60)], "e long, seq long, event int, phase int")
    kinds = F.element_at(F.array(*map(F.lit, ("event", "cumulative", "phase_gated", "global"))), (F.col("e") % 4 + 1).cast("int"))
    spec = rows.select("e").distinct().select("e", kinds.alias("locality"), F.lit(8).alias("min_length"), F.lit(5).alias("min_overlap"), F.array(F.lit(2)).alias("start_phases"), F.array(F.lit(1)).alias("phases"))
    found = relevance.sample_windows(rows, ["e"], "seq", "event", "phase", spec, 8, 16)
    for r in found.collect():
        assert 8 <= r.length <= 16 and 0 <= r.start <= 60 - r.length
        inside = range(r.start, r.start + r.length)
        if r.locality == "event":
            assert r.sampler == "event" and (20 in inside or 33 in inside)
        if r.locality == "cumulative":
            assert r.start >= 20
        if r.locality == "phase_gated":
            assert sum((i // 10) % 4 == 1 for i in inside) >= 5
    assert relevance.relevance_report(found, rows, ["e"], "seq", "phase", spec).where("NOT validated").count() == 0


def test_short_episodes_and_missing_localities(spark):
    rows = spark.createDataFrame([(1, i, 0, 0) for i in range(5)] + [(2, i, 0, 0) for i in range(20)], "e long, seq long, event int, phase int")
    spec = spark.createDataFrame([(1, "event"), (2, "event")], "e long, locality string").select("*", F.lit(8).alias("min_length"), F.lit(5).alias("min_overlap"), F.array(F.lit(2)).alias("start_phases"), F.array(F.lit(1)).alias("phases"))
    both = relevance.sample_windows(rows, ["e"], "seq", "event", "phase", spec, 8, 16)
    assert [(r.e, r.sampler) for r in both.collect()] == [(2, "uniform_fallback")]
    assert relevance.sample_windows(rows, ["e"], "seq", "event", "phase", spec, 8, 16, fallback=False).count() == 0


def test_strategies(spark):
    rows = [(1, 7, "3.5", None, "regression"), (2, 5, "[1, 2]", None, "regression"), (2, 5, "x", None, "skip"), (1, 1, "BA", ["A", "B"], "ranking"), (1, 1, "TF", ["A", "B"], "tfft"), (1, 1, "A", ["A", "B"], "mcq"), (1, 1, "12", None, "numeric"), (1, 1, None, ["A"], "skip")]
    df = spark.createDataFrame(rows, "level int, template int, answer string, options array<string>, want string")
    assert df.where(baselines.strategy("level", "template", "answer", "options") != F.col("want")).count() == 0


def test_injection_ends_with_its_span(spark):
    rows = spark.createDataFrame([(1, i, 0.0) for i in range(10)], "e long, seq long, x double")
    spans = spark.createDataFrame([(1, 2, 4, 5.0), (1, 8, 20, 1.0)], "e long, first long, last long, delta double")
    got = [r.x for r in generators.inject(rows, spans, ["e"], "seq", "x").orderBy("seq").collect()]
    assert got == [0, 0, 5, 5, 5, 0, 0, 0, 1, 1]


def test_windows_are_as_long_as_their_spec_wants(spark):
    """A spec's least length over the caller's, but never over the caller's most; a gated window shares as many rows as its spec says."""
    rows = spark.createDataFrame([(e, i, 5 if i == 30 else 0, 1 if 25 <= i < 37 else 0) for e in range(60) for i in range(60)], "e long, seq long, event int, phase int")
    kinds = F.element_at(F.array(*map(F.lit, ("event", "cumulative", "phase_gated"))), (F.col("e") % 3 + 1).cast("int"))
    least = F.when(F.col("e") < 30, 12).otherwise(40)
    spec = rows.select("e").distinct().select("e", kinds.alias("locality"), least.alias("min_length"), F.lit(9).alias("min_overlap"), F.array(F.lit(1)).alias("start_phases"), F.array(F.lit(1)).alias("phases"))
    found = relevance.sample_windows(rows, ["e"], "seq", "event", "phase", spec, 10, 16)
    out = relevance.relevance_report(found, rows, ["e"], "seq", "phase", spec).collect()
    assert len(out) == 60 and all(r.sampler == r.locality for r in out)
    for r in out:
        if r.locality != "phase_gated":
            assert r.length >= 12 and r.length == (r.length if r.e < 30 else 16)
        else:
            assert r.phase_overlap >= 9 and r.validated
    none = spec.withColumn("min_overlap", F.lit(None).cast("int")).withColumn("min_length", F.lit(None).cast("int"))
    out = relevance.relevance_report(relevance.sample_windows(rows, ["e"], "seq", "event", "phase", none, 10, 16), rows, ["e"], "seq", "phase", none).collect()
    assert all(r.validated and 10 <= r.length <= 16 for r in out) and min(r.phase_overlap for r in out if r.locality == "phase_gated") >= 5


def test_phases_of_a_window(spark):
    phase = ["a"] * 4 + ["b"] * 4 + ["c"] * 4 + ["b"] * 5 + ["d"] * 2 + ["e"] * 4
    rows = spark.createDataFrame([(k, i, i * 10, p) for k in range(30) for i, p in enumerate(phase)], "k long, seq long, ms long, phase string")
    windows = rows.select("k").distinct().withColumn("start", F.lit(0)).withColumn("length", F.lit(len(phase)))
    got = generators.phase_isolation(rows, windows, ["k"], "seq", "ms", "phase", phases=3).collect()
    assert {(r.phase, r.answer, r.phase_length) for r in got} == {("b", 40, 4), ("c", 80, 4), ("b", 120, 5)}
    each = {}
    for r in got:
        each.setdefault(r.k, []).append(r.phase)
    assert all(sorted(v) == ["b", "c"] for v in each.values())  # "d" is short, "a" and "e" are at the ends, one run of "b" counts
    assert len(generators.phase_isolation(rows, windows, ["k"], "seq", "ms", "phase").collect()) == 30


def test_answers_at_one_time(spark):
    rows = [(-1.5, 0), (0.5, 1), (2.5, 2), (None, 0)]
    df = spark.createDataFrame(rows, "x double, axis int").withColumn("limits", F.array(F.lit(1.0), F.lit(1.0)))
    got = df.select(questions.current("x", 1.0).alias("c"), questions.within_rating("x", "limits", "axis").alias("w"), questions.within_rating("x", F.lit(None).cast("array<double>"), "axis").alias("u"), questions.tracking_error_at("x", F.lit(1.0), 1.0).alias("e")).collect()
    assert [(r.c.answer, r.c.value, r.c.holds) for r in got] == [("-1.5", -1.5, True), ("0.5", 0.5, False), ("2.5", 2.5, True), ("Unknown", None, None)]
    assert [r.w.answer for r in got] == ["No", "Yes", "No", "Unknown"] and {r.u.answer for r in got} == {"Unknown"}
    assert [(r.e.answer, r.e.holds) for r in got] == [("2.5", True), ("0.5", False), ("1.5", True), ("Unknown", None)]


def test_jerk_at_the_nearest_row(spark):
    v = [0.0, 1.0, 4.0, 9.0, 16.5, 25.0, 36.0]
    rows = spark.createDataFrame([(1, t, x) for t, x in zip((0, 1000, 2000, 3000, 4000, 5000, 6000), v)] + [(1, None, 5.0), (2, 0, 1.0), (2, 1000, 2.0)], "e long, t long, x double")
    probes = spark.createDataFrame([(1, 2500), (1, 3600), (1, 900), (2, 500), (3, 5)], "e long, t long")
    got = {(r.e, r.t): r for r in questions.jerk_at(probes, rows, ["e"], "t", "x", threshold=1.0).collect()}
    want = lambda i: ((v[i + 2] - v[i]) / 2 - (v[i] - v[i - 2]) / 2) / 2
    assert got[1, 2500].value == pytest.approx(want(2)) and got[1, 3600].value == pytest.approx(want(4)) and got[1, 2500].range == "Medium" and got[1, 2500].holds
    assert [got[k].answer for k in ((1, 900), (2, 500), (3, 5))] == ["Unknown"] * 3
