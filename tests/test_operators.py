"""Hand-computed cases and edge cases of the core operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import encode, scoring, values
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, sampling
from tidemark.operators import sequence as seq
from tidemark.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(spark, xs, name="x", kind="int"):
    return spark.createDataFrame([("e", i, x) for i, x in enumerate(xs)], f"k string, seq int, {name} {kind}")


@pytest.mark.parametrize("token,want", [(None, 0), ("", 0), ("abc", 0), ("4", 4), ("3_foo_1", 3)])
def test_event_id(spark, token, want):
    assert one(spark, values.event_id(F.lit(token).cast("string"))) == want


@pytest.mark.parametrize("xs,want", [([0, 0, 3, 3, 0, 5], [2, 5]), ([3, 3, 0], [0]), ([], [])])
def test_event_starts(spark, xs, want):
    assert [r.seq for r in seq.event_starts(rows(spark, xs), ["k"], ["seq"], "x").orderBy("seq").collect()] == want


@pytest.mark.parametrize("xs,want", [([0, 0, 3], 2), ([3, 0], None), ([0, 0], None), ([None, 3], 1)])
def test_fault_onset(spark, xs, want):
    assert seq.onsets(rows(spark, xs), ["k"], "seq", "x").first()["fault_onset"] == want


def test_protective_stop(spark):
    def labels(safety):
        df = rows(spark, safety, "safety").withColumn("f", F.lit(19)).withColumn("label", F.lit(19))
        return [r.label for r in seq.align_protective_stop(df, ["k"], ["seq"], "safety", "f", "label").orderBy("seq").collect()]

    assert labels([1, 1, 3, 3]) == [0, 0, 19, 19]
    assert labels([1, 2, 3]) == [19, 19, 19]


def test_runs_and_inner_runs(spark):
    df = rows(spark, list("AAABBBBCCC"), kind="string")
    found = seq.runs(df, ["k"], ["seq"], "x")
    assert [(r.x, r.start, r.n) for r in found.orderBy("run").collect()] == [("A", 0, 3), ("B", 3, 4), ("C", 7, 3)]
    assert [(r.x, r.start, r.n) for r in seq.inner_runs(found, ["k"]).collect()] == [("B", 3, 4)]
    split = seq.runs(rows(spark, ["A", None, "A"], kind="string"), ["k"], ["seq"], "x")
    assert [(r.start, r.n) for r in split.orderBy("run").collect()] == [(0, 1), (2, 1)]


def test_change_score(spark):
    got = seq.change_score(rows(spark, [1, 3, 2]), ["k"], ["seq"], ["x"])
    assert [r.score for r in got.orderBy("seq").collect()] == [0, 2, 1]


def test_constant_features(spark):
    df = spark.createDataFrame([("e", "a", v) for v in (10.0, 10.1, 10.0)] + [("e", "b", v) for v in (0.0, 1.0)] + [("e", "c", None)], "k string, feature string, value double")
    got = {r.feature: (r.is_constant, r["mean"]) for r in agg.constant_features(df, ["k"]).collect()}
    assert got["a"][0] and abs(got["a"][1] - 10.0333333) < 1e-6
    assert not got["b"][0] and not got["c"][0]


def test_interpolation(spark):
    known = spark.createDataFrame([("e", 0, 10.0), ("e", 100, 20.0)], "k string, t int, x double")
    probes = spark.createDataFrame([("e", 25), ("e", 0), ("e", 200), ("other", 5)], "k string, t int")
    got = {(r.k, r.t): (r.x, r.how) for r in seq.interpolate(probes, known, ["k"], "t", "x").collect()}
    assert got == {("e", 25): (12.5, "interpolated"), ("e", 0): (10.0, "exact"), ("e", 200): (20.0, "interpolated"), ("other", 5): (None, None)}


def test_nearest_takes_the_smaller_of_a_tie(spark):
    left = spark.createDataFrame([("e", 5, "p")], "k string, at int, name string")
    right = spark.createDataFrame([("e", 3, 1), ("e", 7, 2)], "k string, at int, v int")
    assert joins.nearest(left, right, ["k"], "at", ["v"]).first()["v"] == 1


def test_interval_join_finds_all_across_buckets(spark):
    points = spark.range(100).select(F.lit("e").alias("k"), F.col("id").cast("int").alias("at"))
    spans = spark.createDataFrame([("e", 3, 40), ("e", 39, 41), ("e", 99, 200)], "k string, lo int, hi int")
    assert joins.interval_join(points, spans, ["k"], "at", "lo", "hi", 7).count() == 38 + 3 + 1


def test_bit_pack(spark):
    assert one(spark, values.bit_pack([F.lit(v) for v in (1, 0, 1, None)])) == 5
    assert one(spark, values.bit_pack([F.lit(None).cast("int")] * 2)) is None


@pytest.mark.parametrize("raw,want", [("mc_0019", "mc_019"), ("l2_mc_19", "mc_019")])
def test_statement_id(spark, raw, want):
    assert one(spark, values.statement_id(F.lit(raw))) == want


def test_encode(spark):
    df = spark.createDataFrame([(339.0, 58.551, None)], "timestamp_ms double, feedback_pos_0 double, gone double")
    assert df.select(encode.encode_step("timestamp_ms", encode.acronyms(["feedback_pos_0", "gone"]))).first()[0] == "t=339: fp0=58.55"
    names = ["feedback_pos_0", "feedback_par_0", "feedback_pas_1"]
    assert len(set(encode.acronyms(names).values())) == 3


@pytest.mark.parametrize("reply,want", [("ABCD", 1), ("BDCA", 1 / 3), ("DCBA", 0), ("AABC", 0)])
def test_kendall(spark, reply, want):
    assert abs(one(spark, scoring.ranking(F.lit(reply), F.lit("ABCD")))["score"] - want) < 1e-9


def test_profiles_disagree(spark):
    s = lambda c: one(spark, c)
    assert s(scoring.eval_ranking(F.lit("ABDC"), F.lit("ABCD"))) == 0.5
    assert [s(scoring.multi_select(F.lit(r), F.lit("TFFT")))["score"] for r in ("TFFF", "TTFF")] == [0.5, 0]
    assert [s(scoring.eval_multi(F.lit(r), F.lit("TFFT"))) for r in ("TFFF", "TTFF")] == [0.75, 0.5]
    assert [s(scoring.numerical(F.lit(r), F.lit("10"), F.lit(2.0)))["score"] for r in ("12", "13", "15")] == [1, 0, 0]
    assert [s(scoring.eval_numerical(F.lit(r), F.lit("10"), F.lit(2.0))) for r in ("12", "13", "15")] == [1, 0.5, 0]
    m = F.array(F.lit(0.5), F.lit(0.5))
    assert s(scoring.tensor(F.lit("[1.4, 2.8]"), F.lit("[1, 2]"), m))["score"] == 0.5
    assert s(scoring.eval_tensor(F.lit("[1.4, 2.8]"), F.lit("[1, 2]"), m)) == 0.75


def test_single_select(spark):
    got = one(spark, scoring.single_select(F.lit("I think **B**"), F.lit("B")))
    assert (got["score"], got["parsed"], got["provenance"]) == (1, "B", "lenient")
    assert one(spark, scoring.single_select(F.lit("0.38 A"), F.lit("A")))["provenance"] == "unparseable"
    assert one(spark, scoring.eval_single(F.lit("0.38 A"), F.lit("A"))) == 1
    assert one(spark, scoring.single_select(F.lit(None).cast("string"), F.lit("A")))["score"] is None


def test_cascade_takes_the_judge(spark):
    f = F.lit("multiple_choice_single_select")
    got = one(spark, scoring.cascade(F.lit("no idea"), F.lit("B"), f, F.lit("B")))
    assert (got["score"], got["provenance"]) == (1, "judge")
    assert one(spark, scoring.cascade(F.lit("no idea"), F.lit("B"), f, F.lit("NO_ANSWER")))["score"] == 0


@pytest.mark.parametrize("votes,want", [((1.0, 0.5, 0.0), 0.5), ((1.0, 0.5), 1), ((0.0, 0.5), 0), ((1.0,), 1), ((), None)])
def test_vote(spark, votes, want):
    assert one(spark, scoring.vote(F.array(*map(F.lit, votes)).cast("array<double>"))) == want


def test_chance(spark):
    def corrected(f, n, s):
        return one(spark, F.when(F.lit(f) == "free_form", F.lit(s)).otherwise(scoring.chance_corrected(F.lit(s), scoring.expected_chance(F.lit(f), F.lit(n)))))

    assert corrected("multiple_choice_single_select", 4, 1.0) == 1
    assert corrected("multiple_choice_multi_select", 4, 0.75) == 0.5
    assert abs(corrected("ranking", 4, 0.5) - 1 / 3) < 1e-9
    assert corrected("free_form", 4, 0.5) == 0.5


def test_hash_split(spark):
    assert one(spark, scoring.hash_split(F.lit("ep1"), 42)) == 6628
    assert one(spark, scoring.split_name(F.lit(6628))) == "train"


def test_reply_stem(spark):
    assert one(spark, values.reply_stem(F.lit("level1_0000_0_answer"))) == "level1_0000"


def test_identical_histograms(spark):
    df = spark.range(50).select(F.lit(1).alias("p"), F.lit("f").alias("feature"), (F.col("id") % 7).cast("double").alias("value"))
    assert abs(agg.histogram_kl(df, df, ["p"]).first()["kl"]) < 1e-12


def test_decimate_sizes_and_blocks(spark):
    df = spark.range(100).select(F.lit("e").alias("k"), F.col("id").alias("seq"), F.sin(F.col("id") / 20).alias("x"), F.col("id").alias("other"))
    got = seq.decimate(df, ["k"], "seq", 10, ["x"]).orderBy("seq").collect()
    assert [r.other for r in got] == list(range(0, 100, 10))
    assert seq.decimate(df.where("seq < 7"), ["k"], "seq", 10, ["x"]).count() == 1
    long = spark.range(4000).select(F.lit("e").alias("k"), F.col("id").alias("seq"), (F.sin(F.col("id") / 30) + F.sin(F.col("id") * 2)).alias("x"))
    whole = [r.x for r in seq.decimate(long, ["k"], "seq", 4, ["x"]).orderBy("seq").collect()]
    cut = [r.x for r in seq.decimate(long, ["k"], "seq", 4, ["x"], block=250, overlap=100).orderBy("seq").collect()]
    assert len(whole) == len(cut) == 1000
    assert np.allclose(whole, cut, atol=1e-5)
    assert np.abs(np.array(whole)[20:-20] - np.sin(np.arange(0, 4000, 4) / 30)[20:-20]).max() < 0.05  # the fast wave is gone


def test_downsample_keeps_ends_and_extremes(spark):
    xs = [float((i * 37) % 101) for i in range(200)]
    df = seq.change_score(rows(spark, xs, kind="double"), ["k"], ["seq"], ["x"])
    got = sampling.downsample(df, ["k"], "seq", "score", ["x"], 20).collect()
    at = {r.seq for r in got}
    assert {0, 199, xs.index(min(xs)), xs.index(max(xs))} <= at and len(at) == 20
    assert sampling.downsample(df.where("seq < 10"), ["k"], "seq", "score", ["x"], 20).count() == 10


def test_session_and_rate(spark):
    df = spark.createDataFrame([("e", t) for t in (0, 10, 20, 500, 510, 520, 530)], "k string, t int")
    assert sorted((r.first, r.last, r.n) for r in seq.sessions(df, ["k"], "t", 100).collect()) == [(0, 20, 3), (500, 530, 4)]
    r = seq.sampling_rate(df, ["k"], ["t"], "t").first()
    assert (r.median_dt, r.factor) == (10.0, 10)


def test_empty_tables(spark):
    df = rows(spark, [])
    assert seq.runs(df, ["k"], ["seq"], "x").count() == 0
    assert agg.modal(df, ["k"], "x").count() == 0
    assert sampling.latest(df, ["k"], "seq").count() == 0


def test_json_episodes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": 1}, {"t": 2}]')
    (tmp_path / "b.json").write_text('{"baseline": [{"t": 3}], "counterfactual": [{"t": 4}]}')
    (tmp_path / "a_metadata.json").write_text('{"n": 2}')
    got = tables.json_episodes(spark, str(tmp_path), "struct<t int>")
    assert sorted((r.episode_id, r.stream, r.seq, r.t) for r in got.collect()) == [("a", "flat", 0, 1), ("a", "flat", 1, 2), ("b", "baseline", 0, 3), ("b", "counterfactual", 0, 4)]


def test_decimate_of_episodes_too_short_for_the_filter(spark):
    """27 rows are filled and thinned, 28 are filtered; a missing value is filled first in both."""
    xs = [float(np.sin(i)) if i != 8 else None for i in range(28)]
    rows = spark.createDataFrame([(k, i, xs[i]) for k, n in (("a", 27), ("b", 28), ("c", 20)) for i in range(n)], "k string, seq long, x double")
    got = {}
    for r in seq.decimate(rows, ["k"], "seq", 4, ["x"]).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.x)
    filled = np.array([(xs[7] + xs[9]) / 2 if x is None else x for x in xs])
    assert got["a"] == pytest.approx(filled[:24:4]) and got["c"] == pytest.approx(filled[:20:4])
    assert got["b"] == pytest.approx(seq.smooth(filled[:, None], 4)[:28:4, 0]) and abs(got["b"][1] - filled[4]) > 1e-3


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 501), "b": np.repeat(3.5, 40), "c": rng.integers(0, 4, 300).astype(float), "d": np.array([7.0]), None: rng.pareto(1.0, 97), "e": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("nothing", None)]
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r.k: r.q for r in agg.quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares, bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, shares), rel=1e-12)
    whole = agg.quantiles(spark.createDataFrame(rows, "k string, x double"), [], "x", (0.5,), bins).first().q[0]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
