"""Multi-select and counterfactual items against plain Python."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import python_number, rounded
from tidemark.operators import counterfactual as cf
from tidemark.operators import predicates
from tidemark.operators import statements as st


def test_python_number(spark):
    xs = [0.0, 2.0, -0.25, 5e-06, -1.2e-05, 9.9e-05, 0.0001, 123456.789012, -1e-06, 2e-05]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(python_number("x")).collect()
    assert [r[0] for r in got] == [str(round(x, 6)) for x in xs]


@pytest.mark.parametrize(("fixed", "want"), [(["mc_0003", "l2_mc_4", "MC_3"], ["mc_003", "mc_004"]), (["mc_099", "no statement"], []), ([], []), (["mc_001", "mc_002", "mc_003", "mc_004", "mc_005"], ["mc_001", "mc_002", "mc_003", "mc_004"])])
def test_picked_keeps_the_fixed_and_draws_the_rest(spark, fixed, want):
    offered = F.array(*[F.lit(f"mc_00{i}") for i in range(1, 7)])
    rows = spark.range(40).select("id", st.picked(F.array(*map(F.lit, fixed)).cast("array<string>"), offered, ["id"]).alias("p")).collect()
    for r in rows:
        assert r.p[: len(want)] == want and len(r.p) == len(set(r.p)) == 4
    if len(want) < 4:
        assert len({tuple(r.p) for r in rows}) > 10
    few = spark.range(1).select(st.picked(F.array(F.lit("mc_2")), F.array(F.lit("mc_001"), F.lit("mc_002")), ["id"])).first()[0]
    assert few == ["mc_002", "mc_001"]


def truth_by_hand(i, t, base, post, success):
    """A statement over dictionaries of a base row and the rows after it, two axes."""
    eps = 1e-9
    scale = lambda x: max(eps, abs(x))
    known = lambda k: [r[k] for r in post if r[k] is not None]
    mean = lambda xs: sum(xs) / len(xs) if xs else None

    def error(r):
        e = [abs(r[f"s{a}"] - r[f"v{a}"]) for a in (0, 1) if r[f"s{a}"] is not None and r[f"v{a}"] is not None]
        return mean(e)

    errors = [e for e in map(error, post) if e is not None]
    slopes = [(known(f"e{a}")[-1] - known(f"e{a}")[0]) / scale(base[f"e{a}"]) for a in (0, 1) if base[f"e{a}"] is not None and len(known(f"e{a}")) >= 2]
    if i == "mc_003":
        return any(base[k] is not None and known(k) and min(known(k)) <= (1 - t["speed_drop_ratio"]) * base[k] for k in ("v0", "v1"))
    if i == "mc_004":
        return all(max(abs(x - base[k]) for x in known(k)) <= t["speed_stable_tol"] * scale(base[k]) for k in ("v0", "v1") if base[k] is not None and known(k))
    if i == "mc_005":
        return any(None not in (base[f"e{a}"], base[f"v{a}"], mean(known(f"e{a}")), mean(known(f"v{a}"))) and mean(known(f"e{a}")) >= (1 + t["stall_current_increase"]) * base[f"e{a}"] and mean(list(map(abs, known(f"v{a}")))) <= t["stall_speed_frac"] * scale(base[f"v{a}"]) for a in (0, 1))
    if i in ("mc_006", "mc_007"):
        if base["c"] is None or not known("c"):
            return None
        if i == "mc_006":
            return mean([x <= (1 + t["force_low_increase"]) * base["c"] for x in known("c")]) >= t["force_low_coverage"]
        return any(x >= (1 + t["force_spike_increase"]) * base["c"] for x in known("c"))
    if i == "mc_008":
        return None if error(base) is None or not errors else mean(errors) >= (1 + t["tracking_increase"]) * error(base)
    if i in ("mc_013", "mc_014"):
        if base["r"] is None or not known("r"):
            return None
        return max(known("r")) - min(known("r")) <= t["robot_current_stable_range"] * scale(base["r"]) if i == "mc_013" else mean(known("r")) >= (1 + t["robot_current_increase"]) * base["r"]
    if i == "mc_017":
        return sum(s > t["temp_rise_slope"] for s in slopes) >= round(t["temp_rise_min_axes"]) if slopes else None
    if i == "mc_019":
        if any(r["safe"] != 1 for r in post):
            return False
        terms = lambda track, c, r: [x for x in (track, c, r) if x is not None]
        moved = abs(mean(known("r")) - base["r"]) / scale(base["r"]) if base["r"] is not None and known("r") else None
        before, after = terms(error(base), base["c"], None if base["r"] is None else 0.0), terms(mean(errors), mean(known("c")), moved)
        return mean(after) <= (1 + t["no_effect_agg_increase"]) * mean(before) if before and after else None
    return success if i == "mc_020" else None


def test_multi_select_by_hand(spark):
    """All statements of a level over random episodes with gaps: each item's drawn thresholds judge it and stand in its texts."""
    rng = random.Random(3)
    rows, items = [], []
    for ep in range(60):
        n = rng.randint(4, 14)
        calm = rng.random() < 0.5
        for s in range(n):
            near = lambda x: None if rng.random() < 0.1 else x * (1 + rng.uniform(-0.02, 0.02) if calm else rng.uniform(0.2, 1.8))
            rows.append((ep, s, near(2.0), near(2.2), near(30.0), near(-1.0), near(-1.1), near(25.0), near(5.0), near(1.5), None if rng.random() < 0.01 else 1))
        items.append((ep, 2, 3, [None, True, False][ep % 3]))
    names = ["ep", "seq", "v0", "s0", "e0", "v1", "s1", "e1", "c", "r", "safe"]
    df = spark.createDataFrame(rows, "ep int, seq int, v0 double, s0 double, e0 double, v1 double, s1 double, e1 double, c double, r double, safe int")
    asked = spark.createDataFrame([*items, (999, 2, 3, None)], "ep int, base int, first int, success boolean")
    out = st.multi_select(df, asked, ["ep"], "seq", [("v0", "s0", "e0"), ("v1", "s1", "e1")], "c", "r", "safe", 2, F.array().cast("array<string>"), success="success", n=99).collect()
    drawn = {r.ep: r.asDict() for r in asked.select("ep", *[c.alias(n) for n, c in st.drawn_thresholds(["ep"]).items()]).collect()}
    assert len(out) == 60  # the item without rows goes
    texts = {s.id: s.text for s in st.CATALOGUE if 2 in s.levels}
    seen = set()
    for item in out:
        t = drawn[item.ep]
        own = [dict(zip(names, r)) for r in rows if r[0] == item.ep]
        assert sorted(item.statements) == sorted(texts) and list(item.options) == [chr(65 + i) for i in range(len(texts))]
        for i, text, said in zip(item.statements, item.options.values(), item.answer):
            want = truth_by_hand(i, t, own[2], own[3:], item.success)
            assert said == ("T" if want else "F"), (item.ep, i)
            seen.add((i, said))
            pct = {k: round(100 * v) for k, v in t.items() if k != "ep"}
            whole = texts[i].replace("{temp_rise_min_axes:d}", str(round(t["temp_rise_min_axes"]))).replace("{temp_rise_slope:.2f}", f"{100 * t['temp_rise_slope']:.2f}")
            assert text == whole.format(**pct)
    assert len(seen) >= 20  # most statements are met both ways
    assert len({r.answer for r in out}) > 20 and len({tuple(r.statements) for r in out}) > 50


def test_thresholds_spread_around_the_usual(spark):
    drawn = spark.range(2000).select(*[c.alias(n) for n, c in st.drawn_thresholds(["id"]).items()]).toPandas()
    for name, usual in predicates.THRESHOLDS.items():
        spread, least, most = st.SPREADS.get(name, (0.2, 0.0, 0.99))
        if name == "temp_rise_min_axes":
            assert set(drawn[name]) <= {1.0, 2.0, 3.0, 4.0} and drawn[name].mode()[0] == 2.0
            continue
        assert abs(drawn[name].mean() / usual - 1) < 0.03 and drawn[name].between(least, most).all()
        assert abs(drawn[name].std() / (usual * spread) - 1) < 0.1


def test_usable_statements(spark):
    rows = [(0, "l2_mc_1", [2, 3], "a", None), (1, "mc_001", [1], "b", None), (2, "mc_2", None, "c", 2), (3, "mc_3", None, " d ", None), (4, "mc_4", [2], " ", None), (5, "mc_003", [], "e", None), (6, "mc_5", [3], "f", 2)]
    df = spark.createDataFrame(rows, "line int, id string, usable_levels array<int>, statement string, applicable_level int")
    for level, want in [(1, {"mc_001": "b", "mc_003": "e"}), (2, {"mc_001": "a", "mc_002": "c", "mc_003": "e"}), (3, {"mc_001": "a", "mc_003": "e", "mc_005": "f"})]:
        assert {r.id: r.statement for r in st.usable(df, F.lit(level)).collect()} == want


# counterfactual items


@pytest.fixture(scope="module")
def streams(spark):
    """Episode 1: an event at row 40 of the second stream; 2: a collision; 3: no event; 4: the event is too early for a window; 5: no second stream."""
    rows = []
    for ep, n, onset, event in [(1, 90, 40, 5), (2, 90, 50, 17), (3, 90, None, 0), (4, 90, 10, 5), (5, 90, None, None)]:
        for s in range(n):
            rows.append((ep, "baseline", s, s * 10, 0, float(s % 7), 1.0))
            if event is not None:
                rows.append((ep, "counterfactual", s, 5000 + s * 10, event if onset is not None and onset <= s < onset + 9 else 0, 1000.0 + s, 2.5))
    return spark.createDataFrame(rows, "ep int, stream string, seq int, ms long, event int, x double, y double").repartition(4)


def test_pair_windows(spark, streams):
    got = {r.ep: r for r in cf.pair_windows(streams, ["ep"], "seq", "stream", "event").collect()}
    assert sorted(got) == [1, 2]
    for ep, onset in ((1, 40), (2, 50)):
        w = got[ep]
        assert w.onset == onset and 32 <= w.length <= min(64, onset + 1) and w.n_after == 90 - onset
        assert 0 <= w.start and w.start + w.length <= 90 and w.start + 5 <= onset <= w.start + w.length - 1 - 5
    assert [r.ep for r in cf.predictive(cf.pair_windows(streams, ["ep"], "seq", "stream", "event")).collect()] == [1]


def test_values_come_from_the_other_stream(spark, streams):
    items = cf.pair_windows(streams, ["ep"], "seq", "stream", "event")
    for r in cf.value_items(streams, items, ["ep"], "seq", "stream", "ms", ["x", "y"]).collect():
        assert r.v0 == 1000.0 + r.onset + r.steps and r.v1 == 2.5 and r.ahead == 10 * r.steps and 1 <= r.steps <= 10
        context = [s % 7 for s in range(r.start, r.start + r.length)]
        assert abs(r.std0 - np.std(context)) < 1e-6 and r.std1 == 0 and abs(r.margin0 - 0.75 * np.std(context)) < 2e-6
    last = items.withColumn("n_after", F.lit(1))
    assert cf.value_items(streams, last, ["ep"], "seq", "stream", "ms", ["x"]).count() == 0


#: Products and quotients as lineitem's, at a half in the seventh digit or beside it.
HALVES = [28.556161499999998, 65.0827485, -8.3546895, 75.96788049999999, 24.0, -0.25, 1e308, float("inf"), None]


def test_halves_fall_as_in_sql(spark):
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(HALVES)], "i int, x double").orderBy("i").select(rounded("x", 6).alias("r")).collect()]
    want = duckdb.sql(f"SELECT round(x, 6) FROM (SELECT unnest({[str(x) if x is not None else None for x in HALVES]}::DOUBLE[]) AS x)".replace("None", "NULL")).fetchall()
    assert got == [r[0] for r in want]


@pytest.mark.parametrize("price, tax", [(30705.55, 0.07), (8794.41, 0.05), (65740.15, 0.01)])
def test_answers_at_a_half(spark, price, tax):
    """The value of an item is the one SQL gives, though its seventh digit is a half."""
    value = price * (1 - tax) / 1000
    rows = spark.createDataFrame([(1, "c", s, s * 10, value) for s in range(30)], "ep int, stream string, seq int, ms long, x double")
    items = spark.createDataFrame([(1, 10, 2, 8, 20)], "ep int, onset int, start int, length int, n_after int")
    got = cf.value_items(rows, items, ["ep"], "seq", "stream", "ms", ["x", "x"], ("c", "c")).first()
    assert got.v0 == duckdb.execute("SELECT round(?::DOUBLE, 6)", [value]).fetchall()[0][0]


def test_segments_in_order(spark, streams):
    items = cf.pair_windows(streams, ["ep"], "seq", "stream", "event")
    out = cf.segment_items(streams.where("stream = 'counterfactual'"), items, ["ep"], "seq", F.col("x").cast("int").cast("string")).collect()
    assert len(out) == 2
    for r in out:
        parts = [[int(x) for x in r.options[letter].split(" | ")] for letter in r.answer]
        flat = [x for p in parts for x in p]
        assert sorted(r.options) == list("ABCD") and len({len(p) for p in parts}) == 1 and 5 <= len(parts[0]) <= 7
        assert flat == list(range(flat[0], flat[0] + len(flat))) and flat[0] >= 1000 + r.onset
    assert cf.segment_items(streams.where("stream = 'counterfactual'"), items.withColumn("n_after", F.lit(19)), ["ep"], "seq", F.lit("x")).count() == 0


def test_window_features_read_rows_once(spark):
    """One join of rows and items, one aggregation: rows after the first are not joined back to their base row."""
    rows = spark.range(20).select(F.lit(1).alias("ep"), F.col("id").alias("s"), *[(F.col("id") * 1.0).alias(c) for c in ("v", "p", "e", "c", "r")], F.lit(1).alias("safe"))
    items = spark.createDataFrame([(1, 9, 10), (2, 9, 10)], "ep int, base long, first long")
    out = predicates.window_features(rows, items, ["ep"], "s", [("v", "p", "e")], "c", "r", "safe")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    r = out.collect()
    assert len(r) == 1 and (r[0].pre_v0, r[0].min_v0, r[0].max_v0, r[0].early_e0, r[0].first_e0, r[0].last_e0, r[0].contact_most, r[0].n_e0) == (9, 10, 19, 13, 10, 19, 19, 10)
    assert predicates.window_features(rows, items.withColumn("first", F.lit(20)), ["ep"], "s", [("v", "p", "e")], "c", "r", "safe").count() == 0
    assert predicates.window_features(rows, items.withColumn("base", F.lit(30)), ["ep"], "s", [("v", "p", "e")], "c", "r", "safe").count() == 0
