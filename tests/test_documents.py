"""Noise on items, forecasts from text, printed literals, drawn chains, published tables and partners by hand."""

import ast
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import baselines, draws, literals, noise, values
from tidemark.operators import generators as gen
from tidemark.operators import joins
from tidemark.operators import sequence as seq
from tidemark.plans import documents, lookups
from tidemark.sources import tables
from tidemark.sources.scratch import made_once

# printed literals

TEXTS = [
    "{'a': 1, 'b': None, \"c\": [1, (2.5, 'x, {y}: z'), {}], 'd': {'e': True, 'f': ()}}", "{}", "", "  ", None, "[1, 2]", "nonsense", "{'a': nan}", "{'a': 'open", "{'a' 1}", "{'a': 1,, 'b': 2}",
    "{'s': \"it's\", 't': 'say \"x\"', 'u': 'both \\' and \"', 'n': -3.5, 'l': [], 'tt': ('a', 'b'), 'one': (1,)}", "{'a': '\U0001f600 \\U0001f600 \\u00fc'}", "{'a': {'b': {'c': [{'d': 'e'}]}}}", "{'x': 'tab\\tnew\\nline\\\\ \\x41 \\101'}",
]


def test_literals_as_python_reads_them(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    out = df.select("i", "t", F.to_json(literals.literal_variant("t")).alias("v"), literals.literal_text(literals.literal_entries("t")).alias("again"), literals.literal_patch("t", {"a": F.lit("7"), "zz": F.lit("'n'")}).alias("forced"), literals.literal_patch("t", {"a": F.lit("7"), "zz": F.lit("8")}, add=False).alias("known"))
    for r in out.collect():
        try:
            want = ast.literal_eval(r.t)
        except (ValueError, SyntaxError, TypeError):
            assert r.v is None and r.again is None and r.known == r.t and r.forced == "{'a': 7, 'zz': 'n'}"
            continue
        assert json.loads(r.v) == json.loads(json.dumps(want))
        if not isinstance(want, dict):
            assert r.again is None
            continue
        assert r.again == str(want) and r.forced == str({**want, "a": 7, "zz": "n"})
        assert r.known == (str({k: 7 if k == "a" else v for k, v in want.items()}) if want else r.t)


def test_literals_spelled_otherwise(spark):
    text = "{2: (5), 'u': -.5, 'w': 1_000, 'z': 5., 'e': 1e3, 'q': 'a\\qb', }"
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(literals.literal_variant("t"))).first()[0]
    assert json.loads(got) == {"2": 5, "u": -0.5, "w": 1000, "z": 5, "e": 1000, "q": "a\\qb"}


def test_episode_metadata(spark):
    rows = [("{'fault_id': 3, 'task': 'lift', 'payload_cog_configured': [0, 0.5]}", "{'fault_id': 9}"), ("{'fault_id': None, 'condition': 'unknown'}", "{'fault_id': 9.0}"), ("{'condition': 'tuned'}", None), ("oops", "[1]"), (None, None)]
    got = [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, f string").orderBy("i").select(literals.episode_metadata("m", "f").alias("x")).collect()]
    assert [(r.robot_type, r.task, r.condition, r.fault_id, r.payload_cog_configured) for r in got] == [("ur3", "lift", "fault", 3, "[0,0.5]"), ("ur3", "unknown", "fault", 9, None), ("ur3", "unknown", "tuned", None, None), ("ur3", "unknown", "normal", None, None), ("ur3", "unknown", "normal", None, None)]


@pytest.mark.parametrize("few, join", [(100, "BroadcastHashJoin"), (1, "SortMergeJoin")])
def test_made_once_for_equal_texts(spark, few, join):
    """200 rows have three texts, a null among them: the costly expression sees three."""
    seen = []

    def make(d):
        seen.append(d.count())
        return d.select("t", F.length("t").alias("n"))

    rows = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), (F.col("id") % 3).cast("int"))).alias("t"))
    out = made_once(rows, ["t"], make, few)
    assert seen == [3] and join in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.t, r.n) for r in out.collect()) == [(i, "x" * (i % 3) if i % 3 else None, i % 3 or None) for i in range(200)]


@pytest.mark.parametrize("name, plans", [("literal_patched", documents), ("nested_metadata", documents), ("literal_metadata", lookups)])
def test_literals_are_read_once_for_equal_texts(spark, monkeypatch, name, plans):
    seen = []

    def count(rows, by, make):
        seen.append((rows.count(), rows.select(*by).distinct().count()))
        return made_once(rows, by, make)

    monkeypatch.setattr(plans, "made_once", count)
    assert getattr(plans, name)(spark, "/root/testdata/sf0.001").count() == seen[0][0] > seen[0][1]


# noise

SERIES = ["t=0: a=1, b=58.55, c=x, d=1.5, e=2", "t=10: a=2, b=58.5, c=y, d=nan, e=2.25", "t=20: a=3, b=-3, c=z, d=2.5, e=7"]
ITEM = "id string, context struct<time_series:array<string>,series_a:struct<time_series:array<string>,name:string>,series_b:struct<time_series:array<string>>,other:int>, options map<string,string>, text string"


@pytest.fixture(scope="module")
def items(spark):
    options = {"A": "a=1.5, b=2.5, c=3 | a=2.5, b=2.55, c=4", "B": "x = 5 it says", "C": None}
    rows = [("6f1c2a00-0000-4000-8000-0000000000ff", (SERIES, (SERIES[:1], "n"), None, 5), options, "q"), ("no uuid", None, None, "r"), ("u", ([], None, (["t=1: plain"],), 1), {}, None), ("6F1C2A00-0000-4000-8000-0000000000FF", (SERIES, None, None, 5), options, "q")]
    return spark.createDataFrame(rows, ITEM)


def test_noise_without_spread(items):
    """Whole numbers, texts, times and odd numbers stay; float features keep their first value."""
    out = noise.noise_items(items, 0.0)
    first, none, empty, _ = out.collect()
    assert out.columns == [*items.columns, "noise"]
    assert first.context.time_series == ["t=0: a=1, b=58.55, c=x, d=1.5, e=2.00", "t=10: a=2, b=58.55, c=y, d=nan, e=2.00", "t=20: a=3, b=58.55, c=z, d=2.5, e=2.00"]
    assert first.context.series_a == (SERIES[:1], "n") and first.context.other == 5 and first.text == "q"
    assert first.options == {"A": "a=1.5, b=2.50, c=3 | a=1.5, b=2.50, c=4", "B": "x = 5 it says", "C": None}
    assert (first.noise.applied, first.noise.sigma, first.noise.rng_seed) == (True, 0.0, 255)
    assert none.context is None and none.options is None
    assert empty.context.time_series == [] and empty.context.series_b.time_series == ["t=1: plain"] and empty.options == {}


def test_noise_without_spread_on_constant_series_changes_nothing(spark):
    lines = [f"t={i}: a={i}, b=2.50, c=-0.25, d=word" for i in range(8)]
    df = spark.createDataFrame([("x", (lines, None, None, 1), {"A": " | ".join(x.split(": ")[1] for x in lines)}, "t")], ITEM)
    assert noise.noise_items(df, 0.0).drop("noise").collect() == df.collect()


def test_noise_walks(spark, items):
    a, _, _, b = noise.noise_items(items, 0.5).collect()
    assert a.context.time_series == b.context.time_series and a.options == b.options  # by the seed alone
    assert a.options["A"] != noise.noise_items(items, 0.1).first().options["A"]
    lines = [f"t={i}: a={i}, b=2.500, c=1.5" for i in range(400)]
    df = spark.createDataFrame([(f"item {i}", (lines, None, None, 1), None, "t") for i in range(4)], ITEM)
    steps = []
    for r in noise.noise_items(df, 0.2).collect():
        rows = [dict(p.split("=") for p in x.split(": ")[1].split(", ")) for x in r.context.time_series]
        assert [x["a"] for x in rows] == [str(i) for i in range(400)] and rows[0]["b"] == "2.500"
        steps.append(np.diff([float(x["b"]) for x in rows]))
    assert abs(np.std(steps) - 0.2) < 0.02 and abs(np.mean(steps)) < 0.02 and abs(np.corrcoef(steps[0], steps[1])[0, 1]) < 0.15


# forecasts from text


def test_vector_forecast_by_hand(spark):
    lines = [f"t={t}: jp0={2 * t + 1}, x=9, jp1={5 - t}.5" for t in (0, 10, 20)]
    short = {"jp0": "joint_pos_0", "jp1": "joint_pos_1"}
    rows = [
        (1, lines, short, "value at T+30ms?", "[1,2]"), (2, lines, short, "no horizon", "[1,2]"), (3, lines, short, "T+30ms", "B"), (4, lines[:1], short, "T+30ms", "[1,2]"), (5, [], short, "T+30ms", "[1,2]"),
        (6, ["jp0=9", *lines[:2], "t=20: jp1=7.0"], short, "t+5 MS", "[1,2,3]"), (7, ["t=0: jp0=1", "t=10: jp0=x"], short, "T+10ms", "[1]"), (8, ["t=5: joint_pos_0=1", "t=5: joint_pos_0=3"], {}, "T+10ms", "[1]"), (9, None, short, "T+10ms", "[1]"),
    ]
    df = spark.createDataFrame(rows, "id int, rows array<string>, short map<string,string>, question string, answer string")
    got = {r.id: r.forecast for r in baselines.vector_forecast(df, ["id"], "rows", "short", F.lit("joint_pos"), "answer", "question").collect()}
    a, b = np.polyfit([0, 10, 20], [5.5, -5.5, -15.5], 1)
    assert got[1] == pytest.approx([101.0, a * 50 + b], abs=1e-5)
    assert [got[i] for i in (2, 3, 4, 5, 9)] == [None] * 5
    a, b = np.polyfit([0, 10, 20], [5.5, -5.5, 7.0], 1)  # the row without a time counts for no axis
    assert got[6] == pytest.approx([51.0, a * 25 + b, 0.0], abs=1e-5) and got[7] == [1.0] and got[8] == [2.0]


# any depth


def test_finite_nested(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, [(1.0, [nan, 2.0])], {"a": {"b": inf}}, [None], "t"), (None, None, None, [], None)], "x double, l array<struct<a:double,b:array<double>>>, m map<string,map<string,double>>, n array<float>, s string")
    a, b = values.without_infinities(df).collect()
    assert a.asDict(True) == {"x": None, "l": [{"a": 1.0, "b": [None, 2.0]}], "m": {"a": {"b": None}}, "n": [None], "s": "t"} and tuple(b) == (None, None, None, [], None)
    assert values.without_infinities(df).schema.simpleString() == df.schema.simpleString()
    assert math.isinf(values.without_infinities(df, infinities=False).first().m["a"]["b"])


# the chain of events


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_event_chain_as_row_by_row(spark, block):
    sizes, share, least, most, ids = {"a": 500, "b": 3, "c": 2, "d": 64, "e": 0, "f": 129}, 0.15, 3, 9, [4, 6, 8]
    rows = spark.createDataFrame([(k, i, n) for k, n in sizes.items() for i in range(n)], "k string, i int, n int").withColumn("longest", F.least(F.lit(most), F.col("n") - F.col("i")))
    drawn = {(r.k, r.i): r for r in rows.select("k", "i", draws.draw(1_000_000, "start", "k", "i").alias("on"), (F.lit(least) + draws.draw(F.col("longest") - least + 1, "run", "k", "i")).alias("d"), draws.draw(3, "which", "k", "i").alias("e")).collect()}
    want = []
    for k, n in sizes.items():
        i = 0
        while i < n:
            r = drawn[k, i]
            if n - i >= least and r.on < share * 1_000_000:
                want.append((k, i, i + r.d - 1, ids[r.e]))
                i += r.d
            else:
                i += 1
    episodes = spark.createDataFrame(list(sizes.items()), "k string, n int")
    got = sorted(tuple(r) for r in gen.event_chain(episodes, ["k"], "n", ids, share, least, most, block=block).collect())
    assert got == sorted(want) and len(want) > 30


# tables


def test_keyed_table_needs_no_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(i % 13, i, float(i)) for i in range(500)], "k int, i int, x double")
    kept = tables.write_keyed(rows, "keyed_by_hand", str(tmp_path / "keyed"), ["k"], ["i"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = seq.ordered(["k"], ["i"])
        done = kept.withColumn("d", F.col("x") - F.lag("x").over(w))
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and done.where("d = 13").count() == 487
        thin = seq.decimate(kept, ["k"], "i", 4, ["x"])
        assert "Exchange" not in thin._jdf.queryExecution().executedPlan().toString() and thin.count() > 0
        both = kept.join(kept.groupBy("k").agg(F.max("i").alias("last")), "k")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE keyed_by_hand")


def test_thinned_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, i * 0.008, float(np.sin(i / 9)), "c") for k in "ab" for i in range(40)] + [("s", i, i * 0.5, float(i), "d") for i in range(20)], "k string, i long, rec_timestamp double, x double, category string")
    got = {}
    for r in tables.thinned_by_key(rows, "thinned_by_hand", str(tmp_path / "thin"), ["k"], "i", 4, ["x", "rec_timestamp"], 2).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r)
    spark.sql("DROP TABLE thinned_by_hand")
    assert [len(got[k]) for k in "abs"] == [10, 10, 5] and {r.category for r in got["s"]} == {"d"}
    assert [r.rec_timestamp for r in got["s"]] == [0, 2000, 4000, 6000, 8000] and [r.x for r in got["s"]] == [0.0, 4.0, 8.0, 12.0, 16.0]
    want = seq.smooth(np.array([[np.sin(i / 9), i * 0.008] for i in range(40)]), 4)[::4]
    assert [r.x for r in got["a"]] == pytest.approx(want[:, 0]) and [r.rec_timestamp for r in got["a"]] == [int(t * 1000) for t in want[:, 1]]


def test_publish(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"v{i}") for i in range(50)], "i int, v string").write.parquet(path)
    read = lambda p=path: {r.i: r.v for r in spark.read.parquet(p).collect()}
    fix = lambda n, v: tables.patch(spark.read.parquet(path), F.col("i") < n, {"v": F.lit(v)})
    assert [(r.before.v, r.after.v) for r in tables.changed_rows(spark.read.parquet(path), F.col("i") < 2, {"v": F.lit("v0")}).collect()] == [("v1", "v0")]
    backup = tables.publish(fix(10, "new"), path, rows=50)
    assert read()[9] == "new" and read()[10] == "v10" and read(backup)[9] == "v9"
    assert tables.publish(fix(20, "newer"), path) == backup
    assert read()[0] == "newer" and read(backup)[0] == "v0"  # the first backup stays
    with pytest.raises(ValueError):
        tables.publish(spark.read.parquet(path).limit(3), path, rows=50)
    assert len(read()) == 50 and sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.backup"]


# partners and signals


def test_partner(spark):
    rng = random.Random(1)
    rows = [("k", rng.choice("xyz"), i) for i in range(60)] + [("one", "x", i) for i in range(100, 104)] + [("alone", "x", 200), ("two", "x", 300), ("two", "y", 301), ("two", "y", 302)]
    got = {r.id: r for r in joins.partner(spark.createDataFrame(rows, "k string, d string, id int"), ["k"], "d", ["id"], ["d", "id"]).collect()}
    key = {i: (k, d) for k, d, i in rows}
    assert set(got) == {i for k, _, i in rows if k != "alone"}
    for i, r in got.items():
        assert r.other_id != i and key[r.other_id] == (r.k, r.other_d) and (r.other_d != r.d) == (r.k != "one")


def test_signals(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, None, None), (1, 1, None, 2.0, 3.0), (2, 0, None, None, None), (3, 0, 1.0, 2.0, float("nan"))], "e int, i int, b double, a double, c double")
    bits = gen.signal_bits(rows, ["e"], "i", ["b", "a", "c"])
    assert {r.e: r.bits for r in bits.collect()} == {1: 1, 2: 0, 3: 7}
    pick = lambda wanted: {r.e: r.s for r in bits.select("e", gen.pick_signal("bits", ["b", "a", "c"], wanted, ["e"]).alias("s")).collect()}
    assert pick(F.array(F.lit("c"), F.lit("x"))) == {1: None, 2: None, 3: "c"}
    assert pick(None)[1] == "b" and pick(None)[2] is None and pick(None)[3] in "abc"
    with pytest.raises(ValueError):
        gen.signal_bits(rows, ["e"], "i", [f"s{i}" for i in range(64)])
