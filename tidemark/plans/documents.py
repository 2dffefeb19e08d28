"""Finished items, metadata texts, published tables and drawn events over the driver tables: a plan and SQL each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import baselines, encode, literals, noise, values
from tidemark.operators import generators as gen
from tidemark.operators import joins, relevance
from tidemark.operators import sequence as seq
from tidemark.plans.items import _UNIFORM, _digest, _draw, _windows
from tidemark.plans.registry import query
from tidemark.plans.views import AXES, ROBOT, axes, telemetry
from tidemark.sources import tables
from tidemark.sources.scratch import made_once, shared_folder
from tidemark.sources.tables import table

S = SparkSession
EP = ["episode_id"]


def _plain(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', {x}), '0') END"


# noise on items


def _step(series: str) -> str:
    d = f"md5(concat_ws(':', 'noise', episode_id::VARCHAR, '{series}', 'v', pos::VARCHAR))"
    u = [f"(('0x' || substr({d}, {at}, 8))::BIGINT::DOUBLE / 4294967296)" for at in (1, 9)]
    return f"0.5::DOUBLE * (sqrt(-2 * ln({u[0]} + 0.5 / 4294967296)) * cos(2 * pi() * {u[1]}))"


def _walked(series: str) -> str:
    return f"sum(CASE WHEN pos = 0 THEN first ELSE {_step(series)} END) OVER (PARTITION BY episode_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_UNIFORM}, i AS (SELECT t.*, seq - start AS pos, round_even(CAST(value AS DECIMAL(30, 9)), 2)::DOUBLE AS rv FROM t JOIN w USING (episode_id) WHERE seq >= start AND seq < start + length),
x AS (SELECT *, {_plain("rv")} AS vt FROM i), p AS (SELECT episode_id, max(length(split_part(vt, '.', 2))) AS digits, bool_and(NOT contains(vt, '.')) AS whole, CAST(arg_min(vt, pos) AS DOUBLE) AS first FROM x GROUP BY 1),
n AS (SELECT x.*, digits, whole, {_walked("time_series")} AS a, {_walked("options.A")} AS b FROM x JOIN p USING (episode_id)),
o AS (SELECT *, CASE WHEN whole THEN vt WHEN digits = 1 THEN printf('%.1f', a) ELSE printf('%.2f', a) END AS va, CASE WHEN whole THEN vt WHEN digits = 1 THEN printf('%.1f', b) ELSE printf('%.2f', b) END AS vb FROM n)
SELECT episode_id, pos AS i, concat('t=', ms::VARCHAR, ': f=', fault::VARCHAR, ', k=', k::VARCHAR, ', v=', va) AS line, concat('f=', fault::VARCHAR, ', k=', k::VARCHAR, ', v=', vb) AS option_row, 'v = as it was' AS statement, episode_id AS rng_seed FROM o""")
def noisy_items(spark: S, sf: str) -> DataFrame:
    """Items with a series in their context and as an option, noised and taken apart again: whole numbers, times and statements stay."""
    rows = relevance.context_rows(telemetry(spark, sf), _windows(spark, sf), EP, "seq")
    line = encode.encode_step("ms", {"value": "v", "k": "k", "fault": "f"})
    items = rows.groupBy(*EP).agg(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))).alias("x"))
    lines = F.transform("x", lambda x: x["l"])
    bare = F.transform("x", lambda x: F.regexp_replace(x["l"], "^t=[^:]*: ", ""))
    ids = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex("episode_id")), 12, "0"))
    items = items.select(*EP, ids.alias("id"), F.struct(lines.alias("time_series"), F.lit(1).alias("version")).alias("context"), F.create_map(F.lit("A"), F.array_join(bare, noise.JOINED), F.lit("B"), F.lit("v = as it was")).alias("options"))
    out = noise.noise_items(items, 0.5)
    each = out.select(*EP, F.posexplode("context.time_series").alias("i", "line"), F.split(F.element_at("options", "A"), r" \| ").alias("a"), F.element_at("options", "B").alias("statement"), "noise.rng_seed")
    return each.select(*EP, F.col("i").cast("long").alias("i"), "line", F.get("a", F.col("i")).alias("option_row"), "statement", "rng_seed")


# forecasts from an item's own text

_LINES = f"""{AXES}, f AS (SELECT episode_id, seq, seq * 100 AS ms, round_even(CAST(v0 AS DECIMAL(30, 9)), 2)::DOUBLE AS x0, round_even(CAST(s1 AS DECIMAL(30, 9)), 2)::DOUBLE AS x1 FROM a WHERE seq < 12)"""


@query(f"""WITH {_LINES}, g AS (SELECT episode_id, regr_slope(x0, ms) AS a0, regr_intercept(x0, ms) AS b0, regr_slope(x1, ms) AS a1, regr_intercept(x1, ms) AS b1, max(ms) + 100 * (1 + episode_id % 5) AS t, count(*) AS n FROM f GROUP BY episode_id)
SELECT episode_id, CASE WHEN episode_id % 7 > 0 AND n > 1 THEN round(a0 * t + b0, 4) END AS f0, CASE WHEN episode_id % 7 > 0 AND n > 1 THEN CASE WHEN episode_id % 3 = 0 THEN 0.0 ELSE round(a1 * t + b1, 4) END END AS f1 FROM g""")
def vector_forecast(spark: S, sf: str) -> DataFrame:
    """Lines through axes read back from text: half the items name signals by acronyms, a third never give the second axis, a seventh ask for no list."""
    rows = axes(spark, sf).where("seq < 12").withColumn("ms", F.col("seq") * 100).withColumns({"joint_pos_0": F.col("v0"), "joint_pos_1": F.when(F.col("episode_id") % 3 > 0, F.col("s1"))})
    short, full = encode.encode_step("ms", {"joint_pos_0": "jp0", "joint_pos_1": "jp1"}), encode.encode_step("ms", {"joint_pos_0": "joint_pos_0", "joint_pos_1": "joint_pos_1"})
    rows = rows.withColumn("line", F.when(F.col("episode_id") % 2 == 0, short).otherwise(full))
    items = rows.groupBy(*EP).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x")).withColumn("rows", F.transform("x", lambda x: x["line"]))
    known = F.create_map(*[F.lit(x) for x in ("jp0", "joint_pos_0", "jp1", "joint_pos_1")])
    items = items.withColumn("acronyms", F.when(F.col("episode_id") % 2 == 0, known).otherwise(F.create_map().cast("map<string,string>")))
    items = items.withColumn("question", F.concat(F.lit("What is expected at t+"), (100 * (1 + F.col("episode_id") % 5)).cast("string"), F.lit(" ms?"))).withColumn("answer", F.when(F.col("episode_id") % 7 > 0, "[1.0,2.0]").otherwise("B"))
    out = baselines.vector_forecast(items, EP, "rows", "acronyms", F.lit("joint_pos"), "answer", "question")
    return out.select(*EP, F.round(F.get("forecast", F.lit(0)), 4).alias("f0"), F.round(F.get("forecast", F.lit(1)), 4).alias("f1"))


# metadata as printed


def _meta() -> tuple[Column, Column]:
    fault = F.when(F.col("o_orderkey") % 3 == 0, "None").otherwise((F.col("o_custkey") % 40).cast("string"))
    whole = F.concat(F.lit("{'fault_id': "), fault, F.lit(""", 'condition': 'unknown', 'robot_model': "ur5's", 'offset': {'xyz': (1.5, """), (F.col("o_custkey") % 3).cast("string"), F.lit("), 'on': [True, None]}, 'weight_of_box': "), (F.col("o_custkey") % 9).cast("string"), F.lit("}"))
    text = F.when(F.col("o_orderkey") % 5 == 0, "{}").when(F.col("o_orderkey") % 5 == 1, "{'broken': ").otherwise(whole)
    other = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("{'causes': ['a', {'b': ()}], 'fault_id': "), (F.col("o_custkey") % 7).cast("string"), F.lit("}")))
    return text, other


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 > 1 AS ok, CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 3 > 0 THEN o_custkey % 40 END AS f1, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 END AS f2, o_custkey % 9 AS w, o_custkey % 3 AS p FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN 'ur5''s' ELSE 'ur3' END AS robot_type, 'unknown' AS task, CASE WHEN coalesce(f1, f2) IS NULL THEN 'normal' ELSE 'fault' END AS condition, coalesce(f1, f2)::INT AS fault_id, CASE WHEN ok THEN w::VARCHAR END AS weight_of_box, CASE WHEN ok THEN concat('{"on":[true,null],"xyz":[1.5,', p::VARCHAR, ']}') END AS "offset" FROM x""")
def nested_metadata(spark: S, sf: str) -> DataFrame:
    """Nested dictionaries as programs print them, with a fallback to a second one and defaults; unreadable ones count as empty."""
    text, other = _meta()
    o = table(spark, sf, "orders").select("o_orderkey", text.alias("m"), other.alias("f"))
    o = made_once(o, ["m", "f"], lambda d: d.withColumn("x", literals.episode_metadata("m", "f")))
    return o.select("o_orderkey", "x.robot_type", "x.task", "x.condition", "x.fault_id", "x.weight_of_box", "x.offset")


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE (o_custkey % 40)::VARCHAR END AS fault, concat(', ''condition'': ''unknown'', ''robot_model'': "ur5''s", ''offset'': {''xyz'': (1.5, ', (o_custkey % 3)::VARCHAR, '), ''on'': [True, None]}, ''weight_of_box'': ') AS mid, (o_custkey % 9)::VARCHAR AS w FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '{''fault_id'': 12, ''weight_of_box'': ''2.5 kg''}' WHEN 1 THEN '{''fault_id'': 12, ''weight_of_box'': ''2.5 kg''}' ELSE concat('{''fault_id'': 12', mid, '''2.5 kg''}') END AS forced,
  CASE k WHEN 0 THEN '{}' WHEN 1 THEN '{''broken'': ' ELSE concat('{''fault_id'': 12', mid, w, '}') END AS known FROM x""")
def literal_patched(spark: S, sf: str) -> DataFrame:
    """Keys set in printed dictionaries: by force, or only where they are."""
    o = table(spark, sf, "orders").select("o_orderkey", _meta()[0].alias("m"))
    forced = literals.literal_patch("m", {"fault_id": F.lit("12"), "weight_of_box": F.lit("'2.5 kg'")})
    known = literals.literal_patch("m", {"fault_id": F.lit("12"), "cause": F.lit("3")}, add=False)
    return made_once(o, ["m"], lambda d: d.select("m", forced.alias("forced"), known.alias("known"))).select("o_orderkey", "forced", "known")


@query(f"""WITH {ROBOT} SELECT event_id, CASE WHEN k % 3 > 0 THEN value END AS one, concat('[', CASE WHEN k % 5 > 0 THEN '{{"x":1.5,"n":7}}' ELSE '{{"x":null,"n":7}}' END, ',null]') AS listed, concat('{{"a":{{"b":[', CASE WHEN k % 3 > 0 THEN '2.5' ELSE 'null' END, ',', CASE WHEN k % 5 > 0 THEN '1.5' ELSE 'null' END, ']}}}}') AS deep, k % 3 = 0 AS nan_goes, k % 5 = 0 AS infinity_stays FROM t""")
def finite_documents(spark: S, sf: str) -> DataFrame:
    """NaN and infinities at any depth, by the schema: what is left can be written as JSON."""
    nan, inf = F.when(F.col("k") % 3 > 0, F.lit(2.5)).otherwise(F.lit(float("nan"))), F.when(F.col("k") % 5 > 0, F.lit(1.5)).otherwise(F.lit(float("inf")))
    t = telemetry(spark, sf).select("event_id", F.when(F.col("k") % 3 > 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("one"), F.array(F.struct(inf.alias("x"), F.lit(7).alias("n")), F.lit(None)).alias("listed"), F.create_map(F.lit("a"), F.struct(F.array(nan, inf).alias("b"))).alias("deep"))
    shown = values.without_infinities(t)
    partly = values.without_infinities(t, infinities=False).select("event_id", F.col("deep")["a"]["b"].alias("b"))
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return shown.join(partly, "event_id").select("event_id", "one", json("listed").alias("listed"), json("deep").alias("deep"), F.isnull(F.get("b", F.lit(0))).alias("nan_goes"), (F.get("b", F.lit(1)) == float("inf")).alias("infinity_stays"))


# events along an episode

_CANDIDATES = f"""{ROBOT}, e AS (SELECT episode_id, count(*) AS n FROM t GROUP BY 1), i AS (SELECT episode_id, n, unnest(range(n)) AS i FROM e),
c AS (SELECT episode_id, i, 3 + {_draw("least(6, n - i) - 2", "run", "episode_id", "i")} AS d, [2, 3, 5][{_draw("3", "which", "episode_id", "i")} + 1] AS event FROM i WHERE n - i >= 3 AND {_draw("1000000", "start", "episode_id", "i")} < 200000),
nx AS (SELECT c.episode_id, c.i, min(m.i) AS nxt FROM c LEFT JOIN c m ON c.episode_id = m.episode_id AND c.i + c.d <= m.i GROUP BY 1, 2)"""


@query("WITH RECURSIVE " + _CANDIDATES + """, r AS (SELECT episode_id, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT nx.episode_id, nx.nxt FROM r JOIN nx ON nx.episode_id = r.episode_id AND nx.i = r.i WHERE nx.nxt IS NOT NULL)
SELECT c.episode_id, c.i AS first, c.i + c.d - 1 AS last, c.event FROM r JOIN c ON c.episode_id = r.episode_id AND c.i = r.i""")
def event_chain(spark: S, sf: str) -> DataFrame:
    """Events started row by row, by blocks of 16 rows: what SQL gets by following the chain."""
    n = telemetry(spark, sf).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    return gen.event_chain(n, EP, "n", [2, 3, 5], 0.2, 3, 6, block=16)


# tables


@query(f"WITH {ROBOT} SELECT event_id, ms - lag(ms) OVER w AS gap, round(sum(value) OVER w, 6) AS so_far FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)")
def keyed_table(spark: S, sf: str) -> DataFrame:
    """Rows dealt once into buckets by episode; windows on the table need no shuffle."""
    rows = telemetry(spark, sf).select("episode_id", "event_id", "ms", "value", "seq")
    kept = tables.write_keyed(rows, f"keyed_{uuid.uuid4().hex}", f"{shared_folder(spark)}/keyed", EP, ["seq"], 16)
    w = seq.ordered(EP, ["seq"])
    return kept.select("event_id", (F.col("ms") - F.lag("ms").over(w)).alias("gap"), F.round(F.sum("value").over(w), 6).alias("so_far"))


@query(f"""WITH {ROBOT}, n AS (SELECT episode_id, count(*) AS n FROM t GROUP BY 1) SELECT event_id, event_type, seq * 250 AS row_timestamp FROM t JOIN n USING (episode_id) WHERE seq % 4 = 0 AND (seq // 4 < n // 4 OR seq = 0)""")
def thinned_table(spark: S, sf: str) -> DataFrame:
    """Every fourth row of each episode from a table dealt by episode, its times in milliseconds."""
    rows = telemetry(spark, sf).select("episode_id", "event_id", "event_type", "seq", (F.col("seq") * 0.25).alias("row_timestamp"))
    out = tables.thinned_by_key(rows, f"thinned_{uuid.uuid4().hex}", f"{shared_folder(spark)}/thinned", EP, "seq", 4, [], 16)
    return out.select("event_id", "event_type", "row_timestamp")


def _corrections(spark: S, sf: str) -> tuple[DataFrame, Column, dict[str, Column]]:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p, F.col("p_size") % 10 == 3, {"p_brand": F.concat("p_brand", F.lit("*")), "p_size": F.when(F.col("p_size") < 20, 12).otherwise(F.col("p_size"))}


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 3 THEN concat(p_brand, '*') ELSE p_brand END AS p_brand, CASE WHEN p_size % 10 = 3 AND p_size < 20 THEN 12 ELSE p_size END AS p_size, p_retailprice, p_size % 10 = 3 AS changed FROM part")
def published_table(spark: S, sf: str) -> DataFrame:
    """A table corrected in its place: staged, proven, backed up, renamed; read with its backup."""
    p, where, values_ = _corrections(spark, sf)
    path = f"{shared_folder(spark)}/published"
    p.write.parquet(path)
    backup = tables.publish(tables.patch(spark.read.parquet(path), where, values_), path)
    now, before = spark.read.parquet(path), spark.read.parquet(backup)
    return now.join(before.select("p_partkey", F.col("p_brand").alias("old")), "p_partkey").withColumn("changed", F.col("p_brand") != F.col("old")).drop("old")


@query("SELECT p_partkey, p_brand AS brand_before, concat(p_brand, '*') AS brand_after, p_size AS size_before, CASE WHEN p_size < 20 THEN 12 ELSE p_size END AS size_after FROM part WHERE p_size % 10 = 3")
def dry_run(spark: S, sf: str) -> DataFrame:
    p, where, values_ = _corrections(spark, sf)
    return tables.changed_rows(p, where, values_).select("p_partkey", F.col("before.p_brand").alias("brand_before"), F.col("after.p_brand").alias("brand_after"), F.col("before.p_size").alias("size_before"), F.col("after.p_size").alias("size_after"))


# partners and signals


@query(f"""WITH o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'only' ELSE o_orderstatus END AS dataset FROM orders), g AS (SELECT o_orderpriority, dataset, count(*) AS n FROM o GROUP BY ALL),
r AS (SELECT *, coalesce(lead(dataset) OVER w, first_value(dataset) OVER w) AS next, coalesce(lead(n) OVER w, first_value(n) OVER w) AS size FROM g WINDOW w AS (PARTITION BY o_orderpriority ORDER BY dataset)),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, dataset ORDER BY {_digest("partner", "o_orderkey")}, o_orderkey) - 1 AS r FROM o)
SELECT a.o_orderkey, b.o_orderkey AS other, a.dataset = b.dataset AS alone FROM (SELECT p.*, next, CASE WHEN next = dataset THEN (p.r + 1) % size ELSE p.r % size END AS place FROM p JOIN r USING (o_orderpriority, dataset)) a JOIN p b ON b.o_orderpriority = a.o_orderpriority AND b.dataset = a.next AND b.r = a.place WHERE a.o_orderkey <> b.o_orderkey""")
def partner_episode(spark: S, sf: str) -> DataFrame:
    """A partner of another data set; one key has a single data set, whose episodes pair among themselves."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "only").otherwise(F.col("o_orderstatus")).alias("dataset"))
    out = joins.partner(o, ["o_orderpriority"], "dataset", ["o_orderkey"], ["o_orderkey", "dataset"])
    return out.select("o_orderkey", F.col("other_o_orderkey").alias("other"), (F.col("dataset") == F.col("other_dataset")).alias("alone"))


_HAVE = "list_filter(['e0', 's0', 'v0', 'v1'], lambda x: CASE x WHEN 'e0' THEN episode_id % 3 > 0 WHEN 's0' THEN episode_id % 2 = 0 WHEN 'v0' THEN true ELSE episode_id % 5 > 0 END)"


@query(f"""WITH {AXES}, h AS (SELECT DISTINCT episode_id, {_HAVE} AS have, CASE episode_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['v1', 's0', 'e0'] WHEN 2 THEN ['e0', 'torque'] ELSE ['none'] END AS wanted FROM a),
f AS (SELECT *, CASE WHEN wanted IS NULL THEN have ELSE list_filter(wanted, lambda w: list_contains(have, w)) END AS fit FROM h) SELECT episode_id, array_to_string(have, ',') AS have, CASE WHEN len(fit) > 0 THEN fit[{_draw("greatest(1, len(fit))", "signal", "episode_id")} + 1] END AS signal FROM f""")
def picked_signal(spark: S, sf: str) -> DataFrame:
    """What an episode's first row has, as bits; a drawn signal of those that a template wants."""
    signals = ["v0", "v1", "s0", "e0"]
    rows = axes(spark, sf).withColumn("e0", F.when(F.col("episode_id") % 3 > 0, F.col("e0"))).withColumn("s0", F.when((F.col("episode_id") % 2 == 0) | (F.col("seq") > 0), F.col("s0"))).withColumn("v1", F.when(F.col("episode_id") % 5 > 0, F.col("v1")))
    bits = gen.signal_bits(rows, EP, "seq", signals)
    wanted = F.when(F.col("episode_id") % 4 == 1, F.array(*map(F.lit, ("v1", "s0", "e0")))).when(F.col("episode_id") % 4 == 2, F.array(F.lit("e0"), F.lit("torque"))).when(F.col("episode_id") % 4 == 3, F.array(F.lit("none")))
    have = F.concat_ws(",", *[F.when(F.col("bits").bitwiseAND(F.lit(1 << signals.index(s))) != 0, s) for s in sorted(signals)])
    return bits.select(*EP, have.alias("have"), gen.pick_signal("bits", signals, wanted, EP).alias("signal"))
