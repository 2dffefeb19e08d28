"""Feature maps, metadata, names, texts and the joins of items with their dimensions: a plan and SQL each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import encode, scoring, values
from tidemark.operators import aggregates as agg
from tidemark.operators import joins
from tidemark.operators import sequence as seq
from tidemark.plans.registry import query
from tidemark.plans.views import ROBOT, telemetry
from tidemark.sources import tables
from tidemark.sources.scratch import made_once, shared_folder
from tidemark.sources.tables import table

S = SparkSession
EP = ["episode_id"]


def _features(spark: S, sf: str) -> DataFrame:
    """Parts as rows of a map of features, one of them null for some."""
    names = F.array(*map(F.lit, ("speed_0", "torque_0", "size", "fault_label")))
    vals = F.array(F.col("p_retailprice"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") / 7), F.col("p_size").cast("double"), F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", "p_size", F.map_from_arrays(names, vals).alias("m"))


def _short(x: str, digits: int = 2) -> str:
    """plain_number in SQL: half to even, without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST(round_even({x}, {digits}) AS DECIMAL(30, {digits}))::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 4 ELSE 3 END AS n_known, 'fault_label,size,speed_0,torque_0' AS names, 'size,speed_0' AS kept,
  concat('t=', p_size, ': ', concat_ws(', ', concat('size=', p_size), concat('speed_0=', {_short("p_retailprice")}), CASE WHEN p_size % 3 > 0 THEN concat('torque_0=', {_short("CAST(p_retailprice / 7 AS DECIMAL(30, 9))")}) END)) AS line,
  round_even(CAST(CASE WHEN p_size % 3 > 0 THEN p_retailprice / 7 END AS DECIMAL(30, 9)), 3)::DOUBLE AS torque FROM part""")
def feature_maps(spark: S, sf: str) -> DataFrame:
    """Rows with varying features: nulls out, one out, only some, by name, as text, and a representative torque."""
    f = _features(spark, sf)
    return f.select(
        "p_partkey", F.size(values.without_nulls("m")).alias("n_known"), F.array_join(F.transform(values.by_key("m"), lambda e: e["key"]), ",").alias("names"),
        F.array_join(F.transform(values.by_key(values.only("m", ["speed_0", "size"])), lambda e: e["key"]), ",").alias("kept"),
        encode.encode_features("m", "p_size").alias("line"), encode.representative("m", "torque", "current").alias("torque"),
    )


@query(f"""WITH {ROBOT} SELECT episode_id, seq // 4 AS chunk_no, string_agg(concat('k=', k, ', value=', {_short("CAST(value AS DECIMAL(30, 9))")}), ' | ' ORDER BY seq) AS chunk FROM t WHERE seq < 16 GROUP BY 1, 2""")
def option_chunks(spark: S, sf: str) -> DataFrame:
    """Chunks of four rows as one line each, without timestamps."""
    t = telemetry(spark, sf).where("seq < 16").withColumn("chunk_no", F.floor(F.col("seq") / 4))
    m = F.map_from_arrays(F.array(F.lit("value"), F.lit("k")), F.array(F.col("value").cast("double"), F.col("k").cast("double")))
    return encode.encode_chunks(t.withColumn("m", m), [*EP, "chunk_no"], "seq", encode.encode_features("m"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN replace(p_type, ' ', '_') WHEN 1 THEN 'speed' END AS feature, CASE p_size % 3 WHEN 0 THEN concat(p_size, '.5') WHEN 1 THEN '2.5' END AS delta, CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '7' END AS duration FROM part""")
def positional_params(spark: S, sf: str) -> DataFrame:
    """Numbers from the right, the rest is the feature's name; too few parts give null."""
    k = F.col("p_size").cast("string")
    token = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("12_"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit("_"), k, F.lit(".5_"), k, F.lit(".0"))).when(F.col("p_size") % 3 == 1, F.lit("3_speed_2.5_7")).otherwise(F.lit("4_x"))
    m = values.positional_params(token, {"feature_i": "string", "delta": "numeric", "duration": "integer"})
    return table(spark, sf, "part").select("p_partkey", *[F.try_element_at(m, F.lit(k)).alias(a) for k, a in (("feature_i", "feature"), ("delta", "delta"), ("duration", "duration"))])


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END AS f1, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 END AS f2, o_orderkey % 4 AS c FROM orders)
SELECT o_orderkey, coalesce(f1, f2)::INT AS fault, CASE WHEN c = 0 THEN 'calibration' WHEN coalesce(f1, f2) IS NULL THEN 'normal' ELSE 'fault' END AS condition, coalesce(f1, f2, 0) = 0 AS nominal, coalesce(coalesce(f1, f2) <> 0, true) AS anomalous, 'it''s [1, 2]' AS note FROM x""")
def literal_metadata(spark: S, sf: str) -> DataFrame:
    """Printed dictionaries parsed; fault id by episode, else by fault metadata; condition inferred where unknown."""
    n = F.lit("None")
    meta = F.concat(F.lit("{'task': 'pick', 'fault_id': "), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 7).cast("string")).otherwise(n), F.lit(", 'condition': "), F.when(F.col("o_orderkey") % 4 == 0, F.lit("'calibration'")).otherwise(F.lit("'unknown'")), F.lit(""", 'note': "it's [1, 2]"}"""))
    other = F.concat(F.lit("{'fault_id': "), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") % 4).cast("string")).otherwise(n), F.lit(", 'box': [1, 2, 3]}"))
    o = table(spark, sf, "orders").select("o_orderkey", meta.alias("meta"), other.alias("other"))

    def read(d: DataFrame) -> DataFrame:
        d = d.select("meta", "other", values.literal_dict("meta").alias("m"), values.literal_dict("other").alias("f"))
        d = d.withColumn("fault", values.metadata_fault("m", "f"))
        return d.select("meta", "other", "fault", values.condition("m", "fault").alias("condition"), values.is_nominal("fault", F.lit(None).cast("int")).alias("nominal"), values.is_anomalous("fault").alias("anomalous"), F.element_at("m", "note").alias("note"))

    return made_once(o, ["meta", "other"], read).drop("meta", "other")


@query("""SELECT p_partkey, CASE WHEN lower(substr(p_type, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN concat('an ', p_type) ELSE concat('a ', p_type) END AS phrase, CASE WHEN p_size % 4 = 1 THEN 'a slipping belt' ELSE concat('a ', lower(replace(p_type, ' ', '-'))) END AS anomaly,
  CASE WHEN p_size % 2 = 0 THEN 'the wrist' ELSE 'elbow joint' END AS shown, p_size % 2 = 0 AS is_integer, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2 END AS places, CASE WHEN p_size % 3 = 0 THEN 0 ELSE least(1, p_size / 10) END::DOUBLE AS verdict,
  CASE WHEN p_size % 2 = 0 THEN p_size::INT END AS family_index FROM part""")
def names_and_numbers(spark: S, sf: str) -> DataFrame:
    """Articles, anomaly and display names, number texts, ten-point verdicts, families of names."""
    p, even = table(spark, sf, "part"), F.col("p_size") % 2 == 0
    cause, size = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("-"))), F.col("p_size").cast("string")
    text = F.when(even, size).otherwise(F.concat(size, F.lit(".25")))
    return p.select(
        "p_partkey", values.article("p_type").alias("phrase"), values.anomaly_name((F.col("p_size") % 4).cast("int"), cause, {1: "a slipping belt"}).alias("anomaly"),
        values.display_name(F.when(even, "wrist").otherwise("elbow_joint"), {"wrist": "the wrist"}).alias("shown"), values.is_integer_text(text).alias("is_integer"), values.decimal_places(text).alias("places"),
        values.ten_point_score(F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double"))).alias("verdict"), values.family(F.when(even, F.concat(F.lit("temp_"), size)).otherwise("temp"))["index"].alias("family_index"),
    )


@query(f"""WITH {ROBOT}, r AS (SELECT *, lag(value) OVER (PARTITION BY episode_id ORDER BY seq) AS x FROM t) SELECT event_id, CASE WHEN k % 2 = 0 THEN concat('Speed rose by 9 over ', k, ' rows') ELSE concat('Speed rose by ', {_short("CAST(abs(value - x) AS DECIMAL(30, 9))")}, ' over 1 rows') END AS said FROM r WHERE x IS NOT NULL""")
def event_descriptions(spark: S, sf: str) -> DataFrame:
    """Parameters of the token first, then values derived from the rows."""
    t = telemetry(spark, sf).withColumn("x", F.lag("value").over(seq.ordered(EP, ["seq"]))).where("x IS NOT NULL")
    token = F.when(F.col("k") % 2 == 0, F.concat(F.lit("3_delta=9;L="), F.col("k").cast("string"))).otherwise("3")
    derived = encode.event_values("x", "value", F.lit(1), "ms")
    return t.select("event_id", encode.describe_event(F.lit("Speed rose by {delta} over {L} rows"), values.event_params(token), derived).alias("said"))


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS cf, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS sel FROM orders)
SELECT b.o_orderkey AS baseline, sel AS variant FROM e b WHERE cf = 0 AND sel IS NOT NULL AND sel IN (SELECT o_orderkey FROM e)""")
def selected_variants(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(1).alias("cf"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1).alias("sel"))
    return joins.selected_variants(e, "o_orderkey", "sel", "cf")


@query("""SELECT c_custkey, coalesce(CASE WHEN n_nationkey < 10 THEN n_name END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'screwdriver' WHEN c_mktsegment LIKE 'M%' THEN 'claw' END) AS tool, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'pick' END, n_name, '') AS task FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def tools_and_tasks(spark: S, sf: str) -> DataFrame:
    """Tool by id, else by a rule on the name; task by the episode, else by its data set."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "pick").alias("own_task"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    dim = n.select("n_nationkey", F.when(F.col("n_nationkey") < 10, F.col("n_name")).alias("tool"))
    out = joins.with_fallback_rule(c, dim, "n_nationkey", "tool", [(F.col("c_mktsegment") == "BUILDING", F.lit("screwdriver")), (F.col("c_mktsegment").startswith("M"), F.lit("claw"))])
    return out.join(n, "n_nationkey", "left").select("c_custkey", "tool", F.coalesce("own_task", "n_name", F.lit("")).alias("task"))


@query("""WITH n AS (SELECT list({'k': n_nationkey, 'v': n_name} ORDER BY n_nationkey) AS l FROM nation WHERE n_nationkey < 7), x AS (SELECT o_orderkey, o_custkey % 9 AS f, (('0x' || substr(md5(concat_ws(':', 'any', o_orderkey::VARCHAR)), 1, 8))::BIGINT % 7)::INT AS d FROM orders)
SELECT o_orderkey, coalesce(n_name, l[d + 1].v) AS n_name FROM x CROSS JOIN n LEFT JOIN nation ON n_nationkey = f AND f < 7""")
def event_or_any(spark: S, sf: str) -> DataFrame:
    """The event of a fault, else a drawn one."""
    dim = table(spark, sf, "nation").where("n_nationkey < 7").select(F.col("n_nationkey").alias("f"), "n_name")
    return joins.or_any(table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 9).cast("int").alias("f")), dim, "f", ["n_name"], ["o_orderkey"]).select("o_orderkey", "n_name")


@query("""SELECT p_partkey, ps AS template_id FROM (SELECT p_partkey, p_size % 4 AS ps, p_partkey % 3 AS v FROM part WHERE p_partkey % 12 = 11) WHERE ps IN (1, 2) AND v <> 0""".replace("p_partkey % 12 = 11", "p_partkey % 2 = 1"))
def judge_items(spark: S, sf: str) -> DataFrame:
    """Free-text replies that lack a valid vote of one of two judges."""
    p = table(spark, sf, "part")
    none = F.lit(None).cast("double")
    votes = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.when(F.col("p_partkey") % 3 == 0, 0.5).otherwise(none))
    replies = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 1, "free_form").otherwise("numerical").alias("answer_format"), F.col("p_type").alias("answer"), votes.alias("votes"))
    questions = p.select("p_partkey", (F.col("p_size") % 4).alias("template_id"), F.col("p_name").alias("question"), F.col("p_brand").alias("reference"))
    return joins.judge_items(replies, questions, ["p_partkey"], ["a", "b"]).select("p_partkey", "template_id")


@query("SELECT s_suppkey AS stem, concat('alt_', s_nationkey % 2) AS alt, 'plain' AS normal FROM supplier WHERE s_suppkey % 3 = 0")
def split_pairs(spark: S, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    alt = s.where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("stem"), F.concat(F.lit("alt_"), (F.col("s_nationkey") % 2).cast("string")).alias("folder"))
    normal = s.where("s_suppkey % 3 <> 1").select(F.col("s_suppkey").alias("stem"), F.lit("plain").alias("folder"))
    return tables.split_pairs(alt.unionByName(normal), "stem", "folder")


@query("SELECT n_regionkey AS level, concat('q_', n_nationkey) AS stem, n_name AS question, 'T' AS answer FROM nation WHERE n_nationkey % 4 > 0")
def question_files(spark: S, sf: str) -> DataFrame:
    """A tree of one JSON file per question, read back; a broken file goes."""
    root = shared_folder(spark) + "/questions"
    n = table(spark, sf, "nation").select(F.concat(F.lit("level"), F.col("n_regionkey").cast("string")).alias("folder"), F.concat(F.lit("q_"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.to_json(F.struct(F.col("n_name").alias("question"), F.lit("T").alias("answer")))).otherwise('{"question": ').alias("value"))
    fs = spark._jvm.org.apache.hadoop.fs
    for r in n.collect():  # 25 files of a fixed dimension
        path = fs.Path(f"{root}/{r.folder}/{r.name}.json")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(r.value.encode()))
        out.close()
    return tables.json_documents(spark, tables.preferred_inputs(spark, root, [["missing"], [""]])[0], "question string, answer string")


@query(f"WITH {ROBOT} SELECT event_id, seq * 100 AS clock, concat('experiment_', k) AS name FROM t")
def clocks_and_names(spark: S, sf: str) -> DataFrame:
    """A made-up clock, and names without padding."""
    t = tables.with_time(telemetry(spark, sf), EP, ["seq"], out="clock")
    return t.select("event_id", "clock", tables.unpadded(F.concat(F.lit("experiment_"), F.lpad(F.col("k").cast("string"), 6, "0"))).alias("name"))


# judges' texts, totals, provenance, schedules

_SAID = ['```json\n{"score": 1.7, "reason": "good"}\n```', "I would say 0.5 of 1", '{"score": 0.25}', "no score at all", "`B`\n\nbecause", "**C** \n", "NO_ANSWER"]
_SAID_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID) + "]"


@query(f"""WITH x AS (SELECT p_partkey, {_SAID_SQL}[p_partkey % 7 + 1] AS said, p_size FROM part), b AS (SELECT *, trim(CASE WHEN starts_with(said, '```') THEN regexp_replace(split_part(said, '```', 2), '^json', '') ELSE said END, chr(10) || ' ') AS bare FROM x)
SELECT p_partkey, CASE WHEN contains(bare, '"score"') THEN least(1, greatest(0, (bare->>'$.score')::DOUBLE)) ELSE nullif(regexp_extract(bare, '\\b(1(?:\\.0+)?|0\\.5|0(?:\\.0+)?)\\b', 1), '')::DOUBLE END AS score,
  nullif(trim(split_part(trim(said, '` ' || chr(10)), chr(10), 1), '*` '), 'NO_ANSWER') AS canonical, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS n FROM b""".replace("bare->>'$.score'", "CASE WHEN contains(bare, '\"score\"') THEN bare END->>'$.score'"))
def judge_texts(spark: S, sf: str) -> DataFrame:
    """Single verdicts, canonical extractions and expected lengths."""
    p = table(spark, sf, "part").withColumn("said", F.get(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % 7).cast("int")))
    kind = F.when(F.col("p_size") % 3 == 0, "tensor").when(F.col("p_size") % 3 == 1, "ranking").otherwise("numerical")
    truth = F.when(F.col("p_size") % 3 == 0, "[1, 2.5, -3e1]").when(F.col("p_size") % 3 == 1, "ABDC").otherwise("7")
    return p.select("p_partkey", scoring.single_verdict("said")["score"].alias("score"), scoring.extracted("said").alias("canonical"), scoring.expected_length(kind, truth).alias("n"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN concat('Q: ', substr(p_name, 1, 6), ' / R: ', substr(p_brand, 1, 4), ' / C: ', CASE WHEN p_partkey % 2 = 0 THEN 'belt' ELSE '(unspecified)' END) WHEN 2 THEN concat('Q: ', substr(p_name, 1, 6), ' / P: ', substr(p_type, 1, 5)) END AS prompt FROM part""")
def judge_prompts(spark: S, sf: str) -> DataFrame:
    forms = {1: "Q: {question} / R: {reference} / C: {root_cause}", 2: "Q: {question} / P: {prediction}"}
    p = table(spark, sf, "part")
    cause = F.when(F.col("p_partkey") % 2 == 0, "belt")
    return p.select("p_partkey", scoring.judge_prompt(forms, F.col("p_size") % 3, "p_name", "p_type", "p_brand", cause, (6, 5, 4)).alias("prompt"))


@query(f"""WITH {ROBOT} SELECT episode_id, CASE WHEN max(k % 12) >= 11 THEN 'pick_and_place' WHEN episode_id % 4 IN (1, 2) THEN 'peg_in_hole' WHEN episode_id % 4 = 3 THEN 'screwing' ELSE 'unknown' END AS task, max(k) AS top, bool_or(k % 12 > 0 AND fault = 1) AS escalates FROM t WHERE k % 12 <> 9 AND k % 12 <> 10 GROUP BY 1""")
def episode_facts(spark: S, sf: str) -> DataFrame:
    """Task inferred from phases and faults, the largest mode, whether it escalates."""
    t = telemetry(spark, sf).where("k % 12 <> 9 AND k % 12 <> 10").withColumn("phase", (F.col("k") % 12).cast("string")).withColumn("f", F.col("episode_id") % 4)
    task = agg.inferred_task(t, EP, "phase", "f", {"peg_in_hole": (1, 2), "screwing": (3,)})
    up = agg.escalates(t.withColumn("mode", F.when((F.col("k") % 12 > 0) & (F.col("fault") == 1), "3").otherwise("1")), EP, "mode")
    return task.join(agg.largest(t, EP, "k", "top"), EP).join(up, EP)


@query("""SELECT p_brand, count(*) AS n, sum(greatest(1, length(p_name) // 4))::BIGINT AS tokens_in, count(*) * 500 AS tokens_out, round(sum((greatest(1, length(p_name) // 4) * 2 + 500 * 8) / 1e6 * 0.5), 6) AS dollars FROM part GROUP BY 1""")
def preflight_cost(spark: S, sf: str) -> DataFrame:
    price = values.price(F.lit("some-model-v2"), [("other", 1, 1), ("model", 2, 8)])
    return agg.prompt_cost(table(spark, sf, "part"), ["p_brand"], "p_name", price, 500, 0.5)


@query("SELECT o_orderpriority, o_orderstatus, n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus)::INT AS place FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)")
def most_common(spark: S, sf: str) -> DataFrame:
    return agg.most_common(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("SELECT l_orderkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def long_to_wide(spark: S, sf: str) -> DataFrame:
    long = table(spark, sf, "lineitem").select("l_orderkey", F.lower("l_returnflag").alias("feature"), "l_quantity")
    return agg.wide(long, ["l_orderkey"], "feature", "l_quantity", ["a", "n", "r"])


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN concat('e', o_custkey) END, CASE WHEN o_orderkey % 3 = 0 THEN concat('a', o_custkey) END, CASE WHEN o_orderkey % 3 = 0 THEN concat('b', o_custkey) END, CASE WHEN o_orderkey % 5 = 0 THEN 'x,y' END) AS episodes FROM orders""")
def provenance_episodes(spark: S, sf: str) -> DataFrame:
    """The four shapes in which items name their episodes."""
    c = lambda p: F.concat(F.lit(p), F.col("o_custkey").cast("string"))
    each = lambda v: F.struct(F.lit(v).alias("episode"))
    p = F.struct(F.when(F.col("o_orderkey") % 2 == 0, c("e")).otherwise("").alias("episode"), F.when(F.col("o_orderkey") % 3 == 0, c("a")).alias("episode_a"), F.when(F.col("o_orderkey") % 3 == 0, c("b")).alias("episode_b"), F.when(F.col("o_orderkey") % 5 == 0, F.array(each("x"), each(""), each("y"))).alias("episodes"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(agg.episodes_of(p), ",").alias("episodes"))


@query("SELECT o_custkey AS id, true AS both FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, true FROM orders WHERE o_orderstatus = 'O' UNION ALL (SELECT o_custkey, false FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, false FROM orders WHERE o_orderstatus = 'O')")
def id_sets(spark: S, sf: str) -> DataFrame:
    """Ids in both sets, and those only in the first."""
    ids = lambda status: table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"))
    return ids("F").intersect(ids("O")).withColumn("both", F.lit(True)).unionByName(ids("F").subtract(ids("O")).withColumn("both", F.lit(False)))


@query("""WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey, o_orderkey % 97 AS s, o_orderkey % 11 + 1 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
g AS (SELECT o_custkey, 0::BIGINT AS i, (-1000000)::BIGINT AS free, NULL::BIGINT AS taken FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT g.o_custkey, c.i, CASE WHEN c.s >= free THEN c.s + c.n + 5 ELSE free END, CASE WHEN c.s >= free THEN c.o_orderkey END FROM g JOIN c ON c.o_custkey = g.o_custkey AND c.i = g.i + 1)
SELECT o_custkey, taken AS o_orderkey, taken % 97 AS s, taken % 11 + 1 AS n FROM g WHERE taken IS NOT NULL""")
def schedule_without_overlap(spark: S, sf: str) -> DataFrame:
    """Events in drawn order are taken while they keep clear of the last one taken."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 97).alias("s"), (F.col("o_orderkey") % 11 + 1).alias("n"))
    return agg.greedy_schedule(o, ["o_custkey"], "o_orderkey", "s", "n")
