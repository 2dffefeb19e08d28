"""Question items, their windows and answers, injected events, and baselines without a model: a plan and SQL each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import baselines, draws, scoring
from tidemark.operators import generators as gen
from tidemark.operators import joins, questions, relevance
from tidemark.operators import sequence as seq
from tidemark.operators.aggregates import modal
from tidemark.plans.registry import query
from tidemark.plans.views import AXES, REPLIES, ROBOT, axes, replies, telemetry
from tidemark.sources.tables import table

S = SparkSession
EP = ["episode_id"]


def _draw(n: str, salt: str, *by: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{salt}', {', '.join(f'CAST({b} AS VARCHAR)' for b in by)})), 1, 8))::BIGINT % ({n}))"


def _digest(salt: str, *by: str) -> str:
    return f"md5(concat_ws(':', '{salt}', {', '.join(f'CAST({b} AS VARCHAR)' for b in by)}))"


def _number(x: str, digits: int = 4) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{digits}f', {x}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_UNIFORM = f"""{ROBOT}, e AS (SELECT episode_id, count(*) AS n FROM t GROUP BY 1), u AS (SELECT episode_id, n, 8 + {_draw("least(16, n) - 7", "uniform-n", "episode_id")} AS length FROM e WHERE n >= 8),
w AS (SELECT episode_id, {_draw("n - length + 1", "uniform-at", "episode_id")} AS start, length FROM u)"""


def _windows(spark: S, sf: str) -> DataFrame:
    n = telemetry(spark, sf).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    return relevance.uniform_windows(n, EP, "n", 8, 16)


@query(f"WITH {_UNIFORM} SELECT * FROM w")
def uniform_windows(spark: S, sf: str) -> DataFrame:
    return _windows(spark, sf)


#: Specs of the driver's episodes: locality by id, three rows of phases 0 and 2 of k % 4 wanted.
_SPEC = "CASE episode_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'event' WHEN 2 THEN 'cumulative' ELSE 'phase_gated' END"


def _relevant(spark: S, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = telemetry(spark, sf).withColumn("event", F.col("k") % 7).withColumn("phase", F.col("k") % 4)
    spec = rows.select(*EP).distinct().withColumn("locality", F.expr(_SPEC)).withColumn("min_length", F.lit(10)).withColumn("min_overlap", F.lit(2)).withColumn("start_phases", F.array(F.lit(3))).withColumn("phases", F.array(F.lit(0), F.lit(2)))
    return rows, spec, relevance.sample_windows(rows, EP, "seq", "event", "phase", spec, 8, 16)


_RELEVANT = f"""{_UNIFORM}, s AS (SELECT *, {_SPEC} AS locality FROM e), fit AS (SELECT * FROM s WHERE n >= 10),
a AS (SELECT episode_id, arg_min(seq, {_digest("anchor", "episode_id", "seq")}) AS pos FROM t WHERE k % 7 NOT IN (0, 1) GROUP BY 1),
el AS (SELECT f.episode_id, n, pos, 10 + {_draw("least(16, n) - 9", "event-n", "f.episode_id")} AS length FROM fit f JOIN a USING (episode_id) WHERE locality = 'event'),
ew AS (SELECT episode_id, greatest(0, pos - length + 1) + {_draw("least(n - length, pos) - greatest(0, pos - length + 1) + 1", "event-at", "episode_id")} AS start, length, 'event' AS sampler FROM el),
cf AS (SELECT f.episode_id, n, CASE WHEN n - coalesce(fl, 0) >= 10 THEN coalesce(fl, 0) ELSE 0 END AS fl FROM fit f LEFT JOIN (SELECT episode_id, min(seq) AS fl FROM t WHERE k % 4 = 3 GROUP BY 1) USING (episode_id) WHERE locality = 'cumulative'),
cl AS (SELECT *, 10 + {_draw("least(16, n - fl) - 9", "cumulative-n", "episode_id")} AS length FROM cf),
cw AS (SELECT episode_id, fl + {_draw("n - length - fl + 1", "cumulative-at", "episode_id")} AS start, length, 'cumulative' AS sampler FROM cl),
pi AS (SELECT t.episode_id, t.seq, t.seq - row_number() OVER (PARTITION BY t.episode_id ORDER BY t.seq) AS g FROM t JOIN s USING (episode_id) WHERE locality = 'phase_gated' AND k % 4 IN (0, 2)),
pr AS (SELECT episode_id, min(seq) AS rs, count(*) AS rn FROM pi GROUP BY episode_id, g),
pl AS (SELECT r.*, n, least(rn, 2) AS sh, 8 + {_draw("least(16, n) - 7", "phase-n", "r.episode_id", "rs")} AS length FROM pr r JOIN e USING (episode_id) WHERE n >= 8),
pb AS (SELECT *, greatest(0, rs + sh - length) AS lo, least(n - length, rs + rn - sh) AS hi FROM pl),
pc AS (SELECT episode_id, rs, length, lo + {_draw("hi - lo + 1", "phase-at", "episode_id", "rs")} AS start FROM pb WHERE hi >= lo),
pw AS (SELECT episode_id, arg_min(start, {_digest("run", "episode_id", "rs")}) AS start, arg_min(length, {_digest("run", "episode_id", "rs")}) AS length, 'phase_gated' AS sampler FROM pc GROUP BY 1),
st AS (SELECT * FROM ew UNION ALL SELECT * FROM cw UNION ALL SELECT * FROM pw),
rel AS (SELECT w.episode_id, locality, coalesce(st.start, w.start) AS start, coalesce(st.length, w.length) AS length, coalesce(sampler, CASE WHEN locality = 'global' THEN 'uniform' ELSE 'uniform_fallback' END) AS sampler FROM w JOIN s USING (episode_id) LEFT JOIN st USING (episode_id))"""


@query(f"WITH {_RELEVANT} SELECT * FROM rel")
def relevance_windows(spark: S, sf: str) -> DataFrame:
    """One window per episode by its locality, else anywhere."""
    return _relevant(spark, sf)[2]


@query(f"""WITH {_RELEVANT}, o AS (SELECT r.episode_id, count(*) FILTER (k % 4 IN (0, 2)) AS phase_overlap FROM rel r JOIN t ON t.episode_id = r.episode_id AND t.seq >= start AND t.seq < start + length GROUP BY 1)
SELECT rel.*, phase_overlap, CASE WHEN locality IN ('event', 'cumulative') THEN length >= 10 WHEN locality = 'phase_gated' THEN phase_overlap >= 2 ELSE true END AS validated FROM rel JOIN o USING (episode_id)""")
def relevance_validated(spark: S, sf: str) -> DataFrame:
    rows, spec, found = _relevant(spark, sf)
    return relevance.relevance_report(found, rows, EP, "seq", "phase", spec)


def _phases(n: int) -> str:
    return f"""WITH {_UNIFORM}, i AS (SELECT t.*, seq - start AS pos FROM t JOIN w USING (episode_id) WHERE seq >= start AND seq < start + length),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY episode_id, event_type ORDER BY pos) AS g FROM i), r AS (SELECT episode_id, event_type, min(pos) AS s, count(*) AS n FROM g GROUP BY episode_id, event_type, g),
z AS (SELECT *, count(*) OVER p AS c, min(s) OVER p AS lo, max(s) OVER p AS hi FROM r WINDOW p AS (PARTITION BY episode_id)), f AS (SELECT *, {_digest("phase", "episode_id", "s")} AS d FROM z WHERE (c < 3 OR s > lo AND s < hi) AND n >= 2),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY episode_id, event_type ORDER BY d) = 1), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY d) <= {n})
SELECT p.episode_id, p.event_type, p.n AS phase_length, max(ms) FILTER (pos = s) AS answer, min(ms) AS low, max(ms) AS high FROM p JOIN i USING (episode_id) WHERE pos BETWEEN s - 3 AND s + 3 GROUP BY p.episode_id, p.event_type, p.n"""


@query(_phases(1))
def phase_isolation(spark: S, sf: str) -> DataFrame:
    return gen.phase_isolation(telemetry(spark, sf), _windows(spark, sf), EP, "seq", "ms", "event_type", least=2)


@query(_phases(3))
def phase_isolation_several(spark: S, sf: str) -> DataFrame:
    """Up to three phases of a window, an item each."""
    return gen.phase_isolation(telemetry(spark, sf), _windows(spark, sf), EP, "seq", "ms", "event_type", least=2, phases=3)


@query(f"""WITH {_UNIFORM}, p AS (SELECT t.*, seq - start AS pos, length FROM t JOIN w USING (episode_id))
SELECT episode_id, round(max(value) FILTER (pos = length + 2), 4) AS answer, max(ms) FILTER (pos = length + 2) - max(ms) FILTER (pos >= 0 AND pos < length) AS ahead, round(0.75 * stddev_pop(value) FILTER (pos >= 0 AND pos < length), 6) AS margin
FROM p GROUP BY 1 HAVING max(value) FILTER (pos = length + 2) IS NOT NULL""")
def scalar_prediction(spark: S, sf: str) -> DataFrame:
    """Value three rows after the window."""
    return gen.scalar_prediction(telemetry(spark, sf), _windows(spark, sf), EP, "seq", "ms", "value", 3)


@query(f"""WITH {AXES}, p AS (SELECT *, seq - 4 AS pos FROM a)
SELECT episode_id, concat('[', printf('%.6f', max(v0) FILTER (pos = 10)), ',', printf('%.6f', max(v1) FILTER (pos = 10)), ']') AS answer, round(0.75 * stddev_pop(v0) FILTER (pos >= 0 AND pos < 9), 6) AS m0, round(0.75 * stddev_pop(v1) FILTER (pos >= 0 AND pos < 9), 6) AS m1
FROM p GROUP BY 1 HAVING max(v0) FILTER (pos = 10) IS NOT NULL""")
def tensor_prediction(spark: S, sf: str) -> DataFrame:
    """Both axes two rows after nine rows of context."""
    a = axes(spark, sf)
    w = a.select(*EP).distinct().withColumn("start", F.lit(4)).withColumn("length", F.lit(9))
    return gen.tensor_prediction(a, w, EP, "seq", ["v0", "v1"], 2).select(*EP, "answer", F.col("margins")[0].alias("m0"), F.col("margins")[1].alias("m1"))


@query(f"""WITH {ROBOT}, o AS (SELECT episode_id, min(seq) AS onset FROM t WHERE fault = 1 GROUP BY 1), c AS (SELECT t.episode_id, (seq - onset) // 5 AS chunk, count(*) AS n FROM t JOIN o USING (episode_id) WHERE seq >= onset AND seq < onset + 20 GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS k, chr(64 + (row_number() OVER (PARTITION BY episode_id ORDER BY {_digest("segment", "episode_id", "chunk")}, chunk))::INT) AS letter FROM c WHERE n = 5)
SELECT episode_id, string_agg(letter, '' ORDER BY chunk) AS answer FROM f WHERE k = 4 GROUP BY 1""")
def segment_ranking(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    onsets = t.where("fault = 1").groupBy(*EP).agg(F.min("seq").alias("onset"))
    return gen.segment_ranking(t, onsets, EP, "seq", "value").select(*EP, "answer")


_ROBOTS = ("arm of six axes", "heavy carrier", "light picker")
_CAUSES = ("worn belt", "loose bolt", "low battery", "blocked path", "cold joint")


@query("WITH x AS (SELECT c_custkey, [" + ", ".join(f"'{r}'" for r in _ROBOTS) + "] AS pool FROM customer), o AS (SELECT c_custkey, pool[(c_custkey % 3)::INT + 1] AS robot, list_transform(list_sort(list_transform(pool, lambda r: concat(md5(concat_ws(':', 'options', c_custkey::VARCHAR, r)), r))), lambda s: substr(s, 33)) AS o FROM x) SELECT c_custkey, robot, chr(64 + list_position(o, robot)::INT) AS answer, o[1] AS first FROM o")
def robot_identification(spark: S, sf: str) -> DataFrame:
    pool = F.array(*map(F.lit, _ROBOTS))
    c = table(spark, sf, "customer").select("c_custkey", F.get(pool, (F.col("c_custkey") % 3).cast("int")).alias("robot"))
    return gen.single_select(c, ["c_custkey"], "robot", pool).select("c_custkey", "robot", "answer", F.element_at("options", "A").alias("first"))


_SORTED = "list_transform(list_sort(list_transform({x}, lambda r: concat(md5(concat_ws(':', '{salt}', c_custkey::VARCHAR, r)), r))), lambda s: substr(s, 33))"


@query("WITH x AS (SELECT c_custkey, [" + ", ".join(f"'{r}'" for r in _CAUSES) + f"] AS pool FROM customer), d AS (SELECT c_custkey, pool[(c_custkey % 5)::INT + 1] AS cause, list_filter(pool, lambda r: r <> pool[(c_custkey % 5)::INT + 1]) AS rest FROM x), "
       + f"e AS (SELECT *, list_prepend(cause, {_SORTED.format(x='rest', salt='distractor')}[1:3]) AS few FROM d), o AS (SELECT *, {_SORTED.format(x='few', salt='options')} AS o FROM e) SELECT c_custkey, cause, chr(64 + list_position(o, cause)::INT) AS answer, array_to_string(o, '|') AS offered FROM o")
def anomaly_detection(spark: S, sf: str) -> DataFrame:
    pool = F.array(*map(F.lit, _CAUSES))
    c = table(spark, sf, "customer").select("c_custkey", F.get(pool, (F.col("c_custkey") % 5).cast("int")).alias("cause"))
    c = c.withColumn("offered", gen.distractors("cause", pool, ["c_custkey"]))
    out = gen.single_select(c, ["c_custkey"], "cause", "offered")
    return out.select("c_custkey", "cause", "answer", F.array_join(F.map_values("options"), "|").alias("offered"))


@query(f"""WITH {ROBOT}, c AS (SELECT episode_id, event_type, count(*) AS n, min(seq) AS f FROM t GROUP BY 1, 2), m AS (SELECT episode_id, arg_min(event_type, (-n, f)) AS phase FROM c GROUP BY 1),
e AS (SELECT t.episode_id, max(fault * (k % 3)) AS fault, any_value(phase) AS phase, t.episode_id % 2 AS robot, t.episode_id % 3 AS task FROM t JOIN m USING (episode_id) GROUP BY t.episode_id),
p AS (SELECT *, coalesce(lead(episode_id) OVER g, first_value(episode_id) OVER g) AS other FROM e WINDOW g AS (PARTITION BY episode_id % 5 ORDER BY episode_id)),
x AS (SELECT p.episode_id, other, concat(CASE WHEN p.robot <> b.robot THEN 'T' ELSE 'F' END, CASE WHEN p.fault <> b.fault THEN 'T' ELSE 'F' END, CASE WHEN p.task <> b.task THEN 'T' ELSE 'F' END, CASE WHEN p.task = b.task AND p.phase <> b.phase THEN 'T' ELSE 'F' END) AS answer FROM p JOIN e b ON b.episode_id = other WHERE other <> p.episode_id)
SELECT * FROM x WHERE answer LIKE '%T%'""")
def comparison(spark: S, sf: str) -> DataFrame:
    """Each episode against another of its group: robots, anomalies, tasks, usual phases."""
    t = telemetry(spark, sf)
    phase = modal(t, EP, "event_type", "seq").select(*EP, F.col("event_type").alias("phase"))
    e = t.groupBy(*EP).agg(F.max(F.col("fault") * (F.col("k") % 3)).alias("fault")).join(phase, EP)
    e = e.withColumn("robot", F.col("episode_id") % 2).withColumn("task", F.col("episode_id") % 3).withColumn("g", F.col("episode_id") % 5)
    pairs = joins.other_of_group(e, ["g"], EP, [*EP, "fault", "phase", "robot", "task"])
    out = gen.comparison(pairs, ["robot", "other_robot"], ["fault", "other_fault"], ["task", "other_task"], ["phase", "other_phase"])
    return out.select(*EP, F.col("other_episode_id").alias("other"), "answer")


@query(f"""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY {_digest("block", "o_orderkey")}, o_orderkey) - 1 AS i FROM orders),
b AS (SELECT *, i // 4 AS block, chr(65 + (i % 4)::INT) AS label, count(*) OVER (PARTITION BY o_custkey, i // 4) AS n FROM x)
SELECT o_custkey, block, string_agg(label, '' ORDER BY o_totalprice DESC, label) AS answer FROM b WHERE n = 4 GROUP BY 1, 2 HAVING count(DISTINCT o_totalprice) = 4""")
def severity_ranking(spark: S, sf: str) -> DataFrame:
    """Blocks of four in drawn order, ranked; ties make no item. Durations and energies go the same way, ascending."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = seq.Window.partitionBy("o_custkey").orderBy(draws.digest("block", "o_orderkey"), "o_orderkey")
    b = o.withColumn("i", F.row_number().over(w) - 1).withColumn("block", F.floor(F.col("i") / 4)).withColumn("label", F.chr(65 + F.col("i") % 4))
    b = b.withColumn("n", F.count(F.lit(1)).over(seq.Window.partitionBy("o_custkey", "block"))).where("n = 4")
    return gen.ranking_items(b, ["o_custkey", "block"], "label", "o_totalprice", descending=True)


@query("SELECT o_orderkey, n_name AS root_cause, concat('see ', n_comment) AS answer FROM orders JOIN nation ON o_custkey % 30 = n_nationkey".replace("n_comment", "n_regionkey"))
def troubleshooting(spark: S, sf: str) -> DataFrame:
    """Fault to cause and remedy; faults without a known cause make no item."""
    causes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("fault"), "n_name", F.concat(F.lit("see "), F.col("n_regionkey").cast("string")).alias("remedy"))
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("fault"))
    return gen.cause_items(o, causes, "fault", "n_name", "remedy").select("o_orderkey", "root_cause", "answer")


@query("""WITH x AS (SELECT p_partkey, p_size % 30 AS fault, p_size AS mass, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS right_mass, p_brand AS tool, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#11' END AS right_tool FROM part)
SELECT p_partkey, fault, concat_ws('; ', CASE WHEN mass <> right_mass THEN concat('set mass from ', mass, ' to ', right_mass) END, CASE WHEN right_tool IS NOT NULL AND tool <> right_tool THEN concat('set tool from ', tool, ' to ', right_tool) END) AS answer
FROM x WHERE fault IN (22, 23, 28) AND (mass <> right_mass OR right_tool IS NOT NULL AND tool <> right_tool)""")
def optimisation(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 30).alias("fault"), F.col("p_size").alias("mass"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).alias("right_mass"), F.col("p_brand").alias("tool"), F.when(F.col("p_partkey") % 3 == 0, "Brand#11").alias("right_tool"))
    return gen.correction_items(p, "fault", (22, 23, 28), [("mass", "mass", "right_mass"), ("tool", "tool", "right_tool")], ["p_partkey"])


@query("SELECT c_custkey, r_regionkey FROM customer, region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = r_regionkey)")
def combinations(spark: S, sf: str) -> DataFrame:
    """Templates (a small catalogue) with episodes, less what is done."""
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5).alias("r_regionkey"))
    return gen.combinations(table(spark, sf, "region").select("r_regionkey"), table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey", "r_regionkey"])


_CELLS = f"""{ROBOT}, e AS (SELECT episode_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT episode_id, n, unnest(range(0, n // 12 + 1)) AS cell FROM e),
d AS (SELECT *, 3 + {_draw("4", "duration", "episode_id", "cell")} AS d FROM c WHERE {_draw("1000000", "on", "episode_id", "cell")} < 500000),
f AS (SELECT *, cell * 12 + {_draw("12 - d", "place", "episode_id", "cell")} AS first FROM d), sp AS (SELECT episode_id, first, first + d - 1 AS last, [2, 3, 5][{_draw("3", "event", "episode_id", "cell")} + 1] AS event FROM f WHERE first + d - 1 < n)"""


def _spans(spark: S, sf: str) -> DataFrame:
    n = telemetry(spark, sf).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    return gen.event_spans(n, EP, "n", [2, 3, 5], 0.5, 3, 6)


@query(f"WITH {_CELLS} SELECT * FROM sp")
def event_spans(spark: S, sf: str) -> DataFrame:
    return _spans(spark, sf)


@query(f"WITH {_CELLS} SELECT event_id, round(CASE WHEN sp.event IS NOT NULL THEN value - 10 * sp.event ELSE value END, 6) AS value, sp.event IS NOT NULL AS injected FROM t LEFT JOIN sp ON sp.episode_id = t.episode_id AND seq BETWEEN first AND last")
def inject_dip(spark: S, sf: str) -> DataFrame:
    spans = _spans(spark, sf).select(*EP, "first", "last", (10.0 * F.col("event")).alias("delta"))
    return gen.inject(telemetry(spark, sf), spans, EP, "seq", "value", -1).select("event_id", F.round("value", 6).alias("value"), "injected")


@query(f"""WITH {ROBOT}, b AS (SELECT *, nullif(k % 3, 0) AS e, lag(value) OVER w AS bef, seq - row_number() OVER (PARTITION BY episode_id, k % 3 ORDER BY seq) AS g FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)),
r AS (SELECT episode_id, any_value(e) AS event, min(seq) AS first, count(*) AS n, arg_min(ms, seq) AS onset_time, coalesce(arg_min_null(bef, seq), arg_min(value, seq)) AS x, arg_max(value, seq) AS y FROM b WHERE e IS NOT NULL GROUP BY episode_id, e, g)
SELECT episode_id, first, n, round(abs(y - x), 6) AS delta, round((y - x) / greatest(1, n), 6) AS rate, [0.5, 1.0, 1.5, 2.0, 2.5][(event + n) % 5 + 1]::DOUBLE AS payload, concat_ws('_', event::VARCHAR, {_number("x", 6)}, {_number("y", 6)}, {_number("abs(y - x)", 6)}) AS label FROM r""")
def event_labels(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("e", F.col("k") % 3)
    out = gen.event_labels(t, EP, "seq", "e", "ms", "value")
    return out.select(*EP, "first", "n", F.round("delta", 6).alias("delta"), F.round("rate", 6).alias("rate"), "payload", F.substring_index("label", "_", 4).alias("label"))


# point-in-time answers

_AT = f"""{AXES}, p AS (SELECT DISTINCT episode_id, 12.5 + (episode_id % 9) * 11.5 AS t1, 31.5 + (episode_id % 5) * 17 AS t2 FROM a), hi AS (SELECT episode_id, max(seq) AS hi FROM a GROUP BY 1),
b AS (SELECT p.*, least(floor(t1 / 10), hi) AS a0, least(ceil(t1 / 10), hi) AS a1, least(floor(t2 / 10), hi) AS b0, least(ceil(t2 / 10), hi) AS b1 FROM p JOIN hi USING (episode_id)),
""" + "q AS (SELECT b.episode_id, " + ", ".join(f"CASE WHEN {m}0 = {m}1 THEN {m}x.{c} ELSE {m}x.{c} + ({m}z.{c} - {m}x.{c}) * (({t} - {m}0 * 10) / 10) END AS {c}_{i}" for m, t, i in (("a", "t1", 1), ("b", "t2", 2)) for c in ("v0", "v1", "s0", "e0")) + \
    " FROM b " + " ".join(f"JOIN a {m}{s} ON {m}{s}.episode_id = b.episode_id AND {m}{s}.seq = b.{m}{j}" for m in "ab" for s, j in (("x", 0), ("z", 1))) + ")"


def _probed(spark: S, sf: str) -> DataFrame:
    """v0 v1 s0 e0 at two times of each episode, with suffixes _1 and _2."""
    rows = axes(spark, sf).withColumn("t", F.col("seq") * 10.0)
    signals = ["v0", "v1", "s0", "e0"]
    ids = rows.select(*EP).distinct()
    probes = ids.withColumn("i", F.lit(1)).withColumn("t", 12.5 + (F.col("episode_id") % 9) * 11.5).unionByName(ids.withColumn("i", F.lit(2)).withColumn("t", 31.5 + (F.col("episode_id") % 5) * 17))
    at = questions.at_times(probes, rows, EP, "t", signals)
    return at.groupBy(*EP).agg(*[F.max(F.when(F.col("i") == i, F.col(s))).alias(f"{s}_{i}") for i in (1, 2) for s in signals])


def _parts(x, *names: str) -> list:
    return [F.round(x["value"], 6).alias(f"{names[0]}_value"), x["answer"].alias(f"{names[0]}_answer"), x["holds"].alias(f"{names[0]}_holds")]


@query(f"""WITH {_AT} SELECT episode_id, round(abs(v0_2 - v0_1), 6) AS moved_value, CASE WHEN abs(v0_2 - v0_1) <= 5 THEN 'Yes' ELSE 'No' END AS moved_answer, abs(v0_2 - v0_1) <= 5 AS moved_holds,
  round(abs(s0_2 - v0_2) - abs(s0_1 - v0_1), 6) AS trend_value, CASE WHEN abs(s0_2 - v0_2) - abs(s0_1 - v0_1) > 1e-4 THEN 'increased' WHEN abs(s0_2 - v0_2) - abs(s0_1 - v0_1) < -1e-4 THEN 'decreased' ELSE 'stable' END AS trend_answer, abs(s0_2 - v0_2) - abs(s0_1 - v0_1) > 1e-4 AS trend_holds FROM q""")
def position_and_trend(spark: S, sf: str) -> DataFrame:
    q = _probed(spark, sf)
    moved = questions.same_position("v0_1", "v0_2", 5.0)
    trend = questions.error_trend(F.abs(F.col("s0_1") - F.col("v0_1")), F.abs(F.col("s0_2") - F.col("v0_2")))
    return q.select(*EP, *_parts(moved, "moved"), *_parts(trend, "trend"))


@query(f"""WITH {_AT}, z AS (SELECT *, v0_1 * 9.81 AS ax, v1_1 * 9.81 AS ay, e0_1 * 9.81 AS az FROM q) SELECT episode_id, round(sqrt(ax * ax + ay * ay + az * az), 6) AS size, sqrt(ax * ax + ay * ay + az * az) > 400 AS above,
  CASE WHEN abs(ax) >= greatest(abs(ay), abs(az)) THEN 'X' WHEN abs(ay) >= abs(az) THEN 'Y' ELSE 'Z' END AS highest, CASE WHEN sqrt(v0_1 * v0_1 + v1_1 * v1_1) >= 40 THEN 'Yes' ELSE 'No' END AS force FROM z""")
def vector_answers(spark: S, sf: str) -> DataFrame:
    """Acceleration vector and external force; the sensed parts are missing here, so the estimate counts."""
    q = _probed(spark, sf).withColumn("none", F.lit(None).cast("double"))
    a = questions.acceleration(["v0_1", "v1_1", "e0_1"], 400.0)
    f = questions.force_detected(questions.wrench(["none", "v1_1"], ["v0_1", "v1_1"]), 40.0)
    return q.select(*EP, F.round(a["value"], 6).alias("size"), a["holds"].alias("above"), a["highest"].alias("highest"), f["answer"].alias("force"))


@query(f"""WITH {_AT} SELECT episode_id, round(abs(v1_1), 6) AS torque, abs(v1_1) > 30 AS torque_above, round(v0_1, 6) AS speed, abs(v0_1) < 20 AS speed_below, concat(CASE WHEN abs(v0_1) <= 20 THEN 'T' ELSE 'F' END, CASE WHEN abs(v1_1) <= 40 THEN 'T' ELSE 'F' END, CASE WHEN abs(e0_1) <= 3.14 THEN 'T' ELSE 'F' END) AS limits,
  CASE WHEN abs(v0_1) >= abs(v1_1) AND abs(v0_1) >= abs(e0_1) THEN 0 WHEN abs(v1_1) >= abs(e0_1) THEN 1 ELSE 2 END AS highest FROM q""")
def threshold_answers(spark: S, sf: str) -> DataFrame:
    """Torque, speed and current against thresholds, rated limits per joint, and the joint of the largest value."""
    q = _probed(spark, sf)
    torque, speed = questions.magnitude("v1_1", 30.0), questions.below("v0_1", 20.0)
    joints = ["v0_1", "v1_1", "e0_1"]
    return q.select(*EP, F.round(torque["value"], 6).alias("torque"), torque["holds"].alias("torque_above"), F.round(speed["value"], 6).alias("speed"), speed["holds"].alias("speed_below"), questions.within_limits(joints, F.array(F.lit(20.0), F.lit(40.0))).alias("limits"), questions.ranked_joints(joints)["highest"].alias("highest"))


@query(f"""WITH {AXES}, p AS (SELECT DISTINCT episode_id, unnest([100, 300]) AS pos FROM a), n AS (SELECT p.episode_id, pos, count(*) AS n, median(CASE WHEN abs(v0) > 1e-6 THEN abs(e0) / abs(v0) END) AS m FROM p JOIN a ON a.episode_id = p.episode_id AND seq * 10 BETWEEN pos - 50 AND pos + 50 GROUP BY 1, 2),
f AS (SELECT episode_id, max(m) FILTER (pos = 100 AND n >= 3) AS f1, max(m) FILTER (pos = 300 AND n >= 3) AS f2 FROM n GROUP BY 1)
SELECT episode_id, round(f1, 6) AS f1, round(f2, 6) AS f2, CASE WHEN f1 IS NULL OR f2 IS NULL THEN 'Unknown' WHEN f1 = 0 OR f2 / f1 > 1.1 THEN 'Yes' ELSE 'No' END AS answer FROM f""")
def friction_increase(spark: S, sf: str) -> DataFrame:
    rows = axes(spark, sf).withColumn("t", F.col("seq") * 10)
    probes = rows.select(*EP).distinct().withColumn("t", F.explode(F.array(F.lit(100), F.lit(300)))).withColumn("at", F.col("t"))
    p = questions.friction_proxies(probes, rows, EP, "t", ["at"], "v0", "e0", 50)
    f = p.groupBy(*EP).agg(F.max(F.when(F.col("at") == 100, F.col("friction"))).alias("f1"), F.max(F.when(F.col("at") == 300, F.col("friction"))).alias("f2"))
    return f.select(*EP, F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"), questions.friction_rises("f1", "f2", 10.0)["answer"].alias("answer"))


@query(f"""WITH {ROBOT}, j AS (SELECT event_id, ((lead(value, 2) OVER w - value) / nullif((lead(ms, 2) OVER w - ms) / 1000.0, 0) - (value - lag(value, 2) OVER w) / nullif((ms - lag(ms, 2) OVER w) / 1000.0, 0)) / nullif((lead(ms) OVER w - lag(ms) OVER w) / 1000.0, 0) AS j FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq))
SELECT event_id, round(j * 1e6, 4) + 0.0 AS jerk, CASE WHEN abs(j) < 1 THEN 'Low' WHEN abs(j) < 5 THEN 'Medium' WHEN abs(j) >= 5 THEN 'High' END AS band FROM j""")
def jerk_at_rows(spark: S, sf: str) -> DataFrame:
    j = questions.jerk_at_rows(telemetry(spark, sf), EP, ["seq"], "ms", "value")
    return j.select("event_id", (F.round(F.col("jerk") * 1e6, 4) + 0.0).alias("jerk"), questions.jerk_range("jerk").alias("band"))


@query(f"""WITH {_AT} SELECT episode_id, round(s1_1, 6) AS current, CASE WHEN abs(s1_1) > 30 THEN true ELSE false END AS above, CASE WHEN episode_id % 4 = 0 THEN 'Unknown' WHEN abs(s1_1) <= CASE episode_id % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 40.0 ELSE 2.0 END THEN 'Yes' ELSE 'No' END AS rated,
  round(abs(s0_1 - v0_1), 6) AS error, abs(s0_1 - v0_1) > 1 AS error_above FROM (SELECT *, s0_1 - v1_1 AS s1_1 FROM q)""")
def current_answers(spark: S, sf: str) -> DataFrame:
    """A current with its sign against a threshold and against its joint's rating, and a tracking error at one time."""
    q = _probed(spark, sf).withColumn("signed", F.col("s0_1") - F.col("v1_1"))
    limits = F.when(F.col("episode_id") % 4 > 0, F.array(F.lit(25.0), F.lit(40.0)))
    own, error = questions.current("signed", 30.0), questions.tracking_error_at("s0_1", "v0_1", 1.0)
    return q.select(*EP, F.round(own["value"], 6).alias("current"), own["holds"].alias("above"), questions.within_rating("signed", limits, F.col("episode_id") % 3)["answer"].alias("rated"), F.round(error["value"], 6).alias("error"), error["holds"].alias("error_above"))


@query(f"""WITH {ROBOT}, j AS (SELECT episode_id, ms, seq, ((lead(value, 2) OVER w - value) / nullif((lead(ms, 2) OVER w - ms) / 1000.0, 0) - (value - lag(value, 2) OVER w) / nullif((ms - lag(ms, 2) OVER w) / 1000.0, 0)) / nullif((lead(ms) OVER w - lag(ms) OVER w) / 1000.0, 0) AS j FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY ms)),
p AS (SELECT episode_id, min(ms) + (max(ms) - min(ms)) // 3 AS here FROM t GROUP BY 1), n AS (SELECT p.episode_id, list(j.j ORDER BY abs(ms - here), ms)[1] AS near FROM p JOIN j USING (episode_id) GROUP BY 1)
SELECT episode_id, round(near * 1e6, 4) + 0.0 AS value, CASE WHEN abs(near) < 1 THEN 'Low' WHEN abs(near) < 5 THEN 'Medium' WHEN abs(near) >= 5 THEN 'High' END AS band, abs(near) > 5 AS holds FROM n""")
def jerk_near(spark: S, sf: str) -> DataFrame:
    """The jerk at the row nearest to a time."""
    t = telemetry(spark, sf)
    probes = t.groupBy(*EP).agg((F.min("ms") + F.expr("(max(ms) - min(ms)) div 3")).alias("ms"))
    out = questions.jerk_at(probes, t, EP, "ms", "value")
    return out.select(*EP, (F.round(F.col("value") * 1e6, 4) + 0.0).alias("value"), F.col("range").alias("band"), "holds")


# baselines and stored scores

_OPTIONS = "CASE WHEN kind < 5 OR kind IN (7, 8) THEN ['A', 'B', 'C', 'D'] END"


def _items(spark: S, sf: str) -> DataFrame:
    r = replies(spark, sf).withColumn("kind", F.col("item_id") % 12)
    return r.withColumn("options", F.when((F.col("kind") < 5) | F.col("kind").isin(7, 8), F.array(*map(F.lit, "ABCD")))).withColumn("template", F.when(F.col("kind") == 6, 7).otherwise(5))


@query(f"""WITH {REPLIES} SELECT item_id, CASE WHEN level = 1 AND kind = 6 THEN 'regression' WHEN kind < 3 THEN 'mcq' WHEN kind < 5 THEN 'tfft' WHEN kind IN (7, 8) THEN 'ranking' WHEN kind IN (5, 6) THEN 'numeric' ELSE 'skip' END AS strategy,
  CASE WHEN kind < 3 OR kind IN (5, 6, 11) THEN 'numerical' WHEN kind < 5 THEN 'multi_select' WHEN kind < 9 THEN 'ranking' ELSE 'numerical' END AS chart_type FROM r""")
def baseline_strategy(spark: S, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", baselines.strategy("level", "template", "truth", "options").alias("strategy"), baselines.answer_type("truth").alias("chart_type"))


@query(f"""WITH {REPLIES} SELECT item_id, substr('ABCD', CAST({_draw("4", "mcq", "item_id")} AS INT) + 1, 1) AS choice, translate(substr({_digest("tfft", "item_id")}, 1, 4), '0123456789abcdef', 'FFFFFFFFTTTTTTTT') AS flags,
  array_to_string(list_transform(list_sort(list_transform(['A', 'B', 'C', 'D'], lambda c: concat(md5(concat_ws(':', 'ranking', item_id::VARCHAR, c)), c))), lambda s: substr(s, 33)), '') AS ranking, {_draw("greatest(1, p_size)", "numeric", "item_id")} AS number FROM r""")
def random_baselines(spark: S, sf: str) -> DataFrame:
    letters = F.array(*map(F.lit, "ABCD"))
    return replies(spark, sf).select("item_id", baselines.random_choice(letters, "item_id").alias("choice"), baselines.random_flags(F.lit(4), "item_id").alias("flags"), baselines.random_ranking(letters, "item_id").alias("ranking"), baselines.random_number("p_size", F.lit(8), "item_id").alias("number"))


@query(f"WITH {ROBOT} SELECT episode_id, round(CASE WHEN count(*) >= 2 THEN regr_slope(value, seq) * (max(seq) + 3) + regr_intercept(value, seq) ELSE arg_max(value, seq) END, 4) AS forecast FROM t GROUP BY 1")
def line_forecast(spark: S, sf: str) -> DataFrame:
    """A straight line through the episode, three rows on."""
    f = baselines.line_forecast(telemetry(spark, sf), EP, "seq", "value", F.col("__end") + 3)
    return f.select(*EP, F.round("forecast", 4).alias("forecast"))


@query(f"""WITH {REPLIES} SELECT item_id, answer_format, CASE WHEN kind = 11 THEN CASE WHEN p_size % 2 = 0 THEN 0.5 END WHEN kind < 3 THEN CASE WHEN letter = 'B' THEN 1.0 ELSE 0.0 END WHEN kind = 3 THEN 0.75 WHEN kind = 4 THEN 0.5 WHEN kind < 7 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN kind = 7 THEN 0.25 WHEN kind = 8 THEN 0.5 WHEN kind = 9 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM r""")
def rescored(spark: S, sf: str) -> DataFrame:
    r = replies(spark, sf).withColumn("verdict", F.when(F.col("p_size") % 2 == 0, 0.5))
    return baselines.rescored(r, "reply", "truth", F.col("answer_format"), "verdict").select("item_id", "answer_format", "score")


@query(f"""WITH {REPLIES} SELECT item_id, answer_format AS new_format, 'b' AS new_type, CASE WHEN p_size % 3 = 0 THEN CASE WHEN kind < 3 THEN CASE WHEN letter = 'B' THEN 1.0 ELSE 0.0 END WHEN kind = 3 THEN 0.75 WHEN kind = 4 THEN 0.5 WHEN kind < 7 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN kind = 7 THEN 0.25 WHEN kind = 8 THEN 0.5 WHEN kind = 9 THEN 1.0 WHEN kind = 10 THEN 0.0 END ELSE 0.125 END::DOUBLE AS new_score
FROM r WHERE p_size % 3 < 2""")
def retagged(spark: S, sf: str) -> DataFrame:
    """A third has another format than stored, a third another type, a third is as it was."""
    r = replies(spark, sf).withColumn("stored", F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("answer_format"))).withColumn("stored_type", F.when(F.col("p_size") % 3 == 2, "b").otherwise("a")).withColumn("score", F.lit(0.125))
    return baselines.retagged(r, "stored", F.col("answer_format"), "stored_type", F.lit("b"), "reply", "truth").select("item_id", "new_format", "new_type", "new_score")


_TEXTS = {
    "gold": ["set the payload to 1.5 kg and slow down the wrist", "replace the worn belt, then check the tension", "the and for with", "reduce speed to 55 mm/s and offset -2"],
    "cause": ["payload_mismatch", "worn_belt", "loose-bolt", "none"],
    "said": ["Payload 1.5kg; slow the wrist down.", "It is the worn_belt.", "a bolt came loose", "offset -2 at 55", "replace belt and check tension then"],
}
_STOP = "(" + ", ".join(f"'{w}'" for w in scoring.STOPWORDS) + ")"
_LISTS = {k: "[" + ", ".join("'" + x + "'" for x in v) + "]" for k, v in _TEXTS.items()}


@query(f"""WITH x AS (SELECT p_partkey, {_LISTS["gold"]}[p_partkey % 4 + 1] AS gold, {_LISTS["cause"]}[p_partkey % 4 + 1] AS cause, {_LISTS["said"]}[p_size % 5 + 1] AS said, CASE WHEN p_partkey % 3 = 0 THEN 'troubleshooting' WHEN p_partkey % 3 = 1 THEN 'optimization' ELSE 'other' END AS kind FROM part),
y AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(gold), '[a-z][a-z0-9_-]{{2,}}')), lambda w: w NOT IN {_STOP}) AS g, list_filter(list_distinct(regexp_extract_all(lower(said), '[a-z][a-z0-9_-]{{2,}}')), lambda w: w NOT IN {_STOP}) AS h,
  list_distinct(regexp_extract_all(gold, '(-?\\d+(?:\\.\\d+)?)\\s*([a-zA-Z]+|°[CFK])?', 1)) AS nums, list_filter(string_split_regex(lower(cause), '[_\\s-]+'), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS cw FROM x),
z AS (SELECT *, CASE WHEN len(g) > 0 THEN len(list_intersect(g, h)) / len(g) ELSE 0 END AS share, len(nums) > 0 AND len(list_filter(nums, lambda v: NOT contains(lower(said), v))) = 0 AS params, contains(lower(said), lower(cause)) OR len(cw) > 0 AND len(list_filter(cw, lambda w: NOT contains(lower(said), w))) = 0 AS named FROM y)
SELECT p_partkey, round(share, 6) AS share, params, named, CASE kind WHEN 'troubleshooting' THEN CASE WHEN share >= 0.4 THEN 1.0 WHEN named THEN 0.5 ELSE 0.0 END WHEN 'optimization' THEN CASE WHEN params AND share >= 0.4 THEN 1.0 WHEN params OR share >= 0.4 THEN 0.5 ELSE 0.0 END END::DOUBLE AS score FROM z""")
def rubric(spark: S, sf: str) -> DataFrame:
    pick = lambda name, by: F.get(F.array(*map(F.lit, _TEXTS[name])), (F.col(by) % len(_TEXTS[name])).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", pick("gold", "p_partkey").alias("gold"), pick("cause", "p_partkey").alias("cause"), pick("said", "p_size").alias("said"), F.when(F.col("p_partkey") % 3 == 0, "troubleshooting").when(F.col("p_partkey") % 3 == 1, "optimization").otherwise("other").alias("kind"))
    return p.select("p_partkey", F.round(scoring.overlap("gold", "said"), 6).alias("share"), scoring.parameters("said", "gold")["all_present"].alias("params"), scoring.cause_named("said", "cause").alias("named"), scoring.rubric("said", "gold", "cause", "kind").alias("score"))
