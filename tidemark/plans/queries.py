"""One query per operator, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import encode, scoring, values
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, predicates, sampling
from tidemark.operators import sequence as seq
from tidemark.plans.registry import query
from tidemark.plans.views import AXES, REPLIES, ROBOT, axes, replies, telemetry
from tidemark.sources import tables
from tidemark.sources.scratch import kept, shared_folder
from tidemark.sources.tables import table
from tidemark.streaming import episodes

S = SparkSession
EP = ["episode_id"]


@query(f"""WITH {ROBOT} SELECT episode_id, count(*) AS n_events, sum(CASE WHEN fault = 1 AND coalesce(prev, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_onsets,
  min(CASE WHEN fault = 1 THEN seq END) AS first_event, round(sum(delta), 4) AS total_change
FROM (SELECT *, lag(fault) OVER w AS prev, coalesce(abs(value - lag(value) OVER w), 0) AS delta FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)) GROUP BY episode_id""")
def episode_overview(spark: S, sf: str) -> DataFrame:
    """Flagship: telemetry per episode with onsets and change, on one shuffle."""
    rows = seq.change_score(telemetry(spark, sf), EP, ["seq"], ["value"], "delta")
    start = (F.col("fault") != 0) & (F.coalesce(F.lag("fault").over(seq.ordered(EP, ["seq"])), F.lit(0)) == 0)
    rows = rows.withColumn("start", start)
    return rows.groupBy(*EP).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("start").alias("n_onsets"), F.min(F.when(F.col("fault") == 1, F.col("seq"))).alias("first_event"), F.round(F.sum("delta"), 4).alias("total_change"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_project(spark: S, sf: str) -> DataFrame:
    """Pruned scan with pushed filters."""
    rows = table(spark, sf, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query(f"WITH {ROBOT} SELECT episode_id, event_id, ms - first_value(ms) OVER (PARTITION BY episode_id ORDER BY seq) AS t FROM t")
def relative_ts(spark: S, sf: str) -> DataFrame:
    return seq.relative_time(telemetry(spark, sf), EP, ["seq"], "ms").select("episode_id", "event_id", "t")


_TOKEN = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(k AS VARCHAR(9)) WHEN 4 THEN concat(CAST(k AS VARCHAR(9)), '_foo_1') ELSE concat(CAST(k AS VARCHAR(9)), '_a=', CAST(fault AS VARCHAR(9)), ';b=2') END"


@query(f"WITH {ROBOT} SELECT event_id, CASE WHEN event_id % 6 < 3 THEN 0 ELSE k END AS parsed, CASE WHEN event_id % 6 = 5 THEN CAST(fault AS VARCHAR) END AS a FROM t")
def event_id_parse(spark: S, sf: str) -> DataFrame:
    token = F.expr(_TOKEN.replace("VARCHAR(9)", "STRING"))
    return telemetry(spark, sf).select("event_id", values.event_id(token).cast("long").alias("parsed"), F.element_at(values.event_params(token), "a").alias("a"))


@query(f"WITH {ROBOT} SELECT event_id, printf('mc_%03d', k) AS statement, printf('l2_mc_%03d', k) AS legacy, printf('level%d_%04d', fault + 1, k) AS stem, fault + 1 AS level FROM t")
def id_normalise(spark: S, sf: str) -> DataFrame:
    k, n = F.col("k").cast("string"), (F.col("fault") + 1).cast("string")
    reply = F.concat(F.lit("level"), n, F.lit("_"), F.lpad(k, 4, "0"), F.lit("_7_answer"))
    raw = F.concat(F.lit("l2_mc_0"), k)
    return telemetry(spark, sf).select("event_id", values.statement_id(raw).alias("statement"), values.legacy_statement_id(raw).alias("legacy"), values.reply_stem(reply).alias("stem"), values.level_of(F.concat(F.lit("out/level"), n, F.lit("/x.json"))).alias("level"))


@query(f"WITH {ROBOT} SELECT event_id, (k & 15)::INT AS bits FROM t")
def bit_pack(spark: S, sf: str) -> DataFrame:
    flags = [F.shiftright("k", i).bitwiseAND(F.lit(1)) for i in range(4)]
    return telemetry(spark, sf).select("event_id", values.bit_pack(flags).alias("bits"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(trunc(c_acctbal) AS INT) END AS whole, round_even(c_acctbal, 1) AS rounded, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '1' WHEN 'MACHINERY' THEN '2' ELSE c_mktsegment END AS code FROM customer")
def safe_casts(spark: S, sf: str) -> DataFrame:
    bal = F.when(F.col("c_acctbal") < 0, F.lit("nan")).otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", values.safe_int(bal).alias("whole"), F.bround("c_acctbal", 1).alias("rounded"), values.mapped("c_mktsegment", {"HOUSEHOLD": "1", "MACHINERY": "2"}, True).alias("code"))


@query(f"""WITH {AXES}, m AS (UNPIVOT (SELECT episode_id, v0, v1, e0 FROM a) ON v0, v1, e0 INTO NAME feature VALUE value)
SELECT episode_id, feature, count(value) AS n, round(avg(value), 6) AS mean,
  (max(value) - min(value)) / (abs(avg(value)) + 1e-9) < 0.02 OR stddev_pop(value) / (abs(avg(value)) + 1e-9) < 0.01 OR count(value) < 2 OR max(value) = min(value) AS is_constant FROM m GROUP BY ALL""")
def constant_features(spark: S, sf: str) -> DataFrame:
    found = agg.constant_features(agg.melt(axes(spark, sf), EP, ["v0", "v1", "e0"]), EP)
    return found.select("episode_id", "feature", "n", F.round("mean", 6).alias("mean"), "is_constant")


@query(f"""WITH {ROBOT}, x AS (SELECT episode_id, seq, max(seq) OVER (PARTITION BY episode_id) AS hi, {", ".join(f"CASE WHEN (episode_id + {i}) % 3 = 0 THEN 7.0 ELSE value * {i + 1} END AS f{i}" for i in range(4))} FROM t),
m AS (UNPIVOT x ON {", ".join(f"f{i}" for i in range(4))} INTO NAME feature VALUE v), c AS (SELECT episode_id, feature, max(v) = min(v) OR (max(v) - min(v)) / (abs(avg(v)) + 1e-9) < 0.02 OR stddev_pop(v) / (abs(avg(v)) + 1e-9) < 0.01 OR count(v) < 2 AS flat FROM m WHERE hi < 10 OR seq BETWEEN 5 AND hi - 5 GROUP BY 1, 2)
SELECT episode_id, count(*) FILTER (flat) AS n_constant, count(*) FILTER (flat) >= 2 AS inactive FROM c GROUP BY 1""")
def inactivity(spark: S, sf: str) -> DataFrame:
    names = [f"f{i}" for i in range(4)]
    rows = telemetry(spark, sf).select(*EP, "seq", *[F.when((F.col("episode_id") + i) % 3 == 0, 7.0).otherwise(F.col("value") * (i + 1)).alias(f"f{i}") for i in range(4)])
    return agg.inactive(agg.melt(rows, [*EP, "seq"], names), EP, "seq", least=2)


@query("SELECT p_type AS feature, CASE WHEN p_type LIKE 'S%' THEN 'intent' WHEN p_type LIKE 'P%' THEN 'outcome' END AS category, count(*) AS n FROM part GROUP BY ALL")
def category_filter(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_type").alias("feature"))
    return rows.withColumn("category", values.category("feature", {"S": "intent", "P": "outcome"})).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ROBOT}, x AS (SELECT *, lag(fault, 1, 0) OVER (PARTITION BY episode_id ORDER BY seq) AS p FROM t) SELECT episode_id, event_id, seq FROM x WHERE fault <> 0 AND p = 0")
def event_starts(spark: S, sf: str) -> DataFrame:
    return seq.event_starts(telemetry(spark, sf), EP, ["seq"], "fault").select("episode_id", "event_id", "seq")


@query(f"WITH {ROBOT}, x AS (SELECT episode_id, min(seq) FILTER (fault <> 0) AS first_event FROM t GROUP BY 1) SELECT episode_id, first_event, CASE WHEN first_event > 0 THEN first_event END AS fault_onset FROM x")
def first_onset(spark: S, sf: str) -> DataFrame:
    return seq.onsets(telemetry(spark, sf), EP, "seq", "fault")


_RUNS = f"""{ROBOT}, x AS (SELECT *, CASE WHEN seq = 0 OR event_type <> lag(event_type) OVER (PARTITION BY episode_id ORDER BY seq) THEN 1 ELSE 0 END AS new FROM t),
y AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY seq) AS run FROM x),
runs AS (SELECT episode_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(seq) AS start, count(*) AS n FROM y GROUP BY episode_id, run)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def phase_runs(spark: S, sf: str) -> DataFrame:
    return seq.runs(telemetry(spark, sf), EP, ["seq"], "event_type")


@query(f"WITH {_RUNS}, z AS (SELECT *, count(*) OVER w AS c, min(run) OVER w AS lo, max(run) OVER w AS hi FROM runs WINDOW w AS (PARTITION BY episode_id)) SELECT episode_id, run, event_type, start, n FROM z WHERE (c < 3 OR run > lo AND run < hi) AND n >= 2")
def phase_candidates(spark: S, sf: str) -> DataFrame:
    return seq.inner_runs(seq.runs(telemetry(spark, sf), EP, ["seq"], "event_type"), EP, 2)


@query(f"WITH {ROBOT}, x AS (SELECT episode_id, seq, seq - row_number() OVER (PARTITION BY episode_id ORDER BY seq) AS g FROM t WHERE value > 20) SELECT episode_id, min(seq) AS first_index, max(seq) AS last_index, count(*) AS n FROM x GROUP BY episode_id, g")
def contiguous_runs(spark: S, sf: str) -> DataFrame:
    return seq.islands(telemetry(spark, sf).where("value > 20"), EP, "seq")


@query(f"WITH {ROBOT}, x AS (SELECT *, first_value(event_type) OVER (PARTITION BY episode_id ORDER BY seq) AS f FROM t) SELECT episode_id, coalesce(min(seq) FILTER (event_type <> f), count(*)) AS segment_length FROM x GROUP BY 1")
def event_segment(spark: S, sf: str) -> DataFrame:
    return seq.event_segment(telemetry(spark, sf), EP, ["seq"], "event_type").groupBy(*EP).agg(F.max("segment_length").alias("segment_length"))


@query(f"""WITH {AXES}, x AS (SELECT *, CASE WHEN episode_id % 2 = 0 THEN 19 ELSE 5 END AS f, safety = 3 AND lag(safety) OVER (PARTITION BY episode_id ORDER BY seq) = 1 AS step FROM a),
y AS (SELECT *, min(CASE WHEN step THEN seq END) OVER (PARTITION BY episode_id) AS s FROM x)
SELECT episode_id, seq, CASE WHEN f = 19 AND s IS NOT NULL THEN CASE WHEN seq >= s THEN f ELSE 0 END ELSE 7 END AS label FROM y""")
def protective_stop_align(spark: S, sf: str) -> DataFrame:
    rows = axes(spark, sf).withColumn("f", F.when(F.col("episode_id") % 2 == 0, 19).otherwise(5)).withColumn("label", F.lit(7))
    return seq.align_protective_stop(rows, EP, ["seq"], "safety", "f", "label").select("episode_id", "seq", "label")


@query(f"""WITH {ROBOT}, x AS (SELECT *, min(CASE WHEN event_type = 'view' THEN seq END) OVER (PARTITION BY episode_id) AS s FROM t)
SELECT event_id, CASE WHEN episode_id % 2 = 0 AND seq >= s THEN 32 ELSE 0 END AS label FROM x""")
def fault_flip(spark: S, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).withColumn("f", F.when(F.col("episode_id") % 2 == 0, 32).otherwise(5)).withColumn("label", F.lit(0))
    return seq.label_from_phase(rows, EP, "seq", "event_type", "f", "label", start="view").select("event_id", "label")


@query(f"WITH {ROBOT} SELECT event_id, round(coalesce((value - lag(value) OVER w) / nullif(ms - lag(ms) OVER w, 0), 0), 9) + 0 AS rate FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)")
def finite_diff(spark: S, sf: str) -> DataFrame:
    return seq.difference(telemetry(spark, sf), EP, ["seq"], "value", "ms").select("event_id", F.round("rate", 9).alias("rate"))


@query(f"WITH {ROBOT} SELECT event_id, round(coalesce(abs(value - lag(value) OVER w), 0) + coalesce(abs(k - lag(k) OVER w), 0), 6) AS score FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)")
def change_score(spark: S, sf: str) -> DataFrame:
    return seq.change_score(telemetry(spark, sf), EP, ["seq"], ["value", "k"]).select("event_id", F.round("score", 6).alias("score"))


@query(f"""WITH {ROBOT}, x AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 21600000 OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)),
y AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY seq)::BIGINT AS session FROM x) SELECT episode_id, session, min(ms) AS first, max(ms) AS last, count(*) AS n FROM y GROUP BY 1, 2""")
def session_groups(spark: S, sf: str) -> DataFrame:
    return seq.sessions(telemetry(spark, sf), EP, "ms", 21_600_000, ["event_id"])


@query(f"""WITH {ROBOT}, x AS (SELECT *, ms - lag(ms) OVER (PARTITION BY episode_id ORDER BY seq) AS d FROM t),
y AS (SELECT episode_id, median(d) FILTER (d > 0) AS m, count(*) FILTER (d > 0) AS c, count(*) AS n FROM x GROUP BY 1)
SELECT episode_id, CASE WHEN c > 3 AND n > 5 THEN m END AS median_dt, greatest(1, coalesce(CASE WHEN c > 3 AND n > 5 THEN round_even(1000 / m / 0.0000001, 0)::BIGINT END, 1)) AS factor FROM y""")
def median_rate(spark: S, sf: str) -> DataFrame:
    return seq.sampling_rate(telemetry(spark, sf), EP, ["seq"], "ms", target_hz=1e-7).select("episode_id", "median_dt", "factor")


@query(f"WITH {ROBOT} SELECT event_id, lead(value, 3) OVER (PARTITION BY episode_id ORDER BY seq) AS ahead FROM t")
def lookahead(spark: S, sf: str) -> DataFrame:
    return seq.lookahead(telemetry(spark, sf), EP, ["seq"], "value", 3).select("event_id", "ahead")


@query(f"WITH {ROBOT} SELECT event_id, last_value(CASE WHEN k NOT IN (0, 1) THEN k END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_event FROM t")
def last_event(spark: S, sf: str) -> DataFrame:
    return seq.last_event_before(telemetry(spark, sf), EP, ["seq"], "k").select("event_id", "last_event")


_PROBES = f"{ROBOT}, p AS (SELECT episode_id, event_id, ms + 3600000 AS ms FROM t WHERE event_type = 'click'), b AS (SELECT episode_id, ms, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM t WHERE event_type = 'view' GROUP BY 1, 2)"


def _probes(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    t = telemetry(spark, sf)
    p = t.where("event_type = 'click'").select("episode_id", F.col("event_id").alias("probe"), (F.col("ms") + 3_600_000).alias("ms"))
    return p, t.where("event_type = 'view'").select("episode_id", "ms", "value", "event_id")


@query(f"WITH {_PROBES} SELECT p.event_id AS probe, b.ms AS ms_found, b.value FROM p ASOF LEFT JOIN b ON p.episode_id = b.episode_id AND p.ms >= b.ms")
def asof_backward(spark: S, sf: str) -> DataFrame:
    p, rows = _probes(spark, sf)
    return seq.asof(p, rows, EP, "ms", ["value"], tie=["event_id"]).select("probe", "ms_found", "value")


@query(f"WITH {_PROBES.replace('max(event_id) AS event_id, arg_max', 'min(event_id) AS event_id, arg_min')} SELECT p.event_id AS probe, b.ms AS ms_found, b.value FROM p ASOF LEFT JOIN b ON p.episode_id = b.episode_id AND p.ms <= b.ms")
def asof_forward(spark: S, sf: str) -> DataFrame:
    p, rows = _probes(spark, sf)
    return seq.asof(p, rows, EP, "ms", ["value"], "forward", tie=["event_id"]).select("probe", "ms_found", "value")


_BRACKET = f"""{_PROBES}, lo AS (SELECT p.*, b.ms AS t0, b.value AS x0 FROM p ASOF LEFT JOIN b ON p.episode_id = b.episode_id AND p.ms >= b.ms),
hi AS (SELECT lo.*, b.ms AS t1, b.value AS x1 FROM lo ASOF LEFT JOIN b ON lo.episode_id = b.episode_id AND lo.ms <= b.ms)"""


@query(f"WITH {_BRACKET} SELECT event_id AS probe, round(CASE WHEN t0 = ms THEN x0 WHEN t1 = ms THEN x1 WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * ((ms - t0) / (t1 - t0)) END, 6) AS value, CASE WHEN t0 = ms OR t1 = ms THEN 'exact' WHEN t0 IS NOT NULL OR t1 IS NOT NULL THEN 'interpolated' END AS how FROM hi")
def interpolate(spark: S, sf: str) -> DataFrame:
    p, rows = _probes(spark, sf)
    return seq.interpolate(p, rows, EP, "ms", "value").select("probe", F.round("value", 6).alias("value"), "how")


@query(f"WITH {_BRACKET} SELECT event_id AS probe, CASE WHEN t1 IS NULL OR ms - t0 <= t1 - ms THEN t0 ELSE t1 END AS ms_found FROM hi")
def nearest_join(spark: S, sf: str) -> DataFrame:
    p, rows = _probes(spark, sf)
    return joins.nearest(p, rows, EP, "ms", ["value"]).select("probe", "ms_found")


@query(f"WITH {ROBOT} SELECT event_id, round((lead(value, 2) OVER w - 2 * lead(value, 1) OVER w + 2 * lag(value, 1) OVER w - lag(value, 2) OVER w) / 2, 6) AS jerk FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq)")
def jerk(spark: S, sf: str) -> DataFrame:
    return seq.jerk(telemetry(spark, sf), EP, ["seq"], "value", 1.0).select("event_id", F.round("jerk", 6).alias("jerk"))


@query(f"WITH {ROBOT}, x AS (SELECT episode_id, seq // 10 AS chunk, count(*) AS n, round(sum(value), 4) AS total FROM t GROUP BY 1, 2) SELECT episode_id, chunk, n, total FROM x WHERE n = 10")
def chunks(spark: S, sf: str) -> DataFrame:
    return seq.chunks(telemetry(spark, sf), EP, "seq", 10).groupBy("episode_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {ROBOT}, x AS (SELECT *, lag(fault, 1, 0) OVER w AS p, count(*) OVER (PARTITION BY episode_id) AS c FROM t WINDOW w AS (PARTITION BY episode_id ORDER BY seq))
SELECT episode_id, seq AS onset, least(32, seq) AS n, seq - least(32, seq) AS start FROM x WHERE fault <> 0 AND p = 0 AND seq >= 16 AND c - seq - 1 >= 4""")
def event_windows(spark: S, sf: str) -> DataFrame:
    return seq.windows_before_event(telemetry(spark, sf), EP, "seq", "fault", 16, 32, 4).select("episode_id", "onset", "n", "start")


_AROUND = f"{ROBOT}, x AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c FROM t), w AS (SELECT episode_id, seq AS center, unnest(range(greatest(0, seq + 2 - 8 + 1), least(c - 8, seq - 2) + 1)) AS start FROM x WHERE fault = 1)"


@query(f"WITH {_AROUND} SELECT episode_id, center, start, 8 AS n FROM w")
def windows_around(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("c", F.count(F.lit(1)).over(seq.Window.partitionBy(*EP))).where("fault = 1").withColumnRenamed("seq", "center")
    return seq.windows_around(t, EP, "c", "center", 8, 2)


@query(f"WITH {_RUNS}, w AS (SELECT DISTINCT episode_id, seq AS start FROM t WHERE fault = 1) SELECT DISTINCT w.episode_id, w.start, 8 AS n FROM w JOIN runs r ON r.episode_id = w.episode_id WHERE r.event_type = 'view' AND least(w.start + 8, r.start + r.n) - greatest(w.start, r.start) >= least(r.n, 2)")
def phase_gated_windows(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    w = t.where("fault = 1").select("episode_id", F.col("seq").alias("start"), F.lit(8).alias("n"))
    return seq.phase_overlap(seq.runs(t, EP, ["seq"], "event_type").where("event_type = 'view'"), w, EP, 2)


@query(f"WITH {ROBOT}, m AS (SELECT episode_id % 5 AS g, episode_id, count(*) AS c FROM t GROUP BY 1, 2), x AS (SELECT *, max(c) OVER (PARTITION BY g) AS most FROM m) SELECT episode_id, most AS n_rows FROM x")
def pad_to_common(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("g", F.col("episode_id") % 5)
    return seq.pad_to_common(t, EP, ["g"], "seq").groupBy(*EP).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {ROBOT}, x AS (SELECT *, CASE WHEN k % 3 > 0 THEN value END AS v FROM t),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY seq) AS i0, first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM x)
SELECT y.event_id, round(coalesce(y.v, a.v + (b.v - a.v) * ((y.seq - y.i0) / (y.i1 - y.i0)), a.v, b.v, 0), 6) AS v FROM y LEFT JOIN x a ON a.episode_id = y.episode_id AND a.seq = y.i0 LEFT JOIN x b ON b.episode_id = y.episode_id AND b.seq = y.i1""")
def fill_gaps(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("v", F.when(F.col("k") % 3 > 0, F.col("value")))
    return seq.fill_gaps(t, EP, ["seq"], "v", "seq").select("event_id", F.round("v", 6).alias("v"))


@query()
def decimate(spark: S, sf: str) -> DataFrame:
    """Anti-alias filter and thinning; tested against a direct filter."""
    return seq.decimate(axes(spark, sf).select("episode_id", "seq", "v0", "v1", "safety"), EP, "seq", 4, ["v0", "v1"])


_UNIT = "((('0x' || substr(md5(concat_ws(':', 'walk-42-{}', episode_id::VARCHAR, seq::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query(f"""WITH {ROBOT}, s AS (SELECT *, sqrt(-2 * ln({_UNIT.format(0)})) * cos(2 * pi() * {_UNIT.format(1)}) * 0.1 AS step FROM t)
SELECT event_id, round(first_value(value) OVER w + sum(CASE WHEN seq > 0 THEN step ELSE 0 END) OVER w, 6) AS noisy FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY seq)""")
def random_walk(spark: S, sf: str) -> DataFrame:
    return seq.random_walk(telemetry(spark, sf), EP, ["seq"], "value", 0.1).select("event_id", F.round("noisy", 6).alias("noisy"))


@query(f"""WITH {ROBOT}, c AS (SELECT episode_id, event_type, count(*) AS n, min(seq) AS f FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, f) AS i FROM c) SELECT episode_id, event_type, n FROM r WHERE i = 1""")
def modal_phase(spark: S, sf: str) -> DataFrame:
    return agg.modal(telemetry(spark, sf), EP, "event_type", "seq")


@query(f"""WITH {ROBOT}, c AS (SELECT episode_id, k % 4 AS label, count(*) AS n FROM t WHERE k % 4 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, label) AS i FROM c) SELECT episode_id, label, n FROM r WHERE i = 1""")
def modal_fault(spark: S, sf: str) -> DataFrame:
    return agg.modal(telemetry(spark, sf).withColumn("label", F.col("k") % 4), EP, "label", skip_zero=True)


@query(f"WITH {ROBOT} SELECT episode_id FROM t GROUP BY 1 HAVING max(CASE WHEN value > 150 THEN 1 ELSE 0 END) = 0")
def nominal_episodes(spark: S, sf: str) -> DataFrame:
    return agg.nominal(telemetry(spark, sf).withColumn("f", (F.col("value") > 150).cast("int")), EP, "f")


_KL = f"""{ROBOT}, pairs AS (SELECT b.e AS baseline, c.e AS candidate FROM (SELECT DISTINCT episode_id AS e FROM t WHERE episode_id % 5 = 0) b JOIN (SELECT DISTINCT episode_id AS e FROM t WHERE episode_id % 5 <> 0) c ON c.e - c.e % 5 = b.e),
u AS (SELECT baseline, candidate, event_type AS f, value, 1 AS l FROM pairs JOIN t ON episode_id = baseline UNION ALL SELECT baseline, candidate, event_type, value, 0 FROM pairs JOIN t ON episode_id = candidate),
e AS (SELECT baseline, candidate, f, min(value) - 1e-9 AS lo, max(value) + 1e-9 AS hi, count(*) FILTER (l = 1) AS nl, count(*) FILTER (l = 0) AS nr FROM u GROUP BY 1, 2, 3 HAVING nl >= 5 AND nr >= 5),
g AS (SELECT *, least(30, greatest(5, nl // 5)) AS bins FROM e),
grid AS (SELECT *, unnest(range(bins)) AS bin FROM g),
h AS (SELECT u.baseline, u.candidate, u.f, least(bins - 1, floor((value - lo) / (hi - lo) * bins)::BIGINT) AS bin, count(*) FILTER (l = 1) AS cl, count(*) FILTER (l = 0) AS cr FROM u JOIN g USING (baseline, candidate, f) GROUP BY ALL),
d AS (SELECT grid.*, coalesce(cl, 0) / (nl * (hi - lo) / bins) + 1e-10 AS p, coalesce(cr, 0) / (nr * (hi - lo) / bins) + 1e-10 AS q FROM grid LEFT JOIN h USING (baseline, candidate, f, bin)),
s AS (SELECT *, p / sum(p) OVER w AS pn, q / sum(q) OVER w AS qn FROM d WINDOW w AS (PARTITION BY baseline, candidate, f)),
kl AS (SELECT baseline, candidate, avg(k) AS kl FROM (SELECT baseline, candidate, f, sum(pn * ln(pn / qn)) AS k FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _divergence(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).select("episode_id", F.col("event_type").alias("feature"), "value")
    ids = t.select("episode_id").distinct()
    named = ids.select("episode_id", F.when(F.col("episode_id") % 5 != 0, F.col("episode_id") - F.col("episode_id") % 5).alias("of"))
    pairs = joins.pair_with_baseline(named, "of", "episode_id")
    side = lambda who: pairs.join(t, F.col(who) == F.col("episode_id")).select("baseline", "candidate", "feature", "value")
    return agg.histogram_kl(side("baseline"), side("candidate"), ["baseline", "candidate"])


@query(f"WITH {_KL} SELECT baseline, candidate, round(kl, 6) AS kl FROM kl")
def kl_divergence(spark: S, sf: str) -> DataFrame:
    return _divergence(spark, sf).select("baseline", "candidate", F.round("kl", 6).alias("kl"))


@query(f"WITH {_KL} SELECT baseline, arg_min(candidate, kl) AS candidate, round(min(kl), 6) AS kl, count(*) AS n_candidates FROM kl GROUP BY 1")
def counterfactual_choice(spark: S, sf: str) -> DataFrame:
    return agg.nearest_counterfactual(_divergence(spark, sf), "baseline", "candidate")


@query(f"WITH {ROBOT} SELECT episode_id, round(0.75 * stddev_pop(value), 6) AS margin FROM t GROUP BY 1")
def margins(spark: S, sf: str) -> DataFrame:
    return agg.margins(telemetry(spark, sf), EP, "value")


@query(f"""WITH {ROBOT}, x AS (SELECT episode_id, arg_min(value, seq) AS first, arg_max(value, seq) AS last, min(value) AS lo, max(value) AS hi FROM t GROUP BY 1)
SELECT *, CASE WHEN hi - lo <= 0.05 * greatest(abs(first), 1e-9) THEN 'stable' WHEN last - first >= 0.5 * (hi - lo) THEN 'increasing' WHEN last - first <= -0.5 * (hi - lo) THEN 'decreasing' ELSE 'fluctuating' END AS trend FROM x""")
def describe_window(spark: S, sf: str) -> DataFrame:
    return agg.describe_window(telemetry(spark, sf), EP, "seq", "value")


@query(f"WITH {ROBOT} SELECT episode_id, count(*) AS n_samples, min(ms) AS first_ts, max(ms) AS last_ts, max(ms) - min(ms) AS duration FROM t GROUP BY 1")
def episode_metadata(spark: S, sf: str) -> DataFrame:
    return agg.episode_metadata(telemetry(spark, sf), EP, "seq", "ms")


_SCALE = "greatest(1e-9, abs({}))"
_STATEMENTS = {
    "mc_003": "m0 <= 0.7 * pv0 OR m1 <= 0.7 * pv1",
    "mc_004": f"f0 <= 0.1 * {_SCALE.format('pv0')} AND f1 <= 0.1 * {_SCALE.format('pv1')}",
    "mc_005": f"me0 >= 1.25 * pe0 AND av0 <= 0.1 * {_SCALE.format('pv0')} OR me1 >= 1.25 * pe1 AND av1 <= 0.1 * {_SCALE.format('pv1')}",
    "mc_006": "low >= 0.8",
    "mc_007": "high",
    "mc_008": "tr >= 1.25 * pt",
    "mc_009": "tr <= 1.1 * pt",
    "mc_012": "pk0 >= 1.2 * pe0 AND le0 <= 0.9 * pk0 OR pk1 >= 1.2 * pe1 AND le1 <= 0.9 * pk1",
    "mc_013": f"span <= 0.1 * {_SCALE.format('pr')}",
    "mc_014": "cm >= 1.2 * pr",
    "mc_015": "tc <= 1.1 * ptc",
    "mc_016": "tc >= 1.25 * ptc",
    "mc_017": "(d0 > 0.005)::INT + (d1 > 0.005)::INT >= 2",
    "mc_018": "((abs(d0) <= 0.002)::INT + (abs(d1) <= 0.002)::INT) / 2 >= 0.8",
    "mc_019": f"safe AND (tr + tc + ct + abs(cm - pr) / {_SCALE.format('pr')}) / 4 <= 1.1 * (pt + ptc + pc) / 4",
}
_TRUTHS = f"""{AXES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS c FROM a), o AS (SELECT *, c // 2 AS onset, (abs(s0 - v0) + abs(s1 - v1)) / 2 AS track, abs(s0 - v0) + abs(e0 - e1) AS tool FROM n),
b AS (SELECT episode_id, v0 AS pv0, v1 AS pv1, e0 AS pe0, e1 AS pe1, contact AS pc, robot_current AS pr, track AS pt, tool AS ptc FROM o WHERE seq = onset - 1),
g AS (SELECT o.*, b.* EXCLUDE (episode_id), seq < onset + greatest(1, floor(0.4 * (c - onset))) AS early FROM o JOIN b USING (episode_id) WHERE seq >= onset),
y AS (SELECT episode_id, any_value(pv0) AS pv0, any_value(pv1) AS pv1, any_value(pe0) AS pe0, any_value(pe1) AS pe1, any_value(pr) AS pr, any_value(pt) AS pt, any_value(ptc) AS ptc, any_value(pc) AS pc, min(v0) AS m0, min(v1) AS m1, max(abs(v0 - pv0)) AS f0, max(abs(v1 - pv1)) AS f1,
  avg(e0) AS me0, avg(e1) AS me1, avg(abs(v0)) AS av0, avg(abs(v1)) AS av1, max(e0) FILTER (early) AS pk0, max(e1) FILTER (early) AS pk1, arg_max(e0, seq) AS le0, arg_max(e1, seq) AS le1, arg_min(e0, seq) AS fe0, arg_min(e1, seq) AS fe1,
  avg(CASE WHEN contact <= 1.2 * pc THEN 1.0 ELSE 0.0 END) AS low, bool_or(contact >= 1.4 * pc) AS high, avg(track) AS tr, avg(tool) AS tc, avg(contact) AS ct, max(robot_current) - min(robot_current) AS span, avg(robot_current) AS cm, bool_and(safety = 1) AS safe FROM g GROUP BY 1),
x AS (SELECT *, (le0 - fe0) / {_SCALE.format("pe0")} AS d0, (le1 - fe1) / {_SCALE.format("pe1")} AS d1 FROM y)"""


def _truths(spark: S, sf: str) -> tuple[DataFrame, dict]:
    rows = axes(spark, sf)
    half = F.floor(F.count(F.lit(1)) / 2)
    items = rows.groupBy(*EP).agg((half - 1).alias("base"), half.alias("first"))
    tool = predicates.tracking_error([(F.col("s0"), F.col("v0"), F.col("e0"), F.col("e1"))])
    return predicates.window_features(rows, items, EP, "seq", [("v0", "s0", "e0"), ("v1", "s1", "e1")], "contact", "robot_current", "safety", tool), predicates.statements(2)


@query(f"WITH {_TRUTHS} SELECT episode_id, " + ", ".join(f"{v} AS {k}" for k, v in _STATEMENTS.items()) + " FROM x")
def mc_statements(spark: S, sf: str) -> DataFrame:
    found, truth = _truths(spark, sf)
    return found.select("episode_id", *[v.alias(k) for k, v in truth.items()])


@query(f"WITH {_TRUTHS} SELECT episode_id, concat(" + ", ".join(f"CASE WHEN {v} THEN 'T' ELSE 'F' END" for v in _STATEMENTS.values()) + ") AS answer FROM x")
def mc_answers(spark: S, sf: str) -> DataFrame:
    """All statements as one answer string per episode."""
    found, truth = _truths(spark, sf)
    return found.select("episode_id", predicates.answer_string(list(truth.values())).alias("answer"))


# joins


@query("SELECT o.o_orderkey, o.o_totalprice, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def enrich_dims(spark: S, sf: str) -> DataFrame:
    """Left joins; Spark broadcasts a side only where its own size estimate is under the threshold."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.enrich(joins.enrich(o, c, ["c_custkey"], {}), n, ["n_nationkey"], {}).select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_resume(spark: S, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.remaining(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_needed(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.needed(rows, o.where("o_totalprice > 450000"), o.where("o_orderpriority = '1-URGENT'"), key=["l_orderkey"])


@query(f"WITH {ROBOT}, s AS (SELECT episode_id, event_id AS span, seq AS lo, seq + k % 7 AS hi FROM t WHERE fault = 1) SELECT t.event_id, s.span FROM t JOIN s ON t.episode_id = s.episode_id AND t.seq BETWEEN s.lo AND s.hi")
def interval_join(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    s = t.where("fault = 1").select("episode_id", F.col("event_id").alias("span"), F.col("seq").alias("lo"), (F.col("seq") + F.col("k") % 7).alias("hi"))
    return joins.interval_join(t.select("episode_id", "event_id", "seq"), s, EP, "seq", "lo", "hi", 8).select("event_id", "span")


@query("SELECT s.s_suppkey, (SELECT min_by(n_name, n_nationkey) FROM nation n WHERE contains(s.s_name, CAST(n.n_nationkey AS VARCHAR))) AS n_name FROM supplier s")
def contains_rule(spark: S, sf: str) -> DataFrame:
    rules = table(spark, sf, "nation").select("n_name", "n_nationkey")
    return joins.first_rule(table(spark, sf, "supplier"), rules, F.col("s_name").contains(F.col("n_nationkey").cast("string")), "n_nationkey", ["n_name"], ["s_suppkey"]).select("s_suppkey", "n_name")


@query("WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, o_orderkey, other FROM a JOIN b USING (o_custkey, i)")
def positional_zip(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return joins.positional_zip(o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("other"), "o_orderdate"), ["o_custkey"], ["o_orderkey"], ["o_orderdate", "other"]).select("o_custkey", "o_orderkey", "other")


@query("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS other_o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def other_episode(spark: S, sf: str) -> DataFrame:
    return joins.other_of_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], ["o_orderkey"])


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws(':', 'block-42', o_orderkey::VARCHAR)), o_orderkey) - 1 AS i FROM orders),
b AS (SELECT *, i // 4 AS block, chr(65 + (i % 4)::INT) AS label, count(*) OVER (PARTITION BY o_custkey, i // 4) AS n FROM x) SELECT o_custkey, block, string_agg(label, '' ORDER BY o_totalprice, label) AS answer FROM b WHERE n = 4 GROUP BY 1, 2""")
def ranking_groups(spark: S, sf: str) -> DataFrame:
    """Groups of four orders in a drawn order, ranked by price."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.rank_letters(joins.blocks_of(o, ["o_custkey"], 4, ["o_orderkey"]), ["o_custkey", "block"], "label", "o_totalprice")


@query("SELECT conv_id, turn, text, q AS question FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user'")
def reply_pairs(spark: S, sf: str) -> DataFrame:
    return joins.reply_of(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", "text").select("conv_id", "turn", "text", "question")


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 2 = 0 AS any_vote, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'old' END AS judge_a FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def vote_merge(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    votes = lambda v: F.create_map(F.lit("a"), F.lit(v))
    both = joins.merge_votes(c.where("c_custkey % 2 = 0").withColumn("votes", votes("old")), c.where("c_custkey % 3 = 0").withColumn("votes", votes("new")), ["c_custkey"], "votes")
    return both.select("c_custkey", (F.size("votes") > 0).alias("any_vote"), F.element_at("votes", "a").alias("judge_a"))


# ranking, sampling, splits

_HEX = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({x}), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 10000)"


@query(f"SELECT o_orderkey, {_HEX.format(x="concat('42:', CAST(o_orderkey AS VARCHAR))")} AS bucket FROM orders")
def hash_split(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", scoring.hash_split(F.col("o_orderkey").cast("string")).alias("bucket"))


@query(f"""WITH i AS (SELECT l_orderkey, o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT o_orderkey, o_orderkey % 1000 FROM orders),
h AS (SELECT k, {_HEX.format(x="concat('42:', CAST(k AS VARCHAR))")} AS b FROM (SELECT DISTINCT k FROM i)), s AS (SELECT k, CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'validation' ELSE 'test' END AS split FROM h)
SELECT l_orderkey AS item, min(split) AS split FROM i JOIN s USING (k) GROUP BY 1 HAVING min(split) = max(split)""")
def hermetic_split(spark: S, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").select("l_orderkey").distinct()
    used = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    items = used.select(F.col("o_orderkey").alias("item"), F.array_compact(F.array(F.when(F.col("l_orderkey").isNotNull(), F.col("o_custkey")), F.col("o_orderkey") % 1000)).alias("episodes"))
    return sampling.hermetic(items, "item", "episodes")


@query("SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY sha256(concat('42:', CAST(p_partkey AS VARCHAR))), p_partkey) AS r FROM part) WHERE r <= 3")
def stratified_sample(spark: S, sf: str) -> DataFrame:
    return sampling.stratified(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey", 3).select("p_brand", "p_type", "p_partkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3")
def top_k(spark: S, sf: str) -> DataFrame:
    return sampling.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def page_slice(spark: S, sf: str) -> DataFrame:
    return sampling.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 50)


@query(f"""WITH {ROBOT}, c AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY episode_id ORDER BY seq)), 0) AS score FROM t),
m AS (SELECT *, count(*) OVER e AS n, seq = min(seq) OVER e OR seq = max(seq) OVER e OR fault = 1 OR seq = first_value(seq) OVER (PARTITION BY episode_id ORDER BY value, seq) OR seq = first_value(seq) OVER (PARTITION BY episode_id ORDER BY value DESC, seq) AS must, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, seq) <= 12 AS top FROM c WINDOW e AS (PARTITION BY episode_id)),
i AS (SELECT *, must OR top AS inside, sum((must OR top)::INT) OVER (PARTITION BY episode_id) AS taken FROM m), d AS (SELECT *, row_number() OVER (PARTITION BY episode_id, inside ORDER BY md5(concat_ws(':', 'fill-42', episode_id::VARCHAR, seq::VARCHAR)), seq) AS draw FROM i)
SELECT episode_id, seq, value FROM d WHERE n <= 24 OR inside OR draw <= 24 - taken""")
def downsample(spark: S, sf: str) -> DataFrame:
    """Peak-preserving: every episode's ends and extremes stay."""
    t = seq.change_score(telemetry(spark, sf), EP, ["seq"], ["value"])
    return sampling.downsample(t, EP, "seq", "score", ["value"], 24, F.col("fault") == 1).select("episode_id", "seq", "value")


@query("SELECT p_partkey, greatest(CASE WHEN p_size > 25 THEN 4 ELSE 1 END, CASE WHEN p_size > 10 THEN 2 ELSE 0 END) AS severity FROM part")
def severity_rank(spark: S, sf: str) -> DataFrame:
    levels = F.array(F.when(F.col("p_size") > 25, "critical").otherwise("low"), F.when(F.col("p_size") > 10, "medium").otherwise("none"))
    return table(spark, sf, "part").select("p_partkey", sampling.severity(F.lit(None).cast("int"), levels).alias("severity"))


_POOL = ("ECONOMY", "PROMO", "STANDARD", "SMALL", "LARGE", "MEDIUM")
_DRAWN = "list_transform(list_sort(list_transform({x}, lambda r: concat(md5(concat_ws(':', '{salt}', p_partkey::VARCHAR, r)), r))), lambda s: substr(s, 33))"


@query("WITH p AS (SELECT p_partkey, p_type, list_filter([" + ", ".join(f"'{x}'" for x in _POOL) + "], lambda r: r <> p_type) AS pool FROM part), "
       + f"e AS (SELECT *, {_DRAWN.format(x=f'list_prepend(p_type, {_DRAWN.format(x="pool", salt="pool-42")}[1:3])', salt='order-42')} AS o FROM p) SELECT p_partkey, p_type, concat('A) ', o[1], chr(10), 'B) ', o[2], chr(10), 'C) ', o[3], chr(10), 'D) ', o[4]) AS text FROM e")
def option_shuffle(spark: S, sf: str) -> DataFrame:
    """Four lettered options with the right one among them."""
    options = sampling.shuffled_options(F.col("p_type"), F.array(*map(F.lit, _POOL)), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_type", encode.option_list(options).alias("text"))


@query(f"WITH {ROBOT}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms DESC, event_id DESC) AS r FROM t) SELECT k, event_id, value FROM x WHERE r = 1")
def last_write_wins(spark: S, sf: str) -> DataFrame:
    return sampling.latest(telemetry(spark, sf).withColumn("id", F.col("event_id")), ["k"], "ms", ["event_id"]).select("k", F.col("id").alias("event_id"), "value")


# text encoding


@query(f"WITH {ROBOT} SELECT episode_id, string_agg(concat('t=', ms::VARCHAR, ': k=', k::VARCHAR, ', v=', CASE WHEN rv = floor(rv) THEN CAST(CAST(rv AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', rv), '0') END), chr(10) ORDER BY seq) AS series FROM (SELECT *, round_even(CAST(value AS DECIMAL(30, 9)), 2)::DOUBLE AS rv FROM t) GROUP BY 1")
def encode_series(spark: S, sf: str) -> DataFrame:
    return encode.encode_series(telemetry(spark, sf), EP, "seq", "ms", ["value", "k"])


@query(f"WITH {ROBOT} SELECT event_id, k::VARCHAR AS k FROM t")
def decode_series(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("line", encode.encode_step("ms", encode.acronyms(["value", "k"])))
    return t.select("event_id", F.element_at(encode.decode_step("line"), "k").alias("k"))


@query("SELECT p_partkey, concat('The ', p_name, ' is ', upper(p_name[1]), p_name[2:], ', size ', p_size::VARCHAR, '.') AS text FROM part")
def template_fill(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", encode.fill_template(F.lit("The {name} is {Name}, size {size}."), {"name": "p_name", "size": "p_size"}).alias("text"))


@query("SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_nationkey % 2 = 0 THEN c_name END, c_mktsegment) AS prompt, concat(concat_ws(', ', c_name, CASE WHEN c_acctbal > 0 THEN 'solvent' END), '.') AS about FROM customer")
def prompt_assembly(spark: S, sf: str) -> DataFrame:
    hides = F.when(F.col("c_nationkey") % 2 != 0, F.array(F.lit("name")))
    about = encode.sentence(F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.lit("solvent")))
    return table(spark, sf, "customer").select("c_custkey", encode.prompt({"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, hides).alias("prompt"), about.alias("about"))


# scoring and reports

_RIGHT = "CASE WHEN letter = 'B' THEN 1.0 ELSE 0.0 END"
_CASCADE = f"CASE kind WHEN 0 THEN {_RIGHT} WHEN 1 THEN {_RIGHT} WHEN 2 THEN {_RIGHT} WHEN 3 THEN 0.5 WHEN 4 THEN 0.0 WHEN 5 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN 6 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN 7 THEN 1.0 / 3 WHEN 8 THEN 5.0 / 6 WHEN 9 THEN 1.0 WHEN 10 THEN 0.0 END"
_EVAL = f"CASE kind WHEN 0 THEN {_RIGHT} WHEN 1 THEN {_RIGHT} WHEN 2 THEN {_RIGHT} WHEN 3 THEN 0.75 WHEN 4 THEN 0.5 WHEN 5 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN 6 THEN CASE WHEN p_size = 10 THEN 1.0 ELSE 0.0 END WHEN 7 THEN 0.25 WHEN 8 THEN 0.5 WHEN 9 THEN 1.0 WHEN 10 THEN 0.0 END"
_CHANCE = "CASE WHEN kind < 3 THEN 0.25 WHEN kind < 5 THEN 0.5 WHEN kind < 7 THEN 0.25 WHEN kind < 9 THEN 0.25 WHEN kind < 11 THEN 0.25 ELSE 0.0 END"
SCORED = f"{REPLIES}, s AS (SELECT *, CAST({_EVAL} AS DOUBLE) AS score FROM r)"


def scored(spark: S, sf: str) -> DataFrame:
    r = replies(spark, sf)
    return r.withColumn("score", scoring.evaluate("reply", "truth", "answer_format"))


@query(f"WITH {REPLIES} SELECT item_id, round(CAST({_CASCADE} AS DOUBLE), 6) AS score, CASE WHEN kind IN (4, 5, 7, 10) THEN 'strict' WHEN kind = 11 THEN 'unparseable' ELSE 'lenient' END AS provenance FROM r")
def score_cascade(spark: S, sf: str) -> DataFrame:
    r = replies(spark, sf).withColumn("r", scoring.cascade("reply", "truth", "answer_format"))
    return r.select("item_id", F.round("r.score", 6).alias("score"), F.col("r.provenance").alias("provenance"))


@query(f"WITH {SCORED} SELECT item_id, round(score, 6) AS score, round(CASE WHEN answer_format = 'free_form' THEN NULL ELSE greatest(0, least(1, (score - {_CHANCE}) / (1 - {_CHANCE}))) END, 6) AS corrected FROM s")
def score_eval(spark: S, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.select("item_id", F.round("score", 6).alias("score"), F.round(F.when(F.col("answer_format") != "free_form", scoring.chance_corrected("score", scoring.expected_chance("answer_format", F.lit(4)))), 6).alias("corrected"))


@query(f"""WITH {REPLIES}, x AS (SELECT *, regexp_extract_all(lower(truth), '[a-z][a-z0-9_-]{{2,}}') AS g, regexp_extract_all(lower(reply), '[a-z][a-z0-9_-]{{2,}}') AS h FROM r)
SELECT item_id, round(CASE WHEN len(list_distinct(g)) > 0 THEN len(list_intersect(list_distinct(g), list_distinct(h))) / len(list_distinct(g)) ELSE 0 END, 6) AS overlap FROM x""")
def token_overlap(spark: S, sf: str) -> DataFrame:
    return replies(spark, sf).select("item_id", F.round(scoring.overlap("truth", "reply"), 6).alias("overlap"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 0.5 WHEN p_size % 4 = 1 THEN 1.0 WHEN p_size % 4 = 2 THEN 0.0 END AS DOUBLE) AS vote FROM part")
def vote_median(spark: S, sf: str) -> DataFrame:
    null = F.lit(None).cast("double")
    votes = F.when(F.col("p_size") % 4 == 0, F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0))).when(F.col("p_size") % 4 == 1, F.array(F.lit(1.0), F.lit(0.5), null)).when(F.col("p_size") % 4 == 2, F.array(F.lit(0.0), F.lit(0.5))).otherwise(F.array(null, null))
    return table(spark, sf, "part").select("p_partkey", scoring.vote(votes).alias("vote"))


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM part")
def judge_verdicts(spark: S, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, F.lit('```json\n{"score": 0.5, "reason": "x"}\n```')).when(F.col("p_size") % 3 == 1, F.lit("I give 1 of 1")).otherwise(F.lit("score: 0"))
    return table(spark, sf, "part").select("p_partkey", scoring.verdict(text).alias("score"))


@query(f"WITH {SCORED} SELECT item_id, answer_format AS f FROM s WHERE answer_format <> 'free_form'")
def format_inference(spark: S, sf: str) -> DataFrame:
    r = replies(spark, sf).withColumn("a", F.when(F.col("answer_format") == "tensor", F.lit("[1, 2]")).otherwise(F.col("truth")))
    f = scoring.answer_format(F.lit(1), F.lit(1), F.lit(""), "a", F.col("answer_format") == "multiple_choice_single_select")
    return r.where("answer_format <> 'free_form'").select("item_id", f.alias("f"))


@query(f"WITH {SCORED} SELECT model, answer_format, round(avg(score), 6) AS mean, count(score) AS n, round(stddev_pop(score) / sqrt(count(score)), 6) AS stderr FROM s GROUP BY 1, 2")
def group_means(spark: S, sf: str) -> DataFrame:
    g = agg.mean_and_error(scored(spark, sf), ["model", "answer_format"], "score")
    return g.select("model", "answer_format", F.round("mean", 6).alias("mean"), "n", F.round("stderr", 6).alias("stderr"))


@query("""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT g, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders JOIN q ON g = o_orderpriority WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY g, q1, median, q3""")
def box_stats(spark: S, sf: str) -> DataFrame:
    b = agg.box_stats(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice"), ["g"], "o_totalprice")
    return b.select("g", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query(f"WITH {SCORED}, w AS (SELECT level, answer_format, avg(score) FILTER (model = 'model_0') AS a, avg(score) FILTER (model = 'model_1') AS b, avg(score) FILTER (model = 'model_2') AS c, count(score) AS n FROM s GROUP BY 1, 2) SELECT level, answer_format, round(a, 3) AS model_0, round(b, 3) AS model_1, round(c, 3) AS model_2, round(list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL)), 3) AS mean_across_models, n FROM w")
def model_pivot(spark: S, sf: str) -> DataFrame:
    return agg.model_pivot(scored(spark, sf), ["level", "answer_format"], "model", "score", ["model_0", "model_1", "model_2"])


@query(f"WITH {SCORED} SELECT model, level, answer_format, round(avg(score), 6) AS mean, count(score) AS n FROM s GROUP BY GROUPING SETS ((model, level), (model, answer_format), (model))")
def grouping_sets(spark: S, sf: str) -> DataFrame:
    g = agg.grouping_report(scored(spark, sf), [["model", "level"], ["model", "answer_format"], ["model"]], "score")
    return g.select("model", "level", "answer_format", F.round("mean", 6).alias("mean"), "n")


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(14, floor((l_extendedprice - lo) / (hi - lo) * 15)::BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def usage_histogram(spark: S, sf: str) -> DataFrame:
    return agg.equal_width_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 15)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def linear_trend(spark: S, sf: str) -> DataFrame:
    t = agg.trend(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return t.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query("SELECT source, lang, n, round(100 * n / sum(n) OVER (PARTITION BY source), 6) AS percent FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
def composition(spark: S, sf: str) -> DataFrame:
    return agg.composition(table(spark, sf, "documents"), "source", "lang").withColumn("percent", F.round("percent", 6))


@query(f"WITH {ROBOT}, x AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t) SELECT episode_id, event_id FROM x WHERE spent < 500.005")
def cost_cutoff(spark: S, sf: str) -> DataFrame:
    return agg.within_budget(telemetry(spark, sf), EP, ["seq"], "value", 500.005).select("episode_id", "event_id")


@query("SELECT l_linenumber, l_returnflag, count(*) AS pairs, count(*) FILTER (l_quantity > 10) AS successes, count(*) FILTER (l_quantity > 10 AND l_discount > 0.05) AS failures, round(failures / nullif(successes, 0), 6) AS rate FROM lineitem GROUP BY 1, 2")
def sweep_rates(spark: S, sf: str) -> DataFrame:
    r = agg.failure_rates(table(spark, sf, "lineitem"), ["l_linenumber", "l_returnflag"], F.col("l_quantity") > 10, F.col("l_discount") <= 0.05)
    return r.withColumn("rate", F.round("rate", 6))


@query(f"WITH {AXES}, m AS (UNPIVOT (SELECT v0, v1, e0 FROM a) ON v0, v1, e0 INTO NAME feature VALUE value) SELECT feature, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM m GROUP BY 1")
def step_profile(spark: S, sf: str) -> DataFrame:
    return agg.profile(axes(spark, sf), ["v0", "v1", "e0"]).select("feature", "n", "lo", "hi", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {SCORED}, x AS (SELECT level, posx AS place, letter_ FROM (SELECT level, unnest(range(4)) AS posx, substr(truth, unnest(range(4)) + 1, 1) AS letter_ FROM s WHERE answer_format = 'multiple_choice_multi_select'))
SELECT level, place::INT AS place, avg(CASE WHEN letter_ = 'T' THEN 100.0 ELSE 0 END) AS percent_true, count(*) AS n FROM x GROUP BY 1, 2""")
def letter_balance(spark: S, sf: str) -> DataFrame:
    return agg.letter_balance(replies(spark, sf).where("answer_format = 'multiple_choice_multi_select'"), ["level"], "truth")


@query("SELECT p_partkey, CAST(CASE WHEN contains(p_name, 'red') THEN 1.0 WHEN contains(p_name, 'blue') THEN 2.0 ELSE 5.0 END AS DOUBLE) AS input, greatest(1, length(p_name) // 4)::INT AS tokens FROM part")
def cost_model(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", values.price("p_name", [("red", 1.0, 2.0), ("blue", 2.0, 4.0)])["input"].alias("input"), values.token_estimate("p_name").alias("tokens"))


# sources and sinks


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def sink_roundtrip(spark: S, sf: str) -> DataFrame:
    """Written partitioned and sorted, compacted, read back, keys listed."""
    where = shared_folder(spark)
    o = table(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    tables.write_episodes(o, f"{where}/raw", ["o_custkey"], "o_orderkey", ["o_orderstatus"], files=8)
    tables.compact(spark, f"{where}/raw", f"{where}/compact")
    return episodes.finished(spark, f"{where}/compact", ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def json_roundtrip(spark: S, sf: str) -> DataFrame:
    where = shared_folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    tables.write_json_shards(o, where, 5000)
    return tables.json_lines(spark, where, o.schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark: S, sf: str) -> DataFrame:
    where, s = shared_folder(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s.write.option("header", True).csv(where)
    return tables.csv_rows(spark, where, s.schema)


@query("SELECT vec_id, embedding[1] AS v__feature_0, embedding[2] AS v__feature_1 FROM embeddings")
def flatten_vectors(spark: S, sf: str) -> DataFrame:
    return tables.flatten_array(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 2, "v")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS feedback_pos_0, l_extendedprice / 1000 AS feedback_pos_1, CAST(NULL AS DOUBLE) AS vibration_0, CAST(l_linenumber AS INT) AS robot_mode FROM lineitem")
def canonical_projection(spark: S, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("q_0", F.col("l_quantity")).withColumn("mm", F.col("l_extendedprice"))
    schema = {"l_orderkey": "long", "l_linenumber": "int", "l_partkey": "long", "feedback_pos_0": "double", "feedback_pos_1": "double", "vibration_0": "double", "robot_mode": "int"}
    mapping = {k: k for k in ("l_orderkey", "l_linenumber", "l_partkey")} | {"feedback_pos_{axis}": "q_{axis}", "robot_mode": "l_linenumber"}
    return tables.canonical(li, mapping, schema, {"feedback_pos_1": tables.UNITS["mm"]("mm")})


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def table_patch(spark: S, sf: str) -> DataFrame:
    return tables.patch(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS part, o_orderkey FROM orders")
def episode_cut(spark: S, sf: str) -> DataFrame:
    return tables.cut_episodes(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5).select("o_custkey", "part", "o_orderkey")


@query("SELECT * FROM (VALUES ('event_id', 'sc:Integer'), ('ts', 'sc:DateTime'), ('user_id', 'sc:Integer'), ('event_type', 'sc:Text'), ('value', 'sc:Float'), ('props', 'sc:Text')) AS v(name, tag)")
def schema_export(spark: S, sf: str) -> DataFrame:
    return spark.createDataFrame(list(values.semantic_tags(table(spark, sf, "events").schema).items()), "name string, tag string")


# streaming


def _stream(spark: S, sf: str) -> DataFrame:
    """events by a file stream; the folder that holds the file is listed by a glob."""
    schema: T.StructType = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_counts(spark: S, sf: str) -> DataFrame:
    """Tumbling windows through a stream with a watermark, all windows (complete mode)."""
    where = shared_folder(spark)
    counts = episodes.windowed_counts(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


@query(f"WITH {ROBOT}, x AS (SELECT *, lag(fault, 1, 0) OVER (PARTITION BY episode_id ORDER BY event_id) AS p FROM t) SELECT event_id, episode_id, fault::BIGINT AS fault FROM x WHERE fault <> 0 AND p = 0")
def stream_onsets(spark: S, sf: str) -> DataFrame:
    """Onsets with per-key state across micro-batches."""
    rows = _stream(spark, sf).select("event_id", F.col("user_id").alias("episode_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("fault"))
    return episodes.drain(spark, episodes.onsets(rows, "episode_id", "event_id", "fault"), shared_folder(spark))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def stream_shards(spark: S, sf: str) -> DataFrame:
    where = shared_folder(spark)
    episodes.shard_sink(_stream(spark, sf).where("event_type = 'error'").select("event_id", "user_id"), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("event_id", "user_id")


@query("SELECT count(*) AS n FROM orders")
def checkpointed(spark: S, sf: str) -> DataFrame:
    return kept(spark, table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n")), "n")
