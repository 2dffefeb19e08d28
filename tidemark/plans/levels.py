"""Multi-select and counterfactual items over the driver tables: a plan and SQL each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.draws import digest
from tidemark.functions.values import plain_number
from tidemark.operators import aggregates, contexts, joins, predicates, relevance
from tidemark.operators import counterfactual as cf
from tidemark.operators import generators as gen
from tidemark.operators import sequence as seq
from tidemark.operators import statements as st
from tidemark.operators.predicates import THRESHOLDS, tracking_error
from tidemark.plans.items import _digest, _draw
from tidemark.plans.queries import _SCALE
from tidemark.plans.registry import query
from tidemark.plans.views import AXES, ROBOT, axes, telemetry
from tidemark.sources.tables import table

S = SparkSession
EP = ["episode_id"]
_AXES = [("v0", "s0", "e0"), ("v1", "s1", "e1")]
#: Statements that data of simulations, or other data, can't judge.
_NO_SIMULATION, _NO_OTHER = ("mc_005", "mc_013", "mc_014", "mc_017", "mc_019"), ("mc_020",)


def _texts(ids) -> str:
    return "[" + ", ".join(f"'{i}'" for i in ids) + "]::VARCHAR[]"


def _normal(mean: str, deviation: str, salt: str) -> str:
    d = _digest(salt, "episode_id")
    u = [f"(('0x' || substr({d}, {at}, 8))::BIGINT::DOUBLE / 4294967296)" for at in (1, 9)]
    return f"({mean} + {deviation} * (sqrt(-2 * ln({u[0]} + 0.5 / 4294967296)) * cos(2 * pi() * {u[1]})))"


def _threshold(name: str) -> str:
    mean = THRESHOLDS[name]
    if name == "temp_rise_min_axes":
        return f"least(greatest(round_even({_normal(f'{mean}::DOUBLE', '0.4::DOUBLE', name)}, 0), 1.0), 6.0)"
    spread, least, most = st.SPREADS.get(name, (0.20, 0.0, 0.99))
    return f"least(greatest({_normal(f'{mean}::DOUBLE', f'{max(1e-6, mean * spread)!r}::DOUBLE', name)}, {least}::DOUBLE), {most}::DOUBLE)"


def _rendered(text: str) -> str:
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+(?::[.\w]+)?)\}", text)):
        name, _, form = piece.partition(":")
        if i % 2 == 0:
            parts.append(f"'{piece}'")
        elif form == "d":
            parts.append(f"round_even(t_{name}, 0)::INT::VARCHAR")
        else:
            parts.append(f"printf('%.2f', 100.0::DOUBLE * t_{name})" if form else f"round_even(100.0::DOUBLE * t_{name}, 0)::INT::VARCHAR")
    return "concat(" + ", ".join(parts) + ")"


_HOLDS = {
    "mc_003": "m0 <= (1 - t_speed_drop_ratio) * pv0 OR m1 <= (1 - t_speed_drop_ratio) * pv1",
    "mc_004": f"f0 <= t_speed_stable_tol * {_SCALE.format('pv0')} AND f1 <= t_speed_stable_tol * {_SCALE.format('pv1')}",
    "mc_005": " OR ".join(f"me{i} >= (1 + t_stall_current_increase) * pe{i} AND av{i} <= t_stall_speed_frac * {_SCALE.format(f'pv{i}')}" for i in (0, 1)),
    "mc_006": "low >= t_force_low_coverage",
    "mc_007": "cmax >= (1 + t_force_spike_increase) * pc",
    "mc_008": "tr >= (1 + t_tracking_increase) * pt",
    "mc_013": f"span <= t_robot_current_stable_range * {_SCALE.format('pr')}",
    "mc_014": "cm >= (1 + t_robot_current_increase) * pr",
    "mc_015": "tc <= (1 + t_tcp_tracking_stable_increase) * ptc",
    "mc_016": "tc >= (1 + t_tcp_tracking_increase) * ptc",
    "mc_017": f"((le0 - fe0) / {_SCALE.format('pe0')} > t_temp_rise_slope)::INT + ((le1 - fe1) / {_SCALE.format('pe1')} > t_temp_rise_slope)::INT >= t_temp_rise_min_axes",
    "mc_019": f"safe AND (tr + tc + ct + abs(cm - pr) / {_SCALE.format('pr')}) / 4 <= (1 + t_no_effect_agg_increase) * ((pt + ptc + pc) / 4)",
    "mc_020": "success",
}


def _multi_select(before: str, level: int) -> str:
    """SQL over rows (episode_id, seq, signals) and it (episode_id, base, first, fixed, excluded, success)."""
    offered = sorted({s.id: s for s in st.CATALOGUE if level in s.levels}.items())
    structs = ", ".join(f"{{'id': '{i}', 'text': {_rendered(s.text)}, 'holds': coalesce({_HOLDS[i]}, false)}}" for i, s in offered)
    return f"""WITH {before},
th AS (SELECT *, {", ".join(f"{_threshold(n)} AS t_{n}" for n in THRESHOLDS)} FROM it),
o AS (SELECT *, (abs(s0 - v0) + abs(s1 - v1)) / 2 AS track, abs(s0 - v0) + abs(e0 - e1) AS tool FROM rows),
b AS (SELECT th.*, v0 AS pv0, v1 AS pv1, e0 AS pe0, e1 AS pe1, contact AS pc, robot_current AS pr, track AS pt, tool AS ptc FROM th JOIN o ON o.episode_id = th.episode_id AND seq = base),
y AS (SELECT b.episode_id, min(v0) AS m0, min(v1) AS m1, max(abs(v0 - pv0)) AS f0, max(abs(v1 - pv1)) AS f1, avg(e0) AS me0, avg(e1) AS me1, avg(abs(v0)) AS av0, avg(abs(v1)) AS av1, arg_max(e0, seq) AS le0, arg_max(e1, seq) AS le1, arg_min(e0, seq) AS fe0, arg_min(e1, seq) AS fe1,
  avg(CASE WHEN contact <= (1 + t_force_low_increase) * pc THEN 1.0 ELSE 0.0 END) AS low, max(contact) AS cmax, avg(track) AS tr, avg(tool) AS tc, avg(contact) AS ct, max(robot_current) - min(robot_current) AS span, avg(robot_current) AS cm, bool_and(safety = 1) AS safe FROM b JOIN o ON o.episode_id = b.episode_id AND seq >= first GROUP BY 1),
p AS (SELECT b.*, y.* EXCLUDE (episode_id), list_filter(list_transform(fixed, lambda x: concat('mc_', lpad(regexp_extract(x, '\\d+')::INT::VARCHAR, 3, '0'))), lambda x: list_contains({_texts(i for i, _ in offered)}, x) AND NOT list_contains(excluded, x)) AS own FROM b JOIN y USING (episode_id)),
q AS (SELECT *, list_concat(own, list_transform(list_sort(list_transform(list_filter({_texts(i for i, _ in offered)}, lambda x: NOT list_contains(excluded, x) AND NOT list_contains(own, x)), lambda x: concat(md5(concat_ws(':', 'statement', episode_id::VARCHAR, x)), x))), lambda x: substr(x, 33)))[1:4] AS picks FROM p),
c AS (SELECT episode_id, base, list_sort(list_transform(list_filter([{structs}], lambda s: list_contains(picks, s.id)), lambda s: {{'d': md5(concat_ws(':', 'option', episode_id::VARCHAR, s.id)), 'id': s.id, 'text': s.text, 'holds': s.holds}})) AS c FROM q)
SELECT episode_id, base, array_to_string(list_transform(c, lambda s: s.id), ',') AS statements, array_to_string(list_transform(c, lambda s: s.text), chr(10)) AS texts, array_to_string(list_transform(c, lambda s: CASE WHEN s.holds THEN 'T' ELSE 'F' END), '') AS answer FROM c"""


def _shown(out: DataFrame) -> DataFrame:
    return out.select(*EP, "base", F.array_join("statements", ",").alias("statements"), F.array_join(F.map_values("options"), "\n").alias("texts"), "answer")


def _asked(items: DataFrame, fixed: tuple[str, ...], predictive: bool) -> tuple[DataFrame, Column]:
    """Every fourth episode is a simulation, whose success is known for two of three."""
    simulated = F.col("episode_id") % 4 == 0
    items = items.withColumn("success", F.when(simulated & (F.col("episode_id") % 3 > 0), F.col("episode_id") % 3 == 1))
    more = ("mc_019",) if predictive else ()
    lists = [F.array(*map(F.lit, (*ids, *more))) for ids in (_NO_SIMULATION, _NO_OTHER)]
    return items.withColumn("excluded", F.when(simulated, lists[0]).otherwise(lists[1])), F.array(*map(F.lit, fixed)).cast("array<string>")


def _it(source: str, base: str, first: str, fixed: tuple[str, ...], predictive: bool) -> str:
    more = ("mc_019",) if predictive else ()
    return f"""it AS (SELECT episode_id, {base} AS base, {first} AS first, {_texts(fixed)} AS fixed, CASE WHEN episode_id % 4 = 0 THEN {_texts((*_NO_SIMULATION, *more))} ELSE {_texts((*_NO_OTHER, *more))} END AS excluded,
  CASE WHEN episode_id % 4 = 0 AND episode_id % 3 > 0 THEN episode_id % 3 = 1 END AS success FROM {source})"""


# level 2: a window that ends before an event, and what follows

_BEFORE = f"""{AXES}, ev AS (SELECT *, coalesce(v0 >= 48, false) AS e, coalesce(lag(v0 >= 48) OVER w, false) AS pe, count(*) OVER (PARTITION BY episode_id) AS n FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY seq)),
os AS (SELECT episode_id, arg_min(seq, {_digest("event", "episode_id", "seq")}) AS onset FROM ev WHERE e AND NOT pe AND seq >= 8 AND n - seq - 1 >= 5 GROUP BY 1), rows AS (SELECT * FROM a)"""


def _level2(spark: S, sf: str, fixed: tuple[str, ...], predictive: bool) -> DataFrame:
    rows = axes(spark, sf).withColumn("event", F.when(F.col("v0") >= 48, 3).otherwise(0))
    hits = seq.windows_before_event(rows, EP, "seq", "event", 8, 16, 5)
    one = hits.groupBy(*EP).agg(F.min_by("onset", digest("event", "episode_id", "onset")).alias("onset"))
    items, tokens = _asked(one.select(*EP, (F.col("onset") - 1).alias("base"), F.col("onset").alias("first")), fixed, predictive)
    tool = tracking_error([(F.col("s0"), F.col("v0"), F.col("e0"), F.col("e1"))])
    return _shown(st.multi_select(rows, items, EP, "seq", _AXES, "contact", "robot_current", "safety", 2, tokens, F.col("excluded"), "success", tool))


@query(_multi_select(f"{_BEFORE}, {_it('os', 'onset - 1', 'onset', ('mc_0019',), True)}", 2))
def intervention_outcome(spark: S, sf: str) -> DataFrame:
    """The template's fixed statement is one that predictive items exclude, so all four are drawn."""
    return _level2(spark, sf, ("mc_0019",), True)


@query(_multi_select(f"{_BEFORE}, {_it('os', 'onset - 1', 'onset', ('mc_003', 'mc_004'), False)}", 2))
def anomaly_statements(spark: S, sf: str) -> DataFrame:
    return _level2(spark, sf, ("mc_003", "mc_004"), False)


_AFTER = f"""{_BEFORE}, vi AS (SELECT os.episode_id, onset, n - onset AS n_after, onset - least(16, onset) AS start, least(16, onset) AS length, 1 + {_draw("10", "steps", "os.episode_id")} AS steps FROM os JOIN (SELECT episode_id, count(*) AS n FROM a GROUP BY 1) USING (episode_id)),
vv AS (SELECT vi.episode_id, any_value(steps) AS steps, max(seq * 100) FILTER (seq = onset + steps) - max(seq * 100) FILTER (seq = onset) AS ahead, round(max(s0) FILTER (seq = onset + steps), 6) AS v0, round(max(s1) FILTER (seq = onset + steps), 6) AS v1,
  stddev_pop(s0) FILTER (seq >= start AND seq < start + length) AS d0, stddev_pop(s1) FILTER (seq >= start AND seq < start + length) AS d1 FROM vi JOIN a ON a.episode_id = vi.episode_id WHERE steps < n_after GROUP BY 1)"""


def _after(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = axes(spark, sf).withColumn("event", F.when(F.col("v0") >= 48, 3).otherwise(0)).withColumn("ms", F.col("seq") * 100)
    hits = seq.windows_before_event(rows, EP, "seq", "event", 8, 16, 5)
    one = hits.groupBy(*EP).agg(F.min_by(F.struct("onset", "start", F.col("n").alias("length")), digest("event", "episode_id", "onset")).alias("w")).select(*EP, "w.*")
    n = rows.groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    return rows, one.join(n, EP).withColumn("n_after", F.col("n") - F.col("onset")).drop("n")


@query(f"WITH {_AFTER} SELECT episode_id, steps, ahead, v0 AS answer, round(d0, 6) AS std, round(0.75 * d0, 6) AS margin FROM vv WHERE v0 IS NOT NULL")
def event_value(spark: S, sf: str) -> DataFrame:
    """A signal some rows after an event, from the window before it."""
    rows, items = _after(spark, sf)
    out = gen.event_values(rows, items, EP, "seq", "ms", ["s0"])
    return out.select(*EP, "steps", "ahead", F.col("v0").alias("answer"), F.col("std0").alias("std"), F.col("margin0").alias("margin"))


@query(f"WITH {_AFTER} SELECT episode_id, ahead, concat('[', regexp_replace(printf('%.6f', v0), '(\\.\\d+?)0+$', '\\1'), ',', regexp_replace(printf('%.6f', v1), '(\\.\\d+?)0+$', '\\1'), ']') AS answer, round(0.75 * round(d0 * 1000000)::BIGINT, 0)::DOUBLE / 1000000 AS m0, round(0.75 * round(d1 * 1000000)::BIGINT, 0)::DOUBLE / 1000000 AS m1 FROM vv WHERE v0 IS NOT NULL AND v1 IS NOT NULL")
def event_tensor(spark: S, sf: str) -> DataFrame:
    rows, items = _after(spark, sf)
    out = gen.event_values(rows, items, EP, "seq", "ms", ["s0", "s1"])
    return out.select(*EP, "ahead", cf.tensor_answer(2).alias("answer"), F.col("margin0").alias("m0"), F.col("margin1").alias("m1"))


@query(f"""WITH {_AFTER}, ri AS (SELECT *, 5 + {_draw("least(7, n_after // 4) - 4", "chunk-n", "episode_id")} AS size FROM vi WHERE n_after >= 20), rf AS (SELECT *, onset + {_draw("n_after - 4 * size + 1", "chunk-at", "episode_id")} AS f FROM ri),
rc AS (SELECT a.episode_id, (seq - f) // size AS chunk, count(*) AS n FROM rf JOIN a ON a.episode_id = rf.episode_id AND seq >= f AND seq < f + 4 * size GROUP BY 1, 2),
rl AS (SELECT *, chr(64 + (row_number() OVER (PARTITION BY episode_id ORDER BY {_digest("letter", "episode_id", "chunk")}))::INT) AS letter FROM rc) SELECT episode_id, string_agg(letter, '' ORDER BY chunk) AS answer, max(n) AS size FROM rl GROUP BY 1""")
def event_ranking(spark: S, sf: str) -> DataFrame:
    """Chunks of five to seven rows after an event, of one drawn length, at a drawn place."""
    rows, items = _after(spark, sf)
    out = cf.segment_items(rows, items, EP, "seq", plain_number("v0"))
    return out.select(*EP, "answer", F.size(F.split(F.element_at("options", "A"), r" \| ")).cast("long").alias("size"))


_LEVELS = "(VALUES " + ", ".join(f"({i}, '{s.id}', {list(s.levels)}, '{s.text}')" for i, s in enumerate(st.CATALOGUE)) + ") v(line, id, levels, statement)"


@query(f"SELECT l.c_custkey, count(*) AS n, string_agg(v.id, ',' ORDER BY v.id) AS ids, max(v.statement) FILTER (v.id = 'mc_020') AS twice FROM (SELECT c_custkey, c_custkey % 3 + 1 AS level FROM customer) l JOIN {_LEVELS} ON list_contains(v.levels, l.level) GROUP BY 1")
def statements_by_level(spark: S, sf: str) -> DataFrame:
    """The catalogue as a table, looked up by level: one id has another statement on level 1 than above."""
    rows = [(i, s.id, list(s.levels), s.text, None) for i, s in enumerate(st.CATALOGUE)]
    catalogue = spark.createDataFrame(rows, "line int, id string, usable_levels array<int>, statement string, applicable_level int")
    known = None
    for level in (1, 2, 3):
        one = st.usable(catalogue, F.lit(level))
        known = one if known is None else known.unionByName(one)
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3 + 1).alias("level"))
    return c.join(known, "level").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.max(F.when(F.col("id") == "mc_020", F.col("statement"))).alias("twice"))


@query(f"""WITH x AS (SELECT p_partkey, ['mc_' || (p_size % 25)::VARCHAR, 'l2_MC_0' || (p_size % 9)::VARCHAR, p_type] AS t FROM part), k AS (SELECT * FROM {_LEVELS} WHERE list_contains(levels, 2)),
y AS (SELECT p_partkey, unnest(t) AS t, unnest(range(3)) AS i FROM x), c AS (SELECT *, CASE WHEN regexp_full_match(t, '(?i)(l2_)?mc_\\d+') THEN 'mc_' || lpad(regexp_extract(t, '(\\d+)$', 1)::INT::VARCHAR, 3, '0') ELSE t END AS c FROM y)
SELECT p_partkey, string_agg(coalesce(k.id, '-'), ',' ORDER BY i) AS ids, string_agg(coalesce(k.statement, t), '|' ORDER BY i) AS statements FROM c LEFT JOIN k ON k.id = c.c GROUP BY 1""")
def fixed_options(spark: S, sf: str) -> DataFrame:
    """Tokens of fixed options: known statements by their id, others as they stand."""
    texts = F.create_map(*[F.lit(x) for s in st.CATALOGUE if 2 in s.levels for x in (s.id, s.text)])
    tokens = F.array(F.concat(F.lit("mc_"), (F.col("p_size") % 25).cast("string")), F.concat(F.lit("l2_MC_0"), (F.col("p_size") % 9).cast("string")), F.col("p_type"))
    p = table(spark, sf, "part").select("p_partkey", st.resolved(tokens, texts).alias("r"))
    return p.select("p_partkey", F.array_join(F.transform("r", lambda x: F.coalesce(x["id"], F.lit("-"))), ",").alias("ids"), F.array_join(F.transform("r", lambda x: x["statement"]), "|").alias("statements"))


# level 3: two streams of one episode

_PAIRS = f"""{AXES}, pr AS (SELECT episode_id // 2 AS episode_id, CASE WHEN episode_id % 2 = 0 THEN 'baseline' ELSE 'counterfactual' END AS stream, * EXCLUDE (episode_id) FROM a),
pv AS (SELECT *, seq * 100 AS ms, CASE WHEN stream = 'counterfactual' AND seq >= 40 + episode_id * 7 % 300 AND seq < 60 + episode_id * 7 % 300 THEN 14 + episode_id % 7 ELSE 0 END AS event FROM pr),
pe AS (SELECT episode_id, count(*) FILTER (stream = 'baseline') AS n, count(*) FILTER (stream = 'counterfactual') AS n_other, min(seq) FILTER (event <> 0) AS onset, arg_min(event, seq) FILTER (event <> 0) AS event FROM pv GROUP BY 1),
pf AS (SELECT *, list_filter(range(32, least(64, n) + 1), lambda x: x <= onset + 1 AND greatest(0, onset + 5 - x + 1) <= least(onset - 5, n - x)) AS fits FROM pe WHERE onset IS NOT NULL AND onset < n),
pl AS (SELECT *, fits[{_draw("len(fits)", "pair-n", "episode_id")} + 1] AS length FROM pf WHERE len(fits) > 0),
pw AS (SELECT episode_id, onset, event, greatest(0, onset + 5 - length + 1) + {_draw("least(onset - 5, n - length) - greatest(0, onset + 5 - length + 1) + 1", "pair-at", "episode_id")} AS start, length, n_other - onset AS n_after FROM pl)"""


def _pairs(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = axes(spark, sf).withColumn("stream", F.when(F.col("episode_id") % 2 == 0, "baseline").otherwise("counterfactual")).withColumn("episode_id", F.expr("episode_id div 2"))
    begun = 40 + F.col("episode_id") * 7 % 300
    rows = rows.withColumn("ms", F.col("seq") * 100).withColumn("event", F.when((F.col("stream") == "counterfactual") & (F.col("seq") >= begun) & (F.col("seq") < begun + 20), 14 + F.col("episode_id") % 7).otherwise(0))
    return rows, cf.pair_windows(rows, EP, "seq", "stream", "event")


@query(f"WITH {_PAIRS} SELECT * FROM pw")
def counterfactual_windows(spark: S, sf: str) -> DataFrame:
    return _pairs(spark, sf)[1]


@query(f"""WITH {_PAIRS}, ri AS (SELECT *, 5 + {_draw("least(7, n_after // 4) - 4", "chunk-n", "episode_id")} AS size FROM pw WHERE n_after >= 20 AND event NOT IN (16, 17, 18, 19)),
rf AS (SELECT *, onset + {_draw("n_after - 4 * size + 1", "chunk-at", "episode_id")} AS f FROM ri),
rc AS (SELECT v.episode_id, (seq - f) // size AS chunk, string_agg(concat('q=', v0::INT::VARCHAR, ', r=', robot_current::INT::VARCHAR), ' | ' ORDER BY seq) AS text FROM rf JOIN pv v ON v.episode_id = rf.episode_id AND stream = 'counterfactual' AND seq >= f AND seq < f + 4 * size GROUP BY 1, 2),
rl AS (SELECT *, chr(64 + (row_number() OVER (PARTITION BY episode_id ORDER BY {_digest("letter", "episode_id", "chunk")}))::INT) AS letter FROM rc)
SELECT episode_id, string_agg(letter, '' ORDER BY chunk) AS answer, string_agg(concat(letter, ') ', text), chr(10) ORDER BY letter) AS options FROM rl GROUP BY 1""")
def counterfactual_ranking(spark: S, sf: str) -> DataFrame:
    rows, items = _pairs(spark, sf)
    line = F.concat(F.lit("q="), plain_number("v0"), F.lit(", r="), plain_number("robot_current"))
    out = cf.segment_items(rows.where("stream = 'counterfactual'"), cf.predictive(items), EP, "seq", line)
    return out.select(*EP, "answer", F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n").alias("options"))


def _level3(spark: S, sf: str, fixed: tuple[str, ...]) -> DataFrame:
    rows, items = _pairs(spark, sf)
    asked, tokens = _asked(items.select(*EP, F.col("onset").alias("base"), F.col("onset").alias("first")), fixed, False)
    tool = tracking_error([(F.col("s0"), F.col("v0"), F.col("e0"), F.col("e1"))])
    return _shown(st.multi_select(rows.where("stream = 'counterfactual'"), asked, EP, "seq", _AXES, "contact", "robot_current", "safety", 3, tokens, F.col("excluded"), "success", tool))


_OTHER = f"{_PAIRS}, rows AS (SELECT * FROM pv WHERE stream = 'counterfactual')"


@query(_multi_select(f"{_OTHER}, {_it('pw', 'onset', 'onset', ('mc_0019',), False)}", 3))
def counterfactual_outcome(spark: S, sf: str) -> DataFrame:
    """The onset row itself is what later rows are compared with."""
    return _level3(spark, sf, ("mc_0019",))


@query(_multi_select(f"{_OTHER}, {_it('pw', 'onset', 'onset', (), False)}", 3))
def counterfactual_statements(spark: S, sf: str) -> DataFrame:
    return _level3(spark, sf, ())


_VALUES = f"""{_PAIRS}, vi AS (SELECT *, 1 + {_draw("10", "steps", "episode_id")} AS steps FROM pw WHERE event NOT IN (16, 17, 18, 19)),
vv AS (SELECT vi.episode_id, any_value(steps) AS steps, max(ms) FILTER (stream = 'counterfactual' AND seq = onset + steps) - max(ms) FILTER (stream = 'counterfactual' AND seq = onset) AS ahead, """ + ", ".join(
    f"round(max({c}) FILTER (stream = 'counterfactual' AND seq = onset + steps), 6) AS v{i}, coalesce(stddev_pop({c}) FILTER (stream = 'baseline' AND seq >= start AND seq < start + length), 0) AS d{i}" for i, c in enumerate(("s0", "s1"))
) + " FROM vi JOIN pv ON pv.episode_id = vi.episode_id WHERE steps < n_after GROUP BY 1)"
_PYTHON = "regexp_replace(printf('%.6f', {}), '(\\.\\d+?)0+$', '\\1')"


@query(f"WITH {_VALUES} SELECT episode_id, steps, ahead, v0 AS answer, round(d0, 6) AS std, round(0.75 * d0, 6) AS margin FROM vv WHERE v0 IS NOT NULL")
def counterfactual_value(spark: S, sf: str) -> DataFrame:
    rows, items = _pairs(spark, sf)
    out = cf.value_items(rows, cf.predictive(items), EP, "seq", "stream", "ms", ["s0"])
    return out.select(*EP, "steps", "ahead", F.col("v0").alias("answer"), F.col("std0").alias("std"), F.col("margin0").alias("margin"))


@query(f"WITH {_VALUES} SELECT episode_id, ahead, concat('[', {_PYTHON.format('v0')}, ',', {_PYTHON.format('v1')}, ']') AS answer, round(0.75 * round(d0 * 1000000)::BIGINT, 0)::DOUBLE / 1000000 AS m0, round(0.75 * round(d1 * 1000000)::BIGINT, 0)::DOUBLE / 1000000 AS m1 FROM vv WHERE v0 IS NOT NULL AND v1 IS NOT NULL")
def counterfactual_tensor(spark: S, sf: str) -> DataFrame:
    rows, items = _pairs(spark, sf)
    out = cf.value_items(rows, cf.predictive(items), EP, "seq", "stream", "ms", ["s0", "s1"])
    return out.select(*EP, "ahead", cf.tensor_answer(2).alias("answer"), F.col("margin0").alias("m0"), F.col("margin1").alias("m1"))


# contexts

_DRAWN = f"""{AXES}, ev AS (SELECT *, coalesce(v0 >= 48, false) AS e, coalesce(lag(v0 >= 48) OVER w, false) AS pe, count(*) OVER (PARTITION BY episode_id) AS n FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY seq)),
dw AS (SELECT episode_id, arg_min(seq, {_digest("onset", "episode_id", "seq")}) AS onset FROM ev WHERE e AND NOT pe AND seq >= 8 AND n - seq - 1 >= 5 GROUP BY 1), dl AS (SELECT *, 8 + {_draw("least(16, onset) - 7", "before-n", "episode_id")} AS length FROM dw)"""


def _drawn(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = axes(spark, sf).withColumn("event", F.when(F.col("v0") >= 48, 3).otherwise(0))
    return rows, contexts.drawn_before_event(rows, EP, "seq", "event", 8, 16, 5)


@query(f"WITH {_DRAWN} SELECT episode_id, onset, onset - length AS start, length, sum(v0) FILTER (seq < onset) AS inside, count(*) FILTER (seq >= onset) AS remaining FROM dl JOIN a USING (episode_id) WHERE seq >= onset - length GROUP BY ALL")
def windows_before_events(spark: S, sf: str) -> DataFrame:
    """Windows of every length before an event, and what follows them."""
    rows, w = _drawn(spark, sf)
    inside = relevance.context_rows(rows, w, EP, "seq").groupBy(*EP).agg(F.sum("v0").alias("inside"))
    rest = contexts.remaining_rows(rows, w, EP, "seq").groupBy(*EP).agg(F.count(F.lit(1)).alias("remaining"))
    return w.join(inside, EP).join(rest, EP)


_BLOCKS = f"""{_DRAWN}, bo AS (SELECT *, episode_id % 3 AS g, row_number() OVER (PARTITION BY episode_id % 3 ORDER BY md5(concat_ws(':', 'block-42', episode_id::VARCHAR)), episode_id) - 1 AS i FROM dl),
bk AS (SELECT *, i // 4 AS block, chr(65 + (i % 4)::INT) AS label, count(*) OVER (PARTITION BY g, i // 4) AS c FROM bo), m AS (SELECT bk.g, block, label, bk.episode_id, length, list(v0::INT::VARCHAR ORDER BY seq) AS lines FROM bk JOIN a ON a.episode_id = bk.episode_id AND seq >= onset - length AND seq < onset WHERE c = 4 GROUP BY ALL)"""


def _members(spark: S, sf: str) -> DataFrame:
    rows, w = _drawn(spark, sf)
    blocks = joins.blocks_of(w.withColumn("g", F.col("episode_id") % 3), ["g"], 4, EP)
    return contexts.texts_of_windows(rows, blocks, EP, "seq", plain_number("v0"))


@query(f"WITH {_BLOCKS}, l AS (SELECT g, block, max(length) AS longest FROM m GROUP BY 1, 2) SELECT m.g, m.block, string_agg(concat(label, '=', array_to_string(list_concat(lines, list_transform(range(longest - length), lambda x: lines[-1])), ',')), ';' ORDER BY label) AS streams FROM m JOIN l ON l.g = m.g AND l.block = m.block GROUP BY 1, 2")
def ranking_context(spark: S, sf: str) -> DataFrame:
    """Four episodes side by side, padded to the longest."""
    s = contexts.side_by_side(_members(spark, sf), ["g", "block"], "label", "lines")
    return s.select("g", "block", F.array_join(F.transform(F.map_entries("streams"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("streams"))


@query(f"WITH {_BLOCKS}, r AS (SELECT *, episode_id % 11 AS rank FROM m) SELECT g, block, string_agg(label, '' ORDER BY rank) AS answer, string_agg(concat(label, ') ', array_to_string(lines, ' | ')), chr(10) ORDER BY label) AS options FROM r GROUP BY 1, 2 HAVING count(DISTINCT rank) = 4")
def severity_segments(spark: S, sf: str) -> DataFrame:
    """Segments of four episodes, ranked by how severe their faults are."""
    ranked = _members(spark, sf).withColumn("rank", F.col("episode_id") % 11)
    out = contexts.severity_segments(ranked, ["g", "block"], "label", "rank", "lines")
    return out.select("g", "block", "answer", F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n").alias("options"))


@query(f"WITH {_DRAWN}, f AS (SELECT *, CASE WHEN episode_id % 5 > 0 THEN episode_id % 30 END AS fault FROM dl), t AS (SELECT f.episode_id, list(v0::INT::VARCHAR ORDER BY seq) AS lines FROM f JOIN a ON a.episode_id = f.episode_id AND seq >= onset - length AND seq < onset GROUP BY 1) SELECT f.episode_id, CASE WHEN coalesce(fault, 0) > 0 THEN n_name END AS root_cause, CASE WHEN coalesce(fault, 0) = 0 THEN '{contexts.NOTHING_WRONG}' ELSE concat('see ', n_regionkey) END AS answer, array_to_string(lines, ',') AS context FROM f JOIN t USING (episode_id) LEFT JOIN nation ON n_nationkey = fault WHERE coalesce(fault, 0) = 0 OR n_nationkey % 4 > 0")
def troubleshooting_context(spark: S, sf: str) -> DataFrame:
    """Windows with the remedy of their fault's cause; sound ones say so, faults without a remedy make no item."""
    rows, w = _drawn(spark, sf)
    w = contexts.texts_of_windows(rows, w.withColumn("fault", F.when(F.col("episode_id") % 5 > 0, F.col("episode_id") % 30)), EP, "seq", plain_number("v0"))
    causes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("fault"), "n_name", F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("see "), F.col("n_regionkey").cast("string"))).otherwise(" ").alias("remedy"))
    return contexts.troubleshooting(w, causes, "fault", "n_name", "remedy").select(*EP, "root_cause", "answer", F.array_join("lines", ",").alias("context"))


@query("SELECT n_nationkey::BIGINT AS fault_id, (n_regionkey + 1)::BIGINT AS rank FROM nation WHERE n_nationkey % 3 > 0")
def severity_ranks(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    entry = F.concat(F.lit('{"fault_id": '), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit(', "rank": '), (F.col("n_regionkey") + 1).cast("string"))).otherwise(""), F.lit("}"))
    doc = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"ranking_least_to_most_severe": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]}")).alias("text"))
    return contexts.severity_ranks(doc, "text").select(F.col("fault_id").cast("long").alias("fault_id"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ROBOT} SELECT event_id, seq * 250 AS timestamp_ms, CASE WHEN k % 4 > 0 THEN concat((k % 4)::VARCHAR, CASE WHEN k % 3 > 0 THEN concat('_x', k::VARCHAR) ELSE '' END) END AS event, (k % 4)::INT AS fault_label, event_type AS task_phase FROM t""")
def simulated_rows(spark: S, sf: str) -> DataFrame:
    t = telemetry(spark, sf).select("episode_id", "event_id", (F.col("seq") / 4 + 10).cast("string").alias("sim_time_s"), F.col("k"), F.col("event_type").alias("task_phase")).withColumnRenamed("event_id", "row_id")
    t = t.withColumn("event_id", F.when(F.col("k") % 4 > 0, (F.col("k") % 4).cast("string")).otherwise("none")).withColumn("event_params", F.when(F.col("k") % 3 > 0, F.concat(F.lit(" x"), F.col("k").cast("string"))))
    out = contexts.simulated_rows(t, EP)
    return out.select(F.col("row_id").alias("event_id"), "timestamp_ms", "event", F.coalesce("fault_label", F.lit(0)).alias("fault_label"), "task_phase")


@query("""WITH r AS (SELECT p_partkey, concat('level4_', p_partkey % 50, '_', p_size, '_answer') AS stem, CASE WHEN p_size % 7 = 0 THEN 'baseline_simple' ELSE 'm' END AS model, CASE WHEN p_size % 5 = 0 THEN 0.25 END AS rubric_score FROM part),
q AS (SELECT *, split_part(stem, '_', 2)::INT AS n FROM r), h AS (SELECT *, model <> 'baseline_simple' AND rubric_score IS NULL AND n < 40 AND n % 6 > 0 AS hit FROM q)
SELECT p_partkey, CASE WHEN hit THEN n / 40 ELSE 0.5 END AS score, CASE WHEN hit THEN n / 40 ELSE rubric_score END::DOUBLE AS rubric_score, CASE WHEN hit THEN concat('because ', n) END AS llm_judge_reason, CASE WHEN hit THEN 'free_form_rubric' ELSE 'free_form' END AS answer_format FROM h""")
def rubric_written_back(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    none = F.lit(None)
    replies = p.select("p_partkey", F.concat(F.lit("level4_"), (F.col("p_partkey") % 50).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit("_answer")).alias("stem"), F.when(F.col("p_size") % 7 == 0, "baseline_simple").otherwise("m").alias("model"), F.when(F.col("p_size") % 5 == 0, 0.25).alias("rubric_score"), F.lit(0.5).alias("score"), none.cast("double").alias("llm_judge_score"), none.cast("string").alias("llm_judge_reason"), F.lit("free_form").alias("answer_format"))
    n = F.col("n")
    scores = p.where("p_partkey < 40").select(F.col("p_partkey").alias("n")).select(F.concat(F.lit("level4_"), n.cast("string")).alias("question"), F.when(n % 6 > 0, n / 40).alias("score"), F.concat(F.lit("because "), n.cast("string")).alias("reason"))
    return scoring.written_back(replies, scores, "stem", "model").select("p_partkey", "score", "rubric_score", "llm_judge_reason", "answer_format")


@query("""WITH x AS (SELECT p_partkey, concat('level', p_size % 4, '_', p_partkey, '_', p_size, CASE WHEN p_size % 3 > 0 THEN '_answer.json' ELSE '.json' END) AS f, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END AS q, CASE WHEN p_size % 5 > 0 THEN p_type END AS c FROM part)
SELECT p_partkey, CASE WHEN f LIKE '%_answer.json' THEN substr(f, 6, 1)::INT END AS level, CASE WHEN f LIKE '%_answer.json' THEN concat('level', substr(f, 6, 1), '_', p_partkey) END AS stem, coalesce(CASE WHEN trim(q) <> '' THEN q END, c) AS question FROM x""")
def question_lookup(spark: S, sf: str) -> DataFrame:
    """Which question a reply's file answers, and what was asked."""
    s = lambda c: F.col(c).cast("string")
    file = F.concat(F.lit("level"), (F.col("p_size") % 4).cast("string"), F.lit("_"), s("p_partkey"), F.lit("_"), s("p_size"), F.when(F.col("p_size") % 3 > 0, "_answer.json").otherwise(".json"))
    p = table(spark, sf, "part").select("p_partkey", scoring.question_of(file).alias("q"), scoring.question_text(F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_name")), F.when(F.col("p_size") % 5 > 0, F.col("p_type"))).alias("question"))
    return p.select("p_partkey", "q.level", "q.stem", "question")


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_linenumber % 3 = 1 THEN ['a'] ELSE ['a', 'b', 'c'] END AS names FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN len(names) = 0 THEN 'feature_0' ELSE names[{_draw("greatest(1, len(names))", "feature", "l_orderkey", "l_linenumber")} + 1] END AS feature FROM x""")
def feature_key(spark: S, sf: str) -> DataFrame:
    one, none = F.lit(1.0), F.lit(None).cast("double")
    k = F.col("l_linenumber") % 3
    m = F.create_map(F.lit("timestamp_ms"), one, F.lit("a"), F.when(k > 0, one).otherwise(none), F.lit("b"), F.when(k == 2, one).otherwise(none), F.lit("c"), F.when(k == 2, one).otherwise(none), F.lit("event"), one)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", gen.feature_key(m, ["l_orderkey", "l_linenumber"]).alias("feature"))


@query("SELECT sum(o_custkey % 5)::BIGINT AS completed, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS failed, 0::BIGINT AS skipped FROM orders")
def run_totals(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("string").alias("completed"), F.when(F.col("o_orderstatus") == "F", 1).alias("failed"), F.lit("n/a").alias("skipped"))
    return aggregates.run_totals(o)


@query(f"WITH {AXES}, e AS (SELECT episode_id, CASE WHEN seq % 4 > 0 THEN (abs(s0 - v0) + abs(e0 - e1) + abs(s1 - v1)) / 2 END AS error FROM a) SELECT episode_id, count(error) AS n, round(avg(error), 6) AS error FROM e GROUP BY 1 HAVING count(error) > 0")
def tracking_errors(spark: S, sf: str) -> DataFrame:
    there = lambda c: F.when(F.col("seq") % 4 > 0, F.col(c))
    rows = predicates.tracking_errors(axes(spark, sf), [(there("s0"), there("v0"), F.col("e0"), F.col("e1")), (there("s1"), there("v1"), None, None)])
    return rows.groupBy(*EP).agg(F.count("error").alias("n"), F.round(F.avg("error"), 6).alias("error"))
