"""Quantified ground-truth statements about a window against the values before it.

Each statement is a column over one row per window, with arrays per axis; a table of rules gives the thresholds. Axes with
a missing value are skipped; the quantifier says what remains when none is left (any: false, all: true, others: null).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import mean_of
from tidemark.operators.aggregates import all_of, any_of

EPS = 1e-9

#: Thresholds of the statements.
THRESHOLDS = {
    "speed_drop_ratio": 0.30,
    "speed_stable_tol": 0.10,
    "stall_current_increase": 0.25,
    "stall_speed_frac": 0.10,
    "force_low_increase": 0.20,
    "force_low_coverage": 0.80,
    "force_spike_increase": 0.40,
    "tracking_increase": 0.25,
    "tracking_stable_increase": 0.10,
    "current_peak_increase": 0.20,
    "current_relax_drop": 0.10,
    "robot_current_stable_range": 0.10,
    "robot_current_increase": 0.20,
    "tcp_tracking_stable_increase": 0.10,
    "tcp_tracking_increase": 0.25,
    "temp_rise_slope": 0.005,
    "temp_rise_min_axes": 2.0,
    "temp_stable_slope": 0.002,
    "temp_stable_axes_ratio": 0.80,
    "no_effect_agg_increase": 0.10,
}


def tracking_error(axes: Sequence[tuple[Column, Column, Column | None, Column | None]]) -> Column:
    """Mean over axes of |position setpoint - feedback|, plus |speed setpoint - feedback| where both are known; axes without positions are skipped."""
    errors = []
    for set_at, at, set_speed, speed in axes:
        more = F.lit(0.0) if set_speed is None or speed is None else F.coalesce(F.abs(set_speed - speed), F.lit(0.0))
        errors.append(F.abs(set_at - at) + more)
    return mean_of(errors)


def tracking_errors(rows: DataFrame, axes: Sequence[tuple[Column, Column, Column | None, Column | None]], out: str = "error") -> DataFrame:
    """The rows that have a tracking error, with it."""
    return rows.withColumn(out, tracking_error(axes)).where(F.col(out).isNotNull())


def window_features(rows: DataFrame, items: DataFrame, key: Sequence[str], seq: str, axes: Sequence[tuple[str, str, str]], contact: str, current: str, safety: str, tcp: Column | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """One row per item: values of its base row (pre_) and aggregates of the rows from its first one on.

    items: key, `base` and `first` (places in the episode), maybe `force_low` (the share above the contact before that still
    counts as low), and `by`, what tells items of one episode apart. axes: (speed, setpoint, effort) columns of each axis;
    tcp: the tracking error of the tool, where there is one. Items without a base row go. Later rows are
    compared with the base row, whose contact a window hands to them, so that one aggregation of one join by key finds all;
    of an episode only the base row and those from the first on are kept for it, and Spark spills them.
    """
    by = list(by or key)
    tcp = F.lit(None).cast("double") if tcp is None else tcp
    error = tracking_error([(F.col(sp), F.col(v), None, None) for v, sp, _ in axes])
    low = F.col("force_low") if "force_low" in items.columns else F.lit(THRESHOLDS["force_low_increase"])
    asked = items.select(*{*key, *by}, F.col("base").alias("__base"), F.col("first").alias("__first"), low.alias("__low"))
    own = rows.join(asked, list(key))
    at_base = lambda x: F.max(F.when(F.col(seq) == F.col("__base"), x))
    pre = {f"pre_v{i}": F.col(v) for i, (v, _, _) in enumerate(axes)} | {f"pre_e{i}": F.col(e) for i, (_, _, e) in enumerate(axes)}
    pre |= {"pre_contact": F.col(contact), "pre_current": F.col(current), "pre_track": error, "pre_tcp": tcp}
    # rows of one key are dealt together for the join already; the windows and the groups need no other deal
    w, after = Window.partitionBy(*by), F.col(seq) >= F.col("__first")
    own = own.withColumns({"__contact": at_base(F.col(contact)).over(w), "__last": F.max(seq).over(w), "__there": at_base(F.lit(True)).over(w)})
    own = own.where("__there").where(after | (F.col(seq) == F.col("__base")))
    # the first four tenths of the rows, one at least
    early = F.col(seq) < F.col("__first") + F.greatest(F.lit(1), F.floor((F.col("__last") - F.col("__first") + 1) * 4 / 10))
    of = lambda x: F.when(after, x)
    c, r = of(F.col(contact)), of(F.col(current))
    aggs = [at_base(x).alias(n) for n, x in pre.items()] + [F.count_if(after).alias("__after")]
    for i, (v, _, e) in enumerate(axes):
        speed, effort = of(F.col(v)), of(F.col(e))
        known = F.when(effort.isNotNull(), F.col(seq))
        aggs += [F.min(speed).alias(f"min_v{i}"), F.max(speed).alias(f"max_v{i}"), F.avg(F.abs(speed)).alias(f"abs_v{i}"), F.avg(effort).alias(f"mean_e{i}"), F.count(effort).alias(f"n_e{i}")]
        aggs += [F.max(F.when(early, effort)).alias(f"early_e{i}"), F.min_by(effort, known).alias(f"first_e{i}"), F.max_by(effort, known).alias(f"last_e{i}")]
    aggs += [
        F.avg(F.when(c.isNotNull(), (c <= (1 + F.col("__low")) * F.col("__contact")).cast("double"))).alias("contact_low"),
        F.max(c).alias("contact_most"), F.avg(c).alias("contact"), F.avg(of(error)).alias("track"), F.avg(of(tcp)).alias("tcp"),
        (F.max(r) - F.min(r)).alias("current_span"), F.avg(r).alias("current_mean"), F.bool_and(of(F.coalesce(F.col(safety) == 1, F.lit(False)))).alias("safe"),
    ]
    return own.groupBy(*by).agg(*aggs).where("__after > 0").drop("__after")


def aggregate_error(track: Column, tcp: Column, contact: Column, current: Column) -> Column:
    """Mean of the terms that are known: tracking, tool tracking, contact norm, relative change of the robot's current."""
    return mean_of([track, tcp, contact, current])


def statements(n_axes: int, thresholds: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Truth of each statement over window_features(), by the usual thresholds or those given (columns: each item has its own)."""
    c, axes = F.col, range(n_axes)
    given = thresholds or {}
    t = {n: given.get(n, F.lit(x)) for n, x in THRESHOLDS.items()}
    scale = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(EPS), F.abs(x)))
    far = lambda i: F.greatest(c(f"max_v{i}") - c(f"pre_v{i}"), c(f"pre_v{i}") - c(f"min_v{i}"))
    known = F.array_compact(F.array(*[F.when(c(f"n_e{i}") >= 2, (c(f"last_e{i}") - c(f"first_e{i}")) / scale(c(f"pre_e{i}"))) for i in axes]))
    moved = F.abs(c("current_mean") - c("pre_current")) / scale(c("pre_current"))
    before, after = aggregate_error(c("pre_track"), c("pre_tcp"), c("pre_contact"), F.abs(c("pre_current") - c("pre_current"))), aggregate_error(c("track"), c("tcp"), c("contact"), moved)
    of_known: Callable[[Column], Column] = lambda x: F.when(F.size(known) > 0, x)
    return {
        "mc_003": any_of([c(f"min_v{i}") <= (1 - t["speed_drop_ratio"]) * c(f"pre_v{i}") for i in axes]),
        "mc_004": all_of([far(i) <= t["speed_stable_tol"] * scale(c(f"pre_v{i}")) for i in axes]),
        "mc_005": any_of([(c(f"mean_e{i}") >= (1 + t["stall_current_increase"]) * c(f"pre_e{i}")) & (c(f"abs_v{i}") <= t["stall_speed_frac"] * scale(c(f"pre_v{i}"))) for i in axes]),
        "mc_006": c("contact_low") >= t["force_low_coverage"],
        "mc_007": c("contact_most") >= (1 + t["force_spike_increase"]) * c("pre_contact"),
        "mc_008": c("track") >= (1 + t["tracking_increase"]) * c("pre_track"),
        "mc_009": c("track") <= (1 + t["tracking_stable_increase"]) * c("pre_track"),
        "mc_012": any_of([(c(f"early_e{i}") >= (1 + t["current_peak_increase"]) * c(f"pre_e{i}")) & (c(f"last_e{i}") <= (1 - t["current_relax_drop"]) * c(f"early_e{i}")) for i in axes]),
        "mc_013": c("current_span") <= t["robot_current_stable_range"] * scale(c("pre_current")),
        "mc_014": c("current_mean") >= (1 + t["robot_current_increase"]) * c("pre_current"),
        "mc_015": c("tcp") <= (1 + t["tcp_tracking_stable_increase"]) * c("pre_tcp"),
        "mc_016": c("tcp") >= (1 + t["tcp_tracking_increase"]) * c("pre_tcp"),
        "mc_017": of_known(F.size(F.filter(known, lambda s: s > t["temp_rise_slope"])) >= F.round(t["temp_rise_min_axes"])),
        "mc_018": of_known(F.size(F.filter(known, lambda s: F.abs(s) <= t["temp_stable_slope"])) / F.size(known) >= t["temp_stable_axes_ratio"]),
        "mc_019": F.when(~c("safe"), F.lit(False)).otherwise(after <= (1 + t["no_effect_agg_increase"]) * before),
    }


def answer_string(truths: Sequence[Column]) -> Column:
    """T and F by statement; unknown is F."""
    return F.concat(*[F.when(F.coalesce(x, F.lit(False)), "T").otherwise("F") for x in truths])


def comparative(robot: tuple[Column, Column], fault: tuple[Column, Column], task: tuple[Column, Column], phase: tuple[Column, Column]) -> Column:
    """T and F for: other robot, other anomalous state, other task, same task in another usual phase. Null where nothing differs."""
    a, b = fault
    flags = [robot[0] != robot[1], a != b, task[0] != task[1], (task[0] == task[1]) & F.coalesce(phase[0] != phase[1], F.lit(False))]
    text = answer_string(flags)
    return F.when(text.contains("T"), text)
