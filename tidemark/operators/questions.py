"""Point-in-time answers: signals interpolated at a time, then compared with a threshold, with one another or with limits.

Every answer is a struct of answer, value and holds; a missing signal gives "Unknown" and null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import Name, col, norm
from tidemark.operators.joins import interval_join, nearest

Cols = Sequence[str]

#: Standard gravity in m/s2; defaults of rated speed in rad/s and rated current in A; the step a trend needs.
GRAVITY, RATED_SPEED, RATED_CURRENT, STILL = 9.81, 3.14, 2.0, 1e-4


def at_times(probes: DataFrame, rows: DataFrame, key: Cols, t: str, signals: Cols) -> DataFrame:
    """probes with each signal at time t, linear between the rows around it, clamped at both ends; nulls of rows are skipped.

    Probes and rows are united and shuffled once by key for all signals; each side of a probe is one sorted pass.
    """
    own = [c for c in probes.columns if c not in key]
    point = {x: F.when(F.col(x).isNotNull(), F.struct(F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"))) for x in signals}
    right = rows.select(*key, F.col(t).cast("double").alias("__t"), *[point[x].alias(f"__p{i}") for i, x in enumerate(signals)])
    left = probes.select(*key, F.col(t).cast("double").alias("__t"), *[F.lit(None).cast(right.schema[f"__p{i}"].dataType).alias(f"__p{i}") for i in range(len(signals))], F.struct(*own).alias("__own"))
    both = left.unionByName(right.withColumn("__own", F.lit(None).cast(left.schema["__own"].dataType)))
    frame = lambda order: Window.partitionBy(*key).orderBy(order, F.col("__own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(signals)):
        both = both.withColumn(f"__a{i}", F.last(f"__p{i}", ignorenulls=True).over(frame(F.asc("__t"))))
    for i in range(len(signals)):
        both = both.withColumn(f"__b{i}", F.last(f"__p{i}", ignorenulls=True).over(frame(F.desc("__t"))))
    out = []
    for i, x in enumerate(signals):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        share = (F.col("__t") - a["t"]) / (b["t"] - a["t"])
        out.append(F.when(a["t"] == F.col("__t"), a["x"]).when(b["t"] == F.col("__t"), b["x"]).when(a.isNull(), b["x"]).when(b.isNull(), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * share).alias(x))
    return both.where("__own IS NOT NULL").select(*key, "__own.*", *out)


def _answer(known: Column, answer: Column, value: Column, holds: Column) -> Column:
    return F.struct(F.when(known, answer).otherwise("Unknown").alias("answer"), F.when(known, value.cast("double")).alias("value"), F.when(known, holds).alias("holds"))


def yes_no(holds: Column) -> Column:
    return F.when(holds, "Yes").otherwise("No")


def short(x: Column) -> Column:
    """Four decimals, without trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return F.when(text == "-0.0", "0.0").otherwise(text)


def same_position(q1: Name, q2: Name, eps: float) -> Column:
    """Is the joint where it was? Yes where it moved by at most eps."""
    moved = F.abs(col(q2) - col(q1))
    return _answer(moved.isNotNull(), yes_no(moved <= eps), moved, moved <= eps)


def friction_proxies(probes: DataFrame, rows: DataFrame, key: Cols, t: str, probe: Cols, speed: str, current: str, half: int = 500) -> DataFrame:
    """key, probe and friction: the median of |current| / |speed| of moving rows within half of each probe; null under three rows."""
    spans = probes.select(*key, *probe, (F.col(t) - half).alias("__lo"), (F.col(t) + half).alias("__hi"))
    near = interval_join(rows.select(*key, t, speed, current), spans, key, t, "__lo", "__hi", 2 * half)
    ratio = F.when(F.abs(speed) > 1e-6, F.abs(current) / F.abs(speed))
    return near.groupBy(*key, *probe).agg(F.count(F.lit(1)).alias("__n"), F.percentile(ratio, F.lit(0.5)).alias("__m")).select(*key, *probe, F.when(F.col("__n") >= 3, F.col("__m")).alias("friction"))


def friction_rises(f1: Name, f2: Name, percent: float) -> Column:
    ratio = F.when(col(f1) == 0, F.lit(float("inf"))).otherwise(col(f2) / col(f1))
    known = col(f1).isNotNull() & col(f2).isNotNull()
    return _answer(known, yes_no(ratio > 1 + percent / 100), ratio, ratio > 1 + percent / 100)


def acceleration(axes: Sequence[Name], threshold: float = 1.0) -> Column:
    """The vector x_y_z in m/s2 (four decimals each), its size and whether that is above threshold; highest: the axis of the largest part."""
    parts = [col(a) * GRAVITY for a in axes]
    size = norm(parts)
    text = F.concat_ws("_", *[F.format_string("%.4f", p) for p in parts])
    largest = F.greatest(*[F.abs(p) for p in parts])
    highest = F.coalesce(*[F.when(F.abs(p) == largest, n) for p, n in zip(parts, "XYZ")])
    out = _answer(size.isNotNull(), text, size, size > threshold)
    return F.struct(out["answer"].alias("answer"), out["value"].alias("value"), out["holds"].alias("holds"), F.when(size.isNotNull(), highest).alias("highest"))


def wrench(sensed: Sequence[Name], estimated: Sequence[Name]) -> Column:
    """Array of the sensed parts if all are known, else of the estimated ones; null if neither is whole."""
    whole = lambda parts: F.when(F.forall(F.array(*map(col, parts)), lambda x: x.isNotNull()), F.array(*[col(p).cast("double") for p in parts]))
    return F.coalesce(whole(sensed), whole(estimated))


def force_detected(parts: Name, least: float) -> Column:
    size = F.sqrt(F.aggregate(col(parts), F.lit(0.0), lambda acc, x: acc + x * x))
    return _answer(size.isNotNull(), yes_no(size >= least), size, size >= least)


def magnitude(x: Name, threshold: float) -> Column:
    """|x| and whether it is above threshold: torque, current."""
    return _answer(col(x).isNotNull(), short(F.abs(col(x))), F.abs(col(x)), F.abs(col(x)) > threshold)


def below(x: Name, threshold: float) -> Column:
    """x and whether |x| is below threshold: joint speed."""
    return _answer(col(x).isNotNull(), short(col(x)), col(x), F.abs(col(x)) < threshold)


def current(x: Name, threshold: float) -> Column:
    """x with its sign, and whether |x| is above threshold: motor current."""
    return _answer(col(x).isNotNull(), short(col(x)), col(x), F.abs(col(x)) > threshold)


def within_rating(x: Name, limits: Name, axis: Name, default: float = RATED_CURRENT) -> Column:
    """Is |x| at most its axis's limit? Axes beyond the list take the default; Unknown without a list."""
    axis = F.lit(axis) if isinstance(axis, int) else col(axis)
    known = col(x).isNotNull() & col(limits).isNotNull()
    ok = F.abs(col(x)) <= F.coalesce(F.get(col(limits), axis.cast("int")), F.lit(default))
    return _answer(known, yes_no(ok), F.abs(col(x)), ok)


def tracking_error_at(setpoint: Name, feedback: Name, threshold: float) -> Column:
    """|setpoint - feedback| at one time, and whether it is above threshold."""
    error = F.abs(col(setpoint) - col(feedback))
    return _answer(error.isNotNull(), short(error), error, error > threshold)


def error_trend(first: Name, second: Name) -> Column:
    """increased, decreased or stable, from one tracking error to a later one."""
    diff = col(second) - col(first)
    return _answer(diff.isNotNull(), F.when(diff > STILL, "increased").when(diff < -STILL, "decreased").otherwise("stable"), diff, diff > STILL)


def ranked_joints(values: Sequence[Name]) -> Column:
    """Joints by falling absolute value, ties to the smaller number: highest and order (text of their numbers); null if one is missing."""
    items = F.array(*[F.struct((-F.abs(col(v))).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)])
    order = F.transform(F.array_sort(items), lambda s: s["i"])
    known = F.forall(F.array(*map(col, values)), lambda x: x.isNotNull())
    return F.struct(F.when(known, order[0]).alias("highest"), F.when(known, F.array_join(order.cast("array<string>"), "")).alias("order"))


def within_limits(values: Sequence[Name], limits: Name, default: float = RATED_SPEED) -> Column:
    """T or F per joint: |value| at most its limit; joints beyond the list take the default. Unknown if a value is missing or there is no list."""
    held = [F.abs(col(v)) <= F.coalesce(F.get(col(limits), F.lit(i)), F.lit(default)) for i, v in enumerate(values)]
    known = F.forall(F.array(*map(col, values)), lambda x: x.isNotNull()) & col(limits).isNotNull()
    return F.when(known, F.concat(*[F.when(h, "T").otherwise("F") for h in held])).otherwise("Unknown")


def jerk_at_rows(rows: DataFrame, key: Cols, order: Cols, t: str, speed: str, out: str = "jerk") -> DataFrame:
    """Third derivative at each row from two accelerations over two rows each; null near the ends and where time stands still."""
    w = Window.partitionBy(*key).orderBy(*order)
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    span = lambda a, b: F.nullif((a - b) / 1000.0, F.lit(0.0))
    t0, v0 = F.col(t), F.col(speed)
    before = (v0 - at(speed, -2)) / span(t0, at(t, -2))
    after = (at(speed, 2) - v0) / span(at(t, 2), t0)
    return rows.withColumn(out, (after - before) / span(at(t, 1), at(t, -1)))


def jerk_at(probes: DataFrame, rows: DataFrame, key: Cols, t: str, speed: str, threshold: float = 5.0) -> DataFrame:
    """probes with answer, value, holds and range: the jerk at the row whose time is nearest to the probe's, of two the earlier. Rows without a time don't count."""
    there = rows.where(F.col(t).isNotNull()).select(*key, t, speed)
    found = nearest(probes, jerk_at_rows(there, key, [t], t, speed, "__jerk"), key, t, ["__jerk"]).drop(f"{t}_found")
    j = F.col("__jerk")
    out = _answer(j.isNotNull(), short(j), j, F.abs(j) > threshold)
    return found.withColumn("__a", out).select(*probes.columns, "__a.*", jerk_range(j).alias("range"))


def jerk_range(jerk: Name) -> Column:
    """Low under 1, Medium under 5, else High, by size."""
    size = F.abs(col(jerk))
    return F.when(size < 1, "Low").when(size < 5, "Medium").when(size >= 5, "High")


def joint_count(columns: Sequence[str], prefixes: Sequence[str]) -> int:
    """How many joints the first prefix that has any covers without a gap; read from the schema."""
    for prefix in prefixes:
        n = 0
        while f"{prefix}{n}" in columns:
            n += 1
        if n:
            return n
    return 0
