"""Ordered verbs over episodes: onsets, runs, as-of lookups, interpolation, windows, resampling.

Each takes the key columns of an episode and the columns that order its rows. One shuffle by key serves a whole chain of
these verbs: Spark keeps the partitioning and sort order of the first window for the others on the same key and order.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.draws import draw
from tidemark.functions.values import Name, col, mean_of

Cols = Sequence[str]


def ordered(key: Cols, order: Cols) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def with_seq(df: DataFrame, key: Cols, order: Cols, name: str = "seq") -> DataFrame:
    """Row index from 0 in each episode."""
    return df.withColumn(name, (F.row_number().over(ordered(key, order)) - 1).cast("long"))


def relative_time(df: DataFrame, key: Cols, order: Cols, ts: str, out: str = "t") -> DataFrame:
    """Time since the first valid timestamp of the episode."""
    first = F.first(ts, ignorenulls=True).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.col(ts) - first)


# onsets and runs


def event_starts(df: DataFrame, key: Cols, order: Cols, event: str) -> DataFrame:
    """Rows where a non-zero event follows none."""
    before = F.lag(event, 1, 0).over(ordered(key, order))
    return df.withColumn("__b", F.coalesce(before, F.lit(0))).where((F.col(event) != 0) & (F.col("__b") == 0)).drop("__b")


def onsets(df: DataFrame, key: Cols, seq: str, event: str) -> DataFrame:
    """Per episode: first index with an event, and the fault onset, null if the first row has one already. No sort: hash aggregation."""
    hit = F.when(F.coalesce(F.col(event), F.lit(0)) != 0, F.col(seq))
    return df.groupBy(*key).agg(F.min(hit).alias("first_event"), F.min(seq).alias("__0")).select(*key, "first_event", F.when(F.col("first_event") > F.col("__0"), F.col("first_event")).alias("fault_onset"))


def runs(df: DataFrame, key: Cols, order: Cols, value: str) -> DataFrame:
    """Maximal runs of one value: key, run (from 1), value, start (row index), n. Rows without value end a run and make none."""
    w = ordered(key, order)
    rows = df.select(*key, *[c for c in order if c not in key], value)
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("__i") == 0)).cast("long"))
    rows = rows.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*key, "run").agg(F.min("__i").cast("long").alias("start"), F.count(F.lit(1)).alias("n"), F.first(value).alias(value))
    return out.where(F.col(value).isNotNull()).select(*key, "run", value, "start", "n")


def inner_runs(df: DataFrame, key: Cols, least: int = 3) -> DataFrame:
    """Of runs() output: of three runs and more the first and the last go, and those shorter than least."""
    w = Window.partitionBy(*key)
    rows = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__lo", F.min("run").over(w)).withColumn("__hi", F.max("run").over(w))
    return rows.where((F.col("__n") < 3) | (F.col("run") > F.col("__lo")) & (F.col("run") < F.col("__hi"))).where(F.col("n") >= least).drop("__n", "__lo", "__hi")


def islands(df: DataFrame, key: Cols, index: str) -> DataFrame:
    """Runs of consecutive indices: key, first_index, last_index, n."""
    rows = df.withColumn("__g", F.col(index) - F.row_number().over(ordered(key, [index])))
    return rows.groupBy(*key, "__g").agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(F.lit(1)).alias("n")).drop("__g")


def event_segment(df: DataFrame, key: Cols, order: Cols, token: str) -> DataFrame:
    """Marks the leading rows that hold the first row's token: in_segment and segment_length."""
    w = ordered(key, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__first", F.first(token).over(whole))
    rows = rows.withColumn("__end", F.min(F.when(~F.col(token).eqNullSafe(F.col("__first")), F.col("__i"))).over(Window.partitionBy(*key)))
    length = F.coalesce(F.col("__end") - 1, F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return rows.withColumn("segment_length", length.cast("long")).withColumn("in_segment", F.col("__i") <= F.col("segment_length")).drop("__i", "__first", "__end")


def align_protective_stop(df: DataFrame, key: Cols, order: Cols, safety: str, fault: Name, label: str, faults: Sequence[int] = (19, 37)) -> DataFrame:
    """For these faults labels are 0 before the first step of safety mode from 1 to 3 and the fault from it on."""
    w = ordered(key, order)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__step", (F.col(safety) == 3) & (F.lag(safety).over(w) == 1))
    rows = rows.withColumn("__at", F.min(F.when(F.col("__step"), F.col("__i"))).over(Window.partitionBy(*key)))
    new = F.when(col(fault).isin(*faults) & F.col("__at").isNotNull(), F.when(F.col("__i") >= F.col("__at"), col(fault)).otherwise(0)).otherwise(F.col(label))
    return rows.withColumn(label, new).drop("__i", "__step", "__at")


def label_from_phase(df: DataFrame, key: Cols, seq: str, phase: str, fault: Name, label: str, faults: Sequence[int] = (32, 34), start: str = "1") -> DataFrame:
    """For these faults, where no row is labelled, rows from the first one in the start phase on take the fault."""
    w = Window.partitionBy(*key)
    at = F.min(F.when(F.col(phase).cast("string") == start, F.col(seq))).over(w)
    bare = F.max(F.abs(F.coalesce(F.col(label), F.lit(0)))).over(w) == 0
    return df.withColumn(label, F.when(col(fault).isin(*faults) & bare & (F.col(seq) >= at), col(fault)).otherwise(F.col(label)))


def difference(df: DataFrame, key: Cols, order: Cols, x: str, t: str, out: str = "rate") -> DataFrame:
    """Change per time; 0 in the first row and where no time passed."""
    w = ordered(key, order)
    return df.withColumn(out, F.coalesce((F.col(x) - F.lag(x).over(w)) / F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0)), F.lit(0.0)))


def change_score(df: DataFrame, key: Cols, order: Cols, xs: Cols, out: str = "score") -> DataFrame:
    """Sum of absolute changes over the columns; nulls count nothing."""
    w = ordered(key, order)
    total = F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(F.abs(F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    return df.withColumn(out, total)


def sessions(df: DataFrame, key: Cols, order: str, gap: float, tie: Cols = ()) -> DataFrame:
    """Groups of rows no further than gap apart: key, session (from 1), first, last, n."""
    w = ordered(key, [order, *tie])
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("long"), F.lit(1))
    rows = df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "session").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def sampling_rate(df: DataFrame, key: Cols, order: Cols, t: str, target_hz: float = 10.0, per_second: float = 1000.0) -> DataFrame:
    """key, median_dt, hz, factor: from positive time steps; needs over 3 of them and over 5 rows, else nulls and factor 1."""
    w = ordered(key, order)
    steps = df.withColumn("__d", F.col(t) - F.lag(t).over(w))
    out = steps.groupBy(*key).agg(F.median(F.when(F.col("__d") > 0, F.col("__d"))).alias("__m"), F.count(F.when(F.col("__d") > 0, 1)).alias("__k"), F.count(F.lit(1)).alias("__r"))
    ok = (F.col("__k") > 3) & (F.col("__r") > 5)
    hz = F.when(ok, per_second / F.col("__m"))
    return out.select(*key, F.when(ok, F.col("__m")).alias("median_dt"), hz.alias("hz"), F.coalesce(F.greatest(F.lit(1), F.bround(hz / target_hz).cast("long")), F.lit(1)).alias("factor"))


def lookahead(df: DataFrame, key: Cols, order: Cols, x: str, steps: int, out: str = "ahead") -> DataFrame:
    return df.withColumn(out, F.lead(x, steps).over(ordered(key, order)))


def last_event_before(df: DataFrame, key: Cols, order: Cols, event: str, idle: Sequence[int] = (0, 1), out: str = "last_event") -> DataFrame:
    """The most recent event, but for idle ones, of earlier rows."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(~F.col(event).isin(*idle), F.col(event)), ignorenulls=True).over(w))


# as-of joins and interpolation: one sorted union instead of a range join, so a probe costs one row


def asof(probes: DataFrame, rows: DataFrame, key: Cols, t: str, values: Cols, direction: str = "backward", tie: Cols = ()) -> DataFrame:
    """probes with the values (and <t>_found) of the last row at or before t, or, forward, the first at or after it.

    Both sides are united and sorted within the key once; nothing multiplies. Ties in t of rows go by the tie columns, the
    last of them counts backward, the first forward. Probes without a row keep nulls.
    """
    own = [c for c in probes.columns if c not in key]
    found = F.struct(F.col(t).alias("t"), *values)
    kind = rows.select(found.alias("f")).schema["f"].dataType
    orders = [F.lit(None).cast(rows.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(tie)]
    left = probes.select(*key, F.struct(*own).alias("__own"), F.col(t).alias("__t"), F.lit(None).cast(kind).alias("__f"), *orders)
    right = rows.select(*key, F.lit(None).cast(left.schema["__own"].dataType).alias("__own"), F.col(t).alias("__t"), found.alias("__f"), *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie)])
    turn = (lambda c: F.col(c).asc()) if direction == "backward" else (lambda c: F.col(c).desc())  # forward is backward over the reversed order
    # of equal times rows stand before probes
    w = Window.partitionBy(*key).orderBy(turn("__t"), F.col("__own").isNotNull(), *[turn(f"__tie{i}") for i in range(len(tie))])
    pick = F.last("__f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = left.unionByName(right).withColumn("__hit", pick).where("__own IS NOT NULL")
    return out.select(*key, "__own.*", F.col("__hit.t").alias(f"{t}_found"), *[F.col(f"__hit.{v}").alias(v) for v in values])


def both_sides(probes: DataFrame, rows: DataFrame, key: Cols, t: str, values: Cols) -> DataFrame:
    """probes with `before` and `after`, structs (t, values) of the nearest rows at or before and at or after t: one union, one shuffle, two sorted passes."""
    own = [c for c in probes.columns if c not in key]
    found = F.struct(F.col(t).alias("t"), *values)
    kind = rows.select(found.alias("f")).schema["f"].dataType
    left = probes.select(*key, F.struct(*own).alias("__own"), F.col(t).alias("__t"), F.lit(None).cast(kind).alias("__f"))
    right = rows.select(*key, F.lit(None).cast(left.schema["__own"].dataType).alias("__own"), F.col(t).alias("__t"), found.alias("__f"))
    frame = lambda order: Window.partitionBy(*key).orderBy(order, F.col("__own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("before", F.last("__f", ignorenulls=True).over(frame(F.asc("__t"))))
    out = out.withColumn("after", F.last("__f", ignorenulls=True).over(frame(F.desc("__t")))).where("__own IS NOT NULL")
    return out.select(*key, "__own.*", "before", "after")


def interpolate(probes: DataFrame, rows: DataFrame, key: Cols, t: str, x: str) -> DataFrame:
    """probes with x at time t, linear between the bracketing rows, clamped at both ends, and how: exact or interpolated."""
    both = both_sides(probes, rows.where(F.col(x).isNotNull()), key, t, [x])
    at, t0, t1, x0, x1 = (F.col(c) for c in (t, "before.t", "after.t", f"before.{x}", f"after.{x}"))
    value = F.when(t0 == at, x0).when(t1 == at, x1).when(t0.isNull(), x1).when(t1.isNull(), x0).otherwise(x0 + (x1 - x0) * ((at - t0) / (t1 - t0)))
    how = F.when((t0 == at) | (t1 == at), "exact").when(t0.isNotNull() | t1.isNotNull(), "interpolated")
    return both.withColumn("how", how).withColumn(x, value).drop("before", "after")


def jerk(df: DataFrame, key: Cols, order: Cols, x: str, dt: float, out: str = "jerk") -> DataFrame:
    """Third derivative by the five-point central difference; null within two rows of an end."""
    w = ordered(key, order)
    at = lambda k: F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w)
    return df.withColumn(out, (at(2) - 2 * at(1) + 2 * at(-1) - at(-2)) / (2 * dt**3))


# windows


def chunks(df: DataFrame, key: Cols, seq: str, size: int, start: int = 0, most: int | None = None) -> DataFrame:
    """Back-to-back chunks of size rows; a last short one goes."""
    rows = df.where(F.col(seq) >= start).withColumn("chunk", F.floor((F.col(seq) - start) / size))
    if most is not None:
        rows = rows.where(F.col("chunk") < most)
    full = F.count(F.lit(1)).over(Window.partitionBy(*key, "chunk")) == size
    return rows.withColumn("__full", full).where("__full").drop("__full")


def windows_before_event(df: DataFrame, key: Cols, seq: str, event: str, least: int, most: int, after: int) -> DataFrame:
    """Candidate windows that end right before an onset with room on both sides: key, onset, n (the longest), start."""
    rows = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    hits = event_starts(rows, key, [seq], event).where((F.col(seq) >= least) & (F.col("__n") - F.col(seq) - 1 >= after))
    n = F.least(F.lit(most), F.col(seq))
    return hits.select(*key, F.col(seq).alias("onset"), n.alias("n"), (F.col(seq) - n).alias("start"))


def windows_around(df: DataFrame, key: Cols, n_rows: str, center: str, length: int, margin: int) -> DataFrame:
    """All starts of windows that hold the center with a margin on both sides."""
    lo = F.greatest(F.lit(0), F.col(center) + margin - length + 1)
    hi = F.least(F.col(n_rows) - length, F.col(center) - margin)
    return df.where(hi >= lo).select(*key, center, F.explode(F.sequence(lo, hi)).alias("start"), F.lit(length).alias("n"))


def phase_overlap(run_list: DataFrame, windows: DataFrame, key: Cols, least: int, width: int = 64) -> DataFrame:
    """Windows that share at least min(run length, least) rows with a run of the phase.

    Both go by buckets of width rows, so windows and runs of a long episode meet only where they are near.
    """
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    w = windows.withColumnsRenamed({"start": "w_start", "n": "w_n"})
    w = w.withColumn("__bucket", buckets(F.col("w_start"), F.col("w_start") + F.col("w_n") - 1))
    r = run_list.select(*key, "start", "n").withColumn("__bucket", buckets(F.col("start"), F.col("start") + F.col("n") - 1))
    both = w.join(r, [*key, "__bucket"])
    shared = F.least(F.col("w_start") + F.col("w_n"), F.col("start") + F.col("n")) - F.greatest("w_start", "start")
    return both.where(shared >= F.least(F.col("n"), F.lit(least))).select(*[c for c in w.columns if c != "__bucket"]).distinct().withColumnsRenamed({"w_start": "start", "w_n": "n"})


def seeded_pick(df: DataFrame, key: Cols, by: Cols, k: int = 1, seed: int = 42) -> DataFrame:
    """k rows of each key in an order drawn by a hash of seed and the by columns."""
    w = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), *key, *by), *by)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def pad_to_common(df: DataFrame, key: Cols, group: Cols, seq: str) -> DataFrame:
    """Episodes of a group get as many rows as its longest: the last row is repeated."""
    ends = df.groupBy(*group, *key).agg(F.max_by(F.struct(*df.columns), seq).alias("__last"), F.max(seq).alias("__hi"))
    ends = ends.withColumn("__most", F.max("__hi").over(Window.partitionBy(*group))).where("__most > __hi")
    more = ends.select("__last", F.explode(F.sequence(F.col("__hi") + 1, F.col("__most"))).alias("__seq")).select("__last.*", "__seq")
    return df.unionByName(more.drop(seq).withColumnRenamed("__seq", seq))


# noise, fills, resampling


def fill_gaps(df: DataFrame, key: Cols, order: Cols, x: str, t: str) -> DataFrame:
    """Nulls of x: linear between neighbours, the nearest value at the ends, 0 in an empty column."""
    w = ordered(key, order)
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    back = ordered(key, [F.col(c).desc() for c in order])
    rows = df.withColumn("__a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__b", F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    between = F.col("__a.x") + (F.col("__b.x") - F.col("__a.x")) * ((F.col(t) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t")))
    return rows.withColumn(x, F.coalesce(F.col(x), between, F.col("__a.x"), F.col("__b.x"), F.lit(0.0))).drop("__a", "__b")


def random_walk(df: DataFrame, key: Cols, order: Cols, x: str, sigma: float, seed: int = 42, out: str = "noisy") -> DataFrame:
    """The episode's first value and a running sum of normal steps, drawn by a hash of key and order, so a rerun repeats it."""
    w = ordered(key, order)
    u = lambda salt: (draw(1 << 32, f"walk-{seed}-{salt}", *key, *order) + 0.5) / float(1 << 32)
    step = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1)) * sigma
    i = F.row_number().over(w)
    rows = df.withColumn("__s", step).withColumn("__i", i)
    walk = F.sum(F.when(F.col("__i") > 1, F.col("__s")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) + walk).drop("__s", "__i")


def chebyshev_sections(order: int, ripple_db: float, cut: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a digital Chebyshev low-pass of the first kind; cut as a share of Nyquist."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    mu = np.arcsinh(1 / eps) / order
    poles = (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)) * np.tan(np.pi * cut / 2)
    poles = (1 + poles) / (1 - poles)  # bilinear transform
    upper = sorted((p for p in poles if p.imag > 0), key=abs)
    out = []
    for p in upper:
        a1, a2 = -2 * p.real, abs(p) ** 2
        g = (1 + a1 + a2) / 4  # gain 1 at frequency 0
        out.append([g, 2 * g, g, a1, a2])
    out = np.array(out)
    if order % 2 == 0:  # an even order ripples below 1 at frequency 0
        out[0, :3] *= 10 ** (-ripple_db / 20)
    return out


@functools.lru_cache(maxsize=64)
def impulse_response(q: int) -> np.ndarray:
    """Response of the low-pass for decimation by q (order 8, 0.05 dB, cut at 0.8 / q), as long as it stays above 1e-13 of its start."""
    sections = chebyshev_sections(8, 0.05, 0.8 / q)
    radius = max(np.sqrt(a2) for *_, a2 in sections)
    x = np.zeros(int(np.ceil(np.log(1e-13) / np.log(radius))))
    x[0] = 1.0
    for b0, b1, b2, a1, a2 in sections:
        y, z1, z2 = np.empty_like(x), 0.0, 0.0
        for i, v in enumerate(x):
            y[i] = o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
        x = y
    return x


def _filter(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Convolution of all columns of x with h, as if the first row had always been there."""
    past = np.repeat(x[:1], len(h) - 1, axis=0)
    ext = np.concatenate([past, x])
    size = 1 << (len(ext) + len(h) - 2).bit_length()
    y = np.fft.irfft(np.fft.rfft(ext, size, axis=0) * np.fft.rfft(h, size)[:, None], size, axis=0)
    return y[len(past) : len(ext)]


#: Fixed value: rows reflected at each end before filtering; episodes need more.
PADDING = 27


def smooth(x: np.ndarray, q: int) -> np.ndarray:
    """Zero-phase anti-alias filter for decimation by q over the rows of x (time, channels); odd reflection at the ends."""
    h = impulse_response(q)
    pad = min(PADDING, len(x) - 1)
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]]) if pad else x
    y = _filter(h, _filter(h, ext)[::-1])[::-1]
    return y[pad : pad + len(x)]


def decimate(df: DataFrame, key: Cols, seq: str, q: int, continuous: Cols, block: int = 50_000, overlap: int = 100) -> DataFrame:
    """Every q-th row, continuous columns filtered first.

    Long episodes are cut into blocks of block * q rows with overlap * q rows of neighbours on each side, so a group is
    bounded however long the episode; the filter's memory fades well within the overlap. Episodes shorter than q keep their
    first row; columns with under 2 q values in the whole episode are only thinned, and so are the filled columns of episodes
    too short for the filter's padding (27 rows or fewer). seq must count rows from 0. Counts are aggregated, not windowed.
    """
    if q <= 1:
        return df
    size, lap = block * q, overlap * q
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.count(c) >= 2 * q for c in continuous]).cast("array<boolean>").alias("__full"))
    rows = df.join(counts, list(key))
    rows = rows.withColumn("__block", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(seq) - lap) / size), F.floor((F.col(seq) + lap) / size))))
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable").reset_index(drop=True)
        at = pdf[seq].to_numpy()
        keep = (at // size == pdf["__block"].to_numpy()) & (at % q == 0) & ((at // q < pdf["__n"].to_numpy() // q) | (at == 0))
        if keep.any():
            full = [c for c, ok in zip(continuous, pdf["__full"].iloc[0]) if ok]
            if full and len(pdf) >= q:
                x = pdf[full].astype(float)
                if x.isna().to_numpy().any():
                    x = x.interpolate(limit_direction="both").fillna(0.0)
                pdf[full] = smooth(x.to_numpy(), q) if pdf["__n"].iloc[0] > PADDING else x
        return pdf.loc[keep, [f.name for f in schema]]

    return rows.groupBy(*key, "__block").applyInPandas(run, schema)


def mean_abs(xs: Sequence[Column]) -> Column:
    return mean_of([F.abs(x) for x in xs])
