"""Grouped verbs: modes, constants, histogram divergence, counterfactual choice, margins, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import Name, col

Cols = Sequence[str]


def melt(df: DataFrame, ids: Cols, features: Cols, name: str = "feature", value: str = "value") -> DataFrame:
    """Long form; one narrow pass, no shuffle."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(ids), list(features), name, value)


def modal(df: DataFrame, key: Cols, value: str, order: str | None = None, skip_zero: bool = False) -> DataFrame:
    """key, value, n: the most frequent value. Ties: the one met first by order, or else the smallest. Counts are combined before they are shuffled."""
    rows = df.where(F.col(value).isNotNull() & ((F.col(value) != 0) if skip_zero else F.lit(True)))
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), (F.min(order) if order else F.lit(0)).alias("__first"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), "__first", F.col(value))).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), (-F.col("b.n")).alias("n"))


def constant_features(long: DataFrame, key: Cols, spread: float = 0.02, deviation: float = 0.01) -> DataFrame:
    """Of long rows (key, feature, value): n, mean and whether the feature hardly changes. Features without values are not constant."""
    agg = long.groupBy(*key, "feature").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    scale = F.abs(F.col("mean")) + 1e-9
    close = F.abs(F.col("hi") - F.col("lo")) <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo"))
    flat = (F.col("n") < 2) | close | ((F.col("hi") - F.col("lo")) / scale < spread) | (F.col("sd") / scale < deviation)
    return agg.select(*key, "feature", "n", "mean", ((F.col("n") > 0) & flat).alias("is_constant"))


def inactive(long: DataFrame, key: Cols, seq: str, trim: int = 5, least: int = 55) -> DataFrame:
    """Episodes most of whose features are constant once trim rows go at each end (of over 10)."""
    n = long.groupBy(*key).agg(F.max(seq).alias("__hi"))
    inner = long.join(n, list(key)).where((F.col("__hi") < 10) | F.col(seq).between(F.lit(trim), F.col("__hi") - trim))
    found = constant_features(inner, key)
    return found.groupBy(*key).agg(F.count_if("is_constant").alias("n_constant")).withColumn("inactive", F.col("n_constant") >= least)


def nominal(df: DataFrame, key: Cols, fault: str) -> DataFrame:
    """Episodes whose every fault label that is not null is 0."""
    return df.groupBy(*key).agg(F.max(F.abs(F.coalesce(F.col(fault), F.lit(0)))).alias("m")).where("m = 0").select(*key)


def histogram_kl(left: DataFrame, right: DataFrame, pair: Cols, least: int = 5) -> DataFrame:
    """Mean over features of the divergence of two histograms of common edges.

    left, right: (pair..., feature, value). Features with under least values on a side do not count; a pair without any
    has no row. Bins: a fifth of the left side's values, 5 to 30. One shuffle: rows of both sides meet once by pair and
    feature for the edges, once for the counts, both combined on the map side.
    """
    both = left.select(*pair, "feature", "value", F.lit(1).alias("l")).unionByName(right.select(*pair, "feature", "value", F.lit(0).alias("l"))).where("value IS NOT NULL")
    n_l, n_r = F.count_if(F.col("l") == 1), F.count_if(F.col("l") == 0)
    edges = both.groupBy(*pair, "feature").agg((F.min("value") - 1e-9).alias("lo"), (F.max("value") + 1e-9).alias("hi"), n_l.alias("n_l"), n_r.alias("n_r"))
    edges = edges.where((F.col("n_l") >= least) & (F.col("n_r") >= least)).withColumn("bins", F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("n_l") / 5))).cast("long"))
    at = F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")))
    counts = both.join(edges, [*pair, "feature"]).groupBy(*pair, "feature", "lo", "hi", "bins", "n_l", "n_r", at.alias("bin")).agg(n_l.alias("c_l"), n_r.alias("c_r"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    # empty bins hold the same small mass on both sides: their number is enough
    p, q = F.col("c_l") / (F.col("n_l") * width) + 1e-10, F.col("c_r") / (F.col("n_r") * width) + 1e-10
    sums = counts.withColumn("p", p).withColumn("q", q).groupBy(*pair, "feature", "bins").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count(F.lit(1)).alias("used"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("s"))
    rest = (F.col("bins") - F.col("used")) * 1e-10
    sp, sq = F.col("sp") + rest, F.col("sq") + rest
    kl = F.col("s") / sp + F.log(sq / sp)
    return sums.withColumn("kl", kl).groupBy(*pair).agg(F.avg("kl").alias("kl"), F.count(F.lit(1)).alias("n_features"))


def nearest_counterfactual(scores: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """baseline, candidate, kl, n_candidates: the candidate of least divergence, ties to the smaller id."""
    best = scores.groupBy(baseline).agg(F.min(F.struct("kl", candidate)).alias("b"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select(baseline, F.col(f"b.{candidate}").alias(candidate), F.round("b.kl", 6).alias("kl"), "n_candidates")


def margins(df: DataFrame, key: Cols, x: str, factor: float = 0.75) -> DataFrame:
    return df.groupBy(*key).agg(F.round(factor * F.stddev_pop(x), 6).alias("margin"))


def describe_window(df: DataFrame, key: Cols, seq: str, x: str, tolerance: float = 0.05) -> DataFrame:
    """first, last, lo, hi and the trend in words."""
    agg = df.where(F.col(x).isNotNull()).groupBy(*key).agg(F.min_by(x, seq).alias("first"), F.max_by(x, seq).alias("last"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    span, move = F.col("hi") - F.col("lo"), F.col("last") - F.col("first")
    trend = F.when(span <= tolerance * F.greatest(F.abs("first"), F.lit(1e-9)), "stable").when(move >= 0.5 * span, "increasing").when(move <= -0.5 * span, "decreasing").otherwise("fluctuating")
    return agg.withColumn("trend", trend)


def episode_metadata(df: DataFrame, key: Cols, seq: str, ts: str) -> DataFrame:
    """n_samples, first and last valid timestamp, duration."""
    there = F.when(F.col(ts).isNotNull(), F.col(seq))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_samples"), F.min_by(ts, there).alias("first_ts"), F.max_by(ts, there).alias("last_ts")).withColumn("duration", F.col("last_ts") - F.col("first_ts"))


# report tables


def mean_and_error(df: DataFrame, key: Cols, x: str) -> DataFrame:
    return df.groupBy(*key).agg(F.avg(x).alias("mean"), F.count(x).alias("n"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("stderr"))


def quantiles(df: DataFrame, key: Cols, x: str, shares: Sequence[float], bins: int = 1024) -> DataFrame:
    """key and q, an array: exact quantiles with linear interpolation, of the values that are not null.

    Counts over equal ranges of each group's values tell which ranges hold the wanted ranks; only their rows are counted by
    value and put in order. So what a group brings together is a bin's distinct values, not its own. Null keys are a group.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.struct(F.lit(1).alias("all"), *key).alias("__k"), F.col(x).cast("double").alias("__x"))
    ends = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))).otherwise(0)
    placed = rows.join(ends, "__k").withColumn("__bin", at)
    place = lambda q: (F.col("__n") - 1) * q
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in shares for f in (F.floor, F.ceil)]))
    held = lambda upto, n: F.filter("__ranks", lambda r: (r >= F.col(upto) - F.col(n)) & (r < F.col(upto)))
    order = lambda by: Window.partitionBy("__k").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy("__k", "__n", "__bin").agg(F.count(F.lit(1)).alias("__c")).withColumn("__ranks", ranks).withColumn("__upto", F.sum("__c").over(order("__bin")))
    chosen = counts.where(F.size(held("__upto", "__c")) > 0).select("__k", "__bin", "__ranks", (F.col("__upto") - F.col("__c")).alias("__before"))
    inside = placed.join(chosen, ["__k", "__bin"]).groupBy("__k", "__n", "__bin", "__ranks", "__before", "__x").agg(F.count(F.lit(1)).alias("__c"))
    by_value = Window.partitionBy("__k", "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__upto", F.col("__before") + F.sum("__c").over(by_value))
    values = inside.select("__k", "__n", "__x", F.explode(held("__upto", "__c")).alias("__rank")).groupBy("__k", "__n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__v"))
    value = lambda r: F.element_at("__v", r.cast("long"))
    between = lambda q: value(F.floor(place(q))) + (value(F.ceil(place(q))) - value(F.floor(place(q)))) * (place(q) - F.floor(place(q)))
    return values.select(*[F.col(f"__k.{k}").alias(k) for k in key], F.array(*[between(q) for q in shares]).alias("q"))


def box_stats(df: DataFrame, key: Cols, x: str) -> DataFrame:
    """Quartiles and the values furthest out within 1.5 interquartile ranges."""
    q = quantiles(df, key, x, (0.25, 0.5, 0.75))
    q = q.select(*key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    near = df.join(F.broadcast(q) if not key else q, list(key)).where(F.col(x).between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return near.groupBy(*key, "q1", "median", "q3").agg(F.min(x).alias("low"), F.max(x).alias("high"))


def model_pivot(df: DataFrame, key: Cols, model: str, score: str, models: Sequence[str]) -> DataFrame:
    """Wide means per model, n over all of them and the mean of the models' means; null keys are groups of their own. One aggregation."""
    of = [F.avg(F.when(F.col(model) == m, F.col(score))).alias(f"__{m}") for m in models]
    wide = df.groupBy(*key).agg(*of, F.count(score).alias("n"))
    there = F.array_compact(F.array(*[F.col(f"`__{m}`") for m in models]))
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return wide.select(*key, *[F.round(F.col(f"`__{m}`"), 3).alias(m) for m in models], F.round(mean, 3).alias("mean_across_models"), "n")


def grouping_report(df: DataFrame, sets: Sequence[Cols], score: str) -> DataFrame:
    """Means and counts for several groupings in one pass (grouping sets)."""
    every = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.avg(score).alias("mean"), F.count(score).alias("n"), F.grouping_id().alias("set_id"))


def equal_width_histogram(df: DataFrame, x: str, bins: int = 15, key: Cols = ()) -> DataFrame:
    """Counts of equal bins between the least and the greatest value; the last bin is closed."""
    ends = df.groupBy(*key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = df.join(ends, list(key)) if key else df.join(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return rows.where(F.col(x).isNotNull()).groupBy(*key, at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trend(df: DataFrame, key: Cols, y: str, x: str, least: int = 5) -> DataFrame:
    return df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")).where(F.col("n") >= least)


def letter_balance(df: DataFrame, key: Cols, answer: str) -> DataFrame:
    """Share of T at each place of the answers of the key's modal length."""
    sized = df.where(F.col(answer).rlike("^[TF]+$")).withColumn("len", F.length(answer))
    usual = modal(sized, key, "len").select(*key, "len")
    each = sized.join(usual, [*key, "len"]).select(*key, F.posexplode(F.filter(F.split(answer, ""), lambda c: c != "")).alias("place", "letter"))
    return each.groupBy(*key, "place").agg((100 * F.avg((F.col("letter") == "T").cast("double"))).alias("percent_true"), F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts per pair and their share of the outer group, in percent."""
    n = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def within_budget(df: DataFrame, key: Cols, order: Cols, cost: str, limit: float) -> DataFrame:
    """Rows up to and including the one that brings the running cost to the limit."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__spent", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("__spent") < limit).drop("__spent")


def failure_rates(df: DataFrame, cell: Cols, baseline: Name, counterfactual: Name) -> DataFrame:
    """Pairs, baseline successes, counterfactual failures among them and their rate."""
    ok, bad = F.count_if(col(baseline)), F.count_if(col(baseline) & ~col(counterfactual))
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("pairs"), ok.alias("successes"), bad.alias("failures")).withColumn("rate", F.col("failures") / F.nullif("successes", F.lit(0)))


def profile(df: DataFrame, features: Cols, key: Cols = ()) -> DataFrame:
    """Per feature: n, lo, hi, mean, sd, greatest absolute value."""
    long = melt(df, key, features)
    return long.groupBy(*key, "feature").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.max(F.abs("value")).alias("max_abs"))


def any_of(conditions: Sequence[Column]) -> Column:
    """Existential over axes: unknown axes are skipped, none known is false."""
    there = F.array_compact(F.array(*conditions))
    return F.exists(there, lambda x: x)


def all_of(conditions: Sequence[Column]) -> Column:
    """Universal over axes: unknown axes are skipped, none known is true."""
    return F.forall(F.array_compact(F.array(*conditions)), lambda x: x)


def inferred_task(df: DataFrame, key: Cols, phase: str, fault: str, by_fault: dict[str, Sequence[int]]) -> DataFrame:
    """key and task: nine phases and more are pick_and_place, else the task whose faults hold the episode's, else unknown."""
    agg = df.groupBy(*key).agg(F.max(F.col(phase).cast("string").try_cast("int")).alias("__p"), F.max(fault).alias("__f"))
    task = F.when(F.col("__p") >= 9, "pick_and_place")
    for name, faults in by_fault.items():
        task = task.when(F.col("__f").isin(*faults), name)
    return agg.select(*key, task.otherwise("unknown").alias("task"))


def largest(df: DataFrame, key: Cols, x: str, out: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max(x).alias(out))


def escalates(df: DataFrame, key: Cols, safety: str) -> DataFrame:
    """Whether any known safety mode is not normal; values that are no number are skipped."""
    mode = F.col(safety).cast("string").try_cast("int")
    return df.groupBy(*key).agg(F.coalesce(F.bool_or(mode != 1), F.lit(False)).alias("escalates"))


def prompt_cost(df: DataFrame, key: Cols, prompt: str, model: Column, most_out: int, factor: float = 1.0) -> DataFrame:
    """Before a run: prompts, estimated tokens in, most tokens out and dollars; model is a struct of prices per million."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(prompt) / 4))
    rows = df.withColumn("__t", tokens).withColumn("__d", (tokens * model["input"] + most_out * model["output"]) / 1e6 * factor)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("__t").alias("tokens_in"), (F.count(F.lit(1)) * most_out).alias("tokens_out"), F.round(F.sum("__d"), 6).alias("dollars"))


def wide(long: DataFrame, key: Cols, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long rows as one column per name, means of repeats; names are given, so nothing is read to plan it."""
    return long.groupBy(*key).agg(*[F.avg(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def most_common(df: DataFrame, key: Cols, x: str) -> DataFrame:
    """Counts of each value, falling, with its place; ties by value."""
    counts = df.groupBy(*key, x).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), x)))


def episodes_of(provenance: Name) -> Column:
    """Every episode a provenance struct names: episode, episode_a, episode_b, then those of the list `episodes`, blanks left out."""
    p = col(provenance)
    singles = F.array(p["episode"], p["episode_a"], p["episode_b"])
    every = F.concat(singles, F.coalesce(F.transform(p["episodes"], lambda e: e["episode"]), F.array().cast("array<string>")))
    return F.filter(every, lambda e: e.isNotNull() & (e != ""))


def greedy_schedule(candidates: DataFrame, key: Cols, order: str, start: str, length: str, gap: int = 5) -> DataFrame:
    """Of each key's candidates, in order, those that begin `gap` after the end of the last one taken; few per key by design (events of an episode)."""
    item = F.struct(F.col(order).alias("o"), F.col(start).cast("long").alias("s"), F.col(length).cast("long").alias("n"))
    listed = candidates.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("x"))
    none = F.struct(F.lit(-(1 << 40)).cast("long").alias("free"), F.filter("x", lambda c: F.lit(False)).alias("taken"))
    step = lambda acc, c: F.when(c["s"] >= acc["free"], F.struct((c["s"] + c["n"] + gap).alias("free"), F.concat(acc["taken"], F.array(c)).alias("taken"))).otherwise(acc)
    out = listed.select(*key, F.explode(F.aggregate("x", none, step)["taken"]).alias("c"))
    return out.select(*key, F.col("c.o").alias(order), F.col("c.s").alias(start), F.col("c.n").alias(length))


def run_totals(summaries: DataFrame, counts: Cols = ("completed", "failed", "skipped")) -> DataFrame:
    """Sums over runs' summaries; missing counts are 0."""
    return summaries.agg(*[F.coalesce(F.sum(F.coalesce(F.col(c).try_cast("long"), F.lit(0))), F.lit(0)).alias(c) for c in counts])
