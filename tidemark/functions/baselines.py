"""Answers without a model: which strategy an item takes, straight-line forecasts, seeded random picks; and new scores of stored replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.draws import digest, draw, shuffled
from tidemark.functions.values import Name, col

Cols = Sequence[str]


def _letters(text: Column) -> Column:
    return F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))


def list_answer(answer: Name) -> Column:
    """The numbers of "[1.0, 2.0]" as an array; null for anything else."""
    body = F.regexp_extract(col(answer), r"^\s*\[(.*)\]\s*$", 1)
    numbers = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.trim(body) != "") & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def strategy(level: Name, template: Name, answer: Name, options: Name) -> Column:
    """regression, ranking, tfft, mcq, numeric or skip. options: the letters, an array, null or empty for none."""
    text, keys = col(answer), F.coalesce(col(options), F.array().cast("array<string>"))
    forecast = ((col(level) == 1) & (col(template) == 7)) | (col(level).isin(2, 3) & (col(template) == 5) & list_answer(answer).isNotNull())
    ranking = (F.length(text) == F.size(keys)) & (F.array_distinct(_letters(text)) == F.array_sort(keys))
    of_options = F.when(ranking, "ranking").when(text.rlike("^[TF]{2,}$"), "tfft").otherwise("mcq")
    return F.when(forecast, "regression").when((F.size(keys) > 0) & text.isNotNull(), of_options).when(text.try_cast("double").isNotNull(), "numeric").otherwise("skip")


def line_forecast(points: DataFrame, key: Cols, t: str, x: str, target: Name) -> DataFrame:
    """key and forecast: a least-squares line through (t, x) at target (an expression over key columns or a literal); under two points the last value.

    Sums are combined before they are shuffled.
    """
    there = F.col(x).isNotNull() & F.col(t).isNotNull()
    agg = points.where(there).groupBy(*key).agg(F.regr_slope(x, t).alias("__a"), F.regr_intercept(x, t).alias("__b"), F.count(F.lit(1)).alias("__n"), F.max_by(x, t).alias("__last"), F.max(t).alias("__end"))
    agg = agg.withColumn("__to", col(target) if isinstance(target, Column) else F.col(target))
    return agg.select(*key, F.when((F.col("__n") >= 2) & F.col("__a").isNotNull(), F.col("__a") * F.col("__to") + F.col("__b")).otherwise(F.col("__last")).alias("forecast"))


#: The time and one number of an encoded row, and the horizon in a question.
ROW_TIME, ROW_NUMBER, HORIZON = r"^t=(-?\d+(?:\.\d+)?)\s*:", r"([A-Za-z]\w*)=(-?\d+(?:\.\d+)?)", r"(?i)T\+(\d+)\s*ms"


def acronym_of(signal: Column, acronyms: Column) -> Column:
    """The short name that stands for a signal in an item's rows (short -> long); without one the signal itself."""
    return F.coalesce(F.get(F.map_keys(F.map_filter(acronyms, lambda _, v: v == signal)), F.lit(0)), signal)


def row_value(line: Name, key: Column) -> Column:
    """The first number an encoded row gives for a short name."""
    body = F.regexp_replace(col(line), ROW_TIME + r"\s*", "")
    names, numbers = (F.regexp_extract_all(body, F.lit(ROW_NUMBER), F.lit(i)) for i in (1, 2))
    return F.get(numbers, F.array_position(names, key).cast("int") - 1).try_cast("double")


def vector_forecast(items: DataFrame, key: Cols, rows: str, acronyms: Name, signal: Name, answer: Name, question: Name) -> DataFrame:
    """key and forecast, an array: a least-squares line per axis of the signal through an item's own rows, at the question's horizon after the last timed row.

    rows: an array of encoded rows; axes are as many as the gold answer lists. An axis of under two points takes its last
    value, or 0; of one time only, the mean. Null where the answer is no list, the question has no horizon, or under two
    rows have a time. An item's table is taken apart once, all axes of a row together, and fitted in one aggregation.
    """
    axes = F.size(list_answer(answer))
    ahead = F.regexp_extract(col(question), HORIZON, 1).try_cast("double")
    short = F.transform(F.sequence(F.lit(0), F.greatest(axes, F.lit(1)) - 1), lambda i: acronym_of(F.concat(col(signal), F.lit("_"), i.cast("string")), col(acronyms)))
    asked = items.select(*key, axes.alias("__axes"), ahead.alias("__ahead"), short.alias("__short"), F.posexplode_outer(rows).alias("__at", "__line"))
    timed = asked.withColumn("__t", F.regexp_extract("__line", ROW_TIME, 1).try_cast("double"))
    points = timed.withColumn("__v", F.transform("__short", lambda k: row_value("__line", k)))
    each = points.select(*key, "__axes", "__ahead", "__at", "__t", F.posexplode_outer("__v").alias("__axis", "__x"))
    known = F.col("__x").isNotNull() & F.col("__t").isNotNull()
    x, t = F.when(known, F.col("__x")), F.when(known, F.col("__t"))
    fit = each.groupBy(*key, "__axes", "__ahead", "__axis").agg(
        F.regr_slope(x, t).alias("a"), F.regr_intercept(x, t).alias("b"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.max_by(x, F.when(known, F.col("__at"))).alias("last"),
        F.count("__t").alias("timed"), F.max_by("__t", F.when(F.col("__t").isNotNull(), F.col("__at"))).alias("end"),
    )
    value = F.when(F.col("n") >= 2, F.coalesce(F.col("a") * (F.col("end") + F.col("__ahead")) + F.col("b"), F.col("mean"))).otherwise(F.coalesce("last", F.lit(0.0)))
    out = fit.groupBy(*key, "__axes", "__ahead").agg(F.array_sort(F.collect_list(F.struct("__axis", F.round(value, 6).alias("y")))).alias("__f"), F.max("timed").alias("__timed"))
    usable = (F.col("__axes") > 0) & F.col("__ahead").isNotNull() & (F.col("__timed") >= 2)
    return out.select(*key, F.when(usable, F.transform("__f", lambda f: f["y"])).alias("forecast"))


def random_choice(options: Name, item: Name) -> Column:
    keys = col(options)
    return F.when(F.size(keys) > 0, F.get(F.array_sort(keys), draw(F.size(keys), "mcq", item).cast("int")))


def random_flags(n: Name, item: Name) -> Column:
    """T and F, n of them, by digits of a digest; at most 32."""
    digits = F.translate(F.substring(digest("tfft", item), 1, 32), "0123456789abcdef", "FFFFFFFFTTTTTTTT")
    return F.substr(digits, F.lit(1), col(n))


def random_ranking(options: Name, item: Name) -> Column:
    return F.array_join(shuffled(col(options), "ranking", item), "")


def random_number(upper: Name, fallback: Name, item: Name) -> Column:
    """A whole number under the episode's length, or the context's where that is unknown."""
    known = F.when(col(upper) > 0, col(upper)).otherwise(F.greatest(F.lit(1), F.coalesce(col(fallback), F.lit(1))))
    return draw(known, "numeric", item)


def answer_type(answer: Name) -> Column:
    """Type of an answer for charts: multi_select, tensor, ranking or numerical."""
    s = F.upper(F.trim(col(answer)))
    return F.when(s.rlike("^[TF]{2,}$"), "multi_select").when(s.startswith("[") & s.endswith("]"), "tensor").when(s.rlike("^[ABCD]{2,}$"), "ranking").otherwise("numerical")


def rescored(replies: DataFrame, reply: str, truth: str, new_format: Column, judged: str) -> DataFrame:
    """Replies with answer_format and score made anew: free text takes its stored verdict (null without one), all else the eval profile."""
    own = replies.withColumn("answer_format", new_format)
    return own.withColumn("score", F.when(F.col("answer_format") == "free_form", F.col(judged)).otherwise(scoring.evaluate(reply, truth, "answer_format")))


def retagged(replies: DataFrame, old: str, new: Column, old_type: str, new_type: Column, reply: str, truth: str) -> DataFrame:
    """Only the replies whose format or question type changes; their score is made anew where the format changes, else kept."""
    own = replies.withColumn("new_format", new).withColumn("new_type", new_type)
    changed = own.where(~F.col(old).eqNullSafe(F.col("new_format")) | ~F.col(old_type).eqNullSafe(F.col("new_type")))
    score = scoring.evaluate(reply, truth, "new_format")
    return changed.withColumn("new_score", F.when(F.col(old).eqNullSafe(F.col("new_format")), F.col("score")).otherwise(score))


#: Display order of formats; others follow by name.
FORMAT_ORDER = ("multiple_choice_single_select", "multiple_choice_multi_select", "numerical", "ranking", "tensor", "free_form")


def format_rank(answer_format: Name, order: Sequence[str] = FORMAT_ORDER) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), col(answer_format)), F.lit(0)), F.lit(999)).cast("int")


def alias_of(model: Name, aliases: dict[str, str]) -> Column:
    """A model's usual name: lower-cased, spaces and slashes cut to the last part, then the alias table."""
    bare = F.lower(F.element_at(F.split(F.trim(col(model)), "/"), -1))
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv]) if aliases else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, bare), bare)
