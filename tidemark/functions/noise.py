"""Noise on finished items: encoded series inside their contexts and options are taken apart, walked, and put together again.

An item is one row and its series are as long as a prompt, so all of it is expressions over that row: no shuffle, and items
of any number are spread as they lie. Every draw is a digest of the item's seed, the series, the feature and the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.draws import digest, normal
from tidemark.functions.values import Name, col, decimal_places, is_integer_text

#: The time before a row's features, one feature, and what joins the rows of an option.
PREFIX = r"^(t=-?\d+(?:\.\d+)?\s*:\s*)?(.*)$"
FEATURE = r"\s*([^=,\s]+)\s*=\s*(-?[^,]+?)\s*(?:,|$)"
JOINED = " | "


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn refers to it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def parsed_row(line: Name) -> Column:
    """(prefix, names, values): an encoded row's time and its features in order; of a name that repeats, the last value stands at its first place."""
    text = F.coalesce(F.regexp_extract(col(line), PREFIX, 2), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(FEATURE), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(FEATURE), F.lit(2)).alias("v"))
    names = lambda p: F.array_distinct(F.transform(p, lambda x: x["k"]))
    last = lambda p, k: F.element_at(F.filter(p, lambda x: x["k"] == k), -1)["v"]
    return F.struct(F.regexp_extract(col(line), PREFIX, 1).alias("prefix"), let(pairs, lambda p: F.map_from_arrays(names(p), F.transform(names(p), lambda k: last(p, k)))).alias("features"))


def uuid_seed(item: Name) -> Column:
    """The low 32 bits of a UUID; of other texts, 32 bits of their digest."""
    plain = F.regexp_replace(F.lower(F.trim(col(item))), r"[-{}]|^urn:uuid:", "")
    bits = F.when(plain.rlike("^[0-9a-f]{32}$"), F.right(plain, F.lit(8))).otherwise(F.left(digest("seed", item), F.lit(8)))
    return F.conv(bits, 16, 10).cast("long")


def _walk(values: Column, sigma: float, seed: Column, series: Column, name: Column) -> Column:
    """The first value and running sums of normal steps from it, as texts of the column's most decimals."""
    steps = F.transform(values, lambda _, i: F.when(i > 0, normal(0.0, sigma, "noise", seed, series, name, i)).otherwise(values[0].cast("double")))
    digits = F.array_max(F.transform(values, decimal_places))
    shown = lambda x: F.when(digits > 0, F.call_function("printf", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), x)).otherwise(F.bround(x, 0).cast("long").cast("string"))
    return let(steps, lambda s: F.transform(s, lambda _, i: shown(F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))))


def noisy_rows(lines: Name, sigma: float, seed: Column, series: Column) -> Column:
    """Encoded rows, each float feature of which becomes a walk from its first value.

    Features that a row lacks, that are not numbers or not finite somewhere, and those that are whole numbers everywhere stay
    as they are; rows without features, null and empty lists come back untouched.
    """
    rows = F.transform(col(lines), parsed_row)

    def noised(rows: Column) -> Column:
        names = F.map_keys(rows[0]["features"])

        def walked(name: Column) -> Column:
            values = F.transform(rows, lambda r: F.try_element_at(r["features"], name))
            number = lambda v: v.try_cast("double")
            fit = lambda v: F.forall(v, lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")) & x.rlike(r"^\s*[-+.\d]"), F.lit(False))) & ~F.forall(v, is_integer_text)
            return let(values, lambda v: F.when(fit(v), _walk(v, sigma, seed, series, name)))

        walks = F.map_from_arrays(names, F.transform(names, walked))
        row = lambda w: lambda r, i: F.concat(r["prefix"], F.array_join(F.transform(F.map_entries(r["features"]), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.get(F.try_element_at(w, e["key"]), i), e["value"]))), ", "))
        return let(walks, lambda w: F.transform(rows, row(w)))

    usable = (F.size(col(lines)) > 0) & F.forall(col(lines), lambda x: x.isNotNull())
    return F.when(usable, let(rows, lambda r: F.when(F.size(r[0]["features"]) > 0, noised(r)).otherwise(col(lines)))).otherwise(col(lines))


def is_encoded_option(text: Name, least: int = 3) -> Column:
    """Whether an option's first row has features enough not to be a statement."""
    return F.coalesce(F.size(parsed_row(F.split_part(col(text), F.lit(JOINED), F.lit(1)))["features"]) >= least, F.lit(False))


def noisy_option(text: Name, sigma: float, seed: Column, series: Column) -> Column:
    return F.array_join(noisy_rows(F.split(col(text), r" \| "), sigma, seed, series), JOINED)


def noise_items(items: DataFrame, sigma: float, item: str = "id", context: str = "context", options: str = "options") -> DataFrame:
    """items with noise in context.time_series, context.series_a and series_b, and in options that are encoded rows; adds `noise` (applied, sigma, rng_seed).

    context: a struct with any of these fields (time_series: array of rows); options: a map of texts. Other fields stay. A
    sigma of 0 repeats each float feature's first value.
    """
    seed = uuid_seed(item)
    out = items
    shape = items.schema[context].dataType if context in items.columns else None
    if isinstance(shape, T.StructType):
        c = F.col(context)
        paths = [("time_series",)] if _is_series(shape, "time_series") else []
        paths += [(s, "time_series") for s in ("series_a", "series_b") if s in shape.names and isinstance(shape[s].dataType, T.StructType) and _is_series(shape[s].dataType, "time_series")]
        for path in paths:
            own = F.col(".".join([context, *path]))
            c = c.withField(".".join(path), noisy_rows(own, sigma, seed, F.lit(".".join(path))))
        out = out.withColumn(context, c)
    if options in items.columns:
        out = out.withColumn(options, F.transform_values(options, lambda k, v: F.when(is_encoded_option(v), noisy_option(v, sigma, seed, F.concat(F.lit("options."), k))).otherwise(v)))
    return out.withColumn("noise", F.struct(F.lit(True).alias("applied"), F.lit(float(sigma)).alias("sigma"), seed.alias("rng_seed")))


def _is_series(shape: T.StructType, name: str) -> bool:
    return name in shape.names and isinstance(shape[name].dataType, T.ArrayType) and isinstance(shape[name].dataType.elementType, T.StringType)
