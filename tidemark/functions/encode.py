"""Compact text forms of time series, and their parsers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import Name, col, plain_number


def acronyms(names: Sequence[str], rounds: int = 10) -> dict[str, str]:
    """Initials of the words of each name and its trailing number; clashing names take ever more letters of their last words.

    Works on column names when the plan is made, never on rows.
    """

    def short(name: str, extra: int) -> str:
        words = [w for w in name.split("_") if w]
        tail = words.pop() if len(words) > 1 and words[-1].isdigit() else ""
        return "".join(w[0] for w in words[:-1]) + (words[-1][: 1 + extra] if words else "") + tail

    extra = dict.fromkeys(names, 0)
    for _ in range(rounds):
        made = {n: short(n, extra[n]) for n in names}
        clash = [n for n in names if list(made.values()).count(made[n]) > 1]
        if not clash:
            break
        for n in clash:
            extra[n] += 1
    return {n: short(n, extra[n]) for n in names}


def encode_step(ts: Name, features: Mapping[str, str], digits: int = 2) -> Column:
    """t=<ts>: a=v, b=v: features by full name, nulls left out."""
    parts = [F.concat(F.lit(f"{features[n]}="), plain_number(n, digits)) for n in sorted(features)]
    return F.concat(F.lit("t="), plain_number(ts, 0), F.lit(": "), F.concat_ws(", ", *parts))


def encode_series(df: DataFrame, key: Sequence[str], seq: str, ts: str, features: Sequence[str]) -> DataFrame:
    """key and series: one line per row, in order. A series is a prompt's window, so it is bounded by the window's length."""
    short = acronyms(features)
    lines = df.select(*key, F.struct(F.col(seq).alias("s"), encode_step(ts, short).alias("l")).alias("x"))
    out = lines.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return out.select(*key, F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("series"))


def decode_step(line: Name) -> Column:
    """Map of an encoded line's short names to texts."""
    return F.str_to_map(F.regexp_replace(col(line), "^t=[^:]*: ", ""), F.lit(", "), F.lit("="))


def looks_encoded(text: Name, least: int = 3) -> Column:
    first = F.element_at(F.split(col(text), "\n"), 1)
    return F.size(F.regexp_extract_all(first, F.lit(r"([A-Za-z]\w*=-?[\d.]+)"), F.lit(1))) >= least


def fill_template(template: Name, values: Mapping[str, Name]) -> Column:
    """Each {k} replaced literally; {K} by the capitalised value."""
    out = col(template)
    for k, v in values.items():
        v = F.coalesce(col(v).cast("string"), F.lit(""))
        out = F.replace(out, F.lit("{" + k + "}"), v)
        out = F.replace(out, F.lit("{" + k.capitalize() + "}"), F.concat(F.upper(F.substring(v, 1, 1)), F.substr(v, F.lit(2))))
    return out


def sentence(*clauses: Column) -> Column:
    """Optional clauses joined; a null one is left out."""
    return F.concat(F.concat_ws(", ", *clauses), F.lit("."))


def prompt(parts: Mapping[str, Column], hides: Column) -> Column:
    """Named parts, one per line, without those that `hides` lists and those that are null."""
    shown = [F.when(~F.array_contains(F.coalesce(hides, F.array().cast("array<string>")), k), v) for k, v in parts.items()]
    return F.concat_ws("\n", *shown)


def option_list(options: Name) -> Column:
    """A) text, by letter."""
    entries = F.array_sort(F.map_entries(col(options)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def encode_features(features: Name, timestamp: Name | None = None, hidden: Sequence[str] = ("fault_label", "timestamp_ms"), digits: int = 2) -> Column:
    """One row from a map of features, by name, nulls and hidden ones left out: "t=5: a=1, b=2.5", or without the time."""
    shown = F.array_sort(F.map_entries(F.map_filter(col(features), lambda k, v: v.isNotNull() & ~k.isin(*hidden))))
    body = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), plain_number(e["value"], digits))), ", ")
    return body if timestamp is None else F.concat(F.lit("t="), plain_number(timestamp, 0), F.lit(": "), body)


def encode_chunks(df: DataFrame, key: Sequence[str], seq: str, line: Column) -> DataFrame:
    """key and chunk: the lines of a chunk in order, joined by bars, for use in options. Bounded by the chunk's length."""
    out = df.select(*key, F.struct(F.col(seq).alias("s"), line.alias("l")).alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return out.select(*key, F.array_join(F.transform("x", lambda x: x["l"]), " | ").alias("chunk"))


def representative(features: Name, *parts: str) -> Column:
    """Of the features whose name contains one of parts the first by name that has a number, to three decimals."""
    named = lambda k: F.coalesce(*[F.when(k.contains(p), F.lit(True)) for p in parts], F.lit(False))
    found = F.array_sort(F.map_entries(F.map_filter(col(features), lambda k, v: named(k) & v.isNotNull())))
    return F.bround(F.try_element_at(found, F.lit(1))["value"].cast("decimal(30,9)"), 3).cast("double")


def event_values(x: Name, y: Name, n: Name, t: Name) -> Mapping[str, Column]:
    """Values an event's description may name: X before, Y at the end, their difference, the rate per row, length and time."""
    a, b = col(x), col(y)
    return {"X": plain_number(a), "Y": plain_number(b), "delta": plain_number(F.abs(b - a)), "rate": plain_number((b - a) / F.greatest(F.lit(1), col(n))), "L": col(n).cast("string"), "T": col(t).cast("string")}


def describe_event(template: Name, encoded: Column, derived: Mapping[str, Column]) -> Column:
    """An event's description filled from the parameters its token carries, else from the values derived from rows."""
    out = col(template)
    for name, value in derived.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.try_element_at(encoded, F.lit(name)), value, F.lit("")))
    return out
