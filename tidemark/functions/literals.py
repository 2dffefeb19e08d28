"""Texts of nested data as programs print it ({'a': [1, (2.5, None)], "b": True}): read into VARIANT, patched by key, written back.

A text is cut into tokens (strings, marks, words) by one pattern; everything else is higher-order functions over the tokens of
one row, so nothing is shuffled and no Python is run. Dictionaries, lists, tuples, strings with escapes, numbers, True, False
and None are read; keys that are no strings become their text. A text with anything else, that doesn't close, or that names a
key twice, is null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.noise import let
from tidemark.functions.values import Name, col, safe_int

_TOKEN = r"""(?s)'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[\[\](){},:]|[^\s'"\[\](){},:]+"""
_PIECE = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\.|[^\\]+"
#: Escapes that mean the same in JSON, and those that don't.
_SAME = ("\\\\", "\\n", "\\t", "\\r", "\\b", "\\f", '\\"')
_OTHER = {"\\'": "'", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": ""}


def tokens(text: Name) -> Column:
    """The tokens of a text; null if there is anything between them but white space."""
    t = col(text)
    return F.when(F.trim(F.regexp_replace(t, _TOKEN, "")).rlike(r"^\s*$"), F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)))


def _is_string(t: Column) -> Column:
    return t.startswith("'") | t.startswith('"')


def _json_string(t: Column) -> Column:
    """A quoted token as a JSON string."""

    def piece(p: Column) -> Column:
        hexed = F.right(p, F.lit(2))
        octal = F.lpad(F.lower(F.conv(F.substr(p, F.lit(2)), 8, 16)), 4, "0")
        out = F.when(~p.startswith("\\"), F.replace(F.replace(F.replace(F.replace(p, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")))
        out = out.when(p.rlike(r"^\\x..$"), F.concat(F.lit("\\u00"), hexed)).when(p.rlike(r"^\\u....$"), p).when(p.rlike(r"^\\[0-7]"), F.concat(F.lit("\\u"), octal)).when(p.isin(*_SAME), p)
        code = F.conv(F.substr(p, F.lit(3)), 16, 10).cast("long") - 0x10000
        surrogate = lambda x: F.concat(F.lit("\\u"), F.lower(F.hex(x)))
        out = out.when(p.rlike(r"^\\U"), F.when(code < 0, F.concat(F.lit("\\u"), F.right(p, F.lit(4)))).otherwise(F.concat(surrogate(code / 1024 + 0xD800), surrogate(F.lit(0xDC00) + code % 1024))))
        for k, v in _OTHER.items():
            out = out.when(p == k, F.lit(v))
        return out.otherwise(F.concat(F.lit("\\"), p))  # an unknown escape keeps its backslash

    body = F.substr(t, F.lit(2), F.length(t) - 2)
    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0)), piece), ""), F.lit('"'))


def _number(t: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(t, r"(?<=\d)_(?=\d)", ""), r"^\+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^(-?)\.", r"$10."), r"\.(?=$|[eE])", ".0")


def _json(ts: Column) -> Column:
    """The tokens as JSON."""

    def one(t: Column, i: Column) -> Column:
        before, after = F.get(ts, i - 1), F.get(ts, i + 1)
        grouped = ((t == "(") & (F.get(ts, i + 2) == ")") & ~after.isin("(", ",")) | ((t == ")") & (F.get(ts, i - 2) == "(") & (before != ","))
        word = F.when(t == "True", "true").when(t == "False", "false").when(t == "None", "null").otherwise(_number(t))
        key = F.when(F.coalesce(after, F.lit("")) == ":", F.concat(F.lit('"'), t, F.lit('"')))
        last = (t == ",") & after.isin(")", "]", "}")
        out = F.when(_is_string(t), _json_string(t)).when(F.coalesce(grouped | last, F.lit(False)), F.lit("")).when(t == "(", F.lit("[")).when(t == ")", F.lit("]"))
        return out.when(t.rlike(r"^[\[\]{},:]$"), t).otherwise(F.coalesce(key, word))

    return F.array_join(F.transform(ts, one), "")


def literal_json(text: Name) -> Column:
    """The text as JSON, unchecked; null if it has no tokens."""
    return let(tokens(text), _json)


def literal_variant(text: Name) -> Column:
    """The text as VARIANT, null if it can't be read."""
    return F.try_parse_json(literal_json(text))


def _quoted(t: Column) -> Column:
    """A string token as it is printed: single quotes unless it has some and no double ones."""
    plain = F.get_json_object(F.concat(F.lit("["), _json_string(t), F.lit("]")), "$[0]")
    escaped = plain
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = F.contains(plain, F.lit("'")) & ~F.contains(plain, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def literal_entries(text: Name) -> Column:
    """(key, value) of a dictionary's own entries in order, as they are printed (numbers as they are spelled). Null for other texts."""

    def entries(ts: Column) -> Column:
        deep = lambda s, t: s["d"] + F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.array().cast("array<struct<n:int,t:string>>").alias("out"))

        def step(s: Column, t: Column) -> Column:
            outer = (s["d"] == 1) & ((t == ",") | (t == "}")) | (s["d"] == 0)
            shown = F.when(_is_string(t), _quoted(t)).when(t == ",", ", ").when(t == ":", ": ").otherwise(t)
            kept = F.when(outer, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["n"].alias("n"), shown.alias("t")))))
            return F.struct(deep(s, t).alias("d"), (s["n"] + F.when((s["d"] == 1) & (t == ","), 1).otherwise(0)).alias("n"), kept.alias("out"))

        def grouped(s: Column) -> Column:
            parts = F.transform(F.array_distinct(F.transform(s["out"], lambda x: x["n"])), lambda n: F.transform(F.filter(s["out"], lambda x: x["n"] == n), lambda x: x["t"]))
            value = lambda p: F.regexp_replace(F.regexp_replace(F.array_join(F.slice(p, F.lit(3), F.size(p)), ""), r", ([\]}])", "$1"), r", \)", ",)")
            return F.transform(parts, lambda p: F.struct(p[0].alias("key"), value(p).alias("value")))

        closed = (F.element_at(ts, 1) == "{") & (F.element_at(ts, -1) == "}")
        return F.when((F.size(ts) > 1) & closed, let(F.aggregate(ts, state, step), grouped))

    return F.when(literal_variant(text).isNotNull(), let(tokens(text), entries))


def literal_text(entries: Column) -> Column:
    """The printed form of entries."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "), F.lit("}"))


def literal_patch(text: Name, changes: Mapping[str, Column], add: bool = True) -> Column:
    """The text with some keys set (values as they are printed). Keys that are not there are added at the end, or with add=False left out.

    A text that can't be read counts as an empty dictionary when keys are added; otherwise it, a blank one and an empty one stay as they are.
    """
    def patched(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        new = lambda e: F.coalesce(*[F.when(e["key"] == f"'{k}'", v) for k, v in changes.items()], e["value"])
        out = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), new(e).alias("value")))
        if add:
            more = F.array(*[F.struct(F.lit(f"'{k}'").alias("key"), v.alias("value")) for k, v in changes.items()])
            out = F.concat(out, F.filter(more, lambda m: ~F.array_contains(keys, m["key"])))
        return literal_text(out)

    if add:
        return let(F.coalesce(literal_entries(text), F.array().cast("array<struct<key:string,value:string>>")), patched)
    return let(literal_entries(text), lambda e: F.when(F.size(e) > 0, patched(e)).otherwise(col(text)))


#: Fields of an episode's metadata.
TEXT_FIELDS = ("weight_of_box", "shape_of_box", "position_of_box", "gripper_model", "payload_mass_configured", "correct_payload_mass", "payload_cog_configured", "correct_payload_cog", "tcp_offset_configured", "correct_tcp_offset", "tcp_orientation_configured", "offset", "link_affected", "object_description", "damage_description", "material_description", "description_of_experiment")


def field(data: Column, name: str) -> Column:
    """A field of a VARIANT dictionary as text: strings bare, others as JSON; null if it is missing or None."""
    return F.try_variant_get(data, f"$.{name}", "string")


def episode_metadata(text: Name, fault_text: Name, robot: str = "ur3") -> Column:
    """Struct of an episode's metadata from its literal, with the fault id of the other literal where it has none, and defaults.

    condition: the one given, unless it is unknown: then fault or normal by whether there is a fault id.
    """

    def fields(m: Column) -> Column:
        fault = F.coalesce(safe_int(field(m, "fault_id")), safe_int(field(literal_variant(fault_text), "fault_id")))
        given = F.coalesce(field(m, "condition"), F.lit("unknown"))
        return F.struct(
            F.coalesce(field(m, "robot_model"), F.lit(robot)).alias("robot_type"), F.coalesce(field(m, "task"), F.lit("unknown")).alias("task"),
            F.when(given != "unknown", given).when(fault.isNotNull(), "fault").otherwise("normal").alias("condition"), fault.alias("fault_id"), *[field(m, n).alias(n) for n in TEXT_FIELDS],
        )

    return let(literal_variant(text), fields)
