"""Chat formatting with DataFrame functions only.

A template is plain data: control strings, the roles whose text is trained on, and the transitions of a finite-state
machine over roles. Each conversation becomes segments with loss flags, whose concatenation is the formatted string.

    begin  (turn_open role role_close text turn_close)*

Control strings inside roles and texts are escaped: a backslash goes in after their first character, and one more where
backslashes stand there already, so that unescaping gives back every string.

Defined cases: turns go by (turn, role, text), nulls first, and repeated rows are repeated turns; null role or text is
empty; a null conv_id is a conversation of its own; an empty table gives no rows; columns other than conv_id, turn, role
and text are not read. Turn order that the machine rejects is reported, not dropped. A conversation is one output
string, so its turns do meet in one task; documents of other conversations never do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTRUCT = {
    "begin": "<s>",
    "turn_open": "[INST]",
    "role_close": "[/INST]",
    "turn_close": "</s>",
    "loss_roles": ["assistant"],
    "transitions": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}
CONTROLS = ("begin", "turn_open", "role_close", "turn_close")
SEGMENTS = "array<struct<text string, loss boolean>>"


def check_template(template: dict) -> None:
    """Escaping is reversible if no control string holds the first character of one after its own first."""
    strings = [template[k] for k in CONTROLS]
    first = {s[:1] for s in strings}
    if any(len(s) < 2 for s in strings) or "\\" in first or any(c in s[1:] for s in strings for c in first) or len({*strings}) < len(strings):
        raise ValueError("control strings must be distinct, of two characters at least, with first characters that occur nowhere else in them")


def _escape_pattern(template: dict, escaped: bool) -> str:
    each = [rf"(?<={re.escape(s[0])}){chr(92) * 2 if escaped else ''}(?=\\*{re.escape(s[1:])})" for s in (template[k] for k in CONTROLS)]
    return "|".join(each)


def escape(text: Column, template: dict = INSTRUCT) -> Column:
    return F.regexp_replace(text, F.lit(_escape_pattern(template, False)), F.lit("\\\\"))


def unescape(text: Column, template: dict = INSTRUCT) -> Column:
    return F.regexp_replace(text, F.lit(_escape_pattern(template, True)), F.lit(""))


def format_chats(turns: DataFrame, template: dict = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, n_turns, valid, first_bad_turn (its place from 0, or null).

    A conversation is valid if every turn is an allowed transition and the last state is final.
    """
    check_template(template)
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = F.create_map(*[x for state, to in template["transitions"].items() for x in (F.lit(state), F.array(*map(F.lit, to)) if to else F.array().cast("array<string>"))])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, t: Column) -> Column:
        bad = ~F.coalesce(F.array_contains(F.element_at(allowed, s["state"]), t["role"]), F.lit(False))
        return F.struct(F.when(bad, F.lit("")).otherwise(t["role"]).alias("state"), (s["i"] + 1).alias("i"), F.coalesce(s["bad"], F.when(bad, s["i"])).alias("bad"))

    lit = lambda key: F.lit(template[key])
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        head = F.concat(lit("turn_open"), escape(t["role"], template), lit("role_close"))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"], template), t["role"].isin(template["loss_roles"])), segment(lit("turn_close"), F.lit(False)))

    begin = F.array(segment(lit("begin"), F.lit(False)))
    out = chats.select(
        "conv_id",
        F.concat(begin, F.flatten(F.transform("turns", segments))).cast(SEGMENTS).alias("segments"),
        F.aggregate("turns", start, step).alias("end"),
        F.size("turns").cast("long").alias("n_turns"),
    )
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "n_turns",
        (F.col("end.bad").isNull() & F.col("end.state").isin(template["final"])).alias("valid"),
        F.col("end.bad").alias("first_bad_turn"),
    )


def parse_chats(formatted: Column, template: dict = INSTRUCT) -> Column:
    """Turns read back from a formatted string: array<struct<role, text>>."""
    literal = lambda key: re.escape(template[key])
    body = F.substring(formatted, len(template["begin"]) + 1, 1 << 30)
    each = F.split(body, literal("turn_close"), -1)
    each = F.slice(each, 1, F.size(each) - 1)  # what follows the last mark is empty

    def turn(x: Column) -> Column:
        halves = F.split(F.substring(x, len(template["turn_open"]) + 1, 1 << 30), literal("role_close"), -1)
        return F.struct(unescape(F.element_at(halves, 1), template).alias("role"), unescape(F.element_at(halves, 2), template).alias("text"))

    return F.transform(each, turn)


def digest_chats(chats: DataFrame, template: dict = INSTRUCT) -> DataFrame:
    """What identifies formatted conversations, read back from their strings and segments."""
    turns = F.array_join(F.transform(parse_chats(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return chats.select(
        "conv_id",
        F.size(parse_chats(F.col("formatted"), template)).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
