"""Multi-select items: which statements about a window hold, with thresholds drawn per item and written into the texts.

A catalogue is a short list of statements; items pick four by column expressions (fixed ones first, the rest drawn), so
templates with different fixed options, levels and exclusions are rows of one plan. Every threshold is drawn from a digest of
the item, and the same column is written into the text and compared with the window, so that text and answer always agree.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import digest, normal, shuffled
from tidemark.functions.values import Name, col
from tidemark.operators.predicates import THRESHOLDS, statements, window_features


@dataclass(frozen=True)
class Statement:
    """text: {name} is a threshold in per cent, {name:.2f} in per cent with two decimals, {name:d} a count."""

    id: str
    levels: tuple[int, ...]
    text: str


#: The statements, the levels they are for, and their texts. One id can stand for two statements of different levels.
CATALOGUE = (
    Statement("mc_003", (2, 3), "Following the event, at least one joint speed drops sharply (>={speed_drop_ratio}% below pre-event baseline)."),
    Statement("mc_004", (2, 3), "Following the event, joint speeds stay close to baseline (within ±{speed_stable_tol}% of pre-event values)."),
    Statement("mc_005", (2, 3), "Following the event, motor current rises by >={stall_current_increase}% while speed magnitude stays <={stall_speed_frac}% of pre-event baseline (stall-like behavior)."),
    Statement("mc_006", (2, 3), "Following the event, contact-force magnitude remains low (<={force_low_increase}% above pre-event baseline for at least {force_low_coverage}% of timesteps)."),
    Statement("mc_007", (2, 3), "Following the event, contact force shows a significant spike (>={force_spike_increase}% above baseline norm)."),
    Statement("mc_008", (2, 3), "Following the event, tracking error increases noticeably (>={tracking_increase}% above pre-event mean)."),
    Statement("mc_013", (2, 3), "Following the event, robot current remains approximately constant (peak-to-peak range <={robot_current_stable_range}% of pre-event baseline)."),
    Statement("mc_014", (2, 3), "Following the event, robot current increases markedly (>={robot_current_increase}% above pre-event mean)."),
    Statement("mc_015", (2, 3), "Following the event, command and measured TCP motion remain aligned (TCP tracking error increase <={tcp_tracking_stable_increase}%)."),
    Statement("mc_016", (2, 3), "Following the event, command and measured TCP motion become misaligned (TCP tracking error increase >={tcp_tracking_increase}%)."),
    Statement("mc_017", (2, 3), "Following the event, temperatures rise across multiple joints (>={temp_rise_min_axes:d} joints with slope >{temp_rise_slope:.2f}% of baseline per horizon)."),
    Statement("mc_019", (2, 3), "No significant effect: safety stays normal and aggregate error (mean of tracking, TCP-tracking, force, and robot-current deviation terms) increases by <={no_effect_agg_increase}%."),
    Statement("mc_020", (2, 3), "The task is completed successfully."),
    Statement("mc_020", (1,), "Those come from different robots."),
)

#: Relative spread, least and most of the thresholds that are drawn otherwise than by (0.20, 0.0, 0.99).
SPREADS = {
    "force_low_coverage": (0.08, 0.50, 0.99),
    "temp_rise_slope": (0.25, 0.0005, 0.02),
    "temp_stable_slope": (0.25, 0.0002, 0.01),
    "temp_stable_axes_ratio": (0.08, 0.50, 0.99),
}
AXES_DEVIATION, MOST_AXES = 0.4, 6


def canonical(token: Name) -> Column:
    """mc_19, l2_mc_0019 -> mc_019; any other text as it is."""
    text = F.trim(col(token))
    digits = F.regexp_extract(text, r"(?i)^(?:l2_)?mc_(\d+)$", 1)
    return F.when(digits == "", text).otherwise(F.format_string("mc_%03d", digits.try_cast("int")))


def usable(catalogue: DataFrame, level: Name, wanted_id: str = "id") -> DataFrame:
    """Rows of a catalogue table that are for a level: `usable_levels` holds it; where there is none, `applicable_level` is it or is null.

    Key is then (id, level); of rows that repeat a key the last by `line` counts.
    """
    listed = F.coalesce(F.size("usable_levels"), F.lit(0)) > 0
    ok = F.when(listed, F.array_contains("usable_levels", col(level))).otherwise(F.coalesce(F.col("applicable_level") == col(level), F.lit(True)))
    rows = catalogue.where(ok & (F.trim("statement") != "")).withColumn("id", canonical(wanted_id)).withColumn("level", col(level))
    return rows.groupBy("id", "level").agg(F.max_by(F.trim("statement"), "line").alias("statement"))


def resolved(tokens: Column, texts: Column) -> Column:
    """Fixed option tokens as (id, statement): a known statement's, else no id and the token itself."""
    def one(t: Column) -> Column:
        known = F.try_element_at(texts, canonical(t))
        return F.struct(F.when(known.isNotNull(), canonical(t)).alias("id"), F.coalesce(known, t).alias("statement"))

    return F.transform(tokens, one)


def picked(fixed: Column, offered: Column, by: Sequence[str], n: int = 4, salt: str = "statement") -> Column:
    """n ids: the fixed ones that are offered, in their order and once each, then others in drawn order."""
    own = F.array_distinct(F.filter(F.transform(fixed, canonical), lambda t: F.array_contains(offered, t)))
    return F.slice(F.concat(own, shuffled(F.array_except(offered, own), salt, *by)), 1, n)


def drawn_thresholds(by: Sequence[str]) -> dict[str, Column]:
    """One value of each threshold for an item: normal around the usual one, within its bounds."""
    out = {}
    for name, mean in THRESHOLDS.items():
        if name == "temp_rise_min_axes":
            axes = F.bround(normal(mean, AXES_DEVIATION, name, *by), 0)
            out[name] = F.least(F.greatest(axes, F.lit(1.0)), F.lit(float(MOST_AXES)))
            continue
        spread, least, most = SPREADS.get(name, (0.20, 0.0, 0.99))
        out[name] = F.least(F.greatest(normal(mean, max(1e-6, mean * spread), name, *by), F.lit(least)), F.lit(most))
    return out


def rendered(text: str, thresholds: Mapping[str, Column]) -> Column:
    """A statement's text with its thresholds."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+(?::[.\w]+)?)\}", text)):
        name, _, form = piece.partition(":")
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif form == "d":
            parts.append(F.bround(thresholds[name], 0).cast("int").cast("string"))
        elif form:
            parts.append(F.format_string(f"%{form}", 100.0 * thresholds[name]))
        else:
            parts.append(F.bround(100.0 * thresholds[name], 0).cast("int").cast("string"))
    return F.concat(*parts)


def multi_select(rows: DataFrame, items: DataFrame, key: Sequence[str], seq: str, axes: Sequence[tuple[str, str, str]], contact: str, current: str, safety: str, level: int, fixed: Column, excluded: Column | None = None, success: str | None = None, tcp: Column | None = None, by: Sequence[str] | None = None, n: int = 4, catalogue: Sequence[Statement] = CATALOGUE) -> DataFrame:
    """items with `statements` (ids in the order offered), `options` (letter -> text) and `answer` (T or F by letter; what can't be told is F).

    items: key, by, `base` and `first` as for window_features. fixed: tokens of the statements that each item must offer;
    excluded: ids it must not; success: a column of items that judges mc_020. Rows are aggregated per item; only items that have a base row remain.
    """
    by = list(by or key)
    offered = {s.id: s for s in catalogue if level in s.levels}
    every = F.array(*map(F.lit, sorted(offered)))
    allowed = every if excluded is None else F.array_except(every, excluded)
    names = list(THRESHOLDS)
    own = items.withColumn("__picked", picked(fixed, allowed, by, n)).withColumns({f"t_{k}": v for k, v in drawn_thresholds(by).items()})
    own = own.withColumn("__success", F.lit(None).cast("boolean") if success is None else F.col(success).cast("boolean"))
    found = window_features(rows, own.withColumn("force_low", F.col("t_force_low_increase")), key, seq, axes, contact, current, safety, tcp, by)
    both = own.join(found, by)
    t = {k: F.col(f"t_{k}") for k in names}
    truth = statements(len(axes), t) | {"mc_020": F.col("__success")}
    said = [F.struct(F.lit(i).alias("id"), rendered(s.text, t).alias("text"), F.coalesce(truth[i], F.lit(False)).alias("holds")) for i, s in sorted(offered.items()) if i in truth]
    chosen = F.filter(F.array(*said), lambda s: F.array_contains("__picked", s["id"]))
    drawn = F.array_sort(F.transform(chosen, lambda s: F.struct(digest("option", *by, s["id"]).alias("d"), s["id"].alias("id"), s["text"].alias("text"), s["holds"].alias("holds"))))
    out = both.select(*items.columns, drawn.alias("__o"))
    letters = F.transform("__o", lambda _, i: F.chr(65 + i))
    return out.select(*items.columns, F.transform("__o", lambda o: o["id"]).alias("statements"), F.map_from_arrays(letters, F.transform("__o", lambda o: o["text"])).alias("options"), F.array_join(F.transform("__o", lambda o: F.when(o["holds"], "T").otherwise("F")), "").alias("answer"))
