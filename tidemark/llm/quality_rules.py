"""Quality rules as a learned decision list.

Sequential covering in the manner of repeated incremental pruning: on two thirds of the rows not yet covered a conjunction
of thresholds grows by information gain until it covers no counterexample, on the other third it is pruned to what does
best, and learning stops at a rule that is wrong too often. The list becomes ordered Spark conditional expressions.

Statistics are over words [^\\x20\\x09-\\x0D]+ of the whole text. Learning reads at most MAX_ROWS labelled rows.

Defined cases: null text is a text without words; with no labelled rows, or labels of one kind, the list is empty and
keeps every row; a null statistic meets no threshold; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, span_hashes, window_hashes, word_spans

MAX_ROWS = 20_000
REPEAT_WINDOW = 3
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
#: Statistics that rules may test: shares of the counts.
RATIOS = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_IS_MARK = np.isin(np.arange(256), list(b"!?"))
_IS_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_IS_LETTER = _IS_UPPER | np.isin(np.arange(256), np.arange(0x61, 0x7B)) | (np.arange(256) >= 0xC0)  # a character beyond ASCII counts by its first byte


def counts_of(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return (0,) * len(COUNTS)
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    hist = np.bincount(data, minlength=256)
    # words in windows of three that stand in the text twice or more
    repeated = 0
    if n > REPEAT_WINDOW:
        windows = window_hashes(span_hashes(data, starts, ends), REPEAT_WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (n, int((chars[ends] - chars[starts]).sum()), int(hist[_IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated, len(lines), int(hist[_IS_UPPER].sum()), int(hist[_IS_LETTER].sum()), int(hist[_IS_MARK].sum()))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the COUNTS, one row per row of docs."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counts_of(x or "") for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in zip(*rows))], ["doc_id", *COUNTS])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Test:
    name: str
    at_least: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.name]
        return v >= self.bound if self.at_least else v <= self.bound

    def column(self) -> Column:
        v = F.expr(RATIOS[self.name])
        return v >= F.lit(self.bound) if self.at_least else v <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<='} {self.bound:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4, bounds: int = 64) -> Rule:
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad & inside).any() and (bad & inside).any():
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        best = (1e-9, None)
        for name, v in x.items():
            own = v[inside]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, bounds), method="nearest")):
                for at_least in (True, False):
                    hit = own >= cut if at_least else own <= cut
                    p = int((bad[inside] & hit).sum())
                    n = int(hit.sum()) - p
                    if p and n < n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-12:
                            best = (gain, Test(name, at_least, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _covers(rule, x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most: int = 12, seed: int = 1) -> list[Rule]:
    """Rules that find bad rows, in order. A rule must be right for the given share of what it covers in both parts."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    rng = np.random.default_rng(seed)
    while len(rules) < most and (bad & left).sum() >= 3 and (~bad & left).any():
        at = rng.permutation(np.flatnonzero(left))
        grow_at, prune_at = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        part = lambda i: ({k: v[i] for k, v in x.items()}, bad[i])
        rule = _grow(*part(grow_at))
        if not rule:
            break
        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (_worth(r, *part(prune_at)), -len(r)))
        hit = _covers(rule, x) & left
        if not hit.any() or (hit & bad).sum() < precision * hit.sum() or _worth(rule, *part(prune_at)) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_arrays(rows: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and the label `bad` of max_rows rows, or all if there are fewer: those of smallest hash of the id and the statistics."""
    every = rows.select("doc_id", F.col("bad").cast("boolean").alias("bad"), *[F.expr(e).alias(k) for k, e in RATIOS.items()]).where("bad IS NOT NULL")
    draw = F.xxhash64(F.col("doc_id").cast("string"), "bad", *RATIOS)
    n, enough = every.count(), 1.2 * max_rows + 200
    # all but somewhat more rows than are wanted stay where they are: each task would send its max_rows smallest else.
    # Rows that repeat share a hash, so a cut can take too few: it is widened until it has enough
    while enough < n:
        got = every.where(draw < F.lit(int(enough / n * 2**64) - 2**63))
        if got.count() >= max_rows:
            break
        enough *= 4
    else:
        got = every
    got = got.orderBy(draw, "doc_id").limit(max_rows).toPandas()
    return {k: got[k].to_numpy(dtype=float) for k in RATIOS}, got["bad"].to_numpy(dtype=bool)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, from 1; 0 if none: one ordered conditional expression."""
    out = F
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for t in rule:
            cond &= t.column()
        out = out.when(cond, F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
