"""License notices in texts: exact phrases, and short notices with bounded edits.

A notice with up to k edits, cut into k + 1 pieces, has one piece unharmed (pigeonhole). An Aho-Corasick automaton finds
the pieces of all notices in one pass; around each hit the regex library matches the whole notice with at most k edits
(insertions, deletions, substitutions) and reports the span, so a text without a seed costs one scan and no edit search.

Texts are matched as words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, joined by one space.

Defined cases: null and empty texts have no words, no places and no labels; overlapping places all count; of overlapping
fuzzy spans those with the fewest edits are kept; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, word_spans

#: The phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices as words, their label and the edits allowed in each.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    ("licensed under the apache license version 2 0", "apache-2", 5),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc", 7),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("licensed under the gnu general public license version 2", "gpl-2", 5),
    ("licensed under the gnu lesser general public license", "lgpl", 5),
    ("licensed under the gnu affero general public license", "agpl", 5),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 9),
    ("licensed under the mozilla public license version 2 0", "mpl-2", 5),
    ("this is free and unencumbered software released into the public domain", "unlicense", 7),
)

_SEP = np.ones(256, dtype=bool)
_SEP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def seeds_of(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice in edits + 1 contiguous pieces of nearly equal length, and where each begins."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled notices and phrases."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices, self.phrases = notices, phrases
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, edits) in enumerate(notices):
            for seed, at in seeds_of(notice, edits):
                found.setdefault(seed, []).append((i, at))
        for seed, uses in found.items():
            self.automaton.add_word(seed, (len(seed), uses))
        if found:
            self.automaton.make_automaton()
        self.fuzzy = [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n)}){{e<={e}}}(?!\S)") for n, _, e in notices]

    def words(self, text: str) -> tuple[str, np.ndarray]:
        """The words joined by spaces, and the character at which each begins."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        starts, ends = word_spans(data, _SEP)
        if not len(starts):
            return "", starts
        # each word's bytes and one space after it, gathered at once
        sizes = ends - starts
        size_up = sizes + 1
        at = np.cumsum(size_up) - size_up
        out = np.full(int(size_up.sum()), 0x20, dtype=np.uint8)
        inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = data[inside]
        raw = out[:-1]
        if (raw >= 0x80).any():  # bytes to characters
            lead = np.cumsum((raw & 0xC0) != 0x80)
            at = lead[at] - 1
        return raw.tobytes().decode("utf-8", "surrogatepass"), at

    def places(self, joined: str, at: np.ndarray) -> list[tuple[int, str]]:
        """Every place of a base phrase: (index of its first word, label)."""
        out = []
        for phrase, label in self.phrases.items():
            n, i = len(phrase), joined.find(phrase)
            while i >= 0:
                if (i == 0 or joined[i - 1] == " ") and (i + n == len(joined) or joined[i + n] == " "):
                    out.append((int(np.searchsorted(at, i)), label))
                i = joined.find(phrase, i + 1)
        return sorted(out)

    def spans(self, joined: str) -> list[tuple[int, int, int, str]]:
        """Fuzzy notices: (start, end, edits, label) in characters of the joined words."""
        if not joined or not self.notices:
            return []
        hits: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(joined):
            for i, at in uses:
                hits.setdefault(i, set()).add(end + 1 - size - at)
        out = []
        for i, starts in hits.items():
            notice, label, edits = self.notices[i]
            found: set[tuple[int, int, int]] = set()
            # seeds of one notice give starts that its edits shift: one window holds them, of bounded length however many notices follow
            first = last = None
            for start in [*sorted(starts), None]:
                if first is not None and (start is None or start - first > 2 * edits):
                    found.update(self._matches(i, joined, max(0, first - edits - 1), min(len(joined), last + len(notice) + edits + 1)))  # with one character on each side
                    first = start
                first, last = start if first is None else first, start
            # windows overlap, and so may what they give: the best stay
            out += [(s, e, n, label) for s, e, n in _apart(found)]
        # where notices overlap, those with the fewest edits stay
        kept: list[tuple[int, int, int, str]] = []
        covered = Covered()
        for _, level in itertools.groupby(sorted(out, key=lambda x: x[2]), key=lambda x: x[2]):
            fresh = [x for x in level if not covered.meets(x[0], x[1])]
            kept += fresh
            for x in fresh:
                covered.add(x[0], x[1])
        return sorted(kept)

    def _matches(self, i: int, joined: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) in a window: the best match first, then what stands before and after it."""
        out, parts = [], [(lo, hi)]
        while parts:
            lo, hi = parts.pop()
            if 0 < hi < len(joined) and joined[hi] != " ":  # a part's end must be a word's
                hi = joined.rfind(" ", lo, hi)
            m = self.fuzzy[i].search(joined, lo, hi) if lo < hi else None
            if m:
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                parts += [(lo, m.start() - 1), (m.end() + 1, hi)]
        return out


class Covered:
    """Intervals that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, lo: int, hi: int) -> bool:
        i = bisect.bisect_left(self.ends, lo + 1)
        return i < len(self.starts) and self.starts[i] < hi

    def add(self, lo: int, hi: int) -> None:
        """Joins an interval with those it overlaps."""
        i, j = bisect.bisect_left(self.ends, lo + 1), bisect.bisect_left(self.starts, hi)
        if i < j:
            lo, hi = min(lo, self.starts[i]), max(hi, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [lo], [hi]


def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans of one notice those that don't overlap, the fewest edits first, then the first."""
    taken, out = Covered(), []
    for x in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        if not taken.meets(x[0], x[1]):
            taken.add(x[0], x[1])
            out.append(x)
    return out


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (first_word, n_words, edits, label), all fuzzy notices. score: 1 for a base phrase or an exact notice,
    else 1 - edits / length of the best notice, 0 without any.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner()
        rows = []
        for x in b.column(1).to_pylist():
            joined, at = s.words(x or "")
            base = s.places(joined, at)
            fuzzy = s.spans(joined)
            labels = {v for _, v in base}
            score = 1.0 if base else max((1 - e / max(1, end - start) for start, end, e, _ in fuzzy), default=0.0)
            spans = [{"first_word": int(np.searchsorted(at, start)), "n_words": joined.count(" ", start, end) + 1, "edits": e, "label": v} for start, end, e, v in fuzzy]
            rows.append((len(at), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {v for *_, v in fuzzy})), score, spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()), ("label", pa.string())]))]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word long, n_words long, edits long, label string>>")
