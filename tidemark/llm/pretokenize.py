"""Cuts a text as a byte-level BPE vocabulary's splitting pattern does, without running a regex over it."""

from __future__ import annotations

import functools

import numpy as np
import regex

#: The contraction endings of the splitting pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_OTHER, _LETTER, _NUMBER, _WHITE = 0, 1, 2, 3


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(start, stop)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                out[start + m.start() : start + m.end()] = kind
    return out


def piece_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text that is not empty, and whether a piece starts at each.

    A piece starts where the class of characters changes; one plain space joins the run after it; of longer white
    space the last character stands apart (or joins); contraction endings go with their apostrophe.
    """
    n = len(text)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = char_classes()[chars]
    white = kind == _WHITE
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[1:] &= (chars[:-1] != 0x20) | white[1:]
    start[:-1] |= white[:-1] & ~white[1:]
    if "'" in text:
        for p in np.flatnonzero((chars == 0x27) & start).tolist():
            for end in CONTRACTIONS:
                if text.startswith(end, p + 1):
                    start[p + 1] = False
                    if p + 1 + len(end) < n:
                        start[p + 1 + len(end)] = True
                    break
    return chars, start


def pieces(text: str) -> list[str]:
    """What findall with the splitting pattern of public_tokenizers gives."""
    if not text:
        return []
    cuts = np.flatnonzero(piece_starts(text)[1]).tolist()
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def pieces_of_all(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(text, chars, at, ends): all texts in one, a line feed after each, and its code points; where its pieces start, each line feed one of its own; and the numbers of those."""
    text = "\n".join(texts) + "\n"  # white space, but no plain space: what is beside it is cut as at a text's edge
    chars, start = piece_starts(text)
    edge = np.cumsum(np.array([len(t) + 1 for t in texts])) - 1
    start[edge] = True
    start[edge[:-1] + 1] = True
    at = np.flatnonzero(start)
    return text, chars, at, np.searchsorted(at, edge)
