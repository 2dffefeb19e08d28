"""Byte-level BPE encoding and decoding by finite-state transduction.

Encoding. The merge ranks are compiled into a transducer over bytes. Its nondeterministic form guesses token ends:
a configuration is (tokens guessed since the last output, last token, node of the token trie), and a token may end only
where the pair (last token, token) is one that merging leaves alone. For each piece exactly one guess survives to the end.
The machine is determinised lazily: a deterministic state is the set of live configurations without their common output,
made when texts need it for the second time and kept in a table; what all configurations agree on is emitted at once, so a
token comes out after a bounded lookahead. The end of a short piece that leaves the known states for the first time is
walked with the sets themselves, so rare pieces leave no states behind. Tables are bounded: a full one is dropped and grown
anew.

Decoding. Tokens step an incremental UTF-8 machine whose state is the unfinished byte sequence; (state, token) pairs are
compiled lazily too. Text comes out as soon as its bytes are whole, so ids may arrive in any cuts.

Defined cases: null text is the empty text and gives no ids; ids whose bytes are no UTF-8 decode with U+FFFD, as
Python's "replace" does; unknown ids raise KeyError.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, map_batches
from tidemark.llm.pretokenize import pieces

_ROOT = 0
_WALK = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The definition: again and again the leftmost pair of lowest rank is merged. Quadratic; for short strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > until:
        best = min(((ranks[p], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (p := a + b) in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Encoder:
    """The lazily determinised transducer of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], room: int = 1):
        """room: how large the tables may grow; 1 takes some 150 MB, 3 is faster where memory allows."""
        self.ranks, self.max_states, self.max_word_bytes, self.max_pairs = ranks, room * 60_000, room * 32_000_000, room * 200_000
        self.bytes_of = {i: b for b, i in ranks.items()}
        child: dict[int, int] = {}
        token_at: dict[int, int] = {}
        nodes = 1
        for b, i in ranks.items():
            node = _ROOT
            for c in b:
                key = node << 8 | c
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = nodes
                    nodes += 1
                node = nxt
            token_at[node] = i
        self.child, self.token_at = child, token_at
        self.pair_ok: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[bytes, int]]] = {}
        self.words: dict[str, bytes] = {}
        self.word_bytes = 0
        self._reset()

    def _reset(self) -> None:
        start = (((), -1, _ROOT),)
        self.states = [start]
        self.index = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {0: ()}
        self.met: set[int] = set()  # moves needed once

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at one edge (0 left, 1 right) while the token is merged, and the rank of the merge that ends each."""
        key = token << 1 | side
        got = self.edges.get(key)
        if got is None:
            data = self.bytes_of[token]
            got = [(data, 1 << 60)]
            if len(data) > 1:
                halves = merge_by_rank(data, self.ranks, 2)
                if len(halves) == 2:
                    part = halves[side]
                    got += [(part, token), *self._edge(self.ranks[part], side)[1:]]
                else:
                    got = []  # merging never reaches this token
            self.edges[key] = got
        return got

    def stable(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side; left -1 asks whether right is reached at all.

        Parts at the boundary that exist at the same time must not join before one of them joins inside its own token;
        at equal rank the merge further left comes first.
        """
        key = left << 32 | right
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) > self.max_pairs:
                self.pair_ok.clear()
            b = self._edge(right, 0)
            ok = bool(b)
            if left >= 0 and ok:
                a = self._edge(left, 1)
                i = j = 0
                ranks = self.ranks
                while True:
                    (x, x_ends), (y, y_ends) = a[i], b[j]
                    joined = ranks.get(x + y)
                    if joined is not None and joined < x_ends and joined <= y_ends:
                        ok = False
                        break
                    # the younger of both parts did not exist before its own merge
                    x_from = ranks[x] if i + 1 < len(a) else -1
                    y_from = ranks[y] if j + 1 < len(b) else -1
                    if x_from < 0 and y_from < 0:
                        break
                    if x_from > y_from:
                        i += 1
                    else:
                        j += 1
            self.pair_ok[key] = ok
        return ok

    def _advance(self, live: Iterable[tuple], byte: int) -> list[tuple]:
        """The configurations after one more byte."""
        child, token_at, pair_ok, out = self.child, self.token_at, self.pair_ok, []
        for emitted, last, node in live:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            out.append((emitted, last, nxt))
            token = token_at.get(nxt)
            if token is not None:
                ok = pair_ok.get(last << 32 | token)
                if ok or ok is None and self.stable(last, token):
                    out.append((emitted + (token,), token, _ROOT))
        if not out:
            raise ValueError("the vocabulary has no token for some byte")
        return out

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A new move: the state after the byte, and what all its configurations agree on."""
        live = self._advance(self.states[state], byte)
        first = live[0][0]
        n = len(first)
        if len(live) > 1:
            for out, _, _ in live:
                if out[:n] != first[:n]:
                    n = next((i for i, (x, y) in enumerate(zip(out, first)) if x != y), min(n, len(out)))
            live.sort()
        target = tuple([(out[n:], last, node) for out, last, node in live]) if n else tuple(live)
        to = self.index.get(target)
        if to is None:
            to = self.index[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = (to, first[:n])
        return move

    def _survivor(self, live: Iterable[tuple]) -> tuple[int, ...]:
        done = [out for out, _, node in live if node == _ROOT]
        if len(done) != 1:
            raise ValueError("these ranks aren't those of a byte-pair vocabulary")
        return done[0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        state, out, moves, met = 0, [], self.moves, self.met
        for i, byte in enumerate(data):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in met and len(data) - i <= _WALK:
                    if len(met) > 200_000:
                        met.clear()
                    met.add(key)
                    live = self.states[state]
                    for b in data[i:]:
                        live = self._advance(live, b)
                    out += self._survivor(live)
                    return out
                move = self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        rest = self.ends.get(state)
        if rest is None:
            rest = self.ends[state] = self._survivor(self.states[state])
        out += rest
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. Pieces met lately are looked up."""
        words = pieces(text)
        found = list(map(self.words.get, words))
        if None in found:
            if self.word_bytes > self.max_word_bytes:
                self.words.clear()
                self.word_bytes = 0
            keep = self.words
            for i, w in enumerate(words):
                if found[i] is None:
                    ids = keep.get(w)
                    if ids is None:
                        ids = keep[w] = array("I", self.encode_piece(w.encode())).tobytes()
                        self.word_bytes += 170 + 2 * len(w) + len(ids)  # both objects and their place in the table
                    found[i] = ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()


def _utf8_tail(data: bytes) -> int:
    """Length of the unfinished but so far valid sequence at the end of data."""
    for k in range(1, min(3, len(data)) + 1):
        c = data[-k]
        if c >= 0xC0:
            need = 2 if 0xC2 <= c <= 0xDF else 3 if 0xE0 <= c <= 0xEF else 4 if 0xF0 <= c <= 0xF4 else 0
            if need <= k:
                return 0
            if k >= 2:  # the second byte is further bound after some leads
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(c, (0x80, 0xBF))
                if not low <= data[-k + 1] <= high:
                    return 0
            return k
        if c < 0x80:
            return 0
    return 0


class Decoder:
    """Incremental: feed() takes ids in any cuts and gives the text that is whole by then; finish() ends it."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.plain: dict[int, str] = {}
        for i, b in bytes_of.items():
            try:
                self.plain[i] = b.decode()
            except UnicodeDecodeError:
                pass
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.pending = b""

    def _move(self, pending: bytes, token: int) -> tuple[str, bytes]:
        data = pending + self.bytes_of[token]
        k = _utf8_tail(data)
        move = self.moves[pending, token] = (data[: len(data) - k].decode("utf-8", "replace"), data[len(data) - k :])
        return move

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        pending = self.pending
        if not pending:
            got = list(map(self.plain.get, ids))
            if None not in got:
                return "".join(got)
        out, plain, moves = [], self.plain, self.moves
        for t in ids:
            if not pending and t in plain:
                out.append(plain[t])
                continue
            text, pending = moves.get((pending, t)) or self._move(pending, t)
            out.append(text)
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending = self.pending.decode("utf-8", "replace"), b""
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


@held
def encoder_of(path: str, room: int = 1) -> Encoder:
    """One in each Python worker, until a task of another operator runs there."""
    encoder = Encoder(load_ranks(path), room)
    gc.freeze()  # the tables live as long as the worker
    gc.set_threshold(200_000, 50, 50)
    return encoder


@held
def decoder_of(path: str) -> Decoder:
    """One in each Python worker that decodes."""
    return Decoder({i: b for b, i in load_ranks(path).items()})


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", round_trip: str | None = None) -> DataFrame:
    """docs with a column of token ids (array<int>) added; the vocabulary is a path that all executors can open.

    With round_trip, a column of that name says whether the ids, decoded in the same pass, give the text again.
    Columns of docs named like the new ones are replaced. An empty table gives an empty table.
    """
    new = [out] if round_trip is None else [out, round_trip]
    keep = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` array<int>", *(f"`{c}` boolean" for c in new[1:])])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(vocabulary)
        packed, same = [], []
        for x in b.column(len(keep)).to_pylist():
            packed.append(encoder.encode_packed(x or ""))
            if round_trip is not None:
                same.append(decoder_of(vocabulary).decode(np.frombuffer(packed[-1], dtype="<u4").tolist()) == (x or ""))
        values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        offsets = np.zeros(len(packed) + 1, dtype=np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(pa.array(offsets), values), *([pa.array(same, pa.bool_())] if round_trip is not None else [])], [*keep, *new])

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), run, schema)


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of a column of ids added; null ids are no ids."""
    keep = [c for c in docs.columns if c != out]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        decoder = decoder_of(vocabulary)
        texts = [decoder.decode(x or ()) for x in b.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, out])

    return map_batches(docs.select(*keep, F.col(ids).alias("__ids")), run, f"{schema}, `{out}` string")


def digest_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and keeps what identifies both results.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; rows are independent, so repeats give repeats.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = encoder_of(vocabulary, 3), decoder_of(vocabulary)
        n, ids_hex, text_hex = [], [], []
        for x in b.column(1).to_pylist():
            packed = encoder.encode_packed(x or "")
            n.append(len(packed) // 4)
            ids_hex.append(hashlib.sha256(packed).hexdigest())
            text_hex.append(hashlib.sha256(decoder.decode(np.frombuffer(packed, dtype="<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
