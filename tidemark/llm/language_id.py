"""Language identification by error-correcting output codes.

Each language has a binary codeword; one logistic classifier over hashed letter n-grams predicts each bit. Decoding is
loss-weighted: a codeword's distance is the sum over bits of the bit's weight (from its error in training) times the
logistic loss of its prediction; the nearest codeword wins, and two codewords nearly as near flag the text as ambiguous.

Training reads a bounded sample: MAX_ROWS // languages labelled rows of each language (one at least), those of smallest hash
of id and text. Every language that occurs is learned; beyond MAX_LANGUAGES of them, the column is no language column, and
training raises ValueError. Prediction reads every whole text and nothing else.

Defined cases: null text, or text without a letter, is `und` with score 0 and not ambiguous; so is every text when no
row is labelled; with one language every text with letters has it. Rows are predicted alone: repeats agree.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

MAX_ROWS = 2400
MAX_LANGUAGES = 2400
DIM = 1 << 12
GRAMS = (1, 2, 3, 4)
AMBIGUOUS = 0.5
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else a space."""
    out = np.full(0x110000, 0x20, dtype=np.uint32)
    for i in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        if chr(i).isalpha():
            out[i] = i
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the square roots of hashed n-gram counts over lower-cased letters; and whether there are letters."""
    x = np.zeros((len(texts), DIM), dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    table = _letters()
    for row, text in enumerate(texts):
        chars = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        space = chars == 0x20
        keep = np.ones(len(chars), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1])
        chars = np.concatenate(([0x20], chars[keep], [0x20])).astype(np.uint32)
        lettered[row] = not space.all() if len(space) else False
        h = np.zeros(len(chars), dtype=np.uint32)
        counts = np.zeros(DIM)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(n)
            if n in GRAMS and len(h):
                counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1), minlength=DIM)
        root = np.sqrt(counts)
        x[row] = root / max(1e-9, np.sqrt(counts.sum()))
    return x, lettered


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1/+1. Up to 5 languages: all 2**(k-1)-1 splits; more: of random codes that with the largest least distance."""
    if k <= 1:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200 if k <= 100 else 20):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        same = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(same, -bits)
        least = int((bits - same.max()) // 2)
        if np.abs(code.sum(axis=0, dtype=np.int64)).max() < k and (best is None or least > best[0]):
            best = (least, code)
    if best is None or not best[0]:
        raise ValueError("no code found")
    return best[1]


class Model:
    """Languages, codewords, bit classifiers and bit weights."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, bit_weight: np.ndarray):
        self.langs, self.code, self.w, self.b, self.bit_weight = langs, code, w, b, bit_weight

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and ambiguity of each text."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, dtype=bool)
        x, lettered = features(texts)
        margin = x @ self.w + self.b
        if self.code.shape[1]:  # a bit costs one of two losses, so the sum over bits is a product with the code
            if_set, if_not = np.logaddexp(0, -margin) * self.bit_weight, np.logaddexp(0, margin) * self.bit_weight
            loss = ((if_set + if_not) / 2).sum(axis=1, keepdims=True) + (if_set - if_not) / 2 @ self.code.T.astype(np.float64)
        else:
            loss = np.zeros((n, 1))
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = (near / near.sum(axis=1, keepdims=True)).max(axis=1)
        best = loss.argmin(axis=1)
        score[~lettered] = 0.0
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered.tolist())], score, lettered & (score < AMBIGUOUS)


def fit(texts: list[str], langs: list[str], steps: int = 150, l2: float = 1e-5) -> Model:
    """Bit classifiers by accelerated gradient descent on the logistic loss, all bits at once."""
    names = sorted({*langs})
    code = codewords(len(names))
    if not code.shape[1]:
        return Model(names, code, np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    x, lettered = features(texts)
    place = {v: i for i, v in enumerate(names)}
    y = code[[place[v] for v in langs]].astype(np.float32)[lettered]
    x = x[lettered]
    w = np.zeros((DIM, y.shape[1]), dtype=np.float32)
    b = np.zeros(y.shape[1], dtype=np.float32)
    look_w, look_b, rate = w, b, np.float32(8.0)
    for i in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ look_w + look_b), -30, 30))) / max(1, len(y))
        new_w, new_b = look_w - rate * (x.T @ g + l2 * look_w), look_b - rate * g.sum(axis=0)
        m = np.float32(i / (i + 3))
        look_w, look_b = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    wrong = ((x @ w + b) * y <= 0).mean(axis=0)
    weight = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    weight = np.clip(weight, 0.1, None)
    return Model(names, code, w.astype(np.float32), b.astype(np.float32), weight / weight.mean())


def training_sample(labelled: DataFrame, max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], list[str]]:
    """Texts and languages of (doc_id, text, lang): max_rows // languages distinct rows of each language, those of smallest hash.

    Only hashes are ranked; texts are read by each language's greatest hash that counts.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("__draw", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")))
    languages = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not languages:
        return [], []
    each = max(1, max_rows // languages)
    by = Window.partitionBy("lang").orderBy("__draw")
    # rows that repeat share a hash and count once, so copies can't fill a language's share
    bounds = rows.select("lang", "__draw").distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= each).groupBy("lang").agg(F.max("__draw").alias("most"))
    got = rows.join(F.broadcast(bounds), "lang").where("__draw <= most").dropDuplicates(["lang", "__draw"]).select("doc_id", "text", "lang").toPandas()  # at most `each` rows of at most max_languages languages
    got = got.sort_values(["doc_id", "text"], kind="stable")
    return got["text"].tolist(), got["lang"].tolist()


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs with lang_pred, score and ambiguous (columns of these names are replaced)."""
    new = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits weights, whatever the input

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, unsure = shared.value.predict([x or "" for x in b.column(len(keep)).to_pylist()])
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], [*keep, *new])

    return map_batches(docs.select(*keep, F.col("text").alias("__text")), run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id"):
    """The rows kept from training: crc32 of the id's text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
