"""Scoring of free-text replies as column expressions, under two named profiles.

`cascade` reads the answer by layers, from strict to lenient, and scores tiers; `eval` takes the last plausible token and
scores fractions. They disagree on purpose and are kept apart. Every parser returns struct(score, parsed, provenance).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import Name, col

#: Patterns of numbers, answer cues and units, and tolerances of the two profiles.
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
CUE = r"(?i)(?:final\s+)?answer\s*[:=]\s*\*{0,2}\s*"
UNITS = "rad/s|rad|m/s\\^?2|m/s|mm/s|cm/s|mm|cm|km|m|ms|us|ns|s|min|h|mA|kA|A|Nm|N|°C|°F|°|deg(?:rees?)?|%|kPa|MPa|Pa|mV|kV|V|mW|kW|W|kJ|J|kHz|MHz|Hz"
TOLERANCE = 1e-4

RESULT = "struct<score double, parsed string, provenance string>"


def _last(text: Column, pattern: Column | str, group: int = 1) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def _first(text: Column, pattern: Column | str, group: int = 1) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(group)), F.lit(1))


def _clean(reply: Name) -> Column:
    """The reply before any echoed prompt, trimmed."""
    return F.regexp_replace(F.regexp_replace(col(reply), r"(?is)\n\s*\+{3,}\s*prompts?/.*$", ""), r"^\s+|\s+$", "")


def _last_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(-1)), F.lit(""))


def _strip_unit(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?s)^\s*[*`]+\s*(.*?)\s*[*`]+\s*$", "$1")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, rf"(?i)\s*(?:{UNITS})\.?\s*$", "")), r"\.+$", ""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(rf"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it: the optimizer copies plain expressions."""
    return F.transform(F.array(value), use)[0]


def _layers(layers: Sequence[tuple[Column, str]]) -> Column:
    """struct(value, provenance) of the first layer with a value."""
    every = F.array(*[F.struct(value.alias("value"), F.lit(provenance).alias("provenance")) for value, provenance in layers])
    return F.try_element_at(F.filter(every, lambda x: x["value"].isNotNull()), F.lit(1))


def _result(found: Column, score: Callable[[Column], Column], text: Callable[[Column], Column] = lambda v: v.cast("string")) -> Column:
    """RESULT from a layer's struct; score takes its value."""
    return bound(
        found,
        lambda x: F.struct(
            F.when(x.isNotNull(), score(x["value"]).cast("double")).alias("score"),
            F.when(x.isNotNull(), text(x["value"])).alias("parsed"),
            F.when(x.isNotNull(), x["provenance"]).otherwise(F.lit("unparseable")).alias("provenance"),
        ),
    )


def _same_places(a: Column, b: Column) -> Column:
    """How many characters agree by place."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.length(a) > 0)))


def single_select(reply: Name, truth: Name) -> Column:
    text, gt = _clean(reply), F.upper(F.trim(col(truth)))
    found = _layers([
        (F.upper(_first(text, r"^([A-Da-d])$")), "strict"),
        (F.upper(_last(text, CUE + r"([A-D])\b")), "lenient"),
        (F.upper(_last(text, r"(?i)(?:correct|right)\s+answer\s+is\s*:?\s*\*{0,2}\s*([A-D])\b")), "lenient"),
        (F.upper(_last(text, r"\*{1,2}\s*([A-Da-d])\s*\*{1,2}")), "lenient"),
        (F.upper(_last(text, r"(?m)^\s*\*{0,2}\s*([A-Da-d])\s*\*{0,2}\s*\.?\s*$")), "lenient"),
        (F.upper(_last(text, r"(?<!\d\s{0,4})\b([A-Da-d])\b")), "lenient"),
    ])
    return _result(found, lambda value: F.when(value == gt, 1.0).otherwise(0.0))


def _lettered(text: Column, letters: str, n: Column, last: bool) -> Column:
    run = F.concat(F.lit(f"([{letters}]{{"), n.cast("string"), F.lit("})"))
    pick = _last if last else _first
    return _layers([
        (F.upper(_first(text, F.concat(F.lit("(?i)^"), run, F.lit("$")))), "strict"),
        (F.upper(_last(text, F.concat(F.lit(CUE), run, F.lit(r"\b")))), "lenient"),
        (F.upper(_last(text, F.concat(F.lit(r"(?i)\*{1,2}\s*"), run, F.lit(r"\s*\*{1,2}")))), "lenient"),
        (F.upper(pick(text, F.concat(F.lit(r"(?i)\b"), run, F.lit(r"\b")))), "lenient"),
    ])


def multi_select(reply: Name, truth: Name) -> Column:
    """All right 1, one wrong a half, else 0."""
    text, gt = _clean(reply), F.upper(F.trim(col(truth)))
    found = F.when(gt.rlike("^[TF]+$"), _lettered(text, "TF", F.length(gt), last=False))
    return _result(found, lambda value: bound(_same_places(value, gt), lambda right: F.when(right == F.length(gt), 1.0).when(right >= F.length(gt) - 1, 0.5).otherwise(0.0)))


def is_permutation(a: Column, b: Column) -> Column:
    letters = lambda x: F.array_distinct(F.array_sort(F.filter(F.split(x, ""), lambda c: c != "")))
    return (F.length(a) == F.length(b)) & (letters(a) == letters(b))


def kendall_tau(pred: Column, truth: Column) -> Column:
    """Concordant less discordant pairs over all pairs; 1 below two letters."""
    n = F.length(truth)
    ranks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.position(F.substr(truth, i, F.lit(1)), pred))
    signs = F.flatten(F.transform(ranks, lambda r, i: F.transform(F.slice(ranks, i + 2, F.size(ranks)), lambda s: F.when(r < s, 1).otherwise(-1))))
    return F.when(n < 2, F.lit(1.0)).otherwise(F.aggregate(signs, F.lit(0), lambda a, x: a + x) / (n * (n - 1) / 2))


def ranking(reply: Name, truth: Name) -> Column:
    text, gt = _clean(reply), F.upper(F.trim(col(truth)))
    found = F.when(gt.rlike("^[A-D]+$"), _lettered(text, "A-D", F.length(gt), last=True))
    return _result(found, lambda value: F.when(is_permutation(value, gt), (kendall_tau(value, gt) + 1) / 2).otherwise(0.0))


def numerical(reply: Name, truth: Name, margin: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    text, gt = _clean(reply), col(truth).cast("string").try_cast("double")
    found = F.when(gt.isNotNull(), _layers([
        (_number(text), "strict"),
        (_number(_strip_unit(text)), "lenient"),
        (_last(text, CUE + rf"({NUMBER})").try_cast("double"), "lenient"),
        (_last(_strip_unit(_last_line(text)), rf"({NUMBER})").try_cast("double"), "lenient"),
    ]))
    null = F.lit(None).cast("double")
    margin, low, high = (null if x is None else x for x in (margin, low, high))
    return _result(found, lambda value: F.when(low.isNotNull() & high.isNotNull(), value.between(low, high)).otherwise(F.abs(value - gt) <= F.coalesce(margin, F.lit(TOLERANCE))).cast("double"))


def numbers_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def tensor_of(text: Column) -> Column:
    """a_b_c with optional name= before each part; null if any part is no number."""
    parts = F.transform(F.split(text, "_"), lambda p: F.regexp_replace(p, r"^.*=", ""))
    return F.when(F.forall(parts, lambda p: _number(p).isNotNull()), F.transform(parts, lambda p: F.trim(p).cast("double")))


def truth_tensor(truth: Name) -> Column:
    t = F.trim(col(truth))
    return F.when(t.startswith("["), numbers_of(t)).otherwise(tensor_of(t))


def _bracketed(text: Column, n: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(\[\s*[^\[\]]*?-?\d[^\[\]]*?\])"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(blocks, numbers_of), lambda v: F.size(v) == n), F.lit(-1))


def tensor(reply: Name, truth: Name, margins: Column | None = None) -> Column:
    """Share of channels within their margin; without margins all must be equal."""
    text, gt = _clean(reply), truth_tensor(truth)
    n = F.size(gt)
    sized = lambda v: F.when(F.size(v) == n, v)
    cue = F.regexp_replace(_last(text, r"(?is)(?:final\s+)?answer\s*[:=]\s*((?:(?!answer\s*[:=]).)*)"), r"(?s)\r?\n.*$", "")
    number = rf"(?:[A-Za-z_][A-Za-z0-9_]*=)?{NUMBER}"
    chunks = F.regexp_extract_all(_strip_unit(_last_line(text)), F.lit(f"({number}(?:_{number})+)"), F.lit(1))
    found = F.when(gt.isNotNull() & (n > 0), _layers([
        (sized(tensor_of(text)), "strict"),
        (F.when(text.startswith("[") & text.endswith("]"), sized(numbers_of(text))), "strict"),
        (sized(tensor_of(_strip_unit(text))), "lenient"),
        (sized(tensor_of(_strip_unit(cue))), "lenient"),
        (_bracketed(cue, n), "lenient"),
        (_bracketed(text, n), "lenient"),
        (F.try_element_at(F.filter(F.transform(chunks, tensor_of), lambda v: F.size(v) == n), F.lit(-1)), "lenient"),
    ]))

    def score(value: Column) -> Column:
        exact = F.when(value == gt, 1.0).otherwise(0.0)
        if margins is None:
            return exact
        near = F.zip_with(F.zip_with(value, gt, lambda p, g: F.abs(p - g)), margins, lambda d, m: F.when(d <= m, 1.0).otherwise(0.0))
        return F.when(F.size(margins) == n, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / n).otherwise(exact)

    return _result(found, score, lambda v: F.array_join(v.cast("array<string>"), "_"))


# the eval profile


def eval_single(reply: Name, truth: Name) -> Column:
    letter = _last(F.upper(F.trim(col(reply))), r"\b([A-D])\b")
    return F.coalesce((letter == F.upper(F.trim(col(truth)))).cast("double"), F.lit(0.0))


def eval_multi(reply: Name, truth: Name) -> Column:
    """Fraction of places that agree with the last T/F run of the right length."""
    gt, text = F.upper(F.trim(col(truth))), F.upper(F.trim(col(reply)))
    got = _last(text, F.concat(F.lit(r"\b([TF]{"), F.length(gt).cast("string"), F.lit(r"})\b")))
    return F.when(got.isNotNull() & gt.rlike("^[TF]+$"), _same_places(got, gt) / F.length(gt)).otherwise(0.0)


def eval_ranking(reply: Name, truth: Name) -> Column:
    gt = F.upper(F.trim(col(truth)))
    got = _first(F.upper(F.trim(col(reply))), r"\b([A-D]{4})\b")
    return F.when(F.length(got) == F.length(gt), _same_places(got, gt) / F.length(gt)).otherwise(0.0)


def _tier(d: Column, margin: Column) -> Column:
    return F.when(d <= margin, 1.0).when(d <= 2 * margin, 0.5).otherwise(0.0)


def eval_numerical(reply: Name, truth: Name, margin: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    null = F.lit(None).cast("double")
    margin, low, high = (null if x is None else x for x in (margin, low, high))
    gt = F.bround(col(truth).cast("string").try_cast("double"), 4)
    got = F.bround(F.coalesce(_number(col(reply)), F.try_element_at(numbers_of(col(reply)), F.lit(-1))), 4)
    d = F.abs(got - gt)
    score = F.when(low.isNotNull() & high.isNotNull(), got.between(low, high).cast("double")).when(margin.isNotNull(), _tier(d, margin)).otherwise((d < TOLERANCE).cast("double"))
    return F.coalesce(score, F.lit(0.0))


def eval_tensor(reply: Name, truth: Name, margins: Column | None = None) -> Column:
    gt, text = numbers_of(col(truth)), F.trim(col(reply))
    n, every = F.size(gt), numbers_of(text)
    got = F.coalesce(_bracketed(text, n), F.when(F.size(every) >= n, F.slice(every, F.size(every) - n + 1, n)), every)
    exact = F.when(got == gt, 1.0).otherwise(0.0)
    if margins is not None:
        d = F.zip_with(got, gt, lambda p, g: F.abs(p - g))
        tiers = F.zip_with(d, margins, _tier)
        exact = F.when(margins.isNull(), exact).when((F.size(got) == n) & (F.size(margins) == n), F.aggregate(tiers, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return F.when(n > 0, exact).otherwise(0.0)


# helpers of both


#: Parsers of the cascade by answer format: a place for users to register their own.
PARSERS: dict[str, Callable[..., Column]] = {
    "multiple_choice_single_select": single_select,
    "multiple_choice_multi_select": multi_select,
    "numerical": numerical,
    "ranking": ranking,
    "tensor": tensor,
}


def _or_judged(again: Column, stored: Column) -> Callable[[Column], Column]:
    """Of a result: itself, or, where it has no score and an extraction is stored, the result of that."""

    def pick(r: Column) -> Column:
        judge = r["score"].isNull() & stored
        return bound(again, lambda a: F.struct(F.when(judge, F.coalesce(a["score"], F.lit(0.0))).otherwise(r["score"]).alias("score"), F.when(judge, a["parsed"]).otherwise(r["parsed"]).alias("parsed"), F.when(judge, F.lit("judge")).otherwise(r["provenance"]).alias("provenance")))

    return pick


def cascade(reply: Name, truth: Name, answer_format: Name, judged: Name | None = None) -> Column:
    """Dispatch by format. A reply that no layer reads is parsed again from the judge's extraction, where there is one."""
    none = F.lit(None).cast(RESULT)
    out = F
    for name, parser in PARSERS.items():
        own = parser(reply, truth).cast(RESULT)
        if judged is not None:
            own = bound(own, _or_judged(parser(judged, truth).cast(RESULT), col(judged).isNotNull())).cast(RESULT)
        out = out.when(col(answer_format) == name, own)
    unread = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("parsed"), F.lit("unparseable").alias("provenance")).cast(RESULT)
    return F.coalesce(out.otherwise(none), unread)


def evaluate(reply: Name, truth: Name, answer_format: Name) -> Column:
    """Dispatch of the eval profile; free text is left to judges, unknown formats must be equal."""
    f = col(answer_format)
    return (
        F.when(f == "free_form", F.lit(None).cast("double"))
        .when(f == "multiple_choice_single_select", eval_single(reply, truth))
        .when(f == "multiple_choice_multi_select", eval_multi(reply, truth))
        .when(f == "numerical", eval_numerical(reply, truth))
        .when(f == "ranking", eval_ranking(reply, truth))
        .when(f == "tensor", eval_tensor(reply, truth))
        .otherwise((col(reply) == col(truth)).cast("double"))
    )


def answer_format(level: Name, template_id: Name, template_type: Name, answer: Name, has_options: Name) -> Column:
    """Format of an item by level, type name and the answer's shape."""
    kind, a = F.lower(F.coalesce(col(template_type), F.lit(""))), F.trim(col(answer))
    top = F.when(col(template_id).isin(3, 4) | kind.contains("ranking"), F.lit("ranking")).otherwise(F.lit("free_form"))
    shape = (
        F.when(a.rlike("^[TF]{2,}$"), "multiple_choice_multi_select")
        .when(a.rlike("^[ABCD]{3,}$"), "ranking")
        .when(a.rlike("^[A-D]$") & col(has_options), "multiple_choice_single_select")
        .when(a.startswith("["), "tensor")
        .when(_number(a).isNotNull(), "numerical")
        .otherwise("free_form")
    )
    named = F.when(kind.contains("tensor"), "tensor").when(kind.contains("ranking"), "ranking")
    return F.when(col(level) == 4, top).otherwise(F.coalesce(named, shape))


def expected_chance(answer_format: Name, n: Name) -> Column:
    """Score of a blind guess under the eval profile; n: options or items."""
    f, n = col(answer_format), F.greatest(F.lit(1), F.coalesce(col(n), F.lit(4)))
    return F.when(f == "multiple_choice_single_select", 1 / n).when(f == "multiple_choice_multi_select", 0.5).when(f == "ranking", 1 / n).when(f.isin("tensor", "numerical"), 0.25).otherwise(0.0)


def chance_corrected(score: Name, chance: Name) -> Column:
    s, e = col(score), col(chance)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - e) / (1 - e)))  # these two skip nulls
    return F.when(s.isNotNull() & e.isNotNull(), F.when(e >= 1, (s >= 1).cast("double")).otherwise(inside))


def vote(scores: Name) -> Column:
    """Median of the votes that are not null, snapped to halves (half to even); null without votes."""
    v = F.array_sort(F.array_compact(col(scores)))
    n = F.size(v)
    mid = (F.try_element_at(v, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2
    return F.when(n == 1, F.try_element_at(v, F.lit(1))).when(n > 1, F.bround(mid * 2) / 2)


def verdict(text: Name) -> Column:
    """Score of a judge's reply: its JSON, in fences or not, else the first of 1, 0.5, 0; snapped to halves in 0..1; null if there is none."""
    bare = F.regexp_replace(col(text), r"```(?:json)?", "")
    found = F.coalesce(F.get_json_object(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), "$.score").try_cast("double"), _first(bare, r"(?<![\d.])(1(?:\.0)?|0\.5|0(?:\.0)?)(?![\d.])").try_cast("double"))
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(found * 2) / 2)))


def hash_split(key: Name, seed: int = 42, buckets: int = 10_000) -> Column:
    """sha256("seed:key") modulo buckets, exact: the digest is folded 32 bits at a time."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key)), 256)
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(limbs, F.lit(0).cast("long"), lambda acc, x: (acc * (1 << 32) + x) % buckets)


def split_name(bucket: Name, train: float = 0.8, validation: float = 0.1, buckets: int = 10_000) -> Column:
    b = col(bucket)
    return F.when(b < int(train * buckets), "train").when(b < int((train + validation) * buckets), "validation").otherwise("test")


#: Words without content.
STOPWORDS = tuple("""
the and for with that this from into onto are was were has have had but not any all you your its their they them his her our
out off via per than then when what which where who how such also yet may might could would should shall can will just more
most very much some few each every both either neither
""".split())

#: Fixed value: share of the gold tokens that counts as covered.
COVERED = 0.40


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def content_tokens(text: Name, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct lower-cased words of a letter and two or more word characters, without stop words; none for null."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([a-z][a-z0-9_-]{2,})"), F.lit(1))
    return F.coalesce(F.array_except(F.array_distinct(words), F.array(*map(F.lit, stopwords))), _no_texts())


def overlap(gold: Name, reply: Name) -> Column:
    """Share of the gold tokens that the reply has; 0 without gold tokens."""
    g = content_tokens(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, content_tokens(reply))) / F.size(g)).otherwise(F.lit(0.0))


def cause_words(cause: Name) -> Column:
    """Words of an identifier such as worn_belt, of three letters or more, without stop words."""
    words = F.filter(F.split(F.lower(col(cause)), r"[_\s-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.coalesce(words, _no_texts())


def cause_named(reply: Name, cause: Name) -> Column:
    """Whether the reply has the cause's identifier, or all its words."""
    text, words = F.lower(F.coalesce(col(reply), F.lit(""))), cause_words(cause)
    direct = (F.length(col(cause)) > 0) & text.contains(F.lower(col(cause)))
    return F.coalesce(direct, F.lit(False)) | ((F.size(words) > 0) & F.forall(words, lambda w: text.contains(w)))


def gold_numbers(text: Name) -> Column:
    """Distinct numbers of a text, signs kept, units left out."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+|°[CFK])?"), F.lit(1))
    return F.array_distinct(found)


def parameters(reply: Name, gold: Name) -> Column:
    """Struct (all_present, present, missing): which gold numbers stand in the reply; without gold numbers not all are present."""
    text, numbers = F.lower(F.coalesce(col(reply), F.lit(""))), gold_numbers(gold)
    present, missing = F.filter(numbers, lambda x: text.contains(x)), F.filter(numbers, lambda x: ~text.contains(x))
    return F.struct(((F.size(numbers) > 0) & (F.size(missing) == 0)).alias("all_present"), present.alias("present"), missing.alias("missing"))


def rubric(reply: Name, gold: Name, cause: Name, kind: Name, threshold: float = COVERED) -> Column:
    """Heuristic score of free text. troubleshooting: protocol covered 1, only the cause named a half. optimization: parameters and protocol 1, either a half. Other kinds: null."""
    covered, params = overlap(gold, reply) >= threshold, parameters(reply, gold)["all_present"]
    first = F.when(covered, 1.0).when(cause_named(reply, cause), 0.5).otherwise(0.0)
    second = F.when(params & covered, 1.0).when(params | covered, 0.5).otherwise(0.0)
    return F.when(F.lower(col(kind)) == "troubleshooting", first).when(F.lower(col(kind)) == "optimization", second)


def written_back(replies: DataFrame, scores: DataFrame, stem: str, model: str, overwrite: bool = False) -> DataFrame:
    """Replies with the rubric's scores in them, as later steps read them: score, rubric_score, llm_judge_score, llm_judge_reason, answer_format.

    replies: stem (level4_0083_83_answer), model, rubric_score and these columns; scores: question (the stem's first two
    parts), score, reason. Replies of the simple baseline, those with a rubric score (unless overwrite) and those without a
    question or a score stay as they are.
    """
    known = scores.select(F.col("question").alias("__q"), F.col("score").alias("__s"), F.col("reason").alias("__r"))
    out = replies.join(known, F.substring_index(stem, "_", 2) == F.col("__q"), "left")
    fresh = F.lit(True) if overwrite else F.col("rubric_score").isNull()
    hit = F.coalesce((F.col(model) != "baseline_simple") & F.col("__s").isNotNull() & fresh, F.lit(False))
    new = {"score": F.col("__s"), "rubric_score": F.col("__s"), "llm_judge_score": F.col("__s"), "llm_judge_reason": F.col("__r"), "answer_format": F.lit("free_form_rubric")}
    return out.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in replies.columns])


def question_of(file: Name) -> Column:
    """Struct (level, stem) of the question a reply's file answers: level4_0042_2_answer.json -> 4, level4_0042; null for other names."""
    stem = F.regexp_replace(F.regexp_replace(col(file), r"_answer\.json$", ""), r"_[^_]*$", "")
    level = F.regexp_extract(stem, r"^level(\d+)_", 1)
    return F.when(col(file).endswith("_answer.json") & (level != ""), F.struct(level.cast("int").alias("level"), stem.alias("stem")))


def question_text(question: Name, context: Name) -> Column:
    """The question asked, else the context's text; blank ones don't count."""
    said = lambda x: F.when(F.trim(col(x)) != "", col(x))
    return F.coalesce(said(question), said(context))


# judges' texts


def single_verdict(text: Name) -> Column:
    """Struct (score, reason) of one judge's reply: its JSON, in fences or not, clamped to 0..1, else the first of 1, 0.5, 0; the reason is cut to 300 characters."""
    raw = F.trim(F.coalesce(col(text), F.lit("")))
    bare = F.trim(F.when(raw.startswith("```"), F.regexp_replace(F.split_part(raw, F.lit("```"), F.lit(2)), r"^json", "")).otherwise(raw))
    own = F.get_json_object(bare, "$.score").try_cast("double")
    scanned = _first(bare, r"\b(1(?:\.0+)?|0\.5|0(?:\.0+)?)\b").try_cast("double")
    clamped = F.when(own.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), own)))
    reason = F.when(own.isNotNull(), F.coalesce(F.get_json_object(bare, "$.reason"), F.lit(""))).otherwise(bare)
    return F.struct(F.coalesce(clamped, scanned).alias("score"), F.substring(reason, 1, 300).alias("reason"))


def extracted(text: Name) -> Column:
    """What a judge read out of a reply: the first line with text, without fences and emphasis; null where it says NO_ANSWER or nothing."""
    bare = F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"^[`\s]+|[`\s]+$", "")
    line = F.try_element_at(F.filter(F.transform(F.split(bare, r"\r?\n"), F.trim), lambda x: x != ""), F.lit(1))
    return F.when(~F.upper(bare).contains("NO_ANSWER"), F.nullif(F.regexp_replace(line, r"^[*`\s]+|[*`\s]+$", ""), F.lit("")))


def expected_length(answer_format: Name, truth: Name) -> Column:
    """Numbers of a tensor, letters of a ranking or multi-select; null for other formats and empty truths."""
    f, t = col(answer_format), F.trim(col(truth))
    tensor_size = F.when(t.startswith("["), F.size(numbers_of(t))).otherwise(F.size(F.split(t, "_")))
    return F.when(F.length(t) > 0, F.when(f == "tensor", tensor_size).when(f.isin("multiple_choice_multi_select", "ranking"), F.length(t)))


def judge_prompt(templates: dict[int, str], template_id: Name, question: Name, reply: Name, reference: Name, cause: Name, most: tuple[int, int, int] = (6000, 8000, 2000)) -> Column:
    """A judge's prompt: the template of the id, filled with question, prediction, reference and root_cause, each cut to its bound; null for other ids."""
    cut = lambda x, n: F.substring(F.coalesce(col(x), F.lit("")), 1, n)
    asked = F.when(F.length(cut(question, most[0])) > 0, cut(question, most[0])).otherwise("(question text not available)")
    values = {"question": asked, "prediction": cut(reply, most[1]), "reference": cut(reference, most[2]), "root_cause": F.trim(F.coalesce(F.nullif(col(cause), F.lit("")), F.lit("(unspecified)")))}
    out = F
    for number, text in templates.items():
        filled = F.lit(text)
        for name, value in values.items():
            filled = F.replace(filled, F.lit("{" + name + "}"), value)
        out = out.when(col(template_id) == number, filled)
    return out.otherwise(F.lit(None).cast("string"))


def lacks_votes(votes: Name, judges: Sequence[str]) -> Column:
    """Whether one of the judges asked has no valid vote."""
    m = col(votes)
    return F.exists(F.array(*map(F.lit, judges)), lambda j: m.isNull() | F.try_element_at(m, j).isNull())
