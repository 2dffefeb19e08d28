"""Contexts, write-back and lookups by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import aggregates, contexts, generators


def test_drawn_windows_before_an_event(spark):
    rows = spark.createDataFrame([(e, i, 4 if i in (12, 13, 40) else 0) for e in range(80) for i in range(50)] + [(99, i, 1) for i in range(50)], "e long, i long, event int")
    got = contexts.drawn_before_event(rows, ["e"], "i", "event", 8, 20, 5).collect()
    assert {r.e for r in got} == set(range(80)) and {r.onset for r in got} == {12, 40}
    for r in got:
        assert r.start + r.length == r.onset and 8 <= r.length <= min(20, r.onset)
    assert len({r.length for r in got if r.onset == 40}) > 6  # every length, not the longest alone
    w = spark.createDataFrame([(1, 38, 4)], "e long, start long, length long")
    assert [(r.i, r.at) for r in contexts.remaining_rows(rows, w, ["e"], "i").orderBy("i").collect()] == [(i, i - 42) for i in range(42, 50)]


def test_streams_side_by_side(spark):
    df = spark.createDataFrame([(1, "B", ["x"]), (1, "A", ["p", "q", "r"]), (1, "C", None), (2, "A", [])], "k int, label string, lines array<string>")
    got = {r.k: r.streams for r in contexts.side_by_side(df, ["k"], "label", "lines").collect()}
    assert got == {1: {"A": ["p", "q", "r"], "B": ["x", "x", "x"], "C": []}, 2: {"A": []}}


def test_severity_segments_by_hand(spark):
    rows = [(1, "A", 3, ["a", "a"]), (1, "B", 1, ["b"]), (1, "C", 2, ["c"]), (2, "A", 1, ["a"]), (2, "B", 1, ["b"]), (2, "C", 2, ["c"]), (3, "A", 1, ["a"]), (3, "B", 2, []), (3, "C", 3, ["c"]), (4, "A", 1, ["a"]), (4, "B", None, ["b"]), (4, "C", 2, ["c"]), (5, "A", 1, ["a"])]
    got = contexts.severity_segments(spark.createDataFrame(rows, "k int, label string, rank int, lines array<string>"), ["k"], "label", "rank", "lines", size=3).collect()
    assert [(r.k, r.answer, r.options) for r in got] == [(1, "BCA", {"A": "a | a", "B": "b", "C": "c"})]


def test_troubleshooting_by_hand(spark):
    w = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, 5), (5, 9)], "e int, fault int")
    causes = spark.createDataFrame([(3, "worn belt", "replace it"), (5, "unknown", " "), (0, "nothing", "never")], "fault int, cause string, remedy string")
    got = {r.e: (r.root_cause, r.answer) for r in contexts.troubleshooting(w, causes, "fault", "cause", "remedy").collect()}
    assert got == {1: ("worn belt", "replace it"), 2: (None, contexts.NOTHING_WRONG), 3: (None, contexts.NOTHING_WRONG)}


def test_severity_ranks_by_hand(spark):
    texts = ['{"ranking_least_to_most_severe": [{"fault_id": 7, "rank": 1}, {"fault_id": 2.0, "rank": 5}, {"rank": 3}, {"fault_id": 4}, {"fault_id": 7, "rank": 9}]}', "[]", "broken {", None, '{"other": 1}']
    got = contexts.severity_ranks(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert sorted((r.fault_id, r["rank"]) for r in got) == [(2, 5), (7, 9)]


def test_simulated_rows_by_hand(spark):
    rows = [("a", "2.5", "0", "ignored", "move"), ("a", "2.75", "16.0", " v=3 ", "grip"), ("a", "3.0", "4", None, None), ("a", "x", "word", "", "end"), ("b", "0.0", None, None, "s")]
    df = spark.createDataFrame(rows, "k string, sim_time_s string, event_id string, event_params string, task_phase string")
    got = [(r.k, r.timestamp_ms, r.event, r.fault_label, r.task_phase) for r in contexts.simulated_rows(df, ["k"]).collect()]
    assert sorted(got, key=repr) == sorted([("a", 0, None, 0, "move"), ("a", 250, "16_v=3", 16, "grip"), ("a", 500, "4", 4, None), ("a", None, None, 0, "end"), ("b", 0, None, 0, "s")], key=repr)
    assert contexts.simulated_rows(df.drop("event_params", "task_phase"), ["k"]).where("event = '16'").count() == 1


@pytest.mark.parametrize("overwrite", [False, True])
def test_rubric_write_back(spark, overwrite):
    rows = [("level4_01_3_answer", "m", None, "a"), ("level4_01_3_answer", "m", 0.1, "b"), ("level4_01_3_answer", "baseline_simple", None, "c"), ("level4_02_1_answer", "m", None, "d"), ("level4_09_1_answer", "m", None, "e")]
    replies = spark.createDataFrame([(*r[:3], 0.2, None, None, "free_form", r[3]) for r in rows], "stem string, model string, rubric_score double, score double, llm_judge_score double, llm_judge_reason string, answer_format string, tag string")
    scores = spark.createDataFrame([("level4_01", 0.75, "why"), ("level4_02", None, None)], "question string, score double, reason string")
    out = scoring.written_back(replies, scores, "stem", "model", overwrite)
    got = {r.tag: (r.score, r.rubric_score, r.llm_judge_score, r.llm_judge_reason, r.answer_format) for r in out.collect()}
    new, old = (0.75, 0.75, 0.75, "why", "free_form_rubric"), (0.2, None, None, None, "free_form")
    assert got == {"a": new, "b": new if overwrite else (0.2, 0.1, None, None, "free_form"), "c": old, "d": old, "e": old} and out.columns == replies.columns


def test_questions_of_replies(spark):
    names = {"level4_0042_2_answer.json": (4, "level4_0042"), "level4_6f1c2a00-0000_7_answer.json": (4, "level4_6f1c2a00-0000"), "level4_0042_2.json": None, "other_1_2_answer.json": None, "level12_1_2_answer.json": (12, "level12_1")}
    got = {r.f: r.q for r in spark.createDataFrame([(n,) for n in names], "f string").select("f", scoring.question_of("f").alias("q")).collect()}
    assert {k: None if v is None else (v.level, v.stem) for k, v in got.items()} == names
    texts = spark.createDataFrame([("q", "c"), (" ", "c"), (None, "c"), (None, " ")], "q string, c string").select(scoring.question_text("q", "c").alias("x")).collect()
    assert [r.x for r in texts] == ["q", "c", "c", None]


def test_feature_keys_and_totals(spark):
    rows = [(i, {"timestamp_ms": 1.0, "b": 2.0, "a": 1.0, "gone": None}) for i in range(40)] + [(100, {"event": 1.0}), (101, None), (102, {})]
    got = {r.i: r.k for r in spark.createDataFrame(rows, "i int, m map<string,double>").select("i", generators.feature_key("m", ["i"]).alias("k")).collect()}
    assert {got[i] for i in range(40)} == {"a", "b"} and {got[i] for i in (100, 101, 102)} == {"feature_0"}
    totals = aggregates.run_totals(spark.createDataFrame([("3", None, "x"), ("4", "1", None)], "completed string, failed string, skipped string")).first()
    assert tuple(totals) == (7, 1, 0) and tuple(aggregates.run_totals(spark.createDataFrame([], "completed string, failed string, skipped string")).first()) == (0, 0, 0)
