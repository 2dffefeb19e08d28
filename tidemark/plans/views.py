"""The driver tables seen as telemetry, axes, items and replies; Spark and SQL forms side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import epoch_ms
from tidemark.operators.sequence import with_seq
from tidemark.sources.tables import table

ROBOT = """t AS (
  SELECT user_id AS episode_id, event_id, epoch_us(ts) // 1000 AS ms, value, event_type,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fault, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
  FROM events)"""

AXES = """a AS (
  SELECT l_suppkey AS episode_id, l_quantity AS v0, l_extendedprice / 1000 AS v1, l_quantity * (1 - l_discount) AS s0,
    l_extendedprice * (1 - l_tax) / 1000 AS s1, l_discount * 100 AS e0, l_tax * 100 AS e1, l_extendedprice / 1000 AS contact,
    l_quantity AS robot_current, CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 3 ELSE 1 END AS safety,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS seq
  FROM lineitem)"""

#: Replies made from parts, in expressions that both engines read alike.
_LETTER = "substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1)"
_KIND = "CAST(p_partkey % 12 AS INT)"
REPLY_COLUMNS = {
    "item_id": "p_partkey",
    "model": "concat('model_', CAST(p_partkey % 3 AS VARCHAR(9)))",
    "level": "CAST(p_size % 4 AS INT) + 1",
    "answer_format": f"CASE WHEN {_KIND} < 3 THEN 'multiple_choice_single_select' WHEN {_KIND} < 5 THEN 'multiple_choice_multi_select' WHEN {_KIND} < 7 THEN 'numerical' WHEN {_KIND} < 9 THEN 'ranking' WHEN {_KIND} < 11 THEN 'tensor' ELSE 'free_form' END",
    "truth": f"CASE WHEN {_KIND} < 3 THEN 'B' WHEN {_KIND} < 5 THEN 'TFFT' WHEN {_KIND} < 7 THEN '10' WHEN {_KIND} < 9 THEN 'ABCD' WHEN {_KIND} < 11 THEN '1_2' ELSE p_name END",
    "reply": f"""CASE {_KIND} WHEN 0 THEN concat('I think it is **', {_LETTER}, '** as said.') WHEN 1 THEN concat('It drew 0.38 A. Answer: ', {_LETTER})
        WHEN 2 THEN concat('the correct answer is ', {_LETTER}, '.') WHEN 3 THEN 'Answer: TFFF' WHEN 4 THEN 'ttff' WHEN 5 THEN CAST(p_size AS VARCHAR(9))
        WHEN 6 THEN concat('Answer: ', CAST(p_size AS VARCHAR(9)), ' mm') WHEN 7 THEN 'BDCA' WHEN 8 THEN 'so **ABDC**' WHEN 9 THEN 'Answer: [1.0, 2.0]' WHEN 10 THEN '1.0_2.5' ELSE p_type END""",
}
REPLIES = "r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REPLY_COLUMNS.items()) + f", {_KIND} AS kind, {_LETTER} AS letter, p_size FROM part)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an episode per user: episode_id, event_id, ms, value, event_type, fault, k, seq."""
    e = table(spark, sf_dir, "events").withColumn("ms", epoch_ms("ts"))
    rows = e.select(F.col("user_id").alias("episode_id"), "event_id", "ms", "value", "event_type", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("fault"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    return with_seq(rows, ["episode_id"], ["ts", "event_id"]).drop("ts")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an episode per supplier with two axes."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("episode_id"), c("l_quantity").alias("v0"), (c("l_extendedprice") / 1000).alias("v1"), (c("l_quantity") * (1 - c("l_discount"))).alias("s0"),
        (c("l_extendedprice") * (1 - c("l_tax")) / 1000).alias("s1"), (c("l_discount") * 100).alias("e0"), (c("l_tax") * 100).alias("e1"), (c("l_extendedprice") / 1000).alias("contact"),
        c("l_quantity").alias("robot_current"), F.when((c("l_returnflag") == "R") & (c("l_suppkey") % 2 == 0), 3).otherwise(1).alias("safety"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    return with_seq(rows, ["episode_id"], order).drop(*order)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(*[F.expr(e.replace("VARCHAR(9)", "STRING")).alias(c) for c, e in REPLY_COLUMNS.items()], "p_size")
