"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat_format, decontaminate, html_extract, id_store, language_id, license_scan, line_dedup, merkle, quality_rules, sharding, simhash_dedup, vector_codes
from tidemark.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]

CONTROL_CHAT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CHAT, turns.schema)
    return chat_format.digest_chats(chat_format.format_chats(turns.union(more)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(*language_id.training_sample(docs.where(~language_id.held_out())))
    return language_id.identify(docs, model, ["doc_id"]).withColumn("held_out", language_id.held_out())


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark).keep(quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = quality_rules.learn(*quality_rules.as_arrays(stats.join(labels, "doc_id")))
    failed, rule = quality_rules.base_failed(), quality_rules.verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, vocabulary = Scratch(spark).path("store"), public_tokenizers.path("byte_bpe_50k.json")
    id_store.write(table(spark, sf_dir, "documents"), where, vocabulary)
    return id_store.read_digests(spark, where, vocabulary)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = vector_codes.with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    meta = docs.select("doc_id", "lang", "source", "n_chars", sharding.text_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard(meta, shards=8, size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    c = F.col
    fields = lambda text: [c("doc_id"), c("source"), c("lang"), c("n_chars"), text]
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_digest(fields(tampered)))
    return merkle.prove(merkle.build(docs, fields(c("text")), changed=changed)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_id_store": op9_id_store,
    "op10_html_extract": op10_html_extract,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_merkle": op13_merkle,
}

def _lloyd_sql(rounds: int) -> str:
    """SQL of op11's codebooks and codes; each round is a pair of tables."""
    near = "SELECT p.rid, p.p, arg_min(b.e, b.e + 64 * {d}) AS code, min({d}) AS err FROM parts p JOIN b{i} b USING (p) GROUP BY p.rid, p.p"
    d = "CAST(list_sum(list_transform(list_zip(p.part, b.entry), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT)"
    out = [
        r"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        "w AS (SELECT CAST(ceil(max(len(ints)) / 16) AS BIGINT) AS w FROM kept)",
        """parts AS MATERIALIZED (SELECT rid, p, list_slice(list_concat(ints, list_transform(range(16 * w - len(ints)), lambda x: CAST(0 AS BIGINT))), p * w + 1, p * w + w) AS part
  FROM kept, w, (SELECT unnest(range(16)) AS p))""",
        "b0 AS (SELECT p, rid AS e, part AS entry FROM parts WHERE rid < 64)",
    ]
    for i in range(rounds):
        out += [
            f"n{i} AS MATERIALIZED ({near.format(d=d, i=i)})",
            f"""m{i} AS (SELECT p, code, list(m ORDER BY j) AS entry FROM (
    SELECT n.p, n.code, j, CAST(floor(sum(p.part[j]) / count(*)) AS BIGINT) AS m FROM n{i} n JOIN parts p USING (rid, p), w, (SELECT unnest(range(1, 1 + (SELECT w FROM w))) AS j) GROUP BY n.p, n.code, j) GROUP BY p, code)""",
            f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.code = b.e)",
        ]
    return "WITH " + ",\n".join([*out, f"n{rounds} AS MATERIALIZED ({near.format(d=d, i=rounds)})"]) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN (SELECT rid, string_agg(lower(lpad(hex(code), 2, '0')), '' ORDER BY p) AS code, CAST(sum(err) AS BIGINT) AS error FROM n{rounds} GROUP BY rid) USING (rid)"""


_OP11 = _lloyd_sql(2)


def _merkle_sql(low: int, high: int) -> str:
    """SQL of op13 for groups of up to 16**low rows and up to 16**high groups: each level is a table, each proof a chain of joins."""
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"
    said = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({said('doc_id')} || {said('source')} || {said('lang')} || {said('n_chars')} || {said(text)})"
    out = [f"""d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)""",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d)",
        "a0 AS (SELECT tree, k, leaf AS h FROM l)"]

    def climb(name: str, levels: int) -> None:
        for i in range(levels):
            # a tree of one node is done: its root is carried up as it is
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT tree, k // 16 AS k, CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i}) GROUP BY tree, k // 16)")
            out.append(f"{name}r{i} AS MATERIALIZED (SELECT tree, k, CASE WHEN count(*) OVER (PARTITION BY tree) = 1 THEN NULL ELSE list(h) OVER (PARTITION BY tree, k // 16 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS run FROM {name}{i})")

    climb("a", low)
    out.append(f"s AS MATERIALIZED (SELECT tree, row_number() OVER (ORDER BY tree COLLATE \"C\") - 1 AS k, h FROM a{low})".replace(' COLLATE "C"', ""))
    out.append("b0 AS (SELECT '' AS tree, k, h FROM s)")
    climb("b", high)
    fold = lambda h, run, k: f"CASE WHEN {run} IS NULL THEN {h} ELSE sha256(array_to_string(list_concat(list_concat({run}[:{k} % 16], [{h}]), {run}[{k} % 16 + 2:]), '')) END"
    others = lambda run, k: f"coalesce(array_to_string(list_concat({run}[:{k} % 16], {run}[{k} % 16 + 2:]), ''), '')"
    out.append("f0 AS (SELECT l.*, coalesce(changed, leaf) AS fold, '' AS proof, l.k AS up, s.k AS sat, s.h AS subroot FROM l JOIN s USING (tree))")
    last = 0
    for name, i, k, key in [*[("a", i, "up", "f.tree = r.tree AND f.up = r.k") for i in range(low)], *[("b", i, "sat", "f.sat = r.k") for i in range(high)]]:
        out.append(f"f{last + 1} AS MATERIALIZED (SELECT f.* REPLACE ({fold('f.fold', 'r.run', 'f.' + k)} AS fold, f.proof || {others('r.run', 'f.' + k)} AS proof, f.{k} // 16 AS {k}) FROM f{last} f JOIN {name}r{i} r ON {key})")
        last += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified FROM f{last}, b{high} b"


_OP13 = _merkle_sql(5, 3)

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, 'start') AS prev FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, len(regexp_extract_all(role || chr(0) || text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]')) AS marks,
    (prev, role) IN (('start','system'), ('start','user'), ('system','user'), ('user','assistant'), ('assistant','user')) AS ok
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars,
  bool_and(ok) AND arg_max(role, i) = 'assistant' AS valid
FROM m GROUP BY conv_id""",
    "op11_vector_codes": _OP11,
    "op13_merkle": _OP13,
}
