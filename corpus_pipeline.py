"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. A stage's docstring says which rows go.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language_id, line_dedup, simhash_dedup
from tidemark.llm.common import Scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those between two languages; `lang` stays as it came."""
    model = language_id.fit(*language_id.training_sample(docs.where(~language_id.held_out())))
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near-equal to an earlier one are cut; documents that lose all their lines go."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of five-word shingles, or of Jaccard similarity 0.8 or more, the one of smallest id stays."""
    return simhash_dedup.one_per_class(docs, words=5, similar=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and whether decoding them gives the text again."""
    out = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), round_trip="round_trip")
    return out.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", tokenize),
]

#: SQL has no learned language, union-find, or tokenizer; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
