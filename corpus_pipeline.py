"""A training corpus from raw documents: five stages, each working on all that the one before kept.

Every stage takes documents (doc_id: integers, text, lang, source, n_chars, and any further columns, whatever they are called)
and reads no other column than it names. An empty table gives an empty result. All but the last return the columns they got. All but
the first begin by having the executors give back the heap that the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orespark.llm.bpe import bpe_encode
from orespark.llm.common import collect_garbage, delete, scratch, table, write_down
from orespark.llm.decontaminate import decontaminated
from orespark.llm.langid import known_language
from orespark.llm.ngram_join import one_of_each
from orespark.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown, or told with a probability under 0.5, go: null and empty texts, and those without a
    letter, among them. Null ids and languages and repeated rows stay if their text does."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once; of rows that share an id, one. Rows without an
    id and documents without words stay."""
    collect_garbage(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; repeated rows and null ids are judged like
    all others."""
    collect_garbage(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. No row goes; null texts stay null, empty ones empty."""
    collect_garbage(spark)
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row's text; null and empty texts have none."""
    import public_tokenizers

    collect_garbage(spark)
    encoded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=False)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can't express the first stage's model; tests/llm/test_stages.py holds each stage against a plain version of itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after each other. Each result is written down; the one before and what the stage wrote besides are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, folder = write_down(stage(spark, docs, sf_dir), name)
        if before:
            delete(spark, before)
        before = folder
    return docs
