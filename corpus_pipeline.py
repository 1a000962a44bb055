"""A training corpus from `documents`: language, exact and near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import save, scratch, table
from corpusloom.llm.exact_dedup import drop_copies
from corpusloom.llm.langid import UNDETERMINED, identify, sample
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.pii import pii_redacted
from corpusloom.llm.simhash import keep_one_a_group

#: Characters that a packing task encodes at once; its worker still holds what earlier stages left there.
CHARS_AT_ONCE = 5_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without text or letters go."""
    return identify(docs, sample(docs)).filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart), the document with the least doc_id."""
    return drop_copies(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of 5-word shingles alike to 0.8 or more), the document with the least doc_id."""
    return keep_one_a_group(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced by their kinds; n_chars follows the text."""
    redacted = docs.withColumn("_text", pii_redacted(F.col("text")))
    n = F.when(F.col("_text") == F.col("text"), F.col("n_chars")).otherwise(F.length("_text").cast("long"))
    return redacted.withColumn("n_chars", n).withColumn("text", F.col("_text")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), chars_at_once=CHARS_AT_ONCE)


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]

#: Cross-parsing, SimHash and packing have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
