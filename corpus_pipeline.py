"""From documents to packed sequences: the stages, each written and read again before the next.

Documents with null, empty or wordless text fail the quality rules; very long ones are judged, compared, redacted and packed whole. Repeated rows and rows of one id
with different texts are documents of their own until near duplicates go: of the rows of a group that of the least id stays (rows without id
come last), then that of the least hash of its text, so ties are settled alike in each run. Nulls in other columns change nothing; other columns,
whatever their names, come along until packing; empty tables give empty results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirework.llm import near_dedup, packing, pii, quality
from quirework.scratch import keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns. Null, empty and wordless texts fail; very long ones are judged whole; repeated rows and ties are judged
    alike; without labels the base rules alone decide."""
    return quality.filter_documents(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), all columns: that of the least id. Texts without
    words all stay, repeated rows become one, very long texts are compared whole."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with personal data and what gives it away replaced in their texts. Null texts stay null, ``n_chars`` follows the text, repeated rows stay."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens. Null text counts as empty (one end token), very long texts give several pieces,
    repeated rows a set of pieces each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL can express neither the hashed models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are kept in the shared folder (``scratch.cleared`` deletes them once the result is written)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
