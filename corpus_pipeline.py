"""A training-data pipeline of five operators; each stage reads what its predecessor kept, written as Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity
from cadenza.llm.queries import tokenizer


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, with all their columns; null and empty texts have the score of no terms.

    An empty table stays empty; without labels all documents have one score."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, a null one being smaller than any; of rows alike in both one.
    Null is the empty text, of which one document stays, too."""
    return exact_dedup.drop_exact_duplicates(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; documents without words or doc_id stay."""
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, the null source being one; documents that it does not take go."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document taken, and of the text decoded from them; a null text has no ids."""
    return bpe.bpe_digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("bpe", encoded)]

#: The classifier and the mix have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; the last one's result. What a stage has written goes when the next one has read it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
