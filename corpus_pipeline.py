"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
Results are written as Parquet and read again between stages, so that a lost executor
never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphrake.llm import mixing, packing, simhash, substrings, toxicity
from glyphrake.llm.common import materialize, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    return simhash.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words or more that an earlier document has go; documents left empty go."""
    ship(spark)
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken and repeated so that sources meet their target weights, in curriculum order."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens, which follow the order of the documents."""
    ship(spark)
    return packing.pack_documents(docs, in_order=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeated_passages", cut_repeats), ("source_mix", mix), ("packing", pack)]
#: SQL has no classifier, fingerprints or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
