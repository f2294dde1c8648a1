"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import bpe, dedup, jaccard, mixing, quality
from kinloom.plans.scratch import Scratch
from kinloom.plans.ship import ship

#: Entries that encoding remembers in a worker; executors that ran the other stages have less memory left for them.
KEEP = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and very short texts are among them. All columns
    stay, whatever their names; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the one of least doc_id, null last; of
    repeated rows exactly one. Null and empty texts are one group. An empty table stays empty."""
    return dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, the one of least doc_id of each group stays, null
    last; a text without words is linked with nothing and stays. An empty table stays empty."""
    return jaccard.dedup(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's copies: a document comes as often as its source's target asks, a trimmed copy with its first words
    only. Each shard is in one partition, in its shuffled order. Null sources are one source; texts without words have
    no copy; an empty table stays empty."""
    return mixing.in_shards(mixing.mixed_rows(docs, mixing.mix(docs))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with the digests of ids and decoded text; a null text is empty, a null doc_id is
    carried, other columns go, an empty table stays empty."""
    return bpe.encode(docs, keep_units=KEEP, keep_seams=KEEP)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: The stages sample, link documents transitively and tokenise: tests compare the operators of all of them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    s = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
