"""Corpus preparation: language ID, near-duplicates, benchmark leaks, source mixing, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of ``docs`` (the
last one has a ``shard`` column more). ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubspark.llm import decontam, langid, mixing, queries, sharding, simhash
from scrubspark.llm.common import semi_filter, table
from scrubspark.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go, and those whose language is in doubt."""
    return langid.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within the edit bound, go; fewer than five words are no evidence."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each leaf's token budget, from one epoch: none comes twice."""
    chosen = mixing.mix(docs, queries.domain_of_source(), queries.MIX_WEIGHTS, queries.MIX_BUDGET_PERCENT, 1,
                        queries.MIX_SEED)
    return semi_filter(docs, chosen)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the shard it belongs to."""
    return sharding.shard(docs, queries.SHARD_BYTES)


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_duplicates),
          ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express the learned stage. Tests hold near-duplicates, benchmark leaks and shards against brute force;
#: of language and mixing they check properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
