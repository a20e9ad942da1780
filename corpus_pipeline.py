"""A corpus pipeline of five stages over ``documents``: rules, near-duplicates, benchmarks, mix, shards.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last return
the columns of ``documents``; the last adds the shard of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandworks.llm import decontaminate, minhash, mixing, quality_rules, sharding
from strandworks.llm.common import materialize, table


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fences of their language and source.

    Null, empty and word-less texts go; null lang and source are groups of their own; repeated rows stay or go together.
    """
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component.

    The one with the least doc_id stays, of its repeated rows one; texts without words and rows without an id stay.
    """
    return minhash.deduplicate(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times.

    Texts without words are not taken; a null source is one of its own; rows of one id and length move together.
    """
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard.

    Rows of one id share a shard; null texts have 0 bytes; a text beyond the limit is marked ``oversized``, not split.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix_sources", stage_mix),
    ("shard", stage_shard),
]

#: The components of near-duplicates take an open number of steps over all pairs; tests compare the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
