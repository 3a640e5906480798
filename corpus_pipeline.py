"""From raw documents to training shards, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`. Null texts and empty tables pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontaminate, mixing, quality, sharding, simhash
from trialspark.llm.common import prepare, table, written


def columns(docs: DataFrame) -> list:
    """The columns of `docs`, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judged(docs, table(prepare(spark), sf_dir, "labels"), carry=True)
    return judged.where("kept").select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates."""
    prepare(spark)
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontaminate.contamination(docs, table(prepare(spark), sf_dir, "benchmark"), prefix="_c_", offsets=False)
    return found.where(F.col("_c_n_hit") == 0).select(*columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    prepare(spark)
    return sharding.sharded(docs, carry=True)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated),
          ("mixing to target weights", mixed), ("sharding", sharded)]
#: Fingerprints (XXH64) and checksums (CRC-32) have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, in order; each result is written in the shared folder before the next stage reads it."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-stage-{k}")
    return docs
