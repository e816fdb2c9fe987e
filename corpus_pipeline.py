"""A corpus pipeline: quality, near copies, benchmark passages, mixture, shards.

Each stage takes what the one before kept; ``run`` applies all of them to ``documents``. Stages
return the columns of documents; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm import mixing, quality, sharding
from panelgrid.llm.decontaminate import decontaminate
from panelgrid.llm.frames import fresh, materialize
from panelgrid.llm.near_dedup import drop_near_duplicates

#: Model scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
SHARDS = 24
#: Words of the mixture in percent of the words that reach it.
MIX_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, 5, 80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights; a row of two epochs is there twice."""
    epoch = fresh(docs, "epoch")
    return mixing.mix_documents(docs, MIX_PERCENT, epoch=epoch).drop(epoch)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it; columns of these names are replaced."""
    placed = docs.withColumn("shard", sharding.jump_shard(F.col("doc_id"), SHARDS))
    return sharding.number_slots(placed, "shard", ["doc_id"])


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
