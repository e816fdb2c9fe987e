"""Sharding by jump consistent hashing.

A key's shard is computed from the key and the number of shards alone, without a ring table;
one more shard takes rows only into itself, a share of 1 / (shards + 1) in expectation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; every round moves the keys that jump once more."""
    keys = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        shard[moving] = ahead[moving]
        keys[moving] = keys[moving] * STEP + np.uint64(1)
        spread = (keys[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((shard[moving] + 1) * (2147483648.0 / spread)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key column of any type, from 0 to ``shards - 1``.

    The key's text is hashed first, so keys need not be numbers or well spread. A null key
    counts as the empty text. Equal keys always share a shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.arrow_udf("int")
    def shard_of(hashed: pa.Array) -> pa.Array:
        return pa.array(jump_hash(hashed.to_numpy(zero_copy_only=False).view(np.uint64), shards), pa.int32())

    return shard_of(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))))


def number_slots(df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in the given order.

    Rows are range-partitioned by group and order, so a large group is spread over many tasks;
    a row's number is its place in its partition less the group's first place there, plus the
    group's rows in earlier partitions. Only one count per group and partition is summed in
    order. A last range key keeps rows that are equal in group and order splittable. Nulls sort
    first. An empty frame gives an empty one; a column called ``slot`` is replaced.
    """
    df = df.drop(slot)
    part, place, tie = fresh(df, "part"), fresh(df, "place"), fresh(df, "tie")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(tasks, group, *order, tie)
        .sortWithinPartitions(group, *order, tie)
        .drop(tie)
        .withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    stored = materialize(ranged, "slots")
    same = F.col(f"c.{group}").eqNullSafe(F.col(f"d.{group}"))
    counts = stored.groupBy(group, part).agg(
        F.count(F.lit(1)).alias("rows_here"), F.min(place).alias("first_here"))
    earlier = F.coalesce(F.sum("rows_here").over(
        Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, part, (earlier - F.col("first_here")).alias("shift"))
    return stored.alias("d").join(counts.alias("c"), same & (F.col(f"c.{part}") == F.col(f"d.{part}"))).select(
        *[F.col(f"d.{c}") for c in df.columns],
        (F.col(f"d.{place}") + F.col("c.shift")).alias(slot),
    )


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's shard, its slot there and its shard when one more is appended.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard``. A null text has size 8 and the checksum of no
    bytes. Rows that share a key share a shard and get different slots. Slots follow the key.
    """
    lean = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return number_slots(lean, "shard", [key, "text_crc32"])


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Writes one folder per shard; a shard is written by many tasks, one file each."""
    df.write.partitionBy(shard).parquet(path)
