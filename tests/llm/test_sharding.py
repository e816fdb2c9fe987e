from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelgrid.llm import sharding


def plain_jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys.copy(), shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(2).integers(0, 2**64, 20_000, dtype=np.uint64)
    before, after = sharding.jump_hash(keys.copy(), 24), sharding.jump_hash(keys.copy(), 25)
    assert set(after[before != after].tolist()) == {24}
    assert 0.03 < (before != after).mean() < 0.05
    assert np.bincount(before).min() > 700


def test_query(documents, result):
    rows, slots = result("op1_sharding"), defaultdict(list)
    for doc, text, _ in documents:
        row, data = rows[doc], (text or "").encode()
        assert (row["size"], row["text_crc32"], row["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert row["grown_shard"] in (row["shard"], 24)
        slots[row["shard"]].append(row["slot"])
    assert len(rows) == len(documents) and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_of_one_key_that_holds_most_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("shard"), F.lit(None).cast("long").alias("doc_id"), "id")
    rows = sharding.number_slots(df.withColumn("slot", F.lit("old")), "shard", ["doc_id"]).collect()
    for shard in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(1000))


def test_odd_rows(odd, none):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 12 and {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {8}
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(none).collect() == []


def test_written_shards(spark, odd, tmp_path):
    placed = odd.withColumn("shard", sharding.jump_shard(F.col("doc_id"), 3))
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
