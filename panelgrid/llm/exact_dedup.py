"""Exact dedup by a 128-bit content hash; inside its groups the bytes themselves are compared.

Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

WHITE_SPACE = r"[\x20\x09-\x0D]"


#: Bits of the map of repeated hashes, 16 MB at most; a bit that stands for several hashes only lets more texts through.
SLOTS, BITS_OF_A_MAP = 1 << 27, 1 << 15


def without_white_space(text: Column) -> Column:
    """The text less ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _slot(content_hash: str) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(SLOTS))


def maybe_repeated(texts: DataFrame, repeated: DataFrame, content_hash: str) -> DataFrame:
    """The rows of ``texts`` whose hash is marked in a map of the ``repeated`` hashes.

    The map's size is fixed, so it may be broadcast however many hashes there are, and the plan is
    the same at any size.
    """
    maps = repeated.select(_slot("content_hash").alias("slot")).groupBy(F.expr(f"slot div {BITS_OF_A_MAP}").alias("map_number")).agg(
        F.expr(f"bitmap_construct_agg(slot % {BITS_OF_A_MAP})").alias("map_bits"))
    number, bits, slot = (fresh(texts, n) for n in ("map_number", "map_bits", "slot"))
    maps = maps.select(F.col("map_number").alias(number), F.col("map_bits").alias(bits))
    marked = texts.withColumn(slot, _slot(content_hash)).withColumn(number, F.expr(f"{slot} div {BITS_OF_A_MAP}"))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({slot} % {BITS_OF_A_MAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr(f"shiftleft(1, cast({slot} % 8 as int))")
    return marked.join(F.broadcast(maps), number).where(byte.bitwiseAND(is_set) != 0).select(*texts.columns)


def content_groups(candidates: DataFrame) -> DataFrame:
    """One stored row per different content of (content_hash, content, points, doc_key): the row that stays
    and the group's size.

    Rows are grouped by hash and by the bytes, so contents that collide are groups of their own. Copies are combined
    before the shuffle: a group of any size sends one row per task. ``contents`` is the number of
    different contents under the hash, one unless it collides.
    """
    groups = candidates.groupBy("content_hash", "content").agg(
        F.min(F.struct((-F.col("points")).alias("points"), F.isnull("doc_key").alias("no_key"), "doc_key"))
        .getField("doc_key").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = materialize(groups, "content-groups")
    contents = groups.groupBy("content_hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    return groups.join(contents, "content_hash", "left").withColumn("contents", F.coalesce("contents", F.lit(1)))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after deleting ASCII white space; null and empty texts are
    one group. The row with the most code points in its original text stays, the smallest key
    among ties. Rows that repeat a key and a text are copies like others; those that carry the
    key that stays all say ``kept``. A null key loses ties against any other.
    Other columns are ignored, whatever their names; texts are read whole; no rows give no rows.

    Only texts whose hash occurs again, by a map of bits, are shuffled to be compared. Documents then find
    their group by the hash, where it has one content, else by the content. Groups are stored first, so that
    the joins are plain ones, which Spark splits where a group is large.
    """
    hashed, content = fresh(docs, "content_hash"), fresh(docs, "content")
    texts = docs.withColumn(content, without_white_space(F.col(text))).withColumn(hashed, F.md5(content))
    marks = materialize(texts.select(
        F.col(key).alias("doc_key"), F.col(hashed).alias("content_hash"), F.sha2(F.col(content), 256).alias("text_sha256")), "hashes")
    counted = marks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("n > 1").select("content_hash"), "repeated")
    candidates = materialize(maybe_repeated(texts.select(
        F.col(hashed).alias("content_hash"), F.col(content).alias("content"), F.col(key).alias("doc_key"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
    ), repeated, "content_hash"), "candidates")
    groups = materialize(content_groups(candidates), "groups")
    found = ["doc_key", "keep_id", "group_size", "text_sha256"]

    whole = groups.where("contents = 1").select("content_hash", "keep_id", "group_size")
    collided = groups.where("contents > 1")
    by_hash = marks.join(collided.select("content_hash").distinct(), "content_hash", "left_anti").join(
        whole, "content_hash", "left").select(
        "doc_key", F.when(F.col("group_size").isNull(), F.col("doc_key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    by_content = candidates.join(collided, ["content_hash", "content"]).withColumn(
        "text_sha256", F.sha2("content", 256)).select(*found)
    return by_hash.unionByName(by_content).select(
        F.col("doc_key").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
