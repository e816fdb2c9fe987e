"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import materialize


def _toward_least(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links of each node's neighbours to the least node around it.

    Large star (both ways): neighbours greater than the node link to the least of all.
    Small star: the node and its lesser neighbours link to the least of these.
    """
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = around.join(least, "a")
    if both_ways:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.where("a <> m").select("a", F.col("m").alias("b"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (a, b); the component is its least node.

    Every round sends one least node per node and task to the shuffle, and joins that Spark may
    split where a node has many links; nothing is collected. The links of a round are stored in
    the shared folder. Rounds end when links no longer change, after about the logarithm of
    the longest path. Loops are left out, so a node linked only with itself is not listed.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(most_rounds):
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                        F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).first()
        if now == before or not now["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
        links = materialize(_toward_least(_toward_least(links, True), False), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
