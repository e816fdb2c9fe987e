"""Small frame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.session import materialize

__all__ = ["fresh", "materialize", "sampled", "with_block_pairs"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so helper columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sampled(key: Column, wanted: int, total: int, seed: int = 0) -> Column:
    """True for about ``wanted`` of ``total`` rows, chosen by a hash of ``key``.

    A statement about the key alone: the same rows whatever the partitioning, no sort, no cap.
    """
    if total <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * wanted / total)


def with_block_pairs(df: DataFrame, group: list[str], item: str, weight: str, limit: int) -> DataFrame:
    """Rows of each group dealt to tasks that together see every pair of the group.

    Adds ``first_block`` and ``second_block``. A group whose weights sum to at most ``limit``
    is one task (0, 0). A heavier one is cut into blocks by a hash of ``item``, and a row goes
    to each task that pairs its block with another one, so no task holds an unbounded group.
    """
    totals = df.groupBy(*group).agg(
        F.ceil(F.sum(weight) / limit).cast("int").alias("block_count"), F.count(F.lit(1)).alias("group_rows")
    ).where("group_rows > 1")
    own = F.pmod(F.xxhash64(item), F.col("block_count")).cast("int")
    return (
        df.join(totals.drop("group_rows"), group)
        .withColumn("own_block", own)
        .withColumn("other_block", F.explode(F.expr(
            "if(block_count = 1, array(0), filter(sequence(0, block_count - 1), b -> b <> own_block))")))
        .withColumn("first_block", F.least("own_block", "other_block"))
        .withColumn("second_block", F.greatest("own_block", "other_block"))
        .drop("block_count", "own_block", "other_block")
    )
