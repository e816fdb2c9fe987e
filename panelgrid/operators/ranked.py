"""Running totals over globally ordered values, without a single-task sort.

Rows are first reduced to one per distinct value. Spark's range partitioning deals them to
tasks by value, and each task's number is stored with its rows. A running total is the total of
all earlier tasks, one row per task, plus the total within the task. Where the ranges begin
affects only balance; the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.session import materialize

BUCKET = "_bucket"
ROWS_PER_TASK = 50_000
#: Accuracy of the sketch that brackets a rank: an error of one in so many ranks.
SKETCH = 10_000
#: So many values may be told apart at once; a bracket with more is narrowed first.
FEW = 20_000


def with_running_totals(
    df: DataFrame,
    order: str,
    totals: Sequence[str],
    groups: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Adds ``{c}_before``: the sum of ``c`` over rows of the group ordered earlier.

    ``df`` has one row per group and ordered value; callers store it first, which also makes
    counting it free. The number of ranges follows the row count, so one task sorts a bounded
    share of the values however many there are.
    """
    tasks = tasks or max(1, math.ceil(df.count() / ROWS_PER_TASK))
    ranged = df.repartitionByRange(tasks, order).withColumn(BUCKET, F.spark_partition_id())
    bucketed = materialize(ranged, "ranges")
    keys = [*groups, BUCKET]
    per_bucket = bucketed.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    by_bucket = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = by_bucket.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in totals],
    )
    within = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return bucketed.join(offsets, keys).select(
        *df.columns,
        *[
            (F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before")
            for c in totals
        ],
    )


def exact_percentile(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row ``value``: the percentile with linear interpolation between neighbours.

    A sketch brackets the two ranks; one pass counts the values below the bracket and at its ends,
    and only what lies between them is looked at again, until that is little. Nothing is stored or sorted.
    """
    fraction = min(max(fraction, 0.0), 1.0)
    value = F.col(column).cast("double")
    rows = df.where(F.col(column).isNotNull()).select(value.alias("_v"))
    low_value = high_value = None
    edge = 4.0 / SKETCH

    def bracket(some: DataFrame, share: float) -> tuple:
        shares = F.array(F.lit(max(share - edge, 0.0)), F.lit(min(share + edge, 1.0)))
        return some.agg(F.count("_v").alias("n"), F.percentile_approx("_v", shares, F.lit(SKETCH)).alias("ends"),
                        F.min("_v").alias("least"), F.max("_v").alias("most")).first()

    first = bracket(rows, fraction)
    if not first["n"]:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    rank = fraction * (first["n"] - 1)
    low, high = math.floor(rank), math.ceil(rank)
    # Ranks count from the first row of ``rows``, of which ``size`` are left.
    size, ends, limits, below = first["n"], first["ends"], (first["least"], first["most"]), 0
    while low_value is None or high_value is None:
        if size <= FEW:
            counts = sorted((r["_v"], r["n"]) for r in rows.groupBy("_v").agg(F.count(F.lit(1)).alias("n")).collect())
            for v, n in counts:
                low_value = v if low_value is None and below <= low < below + n else low_value
                high_value = v if high_value is None and below <= high < below + n else high_value
                below += n
            break
        a, b = ends
        counted = rows.agg(*[F.count_if(c).alias(k) for k, c in (
            ("under", F.col("_v") < a), ("at_a", F.col("_v") == a), ("at_b", F.col("_v") == b),
            ("inside", (F.col("_v") > a) & (F.col("_v") < b)))]).first()
        at_a = below + counted["under"]
        inside = at_a + counted["at_a"]
        at_b = inside + (counted["inside"] if b > a else 0)
        after = at_b + (counted["at_b"] if b > a else 0)
        wanted = [r for r, v in ((low, low_value), (high, high_value)) if v is None]
        if not all(at_a <= r < after for r in wanted):
            if (a, b) == limits:
                raise RuntimeError("values changed between two reads")
            ends = limits  # the sketch missed a rank
            continue
        low_value = a if low_value is None and low < inside else b if low_value is None and low >= at_b else low_value
        high_value = a if high_value is None and high < inside else b if high_value is None and high >= at_b else high_value
        if low_value is None or high_value is None:
            rows, below, size = rows.where((F.col("_v") > a) & (F.col("_v") < b)), inside, counted["inside"]
            if size > FEW:
                first = bracket(rows, ((low if low_value is None else high) - below) / max(size - 1, 1))
                ends, limits = first["ends"], (first["least"], first["most"])
    return df.sparkSession.range(1).select(F.lit(low_value + (high_value - low_value) * (rank - low)).alias("value"))
