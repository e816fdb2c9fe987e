"""Daily event aggregation and row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.fixed_values import EVENT_FLAGS
from panelgrid.functions.text import contains_any


def event_flags(event_type: str = "EVENT_TYPE") -> list:
    """0/1 columns telling which kinds of event a row is."""
    return [
        contains_any(F.col(event_type), pattern).cast("int").alias(name)
        for name, pattern in EVENT_FLAGS
    ]


def daily_event_agg(events: DataFrame) -> DataFrame:
    """One row per (region_id, timestamp): damage in thousands, counts and means.

    Rows are combined before the shuffle, so a hot region or day costs one partial
    row per task. Sums over nothing are 0, means over nothing are null.
    """
    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0)).alias

    return events.groupBy("region_id", "timestamp").agg(
        (F.coalesce(F.sum("damage_usd"), F.lit(0.0)) / 1000.0).alias("failures"),
        F.count("EVENT_ID").alias("event_count"),
        *[F.sum(name).alias(name) for name, _ in EVENT_FLAGS],
        total("DEATHS_DIRECT")("deaths"),
        total("INJURIES_DIRECT")("injuries"),
        F.avg("MAGNITUDE").alias("avg_magnitude"),
        F.avg("BEGIN_LAT").alias("avg_latitude"),
        F.avg("BEGIN_LON").alias("avg_longitude"),
    )


def resolve_sequence_length(df: DataFrame, region: str, requested: int) -> int:
    """Requested window length, clamped to the longest training series and to at least 1."""
    if requested <= 1:
        return 1
    per_region = df.groupBy(region).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count(F.lit(1)).alias("rows")
    )
    counts = per_region.agg(F.max("train").alias("train"), F.sum("rows").alias("rows")).first()
    longest = counts["train"] or counts["rows"] or 0
    return max(1, min(requested, longest))


def sample_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def load_summary(panel: DataFrame, region: str = "region_id") -> DataFrame:
    """Rows and distinct regions of a panel; regions are counted from one row each."""
    per_region = panel.groupBy(region).agg(F.count(F.lit(1)).alias("n"))
    return per_region.agg(F.sum("n").alias("rows"), F.count(region).alias("regions"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(column).distinct().orderBy(column)


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
