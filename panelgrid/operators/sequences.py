"""Sliding windows over a panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelgrid.operators.features import over_chunks
from panelgrid.operators.series import CHUNK, OWN, POSITION, Series, on_steps, with_halo, with_position

WINDOW_END = "is_window_end"


def positions_for(series: Series, stride: int) -> Series:
    """A stride counts from the region's first row; a stride of one does not care where
    counting starts."""
    return series if stride == 1 else replace(series, from_first=True)


def window_end(length: int, stride: int = 1) -> Callable[[WindowSpec], list[Column]]:
    """Whether a row ends a window of ``length`` rows that lies in one split."""
    def build(w: WindowSpec) -> list[Column]:
        frame = w.rowsBetween(1 - length, 0)
        full = F.count(F.lit(1)).over(frame) == length
        one_split = F.min("split").over(frame) == F.max("split").over(frame)
        on_stride = (F.col(POSITION) - (length - 1)) % stride == 0
        return [(full & one_split & on_stride).alias(WINDOW_END)]

    return build


def mark_window_ends(df: DataFrame, series: Series, length: int, stride: int = 1) -> DataFrame:
    """Adds the window-end flag to every row."""
    return over_chunks(
        df, positions_for(series, stride), length - 1, window_end(length, stride)
    )


def sliding_windows(
    df: DataFrame, series: Series, target: str, length: int, stride: int = 1,
    features: str = "features", dense: bool = False,
) -> DataFrame:
    """One row per window: key and target of its last row, and its feature rows in order.

    The rows of a (region, chunk) and the ``length - 1`` before them are gathered into one array, at most
    ``chunk_rows + length`` of them, and each window is a slice of it.
    """
    series = positions_for(series if dense else on_steps(df, series), stride)
    narrow = df.select(
        *series.key, "latitude", "longitude", "split", F.col(features).alias("_row"),
        F.col(target).cast("float").alias("target"),
    )
    chunks = with_halo(with_position(narrow, series), series, length - 1).groupBy(series.region, CHUNK).agg(
        F.array_sort(F.collect_list(F.struct(
            POSITION, OWN, series.time, "latitude", "longitude", "split", "target", "_row"))).alias("_rows"))
    rows, last = F.col("_rows"), length - 1

    def window(at: Column) -> Column:
        end = F.get(rows, at)
        return F.struct(
            end["split"].alias("split"), end[series.time].alias(series.time), end["latitude"].alias("latitude"),
            end["longitude"].alias("longitude"), F.slice(F.col("_features"), at - last + 1, length).alias("features"),
            end["target"].alias("target"))

    def ends(at: Column) -> Column:
        end = F.get(rows, at)
        one_split = F.forall(F.slice(F.col("_splits"), at - last + 1, length), lambda s: s == end["split"])
        return end[OWN] & ((end[POSITION] - last) % stride == 0) & (F.col("_one_split") | one_split)

    places = F.filter(F.sequence(F.lit(last), F.size(rows) - 1), ends)
    # Most chunks lie in one split, whose windows need no look at their rows.
    whole = (F.size(F.array_distinct("_splits")) == 1) & F.get("_splits", F.lit(0)).isNotNull()
    made = chunks.where(F.size(rows) >= length).withColumns(
        {"_features": rows["_row"], "_splits": rows["split"]}).withColumn("_one_split", whole).select(series.region, F.inline(F.transform(places, window)))
    return made.select("split", *series.key, "latitude", "longitude", "features", "target")
