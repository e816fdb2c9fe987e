"""Summary tables behind maps, charts and the predictions browser."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.operators.clean import filter_predictions, require

DISPLAY_COLUMNS = ("timestamp", "region_id", "hybrid_pred", "target")


def _first_known(column: str) -> Column:
    """Earliest non-null value."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("timestamp"))).alias(column)


def region_risk(predictions: DataFrame) -> DataFrame:
    """Per region: position, mean prediction, and highest class (or the mean again)."""
    if "hybrid_class" in predictions.columns:
        risk = F.max("hybrid_class")
    else:
        risk = F.avg("hybrid_pred")
    return predictions.where("region_id is not null").groupBy("region_id").agg(
        _first_known("latitude"),
        _first_known("longitude"),
        F.avg("hybrid_pred").alias("hybrid_pred"),
        risk.alias("hybrid_class"),
    )


def risk_map_table(predictions: DataFrame) -> DataFrame:
    """Located predictions averaged per region; passed through without a region column."""
    located = require(predictions, ["latitude", "longitude", "hybrid_pred"])
    if "region_id" not in predictions.columns:
        return located.select("latitude", "longitude", "hybrid_pred")
    return located.where("region_id is not null").groupBy("region_id").agg(
        _first_known("latitude"), _first_known("longitude"),
        F.avg("hybrid_pred").alias("hybrid_pred"),
    )


def daily_mean(predictions: DataFrame) -> DataFrame:
    """Mean prediction and, where it exists, mean target per time."""
    columns = [c for c in ("hybrid_pred", "target") if c in predictions.columns]
    return predictions.where("timestamp is not null").groupBy("timestamp").agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def kpi_summary(predictions: DataFrame) -> DataFrame:
    """One row: rows, regions, time range, mean and highest prediction.

    Summed up per region first, so that no task holds a set of all regions.
    """
    per_region = predictions.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.sum("hybrid_pred").alias("_sum"),
        F.count("hybrid_pred").alias("_n"),
        F.max("hybrid_pred").alias("_max"),
    )
    return per_region.agg(
        F.sum("_rows").alias("total_predictions"),
        F.count("region_id").alias("regions"),
        F.min("_first").alias("first_timestamp"),
        F.max("_last").alias("last_timestamp"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("avg_prediction"),
        F.max("_max").alias("max_prediction"),
    )


def valid_pairs(predictions: DataFrame, a: str = "target", b: str = "hybrid_pred") -> DataFrame:
    """Rows in which both columns are known."""
    return require(predictions, [a, b])


def axis_bounds(predictions: DataFrame, a: str = "target", b: str = "hybrid_pred") -> DataFrame:
    """One row: the range that covers both columns over their valid pairs."""
    return valid_pairs(predictions, a, b).agg(
        F.least(F.min(a), F.min(b)).alias("lower"), F.greatest(F.max(a), F.max(b)).alias("upper")
    )


def _residuals(predictions: DataFrame) -> DataFrame:
    return valid_pairs(predictions).select((F.col("target") - F.col("hybrid_pred")).alias("r"))


def residual_histogram(predictions: DataFrame, bins: int = 25) -> DataFrame:
    """``bins`` equal-width bins of target minus prediction, empty ones included.

    The last bin includes its upper edge; when all residuals are equal the range
    is widened by a half on both sides.
    """
    residuals = _residuals(predictions)
    lo, hi = F.min("r"), F.max("r")
    flat = lo == hi
    bounds = residuals.agg(
        F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
    )
    placed = residuals.withColumn("_b", bounds.select(F.struct("lo", "hi")).scalar())
    offset = (F.col("r") - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo")) * bins
    counts = (
        placed.select(F.least(F.floor(offset), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    edges = bounds.where("lo is not null").select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w")
    )
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("residuals"),
    )


def residual_density(predictions: DataFrame, points: int = 200, bins: int = 25) -> DataFrame:
    """Gaussian kernel density of the residuals at ``points`` positions over their range.

    The bandwidth is the sample deviation times n^(-1/5). Every position is an
    aggregate of its own, so a task keeps ``points`` sums and no row is multiplied.
    ``curve`` is the density on the scale of the histogram's counts.
    """
    residuals = _residuals(predictions)
    n = F.count("r")
    stats = residuals.agg(
        F.min("r").alias("lo"), F.max("r").alias("hi"), n.alias("n"),
        (F.stddev_samp("r") * F.pow(n.cast("double"), F.lit(-0.2))).alias("h"),
    )
    placed = residuals.withColumn("_s", stats.select(F.struct("*")).scalar()).select("r", "_s.*")
    step = (F.col("hi") - F.col("lo")) / (points - 1)

    def kernel_sum(i: int) -> Column:
        z = (F.col("lo") + i * step - F.col("r")) / F.col("h")
        return F.sum(F.exp(-0.5 * z * z))

    sums = placed.where("h > 0").agg(
        F.array(*[kernel_sum(i) for i in range(points)]).alias("sums"),
        *[F.first(c).alias(c) for c in ("lo", "hi", "n", "h")],
    )
    density = F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return (
        sums.where("n is not null")
        .select("lo", "hi", "n", "h", F.posexplode("sums").alias("point", "s"))
        .select(
            "point",
            (F.col("lo") + F.col("point") * step).alias("residual"),
            density.alias("density"),
            (density * F.col("n") * (F.col("hi") - F.col("lo")) / bins).alias("curve"),
        )
    )


def first_rows(predictions: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows of the display columns in time and region order."""
    columns = [c for c in DISPLAY_COLUMNS if c in predictions.columns]
    order = [c for c in ("timestamp", "region_id") if c in columns]
    return predictions.select(*columns).orderBy(*order).limit(limit)


def browse(
    predictions: DataFrame, split: str | None = None, region: str | None = None,
    start: str | None = None, end: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Table and daily curve of the predictions browser for one set of filters."""
    kept = filter_predictions(predictions, split, region, start, end)
    return first_rows(kept), daily_mean(kept)
