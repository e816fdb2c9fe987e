"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgrid.fixed_values import WEATHER_MEASURES


def nan_to_null(value: Column) -> Column:
    """NaN marks a missing value at the sources; inside the panel it is null."""
    return F.nullif(value, F.lit(float("nan")))


def scale_measures() -> list[Column]:
    """Raw element columns (tenths or whole units) to metric measures."""
    return [
        (F.col(element) / divisor).alias(measure) if divisor != 1.0
        else F.col(element).cast("double").alias(measure)
        for element, measure, divisor in WEATHER_MEASURES
    ]


def mean_of_two(a: Column, b: Column) -> Column:
    """Mean of the two values that are present."""
    return F.coalesce((a + b) / 2, a, b)


def clip_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def at_least(value: Column, threshold: Column | float) -> Column:
    """1 where the value reaches the threshold, else 0; null stays null."""
    return (value >= threshold).cast("int")


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def fraction_change(value: Column, previous: Column) -> Column:
    """Relative change as a fraction; 0 where it is undefined or infinite."""
    return F.coalesce(F.try_divide(value - previous, previous), F.lit(0.0))


def standard_score(value: Column, mean: Column, scale: Column) -> Column:
    return (value - mean) / scale
