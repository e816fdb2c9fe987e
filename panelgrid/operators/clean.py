"""Row filters, column selection and null handling."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.fixed_values import EVENT_COUNT_COLUMNS
from panelgrid.functions.numeric import nan_to_null
from panelgrid.operators.series import Series

log = logging.getLogger(__name__)

SAME_DAY_OUTCOMES = (*EVENT_COUNT_COLUMNS, "avg_magnitude", "avg_latitude", "avg_longitude")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column, once, at the source."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all the columns are present."""
    return df.dropna(subset=list(columns))


def in_values(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose value is listed; a frame of values is semi-joined instead of inlined."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(values)))


def between_days(df: DataFrame, column: str, start: str | date, end: str | date) -> DataFrame:
    """Rows from the first day through the whole last day.

    Compared on the column as it is, so that a scan can take the range over.
    """
    first, last = str(start)[:10], str(end)[:10]
    return df.where(F.col(column).between(
        F.lit(first).cast("timestamp_ntz"), F.lit(f"{last} 23:59:59.999999").cast("timestamp_ntz")
    ))


def select_or_null(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """The columns in the given order; those absent become typed nulls."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns
    ])


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in order; booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _tells_the_day(column: str, outcomes: Sequence[str]) -> bool:
    """Same-day outcomes and rolling statistics that include the day itself."""
    return column in outcomes or any(column.startswith(f"{o}_roll") for o in outcomes)


def select_feature_columns(
    df: DataFrame, target: str, features: Mapping[str, Any] | None = None
) -> list[str]:
    """Names of the model features, from an ``include`` list or all numeric columns.

    ``leak_safe`` leaves out columns the target can be computed from: its difference
    and change, its rolling statistics, which include the day itself, and what else is only
    known once the day is over: the columns of ``same_day`` and theirs.
    """
    features = features or {}
    barred = {target, "target_class", "split", *(features.get("exclude") or [])}
    auto = features.get("exclude_auto")
    barred |= set(["longitude", "latitude"] if auto is None else auto)
    if features.get("leak_safe"):
        barred |= {f"{target}_diff_1", f"{target}_pct_change"}
        outcomes = [target, *features.get("same_day", SAME_DAY_OUTCOMES)]
        barred |= {c for c in df.columns if _tells_the_day(c, outcomes)}
    listed = features.get("include")
    if listed:
        return [c for c in listed if c in df.columns and c not in barred]
    return [c for c in numeric_columns(df) if c not in barred]


def resolve_base_columns(
    df: DataFrame, target: str, configured: Sequence[str] | None = None
) -> list[str]:
    """Columns that lags and rolling windows are made of."""
    if configured:
        missing = sorted(set(configured) - set(df.columns))
        if missing:
            log.warning("base columns not in the panel: %s", ", ".join(missing))
        return [c for c in configured if c in df.columns]
    return [c for c in numeric_columns(df) if c not in {target, "longitude", "latitude"}]


def drop_incomplete(df: DataFrame, series: Series, target: str) -> DataFrame:
    return require(df, [target, series.region, series.time])


def in_time_order(df: DataFrame, series: Series) -> DataFrame:
    """Sorted for a reader; operators never need it, they sort within chunks themselves."""
    return df.orderBy(*series.key)


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null to zero in the listed columns that exist."""
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def filter_predictions(
    predictions: DataFrame,
    split: str | None = None,
    region: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Rows matching the set conditions; ``all`` or ``None`` sets none.

    Both dates mean midnight, the end included.
    """
    conditions: list[Column] = []
    for column, wanted in (("split", split), ("region_id", region)):
        if wanted and wanted != "all" and column in predictions.columns:
            conditions.append(F.col(column) == wanted)
    if "timestamp" in predictions.columns:
        if start:
            conditions.append(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            conditions.append(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    for condition in conditions:
        predictions = predictions.where(condition)
    return predictions


def filter_split_or_fail(predictions: DataFrame, split: str) -> DataFrame:
    """The split's rows, or an error naming the splits there are."""
    kept = filter_predictions(predictions, split=split)
    if kept.isEmpty():
        present = []
        if "split" in predictions.columns:
            named = F.array_sort(F.collect_set("split"))
            present = predictions.agg(named.alias("splits")).first()["splits"]
        raise ValueError(f"no prediction for split {split!r}; available: {present or 'none'}")
    return kept
