"""Joins that build and enrich the panel.

No side is broadcast by hint here: coordinates and context grow with the number
of regions, so Spark decides from measured sizes, and falls back to a shuffled
join that it splits where a region is hot.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.fixed_values import EVENT_COUNT_COLUMNS, WEATHER_COLUMNS
from panelgrid.functions.numeric import clip_unit
from panelgrid.functions.text import state_fips
from panelgrid.operators.clean import select_or_null
from panelgrid.operators.grid import region_date_grid
from panelgrid.operators.series import Series, fill_gaps

log = logging.getLogger(__name__)


def left_on_key(grid: DataFrame, facts: DataFrame, series: Series) -> DataFrame:
    """Grid with the facts of the same region and time, null where there are none."""
    return grid.join(facts, series.key, "left")


def attach_coordinates(df: DataFrame, coordinates: DataFrame, region: str = "region_id") -> DataFrame:
    """Latitude and longitude per region, null for unknown regions."""
    return df.join(coordinates.select(region, "latitude", "longitude"), region, "left")


def attach_context(
    df: DataFrame, tables: Mapping[str, DataFrame], region: str = "region_id"
) -> DataFrame:
    """Left-joins each context table; each adds its columns and no rows.

    A table without the region column is skipped with a warning, the others stay. One
    with several rows for a region is an error: which of them holds is not ours to say.
    """
    for name, table in tables.items():
        if region not in table.columns:
            log.warning("context table %s has no column %s; skipped", name, region)
            continue
        if not table.groupBy(region).count().where("count > 1").isEmpty():
            raise ValueError(f"context table {name} has several rows for one {region}")
        df = df.join(table, region, "left")
    return df


def attach_fips(regions: DataFrame) -> DataFrame:
    """Census codes of the regions; regions without one are dropped."""
    return regions.withColumn("fips", state_fips(F.col("region_id"))).where("fips is not null")


def combine_panel(
    weather: DataFrame,
    coordinates: DataFrame,
    events: DataFrame,
    regions: DataFrame,
    start: str,
    end: str,
    series: Series = Series(),
    context: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Dense region-by-day panel of weather, events, coordinates and context.

    Static columns join the region table before its days are generated, so those
    joins see one row per region. Grid, weather and events meet on (region, time);
    weather and events come partitioned that way from their aggregations.
    """
    static = attach_coordinates(regions, coordinates, series.region)
    static = attach_context(static, context or {}, series.region)
    static_columns = [c for c in static.columns if c != series.region]
    grid = region_date_grid(static, series, start, end)

    measures = [c for c in WEATHER_COLUMNS if c in weather.columns]
    observed = weather.select(*series.key, *measures)
    panel = left_on_key(left_on_key(grid, observed, series), events, series)
    panel = fill_gaps(panel, measures, series, backward=True, observed=observed)
    panel = panel.fillna(0, subset=[*EVENT_COUNT_COLUMNS, "failures", "avg_magnitude"])
    event_columns = [c for c in events.columns if c not in series.key]
    return panel.select(*series.key, *measures, *event_columns, *static_columns)


def rows_for_keys(engineered: DataFrame, keys: DataFrame, series: Series, target: str) -> DataFrame:
    """Engineered rows whose (split, region, time) is a window end, nulls set to zero."""
    on = ["split", *series.key]
    kept = engineered.where(F.col(target).isNotNull()).join(
        keys.select(*on).distinct(), on, "left_semi"
    )
    return kept.fillna(0)


def combine_predictions(
    tabular: DataFrame, temporal: DataFrame, weight_tabular: float, series: Series = Series()
) -> DataFrame:
    """Tabular rows with the temporal prediction of the same key and the blend of both.

    Rows without a temporal prediction keep the tabular one.
    """
    weight = clip_unit(F.lit(float(weight_tabular)))
    on = ["split", *series.key]
    joined = tabular.join(temporal.select(*on, "lstm_pred"), on, "left")
    blend = weight * F.col("tabular_ensemble") + (1.0 - weight) * F.col("lstm_pred")
    return joined.withColumn("hybrid_pred", F.coalesce(blend, F.col("tabular_ensemble")))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name, absent ones null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def tag_region(weather: DataFrame, stations: DataFrame) -> DataFrame:
    """Station rows renamed to the region each station stands for."""
    named = weather.join(stations.select("station", "region_id"), "station")
    return select_or_null(named, ["region_id", "timestamp", *WEATHER_COLUMNS])
