"""Raw feeds to a dense panel, and a panel to model inputs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid import config as cfg
from panelgrid.functions.text import day_floor, parse_damage, parse_event_time, state_code
from panelgrid.operators import aggregate, clean, features, joins, sequences, split
from panelgrid.operators.grid import align_time_series, day_bounds, region_table
from panelgrid.operators.series import Series, on_steps
from panelgrid.session import materialize
from panelgrid.sources import weather as wx
from panelgrid.sources.events import files_for_years, scan_storm_events

log = logging.getLogger(__name__)

PANEL_COLUMNS = ("region_id", "timestamp", "failures")


def series_of(config: Mapping[str, Any]) -> Series:
    data = config["data"]
    return Series(
        region=data["group_column"], time=data["timestamp_column"],
        frequency=data.get("frequency"), chunk_rows=data.get("chunk_rows", Series.chunk_rows),
    )


def typed_events(raw: DataFrame, states: Sequence[str] | DataFrame, start: str, end: str) -> DataFrame:
    """Raw event rows of the wanted regions and days, parsed; one narrow projection."""
    placed = raw.withColumn("region_id", state_code(F.col("STATE")))
    wanted = clean.in_values(clean.require(placed, ["STATE"]), "region_id", states)
    # The range test also drops rows whose time cannot be read.
    timed = wanted.withColumn("_time", parse_event_time(F.col("BEGIN_DATE_TIME")))
    kept = clean.between_days(timed, "_time", start, end)
    return kept.select(
        "region_id",
        day_floor(F.col("_time")).alias("timestamp"),
        "EVENT_ID",
        parse_damage(F.col("DAMAGE_PROPERTY")).alias("damage_usd"),
        *aggregate.event_flags(),
        "DEATHS_DIRECT", "INJURIES_DIRECT", "MAGNITUDE", "BEGIN_LAT", "BEGIN_LON",
    )


def daily_events(raw: DataFrame, states: Sequence[str] | DataFrame, start: str, end: str) -> DataFrame:
    """Events per region and day."""
    return aggregate.daily_event_agg(typed_events(raw, states, start, end))


def daily_weather(
    observations: DataFrame, stations: DataFrame, start: str, end: str
) -> DataFrame:
    """Measures per region and day from long observations of all stations at once.

    ``stations`` maps station to region_id. A station belongs to one region, so the
    region joins the daily rows, after the aggregation made them few.
    """
    wanted = clean.between_days(observations, "timestamp", start, end).join(
        stations.select("station").distinct(), "station", "left_semi"
    )
    wide = wx.pivot_elements(wanted, ["station", "timestamp"])
    return joins.tag_region(wx.to_measures(wide, ["station", "timestamp"]), stations)


def station_table(spark: SparkSession, stations: Mapping[str, Any]) -> DataFrame:
    """(region_id, station) from a mapping of region to id, or to a dict with ``id``."""
    rows = [(r, s["id"] if isinstance(s, Mapping) else str(s)) for r, s in stations.items()]
    return spark.createDataFrame(rows, "region_id string, station string")


def load_real_panel(
    spark: SparkSession,
    config: Mapping[str, Any],
    event_paths: Sequence[str],
    daily_paths: Sequence[str],
    station_path: str,
    context: Mapping[str, DataFrame] | None = None,
    responses: Sequence[DataFrame] = (),
) -> DataFrame:
    """Landed event and weather files to the dense panel.

    ``responses`` are further weather sources, (station, timestamp, measures) rows in order of
    preference: a station's rows come from the first of them that has any in the wanted days,
    else from the daily files. No weather at all is an error.
    """
    real = cfg.resolve(config)["data"]["real"]
    start, end = day_bounds(real["start_date"], real["end_date"])
    named = station_table(spark, real["ghcn"]["stations"])
    regions = list(real["ghcn"]["stations"])
    events = daily_events(scan_storm_events(spark, event_paths), regions, start, end)
    metadata = wx.scan_stations(spark, station_path, named)
    for row in wx.missing_stations(metadata, named).toLocalIterator():
        log.warning("no metadata for station %s", row["station"])
    weather = first_weather(wx.scan_daily_files(spark, daily_paths), responses, named, start, end)
    coordinates = named.join(metadata, "station", "left").select(
        "region_id", "latitude", "longitude", "elevation"
    )
    return joins.combine_panel(
        weather, coordinates, events, region_table(spark, regions, "region_id"), start, end,
        context=context,
    )


def first_weather(
    observations: DataFrame, responses: Sequence[DataFrame], stations: DataFrame, start: str, end: str
) -> DataFrame:
    """Measures per region and day, each station from the first source that has it."""
    wanted = [
        clean.between_days(source, "timestamp", start, end).join(
            stations.select("station").distinct(), "station", "left_semi")
        for source in (*responses, observations)
    ]
    if all(source.isEmpty() for source in wanted):
        raise RuntimeError("no weather available for the wanted stations and days")
    if not responses:
        return daily_weather(observations, stations, start, end)
    keys = ["station", "timestamp"]
    from_files = wx.to_measures(wx.pivot_elements(wanted[-1], keys), keys)
    return joins.tag_region(wx.first_available([*wanted[:-1], from_files], "station"), stations)


def load_listed_panel(
    spark: SparkSession, config: Mapping[str, Any], listing: DataFrame, event_folder: str,
    daily_paths: Sequence[str], station_path: str, **more: Any,
) -> DataFrame:
    """The dense panel from the latest event file of each configured year.

    ``listing`` names the files there are; a year without one is logged.
    """
    years = configured_years(cfg.resolve(config)["data"]["real"])
    paths = [f"{event_folder.rstrip('/')}/{name}" for name in files_for_years(listing, years)]
    return load_real_panel(spark, config, paths, daily_paths, station_path, **more)


def configured_years(real: Mapping[str, Any]) -> list[int]:
    """Years of event files to read: those listed, else all from start to end."""
    years = real["storm_events"].get("years")
    start, end = day_bounds(real["start_date"], real["end_date"])
    return list(years or range(int(start[:4]), int(end[:4]) + 1))


Loader = Callable[[SparkSession, Mapping[str, Any]], DataFrame]


def load_panel(
    spark: SparkSession, loaders: Mapping[str, Loader], config: Mapping[str, Any],
    mode: str = "real",
) -> DataFrame:
    """The panel of the named loader, checked for the columns every step relies on.

    Rows without a region are dropped here, once, and NaN becomes null.
    """
    if mode not in loaders:
        raise ValueError(f"no panel loader for mode {mode!r}; have {sorted(loaders)}")
    panel = loaders[mode](spark, config)
    missing = [c for c in PANEL_COLUMNS if c not in panel.columns]
    if missing:
        raise ValueError(f"panel lacks {', '.join(missing)}")
    return clean.without_nan(clean.require(panel, ["region_id"]))


@dataclass
class ModelInputs:
    """Everything a model fit needs; all frames are lazy.

    ``stored`` tells that ``engineered`` was written once and is not recomputed.
    """

    engineered: DataFrame
    tabular: DataFrame
    windows: DataFrame
    feature_columns: list[str]
    sequence_feature_columns: list[str]
    scaler: DataFrame
    target_column: str
    target_type: str
    threshold: DataFrame | None
    sequence_length: int
    series: Series
    stored: bool = False

    def counts(self) -> DataFrame:
        """Rows per split of both data sets."""
        tabular = aggregate.sample_counts(self.tabular).withColumn("kind", F.lit("tabular"))
        windows = aggregate.sample_counts(self.windows).withColumn("kind", F.lit("sequence"))
        return tabular.unionByName(windows)


def labelled_panel(
    panel: DataFrame, config: Mapping[str, Any], align: bool = True, store: bool = False
) -> DataFrame:
    """Aligned panel with split labels, still narrow.

    With ``align=False`` the panel is taken to lie on its grid; nulls become zero
    as they do in alignment.
    """
    series = series_of(config)
    aligned = align_time_series(panel, series) if align else panel.fillna(0)
    if store:
        aligned = materialize(aligned, "aligned")
    sizes = config["split"]
    return split.chronological_split(aligned, series, sizes["val_size"], sizes["test_size"])


def engineered_panel(
    panel: DataFrame, config: Mapping[str, Any] | None = None, align: bool = True
) -> DataFrame:
    """Aligned panel with split labels and features."""
    config = cfg.resolve(config)
    return features.engineer_features(
        labelled_panel(panel, config, align), series_of(config), config["target"]["column"],
        config["features"], dense=align,
    )


def build_model_inputs(
    panel: DataFrame, config: Mapping[str, Any] | None = None, align: bool = True,
    store: bool = True,
) -> ModelInputs:
    """Panel to tabular rows, scaled windows and fitted scaler.

    Splits, window length and threshold come from the narrow aligned panel. The wide
    rows are shuffled once: features and the window-end flag share that pass, so the
    tabular rows are a filter. ``store`` writes the aligned panel to the shared folder, as
    several passes start from it,
    and the engineered one too where windows use engineered columns; where they use
    panel columns only, nothing but the tabular rows would ever read it.
    """
    config = cfg.resolve(config)
    series = series_of(config)
    target_cfg, sequence = config["target"], config["sequence"]
    label = target = target_cfg["column"]
    labelled = labelled_panel(panel, config, align, store)
    if not align:
        series = on_steps(labelled, series)
    # an aligned panel lies on its grid, and of the other one it is known from here on
    dense = not series.counted
    length = aggregate.resolve_sequence_length(labelled, series.region, sequence["length"])
    stride = sequence["stride"]
    engineered = features.engineer_features(
        labelled, sequences.positions_for(series, stride), target, config["features"],
        more=sequences.window_end(length, stride), more_reach=length - 1, dense=dense,
    )
    columns = clean.select_feature_columns(engineered, target, config["features"])
    sequence_columns = list(sequence["features"] or columns)
    narrow = set(sequence_columns) <= set(labelled.columns)
    if store and not narrow:
        engineered = materialize(engineered, "engineered")
    source = labelled if narrow else engineered
    scaler = split.fit_scaler(source, sequence_columns)
    threshold = None
    if target_cfg["type"] == "classification":
        threshold = split.target_threshold(
            labelled, target, target_cfg["classification_threshold_percentile"]
        )
        engineered = split.with_target_class(engineered, target, threshold)
        source = split.with_target_class(source, target, threshold)
        label = "target_class"
    scaled = split.with_scaled_features(source, sequence_columns, scaler)
    tabular = engineered.where(sequences.WINDOW_END).drop(sequences.WINDOW_END)
    return ModelInputs(
        engineered=engineered, tabular=tabular.fillna(0),
        windows=sequences.sliding_windows(scaled, series, label, length, stride, dense=dense),
        feature_columns=columns, sequence_feature_columns=sequence_columns, scaler=scaler,
        target_column=label, target_type=target_cfg["type"], threshold=threshold,
        sequence_length=length, series=series, stored=store and not narrow,
    )
