"""Daily weather: fixed-width station files, station metadata and landed JSON responses."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.fixed_values import MISSING_OBSERVATION, WEATHER_COLUMNS, WEATHER_MEASURES
from panelgrid.functions.numeric import mean_of_two, scale_measures
from panelgrid.functions.text import NUMBER, fixed_field, make_day

log = logging.getLogger(__name__)

ELEMENTS = [element for element, _, _ in WEATHER_MEASURES]

STATION_FIELDS = (
    ("latitude", 12, 20, "double"),
    ("longitude", 21, 30, "double"),
    ("elevation", 31, 37, "double"),
    ("state", 38, 40, "string"),
    ("name", 41, 71, "string"),
)

WIDE_RESULTS = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType(
        [T.StructField("STATION", T.StringType()), T.StructField("DATE", T.StringType())]
        + [T.StructField(e, T.DoubleType()) for e in ELEMENTS]
    ))),
])
LONG_RESULTS = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("station", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]))),
])


def valid_observation(value: Column, quality: Column) -> Column:
    """A number, not the missing mark, and no quality flag raised."""
    text = F.trim(value)
    return (F.trim(quality) == "") & (text != MISSING_OBSERVATION) & text.rlike(NUMBER)


def daily_observations(lines: DataFrame, line: str = "value") -> DataFrame:
    """(station, timestamp, element, raw): one row per valid day of each line.

    A line is one station, month and element with 31 day slots of eight characters.
    Lines of other elements are dropped before the slots are opened.
    """
    text = F.col(line)
    months = lines.select(
        F.substring(text, 1, 11).alias("station"),
        F.substring(text, 12, 4).try_cast("int").alias("year"),
        F.substring(text, 16, 2).try_cast("int").alias("month"),
        F.substring(text, 18, 4).alias("element"),
        F.substring(text, 22, 248).alias("slots"),
    ).where(F.col("element").isin(ELEMENTS))
    slots = months.select(
        "station", "year", "month", "element", "slots",
        F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day"),
    )
    offset = (F.col("day") - 1) * 8
    return (
        slots.select(
            "station", "element",
            make_day(F.col("year"), F.col("month"), F.col("day")).alias("timestamp"),
            F.substring("slots", offset + 1, F.lit(5)).alias("value"),
            F.substring("slots", offset + 7, F.lit(1)).alias("quality"),
        )
        .where(F.col("timestamp").isNotNull() & valid_observation(F.col("value"), F.col("quality")))
        .select(
            "station", "timestamp", "element", F.trim("value").try_cast("double").alias("raw")
        )
    )


def scan_daily_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Fixed-width daily files of any number of stations as long observations."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return daily_observations(spark.read.text(paths))


def stations_from_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    text = F.col(line)
    fields = [fixed_field(text, start, end).try_cast(kind).alias(name)
              for name, start, end, kind in STATION_FIELDS]
    return lines.select(fixed_field(text, 0, 11).alias("station"), *fields)


def scan_stations(
    spark: SparkSession, path: str, wanted: DataFrame | Sequence[str] | None = None
) -> DataFrame:
    """Station metadata from its fixed-width file, kept to the wanted ids."""
    stations = stations_from_lines(spark.read.text(path))
    if wanted is None:
        return stations
    if isinstance(wanted, DataFrame):
        return stations.join(wanted.select("station").distinct(), "station", "left_semi")
    return stations.where(F.col("station").isin(list(wanted)))


def missing_stations(stations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted station ids without metadata."""
    return wanted.select("station").distinct().join(stations, "station", "left_anti")


def pivot_elements(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with a mean per element; all six elements always present."""
    return long.groupBy(*keys).pivot("element", ELEMENTS).agg(F.avg("raw"))


def to_measures(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw elements to the seven weather measures in fixed order."""
    scaled = wide.select(*keys, *scale_measures())
    return scaled.select(
        *keys,
        mean_of_two(F.col("tmax_c"), F.col("tmin_c")).alias("tavg_c"),
        *[F.col(c) for c in WEATHER_COLUMNS if c != "tavg_c"],
    )


def read_responses(
    spark: SparkSession, path: str, schema: T.StructType, per_line: bool = False
) -> DataFrame:
    """Result rows of landed JSON responses: a response is a file, or ``per_line`` a line."""
    return (
        spark.read.schema(schema).option("multiLine", not per_line).json(path)
        .select(F.explode("results").alias("r")).select("r.*")
    )


def weather_from_wide_json(results: DataFrame) -> DataFrame:
    """Daily-summary results (a column per element); an average needs both temperatures."""
    scaled = results.select(
        F.col("STATION").alias("station"),
        F.col("DATE").try_cast("timestamp_ntz").alias("timestamp"),
        *scale_measures(),
    )
    tavg = (F.col("tmax_c") + F.col("tmin_c")) / 2
    return scaled.select(
        "station", "timestamp", tavg.alias("tavg_c"),
        *[c for c in WEATHER_COLUMNS if c != "tavg_c"],
    )


def weather_from_long_json(results: DataFrame) -> DataFrame:
    """Long results (a row per element) pivoted by day, then shaped as the wide ones are."""
    long = results.select(
        "station", F.col("date").try_cast("timestamp_ntz").alias("timestamp"),
        F.col("datatype").alias("element"), F.col("value").alias("raw"),
    )
    wide = pivot_elements(long, ["station", "timestamp"])
    return weather_from_wide_json(
        wide.withColumnRenamed("station", "STATION").withColumnRenamed("timestamp", "DATE")
    )


def first_available(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Per key, all rows of the first source that has any, as for API, API, then file.

    Source number and key are few; the winner per key is a map-side combined
    minimum joined back, so no window runs over a whole station.
    """
    tagged = None
    for rank, source in enumerate(sources):
        one = source.withColumn("_source", F.lit(rank))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    winner = tagged.groupBy(key).agg(F.min("_source").alias("_source"))
    return tagged.join(winner, [key, "_source"], "left_semi").drop("_source")


def assert_any(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error when it holds no row."""
    if df.isEmpty():
        raise RuntimeError(f"no {what} available")
    return df
