"""Storm event files: which to read, and how."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.fixed_values import EVENT_FILE_NAME, EVENT_FILE_PATTERN
from panelgrid.functions.text import parse_event_time

log = logging.getLogger(__name__)

EVENT_SCHEMA = T.StructType([
    T.StructField("EVENT_ID", T.LongType()),
    T.StructField("STATE", T.StringType()),
    T.StructField("EVENT_TYPE", T.StringType()),
    T.StructField("BEGIN_DATE_TIME", T.StringType()),
    T.StructField("BEGIN_LAT", T.DoubleType()),
    T.StructField("BEGIN_LON", T.DoubleType()),
    T.StructField("DAMAGE_PROPERTY", T.StringType()),
    T.StructField("DEATHS_DIRECT", T.LongType()),
    T.StructField("INJURIES_DIRECT", T.LongType()),
    T.StructField("MAGNITUDE", T.DoubleType()),
])


def select_or_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema; those absent are typed nulls."""
    return df.select(*[
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def scan_storm_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The ten event columns of all files, read by name whatever else a file holds.

    Files may order their columns differently; those with the same header are one scan. A
    column a file lacks is null. Quoted fields may hold line breaks: a file is one task then,
    which gzipped files are anyway; the first aggregation spreads its rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no event files to read")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = tuple(spark.read.csv(path, header=True, escape='"').columns)
        layouts.setdefault(header, []).append(path)
    types = {f.name: f for f in EVENT_SCHEMA.fields}
    scans = []
    for header, files in layouts.items():
        on_disk = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in header])
        raw = spark.read.csv(
            files, header=True, schema=on_disk, enforceSchema=False, mode="PERMISSIVE", escape='"',
            multiLine=True,
        )
        scans.append(select_or_null(raw, EVENT_SCHEMA))
    return reduce(DataFrame.unionByName, scans)


YEAR = "year"


def with_year(events: DataFrame) -> DataFrame:
    """Raw events with the year of their time, null where it is unreadable."""
    return events.withColumn(YEAR, F.year(parse_event_time(F.col("BEGIN_DATE_TIME"))))


def read_landed_events(
    spark: SparkSession, folder: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Landed events of a range of years, both included; folders of other years are not read.

    Without a range events of unreadable time are there too.
    """
    landed = spark.read.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField(YEAR, T.IntegerType())])).parquet(folder)
    if first_year is not None:
        landed = landed.where(F.col(YEAR) >= first_year)
    if last_year is not None:
        landed = landed.where(F.col(YEAR) <= last_year)
    return landed.drop(YEAR)


def latest_file_per_year(listing: DataFrame, name: str = "name") -> DataFrame:
    """(year, file) with the largest stamp of each year; other names are ignored."""
    year = F.regexp_extract(name, EVENT_FILE_PATTERN, 1)
    stamp = F.regexp_extract(name, EVENT_FILE_PATTERN, 2)
    return (
        listing.select(year.alias("year"), stamp.alias("stamp"))
        .where("year != ''")
        .groupBy("year")
        .agg(F.max("stamp").alias("stamp"))
        .select("year", F.format_string(EVENT_FILE_NAME, "year", "stamp").alias("file"))
    )


def files_for_years(listing: DataFrame, years: Sequence[int], name: str = "name") -> list[str]:
    """File names of the wanted years, one per year; missing years are logged."""
    wanted = [str(y) for y in years]
    found = latest_file_per_year(listing, name).where(F.col("year").isin(wanted))
    by_year = {row["year"]: row["file"] for row in found.toLocalIterator()}
    for year in wanted:
        if year not in by_year:
            log.warning("no storm event file for year %s", year)
    if not by_year:
        raise RuntimeError("no storm event file for any configured year")
    return [by_year[y] for y in wanted if y in by_year]
