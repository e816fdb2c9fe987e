"""Dense time grids: every region on every step, and alignment of sparse rows to them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgrid.operators.series import CHUNK, Series, fill_chunks
from panelgrid.operators.steps import (
    MICROS, MONTH_MARKS, is_marked, micros_of_day, number_of, time_of,
)

FALLBACK_STEP = 3600 * MICROS  # for series whose step cannot be told
#: Calendars that a series without a given step may turn out to follow.
INFERRED = (*MONTH_MARKS, "business day")


def region_table(spark: SparkSession, regions: DataFrame | Sequence[str], name: str) -> DataFrame:
    """Distinct, non-null region ids as a one-column frame."""
    if not isinstance(regions, DataFrame):
        regions = spark.createDataFrame([(r,) for r in regions], f"{name} string")
    return regions.select(name).where(F.col(name).isNotNull()).distinct()


def day_bounds(start: str | date, end: str | date) -> tuple[str, str]:
    """Both dates at midnight, checked for order."""
    days = []
    for value in (start, end):
        if isinstance(value, str):
            value = datetime.fromisoformat(value)
        days.append(value.strftime("%Y-%m-%d"))
    if days[1] < days[0]:
        raise ValueError("end date lies before start date")
    return days[0], days[1]


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _time_at(kinds: Sequence[str]) -> Column:
    """The time of ``_number``, by ``_kind`` and ``_after``."""
    return reduce(lambda other, kind: F.when(
        F.col("_kind") == kind, time_of(kind, F.col("_number"), F.col("_after"))).otherwise(other),
        kinds, F.lit(None).cast("timestamp_ntz"))


def _number_at(kinds: Sequence[str], time: Column) -> Column:
    """The number of a time, by ``_kind``."""
    return reduce(lambda other, kind: F.when(F.col("_kind") == kind, number_of(kind, time)).otherwise(other),
                  kinds, F.lit(None).cast("long"))


def _ticks(bounds: DataFrame, series: Series, name: str, kinds: Sequence[str]) -> DataFrame:
    """Rows with ``_kind``, ``_first``, ``_last`` and ``_step`` (numbers of that kind of step) to
    one row per step, its time of day ``_after``.

    The rows are few and a step table may sit in a single partition, so they are
    first cut into blocks of steps and spread over all tasks; each task then
    generates its own blocks. An explicit number keeps the spread from being
    coalesced on account of the blocks' small size.
    """
    tasks = _tasks(bounds.sparkSession)
    span = F.col("_step") * series.chunk_rows
    starts = F.explode(F.sequence(F.col("_first"), F.col("_last"), span))
    some = bounds.where("_first <= _last")
    blocks = some.withColumn("_start", starts).repartition(tasks, series.region, "_start")
    end = F.least(F.col("_last"), F.col("_start") + span - F.col("_step"))
    ticks = blocks.withColumn("_number", F.explode(F.sequence(F.col("_start"), end, F.col("_step"))))
    return ticks.withColumn(name, _time_at(kinds)).drop(
        "_kind", "_first", "_last", "_step", "_after", "_start", "_number"
    )


def _with_steps(bounds: DataFrame, series: Series, first: Column, last: Column) -> DataFrame:
    """``bounds`` with the grid of the series' own step from a first to a last time."""
    step = series.step
    return bounds.withColumns({
        "_kind": F.lit(step.kind), "_first": step.first_number(first).cast("long"),
        "_last": step.last_number(first, last).cast("long"), "_step": F.lit(step.size).cast("long"),
        "_after": micros_of_day(first),
    })


def region_date_grid(
    regions: DataFrame, series: Series, start: str | date, end: str | date
) -> DataFrame:
    """Each row of ``regions`` on every step from start to end, both included.

    Steps are generated from the region rows: no join. Further columns of
    ``regions`` (coordinates, context) ride along.
    """
    first, last = (F.lit(day).cast("timestamp_ntz") for day in day_bounds(start, end))
    return _ticks(_with_steps(regions, series, first, last), series, series.time, [series.step.kind])


def region_steps(df: DataFrame, series: Series) -> DataFrame:
    """The grid of each region: (region, kind, first, last, step, after), one row per region.

    A grid begins at the region's first time, on a calendar at the next mark with the same time
    of day, and keeps its parts of a second. Without a configured frequency the step is the
    constant gap between a region's rows, counted in months where all rows mark months in the
    same way, in business days where they skip weekends, else in microseconds. A gap is constant
    exactly when all its distinct times lie on the lattice of the mean gap, so two aggregates tell and no
    window is needed.
    """
    time = F.col(series.time)
    bounds = df.groupBy(series.region).agg(
        F.min(time).alias("_from"), F.max(time).alias("_to"), F.count(time).alias("_rows")
    ).where("_rows > 0")
    lattice = [series.region, "_kind", "_first", "_last", "_step", "_after"]
    if series.frequency:
        return _with_steps(bounds, series, F.col("_from"), F.col("_to")).select(*lattice)

    def gap(kind: str) -> Column:
        whole = number_of(kind, F.col("_to")) - number_of(kind, F.col("_from"))
        return F.when((whole > 0) & (whole % (F.col("_rows") - 1) == 0),
                      F.floor(whole / F.greatest(F.col("_rows") - 1, F.lit(1))))

    kinds = ("time", *INFERRED)
    gaps = bounds.where("_rows >= 3").withColumns({f"_gap_{k}": gap(kind) for k, kind in enumerate(kinds)})

    def off(kind: str, k: int) -> Column:
        number = number_of(kind, time) - number_of(kind, F.col("_from"))
        on = is_marked(kind, time) & (number % F.col(f"_gap_{k}") == 0)
        if kind != "time":
            on &= micros_of_day(time) == micros_of_day(F.col("_from"))
        return F.count_if(~F.coalesce(on, F.lit(False))).alias(f"_off_{k}")

    fits = df.select(series.region, time).where(time.isNotNull()).distinct().join(gaps, series.region).groupBy(
        series.region).agg(F.count(F.lit(1)).alias("_times"), *[off(kind, k) for k, kind in enumerate(kinds)])
    fitted = bounds.join(gaps.drop("_from", "_to", "_rows").join(fits, series.region), series.region, "left")
    kind, step = F.lit("time"), F.lit(FALLBACK_STEP).cast("long")
    # Later ones win: a calendar of months, then a constant gap, then business days.
    for k, name in (*[(k, n) for k, n in enumerate(kinds) if n == "business day"], (0, "time"),
                    *[(k, n) for k, n in enumerate(kinds) if n in MONTH_MARKS][::-1]):
        regular = (F.col("_times") == F.col("_rows")) & (F.col(f"_off_{k}") == 0)
        if name == "business day":
            regular &= F.col(f"_gap_{k}") == 1
        step = F.when(regular, F.col(f"_gap_{k}").cast("long")).otherwise(step)
        kind = F.when(regular, F.lit(name)).otherwise(kind)
    chosen = fitted.withColumns({"_kind": kind, "_step": step})

    return chosen.withColumns(
        {"_first": _number_at(kinds, F.col("_from")), "_last": _number_at(kinds, F.col("_to")), "_after": micros_of_day(F.col("_from"))}).select(*lattice)


def align_reindex(df: DataFrame, series: Series) -> DataFrame:
    """Rows of each region on its own regular grid; off-grid rows vanish, gaps are null.

    Two rows of one region and time are an error, raised when the result is computed.
    """
    kinds = [series.step.kind] if series.frequency else ["time", *INFERRED]
    grid = _ticks(region_steps(df, series), series, series.time, kinds)
    return grid.join(with_unique_keys(df, series), series.key, "left").select(*df.columns)


def align_time_series(df: DataFrame, series: Series) -> DataFrame:
    """Regular grid per region, every column filled forward, what is left set to zero.

    The rows of :func:`align_reindex`, filled. Between two known rows all columns stay the same, so
    only the known rows and one row for each block of ``chunk_rows`` steps are shuffled and filled;
    each is then repeated on the steps up to the next one of its block.
    """
    columns = [c for c in df.columns if c not in series.key]
    kinds = [series.step.kind] if series.frequency else ["time", *INFERRED]
    time, number, span = F.col(series.time), F.col("_number"), F.col("_step") * series.chunk_rows
    grids = region_steps(df, series).where("_first <= _last")
    blocks = grids.withColumn("_number", F.explode(F.sequence(F.col("_first"), F.col("_last"), span)))
    known = with_unique_keys(df.where(F.col(series.region).isNotNull() & time.isNotNull()), series).join(
        grids, series.region).withColumn("_number", _number_at(kinds, time)).where(
        number.between(F.col("_first"), F.col("_last")) & ((number - F.col("_first")) % F.col("_step") == 0)
        & (_time_at(kinds) == time)).drop(series.time)
    rows = known.withColumn("_known", F.lit(True)).unionByName(
        blocks.withColumn("_known", F.lit(False)), allowMissingColumns=True)
    chunk = F.col("_first") + F.floor((number - F.col("_first")) / span) * span
    # An explicit number keeps the blocks spread, however small they are before their steps are made.
    chunked = rows.withColumns({CHUNK: chunk, series.time: _time_at(kinds)}).repartition(
        _tasks(df.sparkSession), series.region, CHUNK)
    filled = fill_chunks(chunked, columns, series)
    end = F.least(F.col("_last") + F.col("_step"), F.col(CHUNK) + span)
    after = F.lead("_number", 1).over(Window.partitionBy(series.region, CHUNK).orderBy("_number", "_known"))
    steps = filled.withColumn("_next", F.coalesce(after, end)).where("_next > _number").withColumn(
        "_number", F.explode(F.sequence(number, F.col("_next") - F.col("_step"), F.col("_step"))))
    return steps.withColumn(series.time, _time_at(kinds)).select(*df.columns).fillna(0)


def with_unique_keys(df: DataFrame, series: Series) -> DataFrame:
    """The rows themselves, partitioned by key as a join on it wants them; fails on a key
    that is there twice."""
    others = [F.first(c).alias(c) for c in df.columns if c not in series.key]
    counted = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_rows"), *others)
    named = F.format_string("duplicate key %s, %s", *[F.col(c).cast("string") for c in series.key])
    single = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(F.raise_error(named).cast("boolean"))
    return counted.where(single).select(*df.columns)


def duplicate_keys(df: DataFrame, series: Series) -> DataFrame:
    """Keys held by more than one row; a panel must have none before alignment."""
    return df.groupBy(*series.key).count().where("count > 1")
