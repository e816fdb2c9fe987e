"""How a panel is keyed in time, and how one region's series is split over tasks.

A region may hold a large share of all rows, so no operator here puts a whole
region into one task. A series is cut into chunks of consecutive rows:

* bounded frames (lags, rolling windows, sliding windows) copy the last rows of
  a chunk into the next one, compute per (region, chunk) and drop the copies;
* unbounded fills make one small row per (region, chunk), carry values across those
  rows, and join them back on (region, chunk);
* chunks and row numbers of irregular series come from range partitions of region and time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelgrid.operators.steps import Step, parse_step
from panelgrid.session import materialize

POSITION = "_pos"
CHUNK = "_chunk"
OWN = "_own"

@dataclass(frozen=True)
class Series:
    """Key columns of a panel and its time step.

    ``frequency`` is the step between neighbouring rows of a region, a fixed span or a calendar
    step (every grid made by :mod:`panelgrid.operators.grid` has one). ``None`` says
    that rows are irregular; positions are then counted instead of computed. ``counted``
    asks for that too where a fixed step has gaps, and ``from_first`` for positions that
    start at 0 in every region.
    """

    region: str = "region_id"
    time: str = "timestamp"
    frequency: str | None = "1D"
    chunk_rows: int = 2048
    counted: bool = False
    from_first: bool = False

    @property
    def key(self) -> list[str]:
        return [self.region, self.time]

    @property
    def step(self) -> Step:
        return parse_step(self.frequency)

    def irregular(self) -> Series:
        return replace(self, frequency=None)

    def time_chunk(self) -> Column:
        """Chunk number from the timestamp alone."""
        step = self.step
        return replace(step, size=step.size * self.chunk_rows).position(F.col(self.time))

    def chunk_window(self, order: str | None = None) -> WindowSpec:
        return Window.partitionBy(self.region, CHUNK).orderBy(order or self.time)


def chunk_order(series: Series) -> WindowSpec:
    """Chunks of a region in time order.

    Frames over it see one row per chunk: a region of a billion rows is half a
    million of them.
    """
    return Window.partitionBy(series.region).orderBy(CHUNK)


def in_ranges(df: DataFrame, series: Series, *numbers: Column) -> DataFrame:
    """Stored rows, dealt to partitions by ranges of (region, time), with ``numbers`` of each row in its partition.

    Ranges follow the rows, not the time, so a region whose rows fall into one hour is spread
    over many tasks like any other.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, series.region, series.time).sortWithinPartitions(series.region, series.time)
    return materialize(ranged.select("*", *numbers), "ranges")


def with_row_index(df: DataFrame, series: Series, name: str = POSITION) -> DataFrame:
    """0-based number of each row within its region in time order, exact for any gaps.

    Rows are range-partitioned by region and time and stored, so a region of any density is
    spread over many tasks. A row's number is its place in its partition, less the region's
    first place there, plus the region's rows in earlier partitions.
    """
    rows = in_ranges(df, series, F.spark_partition_id().alias("_part"),
                     F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    counts = rows.groupBy(series.region, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    parts = Window.partitionBy(series.region).orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(series.region, "_part", (before - F.col("_first")).alias("_offset"))
    return (
        rows.join(offsets, [series.region, "_part"])
        .select(*df.columns, (F.col("_place") + F.col("_offset")).alias(name))
    )


def on_steps(df: DataFrame, series: Series) -> Series:
    """The series itself if every region has one row on each step from its first to its
    last, else one whose positions are counted.

    Lags count rows, so on a series with gaps, repeats or rows between steps a position
    computed from the time would make results depend on where chunks begin. One aggregate
    of the two key columns tells: the steps of a region are bits of 64-bit words, so a word and
    not a row for each step is shuffled.
    """
    if series.frequency is None or series.counted:
        return series
    step = series.step.position(F.col(series.time))
    after = {f"_after_{k}": part for k, part in enumerate(series.step.remainder(F.col(series.time)))}
    seen = df.where(F.col(series.time).isNotNull()).select(
        series.region, step.alias("_step"), *[part.alias(name) for name, part in after.items()])
    words = seen.groupBy(series.region, F.shiftright("_step", 6).alias("_word")).agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(_step, 64) as int))")).alias("_bits"),
        *[edge(c).alias(f"{name}{c}") for name, edge in (("_min", F.min), ("_max", F.max)) for c in ("_step", *after)],
    )
    off = reduce(or_, [F.max(f"_max{c}") != F.min(f"_min{c}") for c in after])
    runs = words.groupBy(series.region).agg(
        F.sum("_rows").alias("_rows"), F.sum(F.bit_count("_bits")).alias("_steps"),
        (F.max("_max_step") - F.min("_min_step") + 1).alias("_span"), off.alias("_off"),
    )
    broken = runs.where("_rows <> _steps or _steps <> _span or _off")
    return series if broken.isEmpty() else replace(series, counted=True)


def with_position(df: DataFrame, series: Series) -> DataFrame:
    """Consecutive integers along each region; free of wide shuffles on a regular grid."""
    if series.frequency is None or series.counted:
        return with_row_index(df, series)
    step = series.step.position(F.col(series.time))
    if not series.from_first:
        return df.withColumn(POSITION, step)
    first = df.groupBy(series.region).agg(F.min(step).alias("_first_step"))
    return df.join(first, series.region).withColumn(POSITION, step - F.col("_first_step")).drop("_first_step")


def with_halo(df: DataFrame, series: Series, before: int) -> DataFrame:
    """Chunks of rows, each led by copies of the ``before`` rows preceding it.

    A chunk has at least eight times as many rows as are copied, so copies are few.
    """
    size = max(series.chunk_rows, 8 * before)
    first = F.floor(F.col(POSITION) / size)
    last = F.floor((F.col(POSITION) + before) / size)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(CHUNK) == first
    )


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(POSITION, CHUNK, OWN)


def fill_gaps(
    df: DataFrame,
    columns: list[str],
    series: Series,
    backward: bool = False,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Last known value within the region, then (``backward``) the next known one.

    ``observed`` may name a smaller frame with the same known values (a grid adds
    only nulls); it is read for the carry instead of ``df``. Rows of an irregular series are
    chunked by ranges of their own order and read from there.
    """
    if series.frequency:
        chunked = df.withColumn(CHUNK, series.time_chunk())
        source = None if observed is None else observed.withColumn(CHUNK, series.time_chunk())
    else:
        chunked, source = in_ranges(df, series, F.spark_partition_id().alias(CHUNK)), None
    return fill_chunks(chunked, columns, series, backward, source).select(*df.columns)


def fill_chunks(
    chunked: DataFrame,
    columns: list[str],
    series: Series,
    backward: bool = False,
    observed: DataFrame | None = None,
) -> DataFrame:
    """:func:`fill_gaps` of rows whose chunk is in ``CHUNK``, which ascends with the time of a region."""
    source = chunked if observed is None else observed
    time = F.col(series.time)
    known = {c: F.when(F.col(c).isNotNull(), time) for c in columns}
    edges = [F.max_by(F.col(c), known[c]).alias(f"_last_{c}") for c in columns]
    if backward:
        edges += [F.min_by(F.col(c), known[c]).alias(f"_first_{c}") for c in columns]
    per_chunk = source.groupBy(series.region, CHUNK).agg(*edges)
    if observed is not None:
        # Chunks without a single observation must still receive carried values.
        spine = chunked.select(series.region, CHUNK).distinct()
        per_chunk = spine.join(per_chunk, [series.region, CHUNK], "left")

    earlier = chunk_order(series).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(series.region).orderBy(F.desc(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [F.last(f"_last_{c}", True).over(earlier).alias(f"_prev_{c}") for c in columns]
    if backward:
        carried += [F.last(f"_first_{c}", True).over(later).alias(f"_next_{c}") for c in columns]
    carry = per_chunk.select(series.region, CHUNK, *carried)

    upto = series.chunk_window().rowsBetween(Window.unboundedPreceding, 0)
    # Read backwards, so that this frame too grows by one row at a time.
    onward = (
        Window.partitionBy(series.region, CHUNK).orderBy(F.desc(series.time))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = {}
    for c in columns:
        options = [F.last(c, True).over(upto), F.col(f"_prev_{c}")]
        if backward:
            options += [F.last(c, True).over(onward), F.col(f"_next_{c}")]
        filled[c] = F.coalesce(*options)
    carried_in = chunked.join(carry, [series.region, CHUNK], "left")
    return carried_in.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in chunked.columns])
