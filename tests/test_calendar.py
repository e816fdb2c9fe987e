"""Calendar steps against pandas' date ranges; no value is lost by alignment."""

from __future__ import annotations

import random
import warnings
from dataclasses import replace
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import features
from panelgrid.operators.grid import align_reindex, align_time_series, region_date_grid
from panelgrid.operators.series import Series, fill_gaps, on_steps, with_halo, with_position
from tests.helpers import SCHEMA, collected

warnings.filterwarnings("ignore", category=FutureWarning)
FREQUENCIES = ["MS", "ME", "2MS", "BMS", "BME", "QS", "QE", "QS-FEB", "BQE-JAN", "2QE-NOV", "YS", "YE-MAY", "BYS", "W", "W-TUE", "3W-FRI",
               "B", "2B", "D", "7h", "90min"]


def rows_for(frequency, seed):
    """A region on the grid with gaps, one with odd rows between, one of a single row."""
    rng = random.Random(seed)
    start = datetime(2019, 1, 1) + timedelta(days=rng.randrange(500), hours=7, microseconds=500_000)
    rows = []
    for region, share in (("on", 0.6), ("odd", 0.5)):
        for moment in pd.date_range(start, periods=40, freq=frequency):
            if rng.random() < share:
                rows.append((region, moment.to_pydatetime(), float(rng.randrange(9)), rng.randrange(9)))
        if region == "odd":
            rows.append(("odd", rows[-1][1] + timedelta(hours=50), 5.0, 1))
            rows.append(("odd", start - timedelta(hours=30), 3.0, 1))
    return [*rows, ("one", start, 1.0, 1)]


def aligned(rows, frequency):
    out = []
    frame = pd.DataFrame(rows, columns=["region_id", "timestamp", "v", "n"])
    for region, own in frame.groupby("region_id"):
        own = own.sort_values("timestamp").set_index("timestamp")
        step = frequency or (pd.infer_freq(own.index) if len(own) > 2 else None) or "1h"
        own = own.reindex(pd.date_range(own.index.min(), own.index.max(), freq=step))
        own["region_id"] = region
        out.append(own.ffill().fillna(0).rename_axis("timestamp").reset_index())
    return pd.concat(out).sort_values(["region_id", "timestamp"])[["region_id", "timestamp", "v", "n"]].values.tolist()


@pytest.mark.parametrize("frequency", FREQUENCIES)
def test_alignment_is_that_of_a_date_range(spark, frequency):
    rows = rows_for(frequency, len(frequency))
    frame = spark.createDataFrame(rows, SCHEMA)
    for chunk in (3, 2048):
        made = collected(align_time_series(frame, Series(frequency=frequency, chunk_rows=chunk)))
        assert made.values.tolist() == aligned(rows, frequency)


@pytest.mark.parametrize("frequency", ["MS", "3ME", "QE-FEB", "YS", "B", "36h", "W-MON", "BME"])
def test_inferred_steps(spark, frequency):
    rng = random.Random(4)
    rows = [("a", t.to_pydatetime() + timedelta(hours=3), float(rng.randrange(9)), 1)
            for t in pd.date_range(datetime(2020, 2, 11), periods=30, freq=frequency)]
    made = collected(align_time_series(spark.createDataFrame(rows, SCHEMA), Series(frequency=None)))
    assert made.values.tolist() == aligned(rows, None)
    assert len(made) == 30


def test_parts_of_seconds_are_kept(spark):
    start = datetime(2020, 1, 1, 0, 0, 0, 500_000)
    rows = [("a", start + timedelta(days=k), float(k + 1), k) for k in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for series in (Series(), Series(frequency=None)):
        assert collected(align_time_series(frame, series))["v"].tolist() == [1.0, 2.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("frequency", ["1D", "MS", None])
def test_equal_times_are_duplicate_keys(spark, frequency):
    rows = [("a", datetime(2020, 1, 1), float(k), k) for k in range(4)] + [("b", datetime(2020, 1, 1), 1.0, 1)]
    with pytest.raises(Exception, match="duplicate key"):
        align_reindex(spark.createDataFrame(rows, SCHEMA), Series(frequency=frequency)).collect()


def test_a_grid_without_a_mark_is_empty(spark):
    rows = [("a", datetime(2020, 1, 5), 1.0, 1), ("a", datetime(2020, 1, 20), 1.0, 1), ("b", datetime(2020, 2, 1), 1.0, 1)]
    made = collected(align_time_series(spark.createDataFrame(rows, SCHEMA), Series(frequency="MS")))
    assert made.values.tolist() == [["b", pd.Timestamp("2020-02-01"), 1.0, 1]]


@pytest.mark.parametrize("frequency", ["MS", "2ME", "B", "3B", "W-SAT", "QS-MAR"])
def test_positions_are_consecutive_and_chunks_change_nothing(spark, frequency):
    regions = spark.createDataFrame([("a",), ("b",)], "region_id string")
    series = Series(frequency=frequency, chunk_rows=4)
    grid = region_date_grid(regions, series, "1968-03-05", "1975-09-02")
    assert [r["timestamp"] for r in grid.where("region_id = 'a'").orderBy("timestamp").collect()] == [
        t.to_pydatetime() for t in pd.date_range("1968-03-05", "1975-09-02", freq=frequency)]
    assert on_steps(grid, series) == series
    positions = [r["_pos"] for r in with_position(grid, series).where("region_id = 'b'").orderBy("timestamp").collect()]
    assert [b - a for a, b in zip(positions, positions[1:])] == [1] * (len(positions) - 1)
    assert on_steps(grid.where("year(timestamp) <> 1970"), series).counted

    values = grid.withColumns({"v": F.when(F.hash("region_id", "timestamp") % 3 == 0, F.dayofyear("timestamp").cast("double")),
                               "n": F.dayofyear("timestamp").cast("long")})
    made = []
    for chunk in (1, 5, 2048):
        own = replace(series, chunk_rows=chunk)
        filled = fill_gaps(values, ["v"], own, backward=True)
        lagged = features.over_chunks(filled, own, 7, lambda w: [
            *features.lag_features(["n"], [1, 7], w), *features.rolling_features(["v"], [4], ["max"], w)])
        made.append(collected(lagged))
    assert made[0].equals(made[1]) and made[1].equals(made[2])
    plain = made[0][made[0]["region_id"] == "a"]
    assert plain["n_lag_7"].tolist() == plain["n"].shift(7).fillna(0).astype(int).tolist()
    assert plain["v_rollmax_4"].tolist() == plain["v"].rolling(4, min_periods=1).max().tolist()


def test_steps_of_an_aligned_panel_are_made_after_the_last_exchange(spark):
    rows = spark.sql("select 1 as region_id, timestamp_ntz'2020-01-01' as timestamp, 5L as n union all "
                     "select 1, timestamp_ntz'2020-03-01', 7L")
    plan = align_time_series(rows, Series(chunk_rows=16))._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode(sequence(_number") < plan.index("Exchange")


def test_copies_of_rows_are_few_even_where_chunks_are_short(spark):
    rows = spark.range(960).selectExpr("1 as region_id", "id as _pos")
    assert with_halo(rows, Series(chunk_rows=16), 12).count() <= 960 * 9 / 8
