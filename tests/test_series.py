from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import features
from panelgrid.operators.grid import align_time_series, duplicate_keys, region_date_grid
from panelgrid.operators.ranked import exact_percentile, with_running_totals
from panelgrid.operators.series import (
    CHUNK, Series, fill_gaps, with_halo, with_position, with_row_index,
)
from panelgrid.operators.steps import MICROS, parse_step
from tests.helpers import SCHEMA, as_pandas, collected, random_rows

# One region holds most of the rows.
SKEWED = {"hot": 160, "a": 7, "b": 1, "c": 40}


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("gaps,frequency", [(0.0, "1D"), (0.4, None)])
@pytest.mark.parametrize("chunk_rows", [4, 1000])
def test_features_match_brute_force(spark, gaps, frequency, chunk_rows):
    rows = random_rows(1, SKEWED, missing=0.2, gaps=gaps)
    series = Series(frequency=frequency, chunk_rows=chunk_rows)
    config = {"lags": [1, 5], "rolling_windows": [3, 6, 12, 5], "rolling_statistics": ["mean", "max", "std"]}
    df = _frame(spark, rows).withColumn("y", F.col("n").cast("double"))
    made = collected(features.engineer_features(df, series, "y", config))
    want = as_pandas(rows)
    want["y"] = want["n"].astype(float)
    groups = want.groupby("region_id")
    for column in ("v", "n"):
        for k in (1, 5):
            np.testing.assert_allclose(
                made[f"{column}_lag_{k}"].astype(float), groups[column].shift(k).fillna(0.0)
            )
        for size in (3, 6, 12, 5):
            rolled = groups[column].rolling(size, min_periods=1)
            for name, values in (("mean", rolled.mean()), ("max", rolled.max()), ("std", rolled.std(ddof=0))):
                np.testing.assert_allclose(
                    made[f"{column}_roll{name}_{size}"].astype(float),
                    values.reset_index(level=0, drop=True), atol=1e-9,
                )
    np.testing.assert_allclose(made["y_diff_1"], groups["y"].diff().fillna(0))
    change = groups["y"].pct_change().replace([np.inf, -np.inf], 0.0).fillna(0.0)
    np.testing.assert_allclose(made["y_pct_change"], change)


def test_feature_names_and_order(spark):
    df = _frame(spark, random_rows(2, {"a": 3})).withColumn("y", F.lit(1.0))
    config = {"lags": [1], "rolling_windows": [2], "rolling_statistics": ["std", "mean"]}
    made = features.engineer_features(df, Series(), "y", config)
    assert made.columns == [
        "region_id", "timestamp", "v", "n", "y", "y_lag_1", "v_lag_1", "v_rollmean_2",
        "v_rollstd_2", "n_lag_1", "n_rollmean_2", "n_rollstd_2", "y_diff_1", "y_pct_change",
    ]


def test_worked_example(spark):
    rows = [("r", datetime(2020, 1, 1) + timedelta(days=i), float(v), 0)
            for i, v in enumerate([0, 0, 2, 0, 3])]
    w = {"lags": [1], "rolling_windows": [3], "rolling_statistics": ["max", "std"],
         "base_weather_cols": ["v"]}
    made = collected(features.engineer_features(_frame(spark, rows), Series(), "v", w))
    assert made["v_lag_1"].tolist() == [0, 0, 0, 2, 0]
    assert made["v_diff_1"].tolist() == [0, 0, 2, -2, 3]
    assert made["v_rollmax_3"].tolist() == [0, 0, 2, 2, 3]
    assert made["v_pct_change"].tolist() == [0, 0, 0, -1, 0]
    np.testing.assert_allclose(made["v_rollstd_3"], [0, 0, 0.942809, 0.942809, 1.247219], atol=1e-6)
    assert (made["v_lag_1"] + made["v_diff_1"])[1:].tolist() == made["v"][1:].tolist()


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_fills_match_brute_force(spark, backward, chunk_rows):
    rows = random_rows(3, SKEWED, missing=0.8)
    series = Series(chunk_rows=chunk_rows)
    df = _frame(spark, rows)
    want = as_pandas(rows)
    groups = want.groupby("region_id")["v"]
    expected = groups.ffill()
    if backward:
        expected = expected.groupby(want["region_id"]).bfill()
    for observed in (None, df.where("v is not null")):
        made = collected(fill_gaps(df, ["v"], series, backward, observed))
        pd.testing.assert_series_equal(made["v"].astype(float), expected, check_names=False)


def test_no_task_group_exceeds_a_chunk(spark):
    df = _frame(spark, random_rows(4, {"hot": 500, "a": 3}))
    chunks = with_halo(with_position(df, Series(chunk_rows=50)), Series(chunk_rows=50), 6)
    largest = chunks.groupBy("region_id", CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 56


def test_row_numbers(spark):
    rows = random_rows(5, SKEWED, gaps=0.5)
    made = collected(with_row_index(_frame(spark, rows), Series(frequency=None), "i"))
    assert made["i"].tolist() == as_pandas(rows).groupby("region_id").cumcount().tolist()


def test_alignment_drops_off_grid_rows_and_fills_forward(spark):
    start = datetime(2020, 1, 1)
    rows = [("r", start, 1.0, 1), ("r", start + timedelta(days=1, hours=6), 9.0, 9),
            ("r", start + timedelta(days=3), 4.0, 4), ("s", start, None, 2)]
    made = collected(align_time_series(_frame(spark, rows), Series()))
    assert made["v"].tolist() == [1.0, 1.0, 1.0, 4.0, 0.0]
    assert made["n"].tolist() == [1, 1, 1, 4, 2]


def test_alignment_infers_a_constant_step(spark):
    start = datetime(2020, 1, 1)
    even = [("even", start + timedelta(days=2 * i), 1.0, i) for i in range(4)]
    uneven = [("uneven", start + timedelta(hours=h), 1.0, h) for h in (0, 1, 5)]
    short = [("short", start, 1.0, 0), ("short", start + timedelta(hours=2), 1.0, 1)]
    made = collected(align_time_series(
        _frame(spark, even + uneven + short), Series(frequency=None)
    ))
    assert made.groupby("region_id").size().to_dict() == {"even": 4, "short": 3, "uneven": 6}


def test_grid_size_and_bad_dates(spark):
    regions = spark.createDataFrame([("a",), ("b",)], "region_id string")
    grid = region_date_grid(regions, Series(chunk_rows=7), "2020-02-01", "2020-03-01")
    assert grid.count() == 2 * 30 == grid.distinct().count()
    with pytest.raises(ValueError):
        region_date_grid(regions, Series(), "2020-02-01", "2020-01-01")


def test_duplicate_keys_are_found(spark):
    day = datetime(2020, 1, 1)
    df = _frame(spark, [("a", day, 1.0, 1), ("a", day, 2.0, 2), ("b", day, 1.0, 1)])
    assert [r["region_id"] for r in duplicate_keys(df, Series()).collect()] == ["a"]


def test_frequencies():
    assert [parse_step(f).size // MICROS for f in ("D", "6h", "15min", "30 s", "2 days", "1H")] == [
        86400, 21600, 900, 30, 172800, 3600
    ]
    for bad in ("WOM", "MS-FEB", "W-XYZ", "B-MON", "0D", "D-MON", "", "5"):
        with pytest.raises(ValueError):
            parse_step(bad)


def test_running_totals_over_many_buckets(spark):
    values = spark.createDataFrame(
        [(g, float(x * x % 997), x % 5) for g in "ab" for x in range(400)], "g string, x double, w int"
    ).groupBy("g", "x").agg(F.sum("w").alias("w")).cache()
    made = with_running_totals(values, "x", ["w"], ["g"], tasks=20).toPandas()
    want = made.sort_values(["g", "x"]).groupby("g")["w"].cumsum() - made["w"]
    assert (made["w_before"] == want.sort_index()).all()


@pytest.mark.parametrize("fraction", [0.0, 0.333, 0.8, 1.0, 1.7])
def test_percentile(spark, fraction):
    values = [1.0, 2.0, 3.0, 4.0, 10.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = np.percentile(values, min(fraction, 1.0) * 100)
    assert exact_percentile(df, "v", fraction).first()["value"] == pytest.approx(want)
