"""Physical plans: exchanges, sorts and pushed filters."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from panelgrid.operators import clean, features
from panelgrid.operators.grid import region_date_grid
from panelgrid.operators.series import Series
from panelgrid.sinks import tables
from panelgrid.sources import artifacts, events
from tests.helpers import SCHEMA, random_rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    spark.createDataFrame(random_rows(9, {"a": 50, "b": 50}), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_all_features_share_one_exchange_and_one_sort(stored):
    config = {"lags": [1, 3, 6], "rolling_windows": [3, 6], "rolling_statistics": ["mean", "max", "std"]}
    plan = plan_of(features.engineer_features(stored, Series(), "v", config))
    assert len(re.findall(r"Exchange hashpartitioning\(region_id#\d+, _chunk", plan)) == 1
    assert plan.count("Exchange") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_date_range_reaches_the_scan(stored):
    kept = clean.between_days(stored, "timestamp", "2020-01-05", "2020-01-09").select("v")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        kept.explain("formatted")
    plan = text.getvalue()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed
    assert "n:bigint" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_grid_is_generated_without_a_join(spark):
    regions = spark.createDataFrame([("a",)], "region_id string")
    plan = plan_of(region_date_grid(regions, Series(), "2020-01-01", "2020-12-31"))
    assert "Join" not in plan and "Cartesian" not in plan


def test_landed_years_and_splits_prune_the_scan(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(k, "TEXAS", "Hail", f"{k % 28 + 1:02d}-JAN-{94 + k % 5} 10:00:00", 1.0, 2.0, "1K", 0, 0, 1.0) for k in range(50)]
    raw = spark.createDataFrame([*rows, (99, "TEXAS", "Hail", "?", 1.0, 2.0, "1K", 0, 0, 1.0)], events.EVENT_SCHEMA)
    tables.land_events(raw, folder)
    some = events.read_landed_events(spark, folder, 1995, 1996)
    plan = plan_of(some)
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ >= 1995\), \(year#\d+ <= 1996\)\]", plan)
    assert {r["EVENT_ID"] % 5 for r in some.collect()} == {1, 2} and some.columns == raw.columns
    assert events.read_landed_events(spark, folder).count() == 51
    tables.land_events(raw.where("EVENT_ID % 5 = 1").limit(3), folder)
    assert events.read_landed_events(spark, folder).count() == 44
    assert events.read_landed_events(spark, folder, 1995, 1995).count() == 3

    predictions = spark.createDataFrame([("a", "train", 1.0), ("b", "test", 2.0)], "region_id string, split string, target double")
    tables.land_partitioned(predictions, str(tmp_path / "run" / "predictions.parquet"), "split")
    read = artifacts.read_predictions(spark, str(tmp_path / "run"))
    assert read.columns == predictions.columns and sorted(map(tuple, read.collect())) == sorted(map(tuple, predictions.collect()))
    assert re.search(r"PartitionFilters: \[[^\]]*split#\d+ = test", plan_of(clean.filter_split_or_fail(read, "test")))
