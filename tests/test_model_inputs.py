from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid import config as cfg
from panelgrid.operators import sequences, split
from panelgrid.operators.aggregate import resolve_sequence_length
from panelgrid.operators.clean import select_feature_columns
from panelgrid.operators.series import Series
from panelgrid.plans.panel import build_model_inputs, load_panel

CONFIG = {
    "sequence": {"length": 5, "features": ["n", "failures_lag_1"]},
    "features": {"lags": [1, 3], "rolling_windows": [3], "rolling_statistics": ["mean", "std"]},
    "training": {
        "temporal": {"iterations": 3, "patience": 1, "max_depth": 2},
        "tabular": {"rf": {"n_estimators": 5, "max_depth": 4},
                    "gbt": {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}},
    },
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for r, size in (("a", 60), ("b", 60), ("hot", 60)):
        for i in range(size):
            y = float((i * 7 + len(r)) % 11)
            rows.append((r, datetime(2020, 1, 1) + timedelta(days=i), y, i % 4, 1.0, 2.0))
    return spark.createDataFrame(
        rows, "region_id string, timestamp timestamp_ntz, failures double, n long, "
              "latitude double, longitude double",
    )


@pytest.mark.parametrize("n,want", [(10, (7, 8)), (2557, (1789, 2173)), (1, (1, 1)), (2, (1, 2)), (3, (2, 3))])
def test_cut_ranks(n, want):
    assert split.cut_ranks(n, 0.15, 0.15) == want


def test_split_is_monotone_in_time(spark, panel):
    labelled = split.chronological_split(panel, Series())
    bounds = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in labelled.groupBy("split").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n")
    ).collect()}
    assert bounds["train"][1] < bounds["val"][0] <= bounds["val"][1] < bounds["test"][0]
    assert sum(b[2] for b in bounds.values()) == 180


def test_scaler_and_constant_feature(spark, panel):
    labelled = split.chronological_split(panel, Series())
    columns = ["n", "latitude"]
    scaler = split.fit_scaler(labelled, columns)
    by_name = {r["feature"]: r for r in split.scaler_rows(scaler).collect()}
    assert by_name["latitude"]["scale"] == 1.0
    scaled = split.with_scaled_features(labelled.where("split = 'train'"), columns, scaler)
    values = np.array([r["features"] for r in scaled.select("features").collect()])
    np.testing.assert_allclose(values.mean(axis=0), 0, atol=1e-6)
    np.testing.assert_allclose(values.std(axis=0), [1, 0], atol=1e-6)


def test_sequence_length_clamp(spark, panel):
    labelled = split.chronological_split(panel, Series())
    assert resolve_sequence_length(labelled, "region_id", 24) == 24
    assert resolve_sequence_length(labelled, "region_id", 1000) == 42
    assert resolve_sequence_length(labelled, "region_id", 0) == 1


@pytest.mark.parametrize("stride", [1, 3])
def test_windows_match_brute_force(spark, panel, stride):
    length = 5
    labelled = split.chronological_split(panel, Series()).withColumn(
        "features", F.array(F.col("n").cast("float"), F.col("failures").cast("float"))
    )
    made = sequences.sliding_windows(labelled, Series(chunk_rows=8), "failures", length, stride)
    found = {(r["region_id"], r["timestamp"]): (r["split"], r["target"], [list(x) for x in r["features"]])
             for r in made.collect()}
    rows = labelled.orderBy("region_id", "timestamp").collect()
    want = {}
    for region in ("a", "b", "hot"):
        own = [r for r in rows if r["region_id"] == region]
        for end in range(length - 1, len(own), stride):
            window = own[end - length + 1: end + 1]
            if len({r["split"] for r in window}) == 1:
                want[region, own[end]["timestamp"]] = (
                    own[end]["split"], own[end]["failures"], [list(r["features"]) for r in window]
                )
    assert found == want


@pytest.mark.parametrize("stride", [1, 2])
def test_windows_and_tabular_rows_share_keys(spark, panel, stride):
    config = cfg.deep_merge(CONFIG, {"sequence": {"stride": stride}})
    inputs = build_model_inputs(panel, config)
    keys = ["split", "region_id", "timestamp"]
    tabular = {tuple(r) for r in inputs.tabular.select(*keys).collect()}
    windows = {tuple(r) for r in inputs.windows.select(*keys).collect()}
    assert tabular == windows and {k[0] for k in tabular} == {"train", "val", "test"}
    assert inputs.sequence_length == 5
    assert sequences.WINDOW_END not in inputs.feature_columns


def test_classification_target(spark, panel):
    inputs = build_model_inputs(panel, cfg.deep_merge(CONFIG, {"target": {"type": "classification"}}))
    threshold = inputs.threshold.first()["value"]
    rows = inputs.tabular.select("failures", "target_class").collect()
    assert all(r["target_class"] == int(r["failures"] >= threshold) for r in rows)
    assert inputs.target_column == "target_class"


def test_feature_selection(spark, panel):
    wide = panel.withColumn("failures_diff_1", F.lit(1.0)).withColumn("event_count", F.lit(1))
    wide = wide.withColumn("event_count_rollmean_3", F.lit(1.0)).withColumn("event_count_lag_1", F.lit(1.0))
    everything = select_feature_columns(wide, "failures")
    assert everything == ["n", "failures_diff_1", "event_count", "event_count_rollmean_3", "event_count_lag_1"]
    safe = select_feature_columns(wide, "failures", {"leak_safe": True})
    assert safe == ["n", "event_count_lag_1"]


def test_loader_contract(spark, panel):
    loaders = {"real": lambda s, c: panel, "bad": lambda s, c: panel.drop("failures")}
    assert load_panel(spark, loaders, {}).count() == 180
    with pytest.raises(ValueError):
        load_panel(spark, loaders, {}, mode="demo")
    with pytest.raises(ValueError):
        load_panel(spark, loaders, {}, mode="bad")


def test_deep_merge_keeps_siblings():
    merged = cfg.resolve({"split": {"val_size": 0.2}})
    assert merged["split"] == {"val_size": 0.2, "test_size": 0.15}
    assert cfg.quick({})["training"]["tabular"]["rf"]["n_estimators"] == 100
