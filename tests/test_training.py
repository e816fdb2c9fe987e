from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from panelgrid import config as cfg
from panelgrid.operators import ensemble
from panelgrid.plans.reporting import report_tables, risk_map
from panelgrid.plans.training import train_and_evaluate
from panelgrid.sources import artifacts
from tests.test_model_inputs import CONFIG, panel  # noqa: F401


@pytest.fixture(scope="module")
def run(spark, panel, tmp_path_factory):  # noqa: F811
    base = str(tmp_path_factory.mktemp("models"))
    return base, train_and_evaluate(panel, CONFIG, base, "trial")


def test_run_folder_and_latest(spark, run):
    base, folder = run
    for part in ("metrics.json", "predictions.csv", "history.json", "feature_columns.json",
                 "scaler.parquet", "random_forest", "boosted_trees", "temporal"):
        assert os.path.isdir(os.path.join(folder, part)), part
    latest = artifacts.read_predictions(spark, os.path.join(base, "latest"))
    assert latest.count() == artifacts.read_predictions(spark, folder).count() > 0


def test_forest_beats_the_mean_on_training_rows(spark, run):
    values = {(r["split"], r["model"], r["metric"]): r["value"]
              for r in artifacts.read_metrics(spark, run[1]).collect()}
    assert values["train", "rf", "r2"] > 0
    assert values["train", "xgb", "r2"] > 0
    assert ("test", "lstm", "rmse") in values


def test_blends_lie_between_their_inputs(spark, run):
    rows = artifacts.read_predictions(spark, run[1])
    outside = rows.where(
        "tabular_ensemble < least(rf_pred, xgb_pred) - 1e-9 or tabular_ensemble > greatest(rf_pred, xgb_pred) + 1e-9"
        " or hybrid_pred < least(lstm_pred, tabular_ensemble) - 1e-9"
        " or hybrid_pred > greatest(lstm_pred, tabular_ensemble) + 1e-9"
    )
    assert outside.count() == 0
    assert rows.where(F.abs(F.col("target") - F.col("hybrid_pred") - F.col("residual")) > 1e-9).count() == 0


def test_reports_over_the_run(spark, run):
    tables = report_tables(spark, run[1], split="test")
    assert tables["overview"].first()["regions"] == 3
    assert tables["map"].count() == 3 and tables["rmse"].count() == 9
    assert risk_map(spark, run[1], "val").count() == 3


def test_stored_feature_lists(spark, run):
    kinds = artifacts.read_feature_columns(spark, run[1]).groupBy("kind").count().collect()
    assert {r["kind"] for r in kinds} == {"tabular", "sequence"}
    files = [f for f in os.listdir(os.path.join(run[1], "history.json")) if f.startswith("part-")]
    with open(os.path.join(run[1], "history.json", files[0])) as f:
        assert json.load(f)["history"][0]["epoch"] == 1


def test_classification_run(spark, panel, tmp_path):  # noqa: F811
    config = cfg.deep_merge(CONFIG, {"target": {"type": "classification"}})
    folder = train_and_evaluate(panel, config, str(tmp_path), "classes", quick=True)
    predictions = artifacts.read_predictions(spark, folder)
    assert predictions.where("hybrid_pred < 0 or hybrid_pred > 1").count() == 0
    assert {r[0] for r in predictions.select("hybrid_class").distinct().collect()} <= {0, 1}
    found = {r["metric"] for r in artifacts.read_metrics(spark, folder).collect()}
    assert {"accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"} <= found
    assert artifacts.read_threshold(spark, folder).first()[0] is not None


def test_weights_are_clipped(spark):
    df = spark.createDataFrame([(10.0, 0.0)], "a double, b double")
    row = df.select(ensemble.blend_hybrid(F.col("a"), F.col("b"), 1.7).alias("x")).first()
    assert row["x"] == 10.0
