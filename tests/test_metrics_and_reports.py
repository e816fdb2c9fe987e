from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from panelgrid.operators import clean, metrics, reports
from panelgrid.operators.ensemble import early_stop

SCORES = [(1, .9), (0, .9), (1, .8), (0, .3), (1, .3), (0, .1)]


def _scores(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def _predictions(spark, pairs):
    rows = [("r", datetime(2020, 1, 1) + timedelta(days=i), None if i == 0 else 1.0 * i, 2.0, "test",
             t, p) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "region_id string, timestamp timestamp_ntz, latitude double, longitude double, "
              "split string, target double, hybrid_pred double",
    )


def test_ranking_with_ties(spark):
    row = metrics.ranking_metrics(_scores(spark, SCORES), "y", "p").first()
    assert row["roc_auc"] == pytest.approx(0.666667, abs=1e-6)
    assert row["pr_auc"] == pytest.approx(0.588889, abs=1e-6)


def test_ranking_with_one_class(spark):
    row = metrics.ranking_metrics(_scores(spark, [(0, .1), (0, .2)]), "y", "p").first()
    assert math.isnan(row["roc_auc"]) and row["pr_auc"] == 0.0


def test_classification_without_positives_called(spark):
    row = metrics.classification_metrics(_scores(spark, [(1, .1), (0, .2)]), "y", "p").first()
    assert row.asDict() == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}


@pytest.mark.parametrize("pairs,r2", [([(3.0, 3.0), (3.0, 3.0)], 1.0), ([(3.0, 2.0), (3.0, 3.0)], 0.0),
                                      ([(1.0, 1.0), (3.0, 2.0)], 0.5)])
def test_r2(spark, pairs, r2):
    df = spark.createDataFrame(pairs, "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first()["r2"] == pytest.approx(r2)


def test_models_without_predictions_have_no_metrics(spark):
    df = _predictions(spark, [(1.0, 2.0), (2.0, 2.0)]).selectExpr(
        "*", "cast(null as double) as lstm_pred"
    )
    assert {r["model"] for r in metrics.evaluate(df).collect()} == {"hybrid_ensemble"}


def test_histogram_counts_like_brute_force(spark):
    rng = np.random.default_rng(0)
    pairs = [(float(a), float(b)) for a, b in rng.integers(0, 50, (300, 2))]
    made = reports.residual_histogram(_predictions(spark, pairs)).orderBy("bin").collect()
    counts, edges = np.histogram([a - b for a, b in pairs], bins=25)
    assert sum(r["residuals"] for r in made) == 300 and len(made) == 25
    np.testing.assert_allclose([r["bin_start"] for r in made], edges[:-1])
    # Values on an inner edge may fall to either side of it.
    assert np.abs(np.cumsum([r["residuals"] for r in made]) - np.cumsum(counts)).max() <= 12


def test_histogram_of_equal_residuals(spark):
    made = reports.residual_histogram(_predictions(spark, [(1.0, 1.0)] * 4)).collect()
    assert sum(r["residuals"] for r in made) == 4
    assert min(r["bin_start"] for r in made) == -0.5


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=200)
    made = reports.residual_density(_predictions(spark, [(float(v), 0.0) for v in values]), points=50)
    rows = made.orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).mean(axis=1) / (h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose([r["density"] for r in rows], want, rtol=1e-9)


def test_region_risk_takes_the_first_known_position(spark):
    row = reports.region_risk(_predictions(spark, [(0.0, 1.0), (0.0, 2.0), (0.0, 6.0)])).first()
    assert (row["latitude"], row["hybrid_pred"], row["hybrid_class"]) == (1.0, 3.0, 3.0)


def test_daily_mean_without_target(spark):
    df = _predictions(spark, [(0.0, 1.0)]).drop("target")
    assert reports.daily_mean(df).columns == ["timestamp", "hybrid_pred"]


def test_unknown_split_names_the_known_ones(spark):
    with pytest.raises(ValueError, match="test"):
        clean.filter_split_or_fail(_predictions(spark, [(0.0, 1.0)]), "nope")


def test_early_stopping():
    stop = early_stop([5.0, 4.0, 4.0, 3.9999, 3.0, 9.0, 9.0], patience=2, min_delta=0.001)
    assert (stop.epochs, stop.best) == (4, 2)
    assert early_stop([3.0, 2.0, 1.0], 2, 0.0).best == 3
