"""Second-order boosting against a plain recursive version, the recurrent readout against direct solutions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelgrid.operators import boosting, ensemble, recurrent

RNG = np.random.default_rng(7)
ROWS = 600
X = np.round(RNG.uniform(0, 4, (ROWS, 5)), 1)
X[RNG.random(X.shape) < 0.05] = np.nan
Y = np.where(X[:, 0] > 2, 5.0, 0.0) + np.nan_to_num(X[:, 1]) * 2 - np.where(np.isnan(X[:, 2]), 4, 0) + RNG.normal(0, 0.1, ROWS)
SPLIT = np.where(RNG.random(ROWS) < 0.7, "train", "val")
PARAMS = {"n_estimators": 6, "learning_rate": 0.4, "max_depth": 3, "reg_lambda": 2.0, "subsample": 1.0, "colsample_bytree": 0.7,
          "min_child_weight": 5.0, "max_bins": 200}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(int(k), SPLIT[k], X[k].tolist(), float(Y[k]), float(Y[k] > 4)) for k in range(ROWS)]
    df = spark.createDataFrame(rows, "id int, split string, x array<double>, value double, label double")
    return df.withColumn("feature_vector", array_to_vector("x")).repartition(5).cache()


def plain_tree(x, gradient, hessian, columns, depth):
    """Best split of all values at each node; a function of rows."""
    def leaf():
        value = -gradient.sum() / (hessian.sum() + PARAMS["reg_lambda"]) * PARAMS["learning_rate"]
        return lambda rows: np.full(len(rows), value)

    if not depth:
        return leaf()
    score = lambda some: gradient[some].sum() ** 2 / (hessian[some].sum() + PARAMS["reg_lambda"])
    best = (1e-6, None)
    for c in columns:
        for missing_left in (True, False):
            for cut in [*np.unique(x[~np.isnan(x[:, c]), c]), np.inf]:
                left = np.where(np.isnan(x[:, c]), missing_left, x[:, c] <= cut)
                if min(hessian[left].sum(), hessian[~left].sum()) >= PARAMS["min_child_weight"]:
                    gain = score(left) + score(~left) - score(np.full(len(x), True))
                    if gain > best[0] + 1e-9:
                        best = (gain, (c, cut, missing_left, left))
    if best[1] is None:
        return leaf()
    c, cut, missing_left, left = best[1]
    below = [plain_tree(x[some], gradient[some], hessian[some], columns, depth - 1) for some in (left, ~left)]

    def score_rows(rows):
        goes = np.where(np.isnan(rows[:, c]), missing_left, rows[:, c] <= cut)
        return np.where(goes, below[0](rows), below[1](rows))

    return score_rows


def plain_model(y, kind, rounds, seed):
    train = SPLIT == "train"
    base = y[train].mean()
    margin = np.full(ROWS, np.log(base / (1 - base)) if kind == "classification" else base)
    for number in range(rounds):
        if kind == "classification":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
        else:
            g, h = margin - y, np.ones(ROWS)
        columns = boosting.tree_columns(seed, number, 5, PARAMS["colsample_bytree"])
        margin = margin + plain_tree(X[train], g[train], h[train], columns, PARAMS["max_depth"])(X)
    return 1 / (1 + np.exp(-margin)) if kind == "classification" else margin


def scores(frame, model):
    return np.array([r["s"] for r in frame.select("id", model.score(F.col("feature_vector")).alias("s")).orderBy("id").collect()])


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_equals_a_plain_booster(spark, frame, kind, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK", 2)
    target = frame.withColumn("target", F.col("label" if kind == "classification" else "value"))
    params = PARAMS if kind == "regression" else {**PARAMS, "min_child_weight": 5.0}
    model, history = boosting.fit_second_order(
        target.where("split = 'train'"), kind, params, 3, validation=target.where("split = 'val'"))
    y = (Y > 4).astype(float) if kind == "classification" else Y
    got, want = scores(frame, model), plain_model(y, kind, 6, 3)
    assert np.allclose(got, want, atol=1e-9)
    own = want[SPLIT == "val"], y[SPLIT == "val"]
    loss = ((own[0] - own[1]) ** 2).mean() if kind == "regression" else -np.log(np.where(own[1] > 0.5, own[0], 1 - own[0])).mean()
    assert history[-1][0] == 6 and history[-1][2] == pytest.approx(loss)
    model.save(spark, str(tmp_path / "m"))
    assert np.array_equal(scores(frame, boosting.BoostedTrees.load(spark, str(tmp_path / "m"))), got)


def test_first_rounds_are_the_shorter_model(frame):
    train = frame.where("split = 'train'").withColumn("target", F.col("value"))
    params = {**PARAMS, "subsample": 0.6}
    long, _ = boosting.fit_second_order(train, "regression", params, 5)
    short, _ = boosting.fit_second_order(train, "regression", {**params, "n_estimators": 2}, 5)
    assert np.allclose(scores(frame, long.first(2)), scores(frame, short), atol=1e-12)
    assert not np.allclose(scores(frame, long), scores(frame, short))
    assert 0.5 < boosting._drawn(RNG.integers(-2**62, 2**62, 4000), 3, 0.6).mean() < 0.7


def test_constant_targets_and_no_rows(spark, frame):
    flat = frame.where("split = 'train'").withColumn("target", F.lit(3.0))
    model, _ = boosting.fit_second_order(flat, "regression", {**PARAMS, "n_estimators": 2})
    assert np.allclose(scores(frame, model), 3.0) and all(len(t.feature) == 1 for t in model.trees)
    with pytest.raises(ValueError):
        boosting.fit_second_order(flat.where("false"), "regression", PARAMS)


def windows_frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        w = rng.normal(size=(6, 3))
        w[0, 1] = np.nan if k % 9 == 0 else w[0, 1]
        # the target depends on the order of the rows, not on their sum
        y = 2.0 * np.nan_to_num(w[5, 0]) - np.nan_to_num(w[4, 0]) + 0.1 * rng.normal()
        rows.append((k, "train" if k < 280 else "val", w.tolist(), float(y), float(y > 0)))
    return rows, spark.createDataFrame(rows, "timestamp int, split string, features array<array<double>>, value double, label double").withColumn(
        "region_id", F.lit("a"))


def direct(rows, p):
    cell = recurrent.Cell.drawn(3, p["hidden"], 0.9, 1.0, 42)
    out = []
    for _, _, w, *_ in rows:
        state = np.zeros(p["hidden"])
        for row in np.nan_to_num(np.array(w)):
            state = np.tanh(row @ cell.inputs + state @ cell.recurrence)
        out.append([*state, 1.0])
    return np.array(out)


def test_recurrent_readout_is_the_ridge_solution(spark, tmp_path):
    rows, frame = windows_frame(spark)
    p = {"hidden": 12, "reg_param": 0.02, "iterations": 40}
    model, history = recurrent.fit_recurrent(frame.withColumn("target", F.col("value")), "regression", p)
    x, y = direct(rows, p), np.array([r[3] for r in rows])
    a, b = x[:280], y[:280]
    weights = np.linalg.solve(a.T @ a / 280 + 0.02 * np.diag([1.0] * 12 + [0.0]), a.T @ b / 280)
    assert np.allclose(model.weights, weights, atol=1e-8)
    assert history[-1][1] == pytest.approx(((a @ weights - b) ** 2).mean())
    assert history[-1][2] == pytest.approx(((x[280:] @ weights - y[280:]) ** 2).mean())
    model.save(spark, str(tmp_path / "r"))
    again = recurrent.RecurrentModel.load(spark, str(tmp_path / "r"))
    found = [r["lstm_pred"] for r in ensemble.score_windows(frame, again, "regression").orderBy("timestamp").collect()]
    assert np.allclose(found, x @ weights, atol=1e-8)
    shuffled = [(*r[:2], r[2][::-1], *r[3:]) for r in rows]
    assert not np.allclose(direct(shuffled, p) @ weights, x @ weights)


def test_recurrent_classes(spark):
    rows, frame = windows_frame(spark)
    model, history = recurrent.fit_recurrent(
        frame.withColumn("target", F.col("label")), "classification", {"hidden": 12, "reg_param": 0.001, "iterations": 30})
    x, y = direct(rows, {"hidden": 12}), np.array([r[4] for r in rows])
    p = 1 / (1 + np.exp(-(x @ model.weights)))
    gradient = x[:280].T @ (p - y)[:280] / 280 + 0.001 * np.append(model.weights[:-1], 0)
    assert np.abs(gradient).max() < 1e-6
    assert history[-1][2] == pytest.approx(-np.log(np.where(y > 0.5, p, 1 - p))[280:].mean())
    found = [r["lstm_pred"] for r in ensemble.score_windows(frame, model, "classification").orderBy("timestamp").collect()]
    assert np.allclose(found, p) and ((p > 0.5) == (y > 0.5)).mean() > 0.8


@pytest.mark.parametrize("kind", ["recurrent", "trees", "linear"])
def test_temporal_kinds(spark, kind):
    _, frame = windows_frame(spark)
    whole = frame.withColumns({"target": F.col("value"), "features": F.transform("features", lambda r: F.transform(r, lambda v: F.nanvl(v, F.lit(0.0))))})
    model, history = ensemble.fit_temporal(whole, "regression", {
        "kind": kind, "iterations": 12, "patience": 2, "min_delta": 0.0, "learning_rate": 0.5, "hidden": 32})
    scored = ensemble.score_windows(whole, model, "regression").join(whole.select("timestamp", "target"), "timestamp")
    error, spread = scored.agg(F.avg((F.col("lstm_pred") - F.col("target")) ** 2), F.var_pop("target")).first()
    assert error < 0.7 * spread
    if history:
        stop = ensemble.early_stop([h[2] for h in history], 2, 0.0)
        assert len(history) == stop.epochs
        if kind == "trees":
            assert len(model.trees) == stop.best
    with pytest.raises(ValueError):
        ensemble.fit_temporal(whole, "regression", {"kind": "other"})
