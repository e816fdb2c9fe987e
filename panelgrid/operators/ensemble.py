"""Tree models on tabular rows, a temporal model on sliding windows, and their blends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.numeric import at_least, clip_unit
from panelgrid.operators.boosting import BoostedTrees, fit_second_order
from panelgrid.operators.joins import combine_predictions
from panelgrid.operators.recurrent import RecurrentModel, fit_recurrent
from panelgrid.operators.series import Series
from panelgrid.session import shared_folder

VECTOR = "feature_vector"
KEY_COLUMNS = ("latitude", "longitude", "split", "target")


def _checkpointing(df: DataFrame) -> None:
    """Long boosting runs cut their lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))


def tabular_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(columns), outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(df)


def window_vectors(windows: DataFrame) -> DataFrame:
    """Feature rows of each window laid end to end, oldest first."""
    flat = F.transform(F.flatten("features"), lambda x: x.cast("double"))
    return windows.withColumn(VECTOR, array_to_vector(flat))


def fit_forest(
    train: DataFrame, target_type: str, params: Mapping[str, Any] | None = None, seed: int = 42
) -> Model:
    """Random forest; every feature is tried at every split when regressing.

    Each tree sees a bootstrap sample of the rows, or with ``bootstrap`` off all of them.
    """
    p = {"n_estimators": 400, "max_depth": 12, "min_samples_leaf": 2, "bootstrap": True,
         **(params or {})}
    regression = target_type != "classification"
    estimator = (RandomForestRegressor if regression else RandomForestClassifier)(
        featuresCol=VECTOR, labelCol="target", seed=seed, numTrees=p["n_estimators"],
        maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"],
        bootstrap=p["bootstrap"],
        featureSubsetStrategy="all" if regression else "sqrt",
    )
    return estimator.fit(train)


def fit_boosted(
    train: DataFrame, target_type: str, params: Mapping[str, Any] | None = None, seed: int = 42
) -> Model | BoostedTrees:
    """Gradient boosted trees with row and feature sampling.

    ``method`` ``second_order`` penalises leaves and samples columns per tree; ``spark`` takes
    Spark ML's trees, which do neither and sample columns per node.
    """
    p = {"method": "second_order", **(params or {})}
    if p["method"] == "second_order":
        return fit_second_order(train, target_type, {k: v for k, v in p.items() if k != "method"}, seed, VECTOR)[0]
    _checkpointing(train)
    p = {"n_estimators": 500, "learning_rate": 0.05, "max_depth": 5, "subsample": 0.9,
         "colsample_bytree": 0.8, **(params or {})}
    kind = GBTRegressor if target_type != "classification" else GBTClassifier
    estimator = kind(
        featuresCol=VECTOR, labelCol="target", seed=seed, maxIter=p["n_estimators"],
        stepSize=p["learning_rate"], maxDepth=p["max_depth"], subsamplingRate=p["subsample"],
        featureSubsetStrategy=str(p["colsample_bytree"]),
    )
    return estimator.fit(train)


def with_prediction(
    df: DataFrame, model: Model | BoostedTrees | RecurrentModel, name: str, target_type: str
) -> DataFrame:
    """Adds the predicted value, or the probability of class 1."""
    if isinstance(model, BoostedTrees):
        return df.withColumn(name, model.score(F.col(VECTOR)))
    if isinstance(model, RecurrentModel):
        return df.withColumn(name, model.score(F.col("features")))
    scored = model.transform(df)
    if target_type == "classification":
        value: Column = vector_to_array("probability").getItem(1)
    else:
        value = F.col("prediction")
    return scored.withColumn(name, value).select(*df.columns, name)


def waited_enough(losses: Sequence[float], patience: int, min_delta: float) -> bool:
    """Whether as many epochs as ``patience`` went by since the last better one."""
    return len(losses) - early_stop(losses, len(losses) + 1, min_delta).best >= patience


@dataclass
class EarlyStop:
    epochs: int
    best: int


def early_stop(losses: Sequence[float], patience: int, min_delta: float) -> EarlyStop:
    """Where training ends and which epoch is kept: the last one that improved the
    best validation loss by more than ``min_delta``, with ``patience`` tries after it."""
    best, best_epoch, waited = float("inf"), 0, 0
    for epoch, loss in enumerate(losses, start=1):
        if loss + min_delta < best:
            best, best_epoch, waited = loss, epoch, 0
        else:
            waited += 1
        if waited >= patience:
            return EarlyStop(epoch, max(best_epoch, 1))
    return EarlyStop(len(losses), max(best_epoch, 1))


def history_table(spark, history: Sequence[tuple[int, float, float | None]]) -> DataFrame:
    return spark.createDataFrame(history, "epoch int, train_loss double, val_loss double")


def fit_temporal(
    windows: DataFrame, target_type: str, params: Mapping[str, Any] | None = None, seed: int = 42
) -> tuple[BoostedTrees | RecurrentModel | Model, list[tuple[int, float, float | None]]]:
    """A model of windows, stopped early on the validation windows, and its history.

    ``kind`` chooses it: ``recurrent`` (a fixed cell over the rows, a trained readout), ``trees``
    (boosted, on flattened windows) or ``linear`` (on flattened windows, without history). Each is fitted once; the
    epoch that is kept is a state the fit went through.
    """
    p = {"kind": "recurrent", "iterations": 25, "patience": 5, "min_delta": 0.0005, **(params or {})}
    kind = p.pop("kind")

    def stopped(losses: list[float]) -> tuple[int, int]:
        found = early_stop(losses, p["patience"], p["min_delta"])
        return found.epochs, found.best

    if kind == "recurrent":
        return fit_recurrent(windows, target_type, p, seed, stopped)
    if kind == "linear":
        return fit_temporal_linear(windows, target_type, p.get("reg_param", 0.1), p["iterations"]), []
    if kind != "trees":
        raise ValueError(f"no temporal model {kind!r}")
    vectors = window_vectors(windows)
    validation = vectors.where("split = 'val'")
    first = windows.select(F.size("features").alias("rows")).first()
    model, history = fit_second_order(
        vectors.where("split = 'train'"), target_type,
        {"max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0, **p, "n_estimators": p["iterations"]},
        seed, VECTOR, validation, lambda losses: waited_enough(losses, p["patience"], p["min_delta"]), first["rows"])
    if history and history[0][2] is not None:
        epochs, best = stopped([h[2] for h in history])
        return model.first(best), history[:epochs]
    return model, history


def fit_temporal_linear(
    windows: DataFrame, target_type: str, reg_param: float = 0.1, iterations: int = 25
) -> Model:
    """Linear (or logistic) model on flattened windows."""
    kind = LinearRegression if target_type != "classification" else LogisticRegression
    train = window_vectors(windows.where("split = 'train'"))
    return kind(
        featuresCol=VECTOR, labelCol="target", regParam=reg_param, maxIter=iterations
    ).fit(train)


def score_windows(
    windows: DataFrame, model: Model | BoostedTrees | RecurrentModel, target_type: str, series: Series = Series()
) -> DataFrame:
    """Temporal prediction per window key."""
    rows = windows if isinstance(model, RecurrentModel) else window_vectors(windows)
    return with_prediction(rows, model, "lstm_pred", target_type).select("split", *series.key, "lstm_pred")


def blend_tabular(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Weighted mean of both tree models."""
    blended = F.lit(alpha) * F.col("rf_pred") + F.lit(1 - alpha) * F.col("xgb_pred")
    return df.withColumn("tabular_ensemble", blended)


def blend_hybrid(tabular: Column, temporal: Column, weight_tabular: float) -> Column:
    """Weighted mean of tabular and temporal predictions, the weight clipped to [0, 1]."""
    weight = clip_unit(F.lit(float(weight_tabular)))
    return weight * tabular + (1.0 - weight) * temporal


def finish_predictions(
    df: DataFrame, weight_tabular: float, target_type: str, probability_threshold: float = 0.5,
    series: Series = Series(),
) -> DataFrame:
    """Adds the weights used and the residual (or class) in the table's fixed order."""
    weight = clip_unit(F.lit(float(weight_tabular)))
    if target_type == "classification":
        last = at_least(F.col("hybrid_pred"), probability_threshold).alias("hybrid_class")
    else:
        last = (F.col("target") - F.col("hybrid_pred")).alias("residual")
    return df.select(
        *series.key, *KEY_COLUMNS, "rf_pred", "xgb_pred", "tabular_ensemble",
        "hybrid_pred", "lstm_pred", weight.alias("weight_tabular"),
        (1.0 - weight).alias("weight_lstm"), last,
    )


def score_all(
    tabular: DataFrame,
    windows: DataFrame | None,
    columns: Sequence[str],
    forest: Model,
    boosted: Model | BoostedTrees,
    temporal: Model | BoostedTrees | RecurrentModel | None,
    config: Mapping[str, Any],
    target: str,
    series: Series = Series(),
) -> DataFrame:
    """Predictions of every model for all splits at once; split is a column throughout."""
    target_type = config["target"]["type"]
    training = config["training"]
    weight = training["ensemble"]["weight_tabular"]
    rows = tabular_vectors(tabular, columns).select(
        *series.key, "latitude", "longitude", "split", F.col(target).alias("target"), VECTOR
    )
    scored = with_prediction(rows, forest, "rf_pred", target_type)
    scored = with_prediction(scored, boosted, "xgb_pred", target_type).drop(VECTOR)
    scored = blend_tabular(scored, training["tabular"]["blend_alpha"])
    if temporal is not None and windows is not None:
        scored = combine_predictions(
            scored, score_windows(windows, temporal, target_type, series), weight, series
        )
    else:
        scored = scored.withColumns({
            "lstm_pred": F.lit(None).cast("double"), "hybrid_pred": F.col("tabular_ensemble")
        })
    return finish_predictions(
        scored, weight, target_type, config["target"]["probability_threshold"], series
    )
