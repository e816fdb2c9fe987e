"""Train, score, evaluate and store one run."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame

from panelgrid import config as cfg
from panelgrid.operators import ensemble
from panelgrid.operators.metrics import evaluate
from panelgrid.plans.panel import build_model_inputs
from panelgrid.session import materialize
from panelgrid.sinks import tables


def train_and_evaluate(
    panel: DataFrame,
    config: Mapping[str, Any] | None = None,
    output_dir: str | None = None,
    run_name: str | None = None,
    quick: bool = False,
    align: bool = True,
    now: datetime | None = None,
) -> str:
    """Returns the run folder with predictions, metrics, models and lists."""
    config = cfg.quick(config or {}) if quick else cfg.resolve(config)
    training = config["training"]
    seed = training["random_seed"]
    inputs = build_model_inputs(panel, config, align=align, store=True)
    target_type = inputs.target_type

    # Rows of a stored panel are a filter on it; others are stored here, for all fits.
    tabular = inputs.tabular if inputs.stored else materialize(inputs.tabular, "tabular")
    windows = materialize(inputs.windows, "windows")
    train = ensemble.tabular_vectors(
        tabular.where("split = 'train'").withColumnRenamed(inputs.target_column, "target"),
        inputs.feature_columns,
    ).select(ensemble.VECTOR, "target")
    if train.isEmpty():
        raise RuntimeError("no training rows")
    forest = ensemble.fit_forest(train, target_type, training["tabular"]["rf"], seed)
    boosted = ensemble.fit_boosted(train, target_type, training["tabular"]["gbt"], seed)

    temporal, history = None, []
    if not windows.where("split = 'train'").isEmpty():
        temporal, history = ensemble.fit_temporal(windows, target_type, training["temporal"], seed)
    scored = ensemble.score_all(
        tabular, windows, inputs.feature_columns, forest, boosted, temporal, config,
        inputs.target_column, inputs.series,
    )
    predictions = materialize(scored, "predictions")
    metrics = evaluate(predictions, target_type, config["target"]["probability_threshold"])
    threshold = inputs.threshold.first()["value"] if inputs.threshold is not None else None

    base = output_dir or config["paths"]["artifacts_dir"]
    folder = tables.run_folder(base, run_name or config["experiment"]["name"], now)
    models = {"random_forest": forest, "boosted_trees": boosted}
    if temporal is not None:
        models["temporal"] = temporal
    tables.save_run(
        folder, predictions, metrics,
        ensemble.history_table(panel.sparkSession, history), inputs.scaler,
        {"tabular_features": inputs.feature_columns,
         "sequence_features": inputs.sequence_feature_columns},
        models, config, threshold,
    )
    tables.update_latest(panel.sparkSession, base, folder)
    return folder
