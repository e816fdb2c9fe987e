"""Regression and classification metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.text import pretty_label
from panelgrid.operators.ranked import with_running_totals
from panelgrid.session import materialize

# Model name -> prediction column.
MODEL_COLUMNS = {
    "rf": "rf_pred",
    "xgb": "xgb_pred",
    "tabular_ensemble": "tabular_ensemble",
    "hybrid_ensemble": "hybrid_pred",
    "lstm": "lstm_pred",
}
DASHBOARD_MODELS = ("hybrid_ensemble", "lstm", "tabular_ensemble")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def regression_aggregates(target: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE and R2 over the rows that have both values."""
    error = target - predicted
    y = F.when(error.isNotNull(), target)
    squared = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > 0, 1.0 - F.try_divide(squared, spread)).otherwise(
        F.when(squared == 0, F.lit(1.0)).when(squared > 0, F.lit(0.0))
    )
    return {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "r2": r2}


def classification_aggregates(
    label: Column, probability: Column, threshold: float
) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 at the threshold; 0 where undefined."""
    both = label.isNotNull() & probability.isNotNull()
    positive = label == 1
    called = probability >= threshold
    tp = F.count_if(both & positive & called)
    fp = F.count_if(both & ~positive & called)
    fn = F.count_if(both & positive & ~called)
    return {
        "accuracy": _ratio(F.count_if(both & (positive == called)), F.count_if(both)),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def _long(df: DataFrame, groups: Sequence[str], cells: Mapping[tuple[str, str], str]) -> DataFrame:
    """Wide aggregate columns to (groups, model, metric, value) rows."""
    rows = F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(metric).alias("metric"),
                 F.col(column).cast("double").alias("value"))
        for (model, metric), column in cells.items()
    ])
    return df.select(*groups, F.explode(rows).alias("_cell")).select(*groups, "_cell.*")


def ranking_metrics(
    df: DataFrame, label: str, score: str, groups: Sequence[str] = ()
) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` per group.

    Rows are first counted per distinct score, which also settles ties: a positive
    outranks every lower-scored negative and half of those scored alike. Average
    precision is the step sum of precision over recall.
    """
    present = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = present.groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    counts = materialize(counts, "score-counts")
    ranked = with_running_totals(counts, score, ["_pos", "_neg"], groups)
    sizes = counts.groupBy(*groups).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    if groups:
        joined = ranked.join(sizes, list(groups))
    else:
        joined = ranked.withColumn("_s", sizes.select(F.struct("_P", "_N")).scalar()).select(
            *ranked.columns, "_s.*"
        )
    hits = F.col("_P") - F.col("_pos_before")
    called = hits + F.col("_N") - F.col("_neg_before")
    pairs = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2))
    precision = F.sum(F.col("_pos") * F.try_divide(hits, called))
    all_pairs = F.max(F.col("_P") * F.col("_N"))
    return joined.groupBy(*groups).agg(
        F.coalesce(F.try_divide(pairs, all_pairs), F.lit(float("nan"))).alias("roc_auc"),
        _ratio(precision, F.max("_P")).alias("pr_auc"),
    )


def regression_metrics(
    df: DataFrame, target: str, predicted: str, groups: Sequence[str] = ()
) -> DataFrame:
    aggregates = regression_aggregates(F.col(target), F.col(predicted))
    return df.groupBy(*groups).agg(*[c.alias(name) for name, c in aggregates.items()])


def classification_metrics(
    df: DataFrame, label: str, probability: str, threshold: float = 0.5,
    groups: Sequence[str] = (),
) -> DataFrame:
    aggregates = classification_aggregates(F.col(label), F.col(probability), threshold)
    return df.groupBy(*groups).agg(*[c.alias(name) for name, c in aggregates.items()])


def evaluate(
    predictions: DataFrame, target_type: str = "regression", threshold: float = 0.5
) -> DataFrame:
    """(split, model, metric, value) for every model column present.

    Each split is one group with a few dozen aggregates: no row is multiplied for
    the regression metrics, and one row per model for the ranking ones.
    """
    models = {m: c for m, c in MODEL_COLUMNS.items() if c in predictions.columns}
    cells, aggregates = {}, []
    for model, column in models.items():
        made = (
            classification_aggregates(F.col("target"), F.col(column), threshold)
            if target_type == "classification"
            else regression_aggregates(F.col("target"), F.col(column))
        )
        for metric, value in made.items():
            cells[model, metric] = f"{model}__{metric}"
            aggregates.append(value.alias(f"{model}__{metric}"))
        aggregates.append(F.count(column).alias(f"{model}__n"))
    wide = predictions.groupBy("split").agg(*aggregates)
    # A model without any prediction in a split has no metrics there.
    for (model, _), column in cells.items():
        wide = wide.withColumn(column, F.when(F.col(f"{model}__n") > 0, F.col(column)))
    long = _long(wide, ["split"], cells)
    if target_type == "classification":
        scores = predictions.select(
            "split", "target",
            F.explode(F.array(*[
                F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"))
                for m, c in models.items()
            ])).alias("s"),
        ).select("split", "target", "s.*")
        ranking = ranking_metrics(scores, "target", "score", ["split", "model"])
        long = long.unionByName(
            ranking.unpivot(["split", "model"], ["roc_auc", "pr_auc"], "metric", "value")
        )
    return long.where(F.col("value").isNotNull())


def metrics_table(
    metrics: DataFrame, metric: str, models: Sequence[str] = DASHBOARD_MODELS
) -> DataFrame:
    """One metric as labelled (Split, Model, value) rows for the models compared in reports."""
    kept = metrics.where((F.col("metric") == metric) & F.col("model").isin(list(models)))
    return kept.where(F.col("value").isNotNull()).select(
        F.initcap("split").alias("Split"), pretty_label(F.col("model")).alias("Model"),
        F.col("value").alias(metric),
    )
