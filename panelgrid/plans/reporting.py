"""Report jobs over stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelgrid.operators import reports
from panelgrid.operators.clean import filter_predictions, filter_split_or_fail
from panelgrid.operators.metrics import metrics_table
from panelgrid.sources.artifacts import read_metrics, read_predictions


def risk_map(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """Risk per region of one split of a stored run."""
    return reports.region_risk(filter_split_or_fail(read_predictions(spark, path), split))


def report_tables(
    spark: SparkSession, path: str, split: str | None = None, region: str | None = None,
    start: str | None = None, end: str | None = None,
) -> dict[str, DataFrame]:
    """The tables behind every report page, for one set of filters."""
    predictions = read_predictions(spark, path, missing_ok=True)
    metrics = read_metrics(spark, path)
    rows, curve = reports.browse(predictions, split, region, start, end)
    return {
        "overview": reports.kpi_summary(predictions),
        "overview_curve": reports.daily_mean(predictions),
        "map": reports.risk_map_table(filter_predictions(predictions, split, region)),
        "predictions": rows,
        "predictions_curve": curve,
        "rmse": metrics_table(metrics, "rmse"),
        "mae": metrics_table(metrics, "mae"),
        "r2": metrics_table(metrics, "r2"),
        "comparison_bounds": reports.axis_bounds(predictions),
        "comparison_pairs": reports.valid_pairs(
            predictions, "lstm_pred", "tabular_ensemble"
        ).select("lstm_pred", "tabular_ensemble"),
    }
