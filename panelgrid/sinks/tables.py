"""Writing tables, metrics, models and whole runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import date, datetime, timezone
from pathlib import PurePath
from typing import Any

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession

from panelgrid.sources.events import YEAR, with_year


def save_table(df: DataFrame, path: str) -> str:
    """Writes by suffix: ``.csv`` (with header) or ``.parquet``; a folder of part files."""
    suffix = PurePath(path).suffix.lower()
    writer = df.write.mode("overwrite")
    if suffix == ".csv":
        writer.option("header", True).csv(path)
    elif suffix == ".parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"cannot tell the table format from {suffix!r}")
    return path


def land_partitioned(df: DataFrame, path: str, by: str) -> str:
    """Parquet folders by the values of a column; values that ``df`` has replace those there, others stay.

    Rows are brought together by the column first, so that a task writes few files; where one value has many
    rows, Spark splits them over several tasks.
    """
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def land_events(events: DataFrame, folder: str) -> str:
    """Raw events as parquet by year; the years that ``events`` has are replaced."""
    return land_partitioned(with_year(events), folder, YEAR)


def _plain(value: Any) -> Any:
    if hasattr(value, "item"):
        return value.item()
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, PurePath):
        return str(value)
    raise TypeError(f"cannot store {type(value)} as JSON")


def to_json_text(data: Mapping[str, Any]) -> str:
    """JSON with sorted keys; numpy scalars, dates and paths become plain values."""
    return json.dumps(data, indent=2, default=_plain, sort_keys=True)


def save_text(spark: SparkSession, text: str, path: str) -> str:
    """One small document as a single text part."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def save_metrics_json(
    metrics: DataFrame, path: str, config: Mapping[str, Any] | None = None,
    threshold: float | None = None,
) -> str:
    """Nested metrics, the configuration and the class threshold as one JSON document.

    The metrics are a few dozen figures whatever the data size.
    """
    nested: dict[str, dict[str, dict[str, float]]] = {}
    for row in metrics.toLocalIterator():
        nested.setdefault(row["split"], {}).setdefault(row["model"], {})[row["metric"]] = row["value"]
    document = {
        "metrics": nested, "config": dict(config or {}), "classification_threshold": threshold
    }
    return save_text(metrics.sparkSession, to_json_text(document), path)


def run_folder(base: str, name: str, now: datetime | None = None) -> str:
    """``base/name_YYYYmmdd_HHMMSS`` in UTC."""
    now = now or datetime.now(timezone.utc)
    return f"{base.rstrip('/')}/{name}_{now:%Y%m%d_%H%M%S}"


def save_models(spark: SparkSession, models: Mapping[str, Any], folder: str) -> None:
    """Spark ML's models by their own writer, the library's as small tables."""
    for name, model in models.items():
        if isinstance(model, Model):
            model.write().overwrite().save(f"{folder}/{name}")
        else:
            model.save(spark, f"{folder}/{name}")


def save_run(
    folder: str,
    predictions: DataFrame,
    metrics: DataFrame,
    history: DataFrame,
    scaler: DataFrame,
    feature_columns: Mapping[str, list[str]],
    models: Mapping[str, Any],
    config: Mapping[str, Any],
    threshold: float | None,
) -> str:
    """Everything a report or a later scoring job needs, below one folder."""
    spark = predictions.sparkSession
    land_partitioned(predictions, f"{folder}/predictions.parquet", "split")
    stored = spark.read.parquet(f"{folder}/predictions.parquet")
    save_table(stored.select(*predictions.columns), f"{folder}/predictions.csv")
    save_metrics_json(metrics, f"{folder}/metrics.json", config, threshold)
    epochs = [row.asDict() for row in history.orderBy("epoch").toLocalIterator()]
    save_text(spark, to_json_text({"history": epochs}), f"{folder}/history.json")
    save_text(spark, to_json_text(dict(config)), f"{folder}/config_used.json")
    save_text(spark, to_json_text(dict(feature_columns)), f"{folder}/feature_columns.json")
    save_table(scaler, f"{folder}/scaler.parquet")
    save_models(spark, models, folder)
    return folder


def update_latest(spark: SparkSession, base: str, folder: str, now: datetime | None = None) -> str:
    """Lets ``base/latest`` stand for the run folder: a small document that names it.

    Every call writes a pointer of its own, numbered by time, and replaces none. A pointer appears when
    Spark commits it; the highest one that is complete counts, so a reader always finds one once there was one, an
    interrupted write changes nothing, and of two writers the later wins. Nothing is copied; returns that path.
    """
    name = PurePath(folder.rstrip("/")).name
    number = f"{now or datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    pointers = f"{base.rstrip('/')}/latest"
    save_text(spark, json.dumps({"number": number, "run": name}), f"{pointers}/{number}")
    return pointers
