"""Artifacts of earlier runs: predictions, metrics, threshold and feature lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("region_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("split", T.StringType()),
    ]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("target", "rf_pred", "xgb_pred", "tabular_ensemble", "hybrid_pred", "lstm_pred",
                  "weight_tabular", "weight_lstm", "residual")
    ]
)

_FIGURES = T.MapType(T.StringType(), T.DoubleType())
METRICS_SCHEMA = T.StructType([
    T.StructField("metrics", T.MapType(T.StringType(), T.MapType(T.StringType(), _FIGURES))),
    T.StructField("classification_threshold", T.DoubleType()),
])


def run_of(spark: SparkSession, path: str) -> str:
    """The folder ``path`` stands for: a run folder, one of its files, or ``latest``."""
    folder = path.rstrip("/")
    if folder.endswith((".csv", ".parquet", ".json")):
        folder = folder.rsplit("/", 1)[0]
    base, _, name = folder.rpartition("/")
    if name != "latest":
        return folder
    try:
        pointers = spark.read.schema("number string, run string").option("recursiveFileLookup", True).json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return folder
    newest = pointers.where("number is not null and run is not null").agg(F.max_by("run", "number").alias("run")).first()
    return f"{base}/{newest['run']}" if newest["run"] else folder


def _file_in(spark: SparkSession, path: str, name: str) -> str:
    return f"{run_of(spark, path)}/{name}"


def read_predictions(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """The predictions table; when absent an error, or an empty frame if ``missing_ok``.

    Classification runs store ``hybrid_class`` in place of ``residual``. The parquet copy is
    read where a run has one; it has a folder per split, so that a filter on the split reads only those.
    """
    folder = run_of(spark, path)
    try:
        stored = spark.read.parquet(f"{folder}/predictions.parquet")
        if stored.columns[-1:] != ["split"] or "target" not in stored.columns:
            return stored
        # A partitioning column comes last; it is put where the table has it.
        names = [c for c in stored.columns if c != "split"]
        at = names.index("target")
        return stored.select(*names[:at], "split", *names[at:])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    file = f"{folder}/predictions.csv"
    try:
        header = spark.read.csv(file, header=True).columns
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if missing_ok:
            return spark.createDataFrame([], PREDICTION_SCHEMA)
        raise FileNotFoundError(f"no predictions at {file}") from None
    types = {f.name: f for f in PREDICTION_SCHEMA.fields}
    types["hybrid_class"] = T.StructField("hybrid_class", T.IntegerType())
    schema = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.csv(file, header=True, schema=schema)


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Nested metrics as (split, model, metric, value) rows; absent entries give none."""
    nested = _read_json(spark, _file_in(spark, path, "metrics.json"), METRICS_SCHEMA)
    splits = nested.select(F.explode("metrics").alias("split", "models"))
    models = splits.select("split", F.explode("models").alias("model", "figures"))
    figures = models.select("split", "model", F.explode("figures").alias("metric", "value"))
    return figures.where(F.col("value").isNotNull())


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, _file_in(spark, path, "metrics.json"), METRICS_SCHEMA).select(
        "classification_threshold"
    )


def read_feature_columns(spark: SparkSession, path: str) -> DataFrame:
    """(kind, position, feature) rows of the stored feature lists."""
    schema = T.StructType([
        T.StructField(k, T.ArrayType(T.StringType()))
        for k in ("tabular_features", "sequence_features")
    ])
    lists = _read_json(spark, _file_in(spark, path, "feature_columns.json"), schema)
    long = lists.unpivot([], ["tabular_features", "sequence_features"], "kind", "features")
    return long.select(
        F.regexp_replace("kind", "_features$", "").alias("kind"),
        F.posexplode("features").alias("position", "feature"),
    )
