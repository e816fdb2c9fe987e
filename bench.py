"""Headline timings: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every result
is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_sources import raw_files, real_panel
from panelgrid.operators import features, metrics, ranked, reports, sequences, split
from panelgrid.operators.grid import align_time_series, region_date_grid
from panelgrid.operators.series import Series, fill_gaps
from panelgrid.plans import panel as plans
from panelgrid.plans.training import train_and_evaluate
from panelgrid.session import build_session, scratch_path, with_own_folder
from panelgrid.sources.artifacts import read_metrics

SERIES = Series(region="region_id")
FEATURES = {
    "lags": [1, 3, 6, 12, 24], "rolling_windows": [3, 6, 12, 24],
    "rolling_statistics": ["mean", "max", "std"],
}


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per supplier and ship day."""
    return st.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("region_id"), F.col("l_shipdate").alias("timestamp")
    ).agg(
        (F.sum("l_extendedprice") / 1000).alias("failures"),
        F.count(F.lit(1)).alias("event_count"),
        F.avg("l_quantity").alias("tavg_c"),
        F.avg("l_discount").alias("prcp_mm"),
    )


def supplier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier on every day, null where it shipped nothing."""
    suppliers = st.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("region_id"),
        (F.col("s_nationkey") * 1.5).alias("latitude"), (F.col("s_nationkey") * -2.5).alias("longitude"),
    )
    grid = region_date_grid(suppliers, SERIES, "1995-01-01", "2001-11-04")
    return grid.join(supplier_days(spark, sf_dir), ["region_id", "timestamp"], "left")


def feature_build(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Raw rows to engineered panel, scaled windows' keys and tabular rows."""
    config = {"features": FEATURES, "sequence": {"features": ["event_count", "tavg_c", "prcp_mm"]}}
    panel = supplier_grid(spark, sf_dir).fillna(0)
    inputs = plans.build_model_inputs(panel, config, align=False, store=True)
    return [inputs.tabular, inputs.windows]


def engineered(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    panel = supplier_grid(spark, sf_dir).fillna(0)
    return [features.engineer_features(panel, SERIES, "failures", FEATURES, dense=True)]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions."""
    return st.table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as string) AS region_id", "l_shipdate AS timestamp",
        "CASE WHEN l_shipdate < timestamp_ntz'1999-09-01' THEN 'train' ELSE 'test' END AS split",
        "l_extendedprice / 1000 AS target", "l_quantity AS rf_pred", "l_quantity * 1.5D AS xgb_pred",
        "l_quantity * 1.25D AS tabular_ensemble", "l_quantity + l_tax AS lstm_pred",
        "l_quantity * 1.1D + l_discount AS hybrid_pred",
        "l_suppkey * 1.0D AS latitude", "l_suppkey * -1.0D AS longitude",
    )


def class_metrics(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    classed = scored(spark, sf_dir).withColumn("target", F.expr("cast(target > 40 as int)"))
    return [metrics.evaluate(classed, "classification", 40.0)]


def window_build(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    columns = ["event_count", "tavg_c", "prcp_mm"]
    labelled = split.chronological_split(supplier_grid(spark, sf_dir).fillna(0), SERIES)
    scaled = split.with_scaled_features(labelled, columns, split.fit_scaler(labelled, columns))
    return [sequences.sliding_windows(scaled, SERIES, "failures", 24, dense=True)]


def fills(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [fill_gaps(
        supplier_grid(spark, sf_dir), ["tavg_c", "prcp_mm"], SERIES, backward=True,
        observed=supplier_days(spark, sf_dir),
    )]


def quick_run(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A quick training run on the panel of orders: fit, score, evaluate, store."""
    config = {
        "features": {"base_weather_cols": ["event_count", "tmax_c", "prcp_mm"]},
        "sequence": {"features": ["event_count", "tmax_c", "prcp_mm"]},
    }
    base = scratch_path(spark, "bench-models")
    folder = train_and_evaluate(st.panel(spark, sf_dir), config, base, "bench", quick=True, align=False)
    return [read_metrics(spark, folder)]


QUERIES = {
    "feature_build": feature_build,
    "engineer_features": engineered,
    "sliding_windows": window_build,
    "forward_backward_fill": fills,
    "align_time_series": lambda s, d: [align_time_series(supplier_days(s, d), SERIES)],
    "daily_events": lambda s, rows: [
        plans.daily_events(rows, st.WANTED_REGIONS, st.START, st.END)
    ],
    "raw_files_to_panel": lambda s, files: [real_panel(s, files)],
    "chronological_split": lambda s, d: [split.chronological_split(
        st.table(s, d, "lineitem").select(F.col("l_shipdate").alias("timestamp"), "l_suppkey"), SERIES)],
    "exact_percentile": lambda s, d: [
        ranked.exact_percentile(st.table(s, d, "lineitem"), "l_extendedprice", 0.8)
    ],
    "regression_metrics": lambda s, d: [metrics.evaluate(scored(s, d))],
    "classification_metrics": class_metrics,
    "region_risk": lambda s, d: [reports.region_risk(scored(s, d))],
    "daily_mean": lambda s, d: [reports.daily_mean(scored(s, d))],
    "train_and_evaluate": quick_run,
    "residual_histogram": lambda s, d: [reports.residual_histogram(scored(s, d))],
}

# Raw inputs are made before the clock starts; the query gets them in place of the folder.
INPUTS = {"daily_events": st.storm_rows, "raw_files_to_panel": raw_files}


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))),
        "spark.driver.memory": "16g",
    })
    with_own_folder(spark).sparkContext.setLogLevel("OFF")
    st.table(spark, sf_dir, "nation").groupBy("n_regionkey").count().collect()
    timings = {}
    for name, build in QUERIES.items():
        if argv and name not in argv:
            continue
        given = INPUTS[name](spark, sf_dir) if name in INPUTS else sf_dir
        start = time.perf_counter()
        for df in build(spark, given):
            df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over all queries", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
