"""Nothing is dropped, capped or made up where data is uneven."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import clean, features, joins, ranked, sequences, split
from panelgrid.operators.grid import align_time_series
from panelgrid.operators.series import Series, fill_gaps, in_ranges, on_steps
from panelgrid.sinks import tables
from panelgrid.sources import artifacts, events, weather
from tests.helpers import SCHEMA, random_rows

DAY = datetime(2020, 1, 1)
FEATURES = {"lags": [1, 5], "rolling_windows": [3, 6], "rolling_statistics": ["mean", "std"],
            "base_weather_cols": ["n"]}


def engineered(df, series):
    made = features.engineer_features(df, series, "v", FEATURES)
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in made.collect()), key=str)


def test_features_of_a_gappy_panel_do_not_depend_on_chunks(spark):
    df = spark.createDataFrame(random_rows(3, {"a": 90, "hot": 400}, gaps=0.4), SCHEMA)
    want = engineered(df, Series(frequency=None))
    assert engineered(df, Series(chunk_rows=8)) == want == engineered(df, Series(chunk_rows=2048))


def test_windows_of_a_gappy_panel_do_not_depend_on_chunks(spark):
    df = spark.createDataFrame(random_rows(4, {"a": 60, "b": 200}, gaps=0.5), SCHEMA).withColumns({
        "split": F.lit("train"), "latitude": F.lit(0.0), "longitude": F.lit(0.0), "features": F.array(F.col("n").cast("float"))})

    def windows(series, stride):
        rows = sequences.sliding_windows(df, series, "n", 4, stride).collect()
        return sorted((r["region_id"], r["timestamp"], str(r["features"])) for r in rows)

    for stride in (1, 3):
        assert windows(Series(chunk_rows=8), stride) == windows(Series(frequency=None), stride)


def test_positions_are_computed_only_on_full_steps(spark):
    def series_of(*days):
        rows = [("r", DAY + timedelta(days=d), 1.0, 1) for d in days]
        return on_steps(spark.createDataFrame(rows, SCHEMA), Series()).counted

    assert not series_of(0, 1, 2, 3)
    assert series_of(0, 1, 3) and series_of(0, 1, 1, 3) and series_of(0, 1, 2.25, 3)


def test_a_stride_on_full_steps_plans_one_more_exchange(spark):
    df = spark.createDataFrame(random_rows(5, {"a": 60}), SCHEMA).withColumns({
        "split": F.lit("train"), "latitude": F.lit(0.0), "longitude": F.lit(0.0), "features": F.array(F.col("n").cast("float"))})

    def exchanges(stride):
        plan = sequences.sliding_windows(df, Series(), "n", 4, stride, dense=True)._jdf.queryExecution().sparkPlan().toString()
        return plan.count("Window"), plan.count("Join")

    assert exchanges(3)[0] == exchanges(1)[0] and exchanges(3)[1] - exchanges(1)[1] == 1


def test_duplicate_keys_fail_alignment(spark):
    rows = [("r", DAY, 1.0, 1), ("r", DAY + timedelta(days=1), 2.0, 1), ("r", DAY, 3.0, 1)]
    with pytest.raises(Exception, match="duplicate key r"):
        align_time_series(spark.createDataFrame(rows, SCHEMA), Series()).collect()


def test_context_with_several_rows_of_a_region_fails(spark):
    df = spark.createDataFrame([("r", 1)], "region_id string, x int")
    twice = spark.createDataFrame([("r", 1), ("r", 2)], "region_id string, y int")
    with pytest.raises(ValueError, match="income"):
        joins.attach_context(df, {"income": twice})


def test_responses_by_line_and_by_file(spark, tmp_path):
    one = '{"results":[{"STATION":"%s","DATE":"2023-01-01","TMAX":100}]}'
    (tmp_path / "lines").mkdir()
    (tmp_path / "files").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(one % s for s in "abc"))
    for s in "abc":
        (tmp_path / "files" / f"{s}.json").write_text((one % s).replace(",", ",\n"))
    by_line = weather.read_responses(spark, str(tmp_path / "lines"), weather.WIDE_RESULTS, per_line=True)
    by_file = weather.read_responses(spark, str(tmp_path / "files"), weather.WIDE_RESULTS)
    assert sorted(r["STATION"] for r in by_line.collect()) == sorted(r["STATION"] for r in by_file.collect()) == ["a", "b", "c"]


def test_event_files_with_other_column_orders_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('EVENT_ID,STATE,EVENT_TYPE,NARRATIVE\n1,TEXAS,"Hail","two\nlines, ""quoted"""\n2,OHIO,Hail,\n')
    (tmp_path / "b.csv").write_text('STATE,EXTRA,EVENT_ID\nUTAH,"x\ny",3\n')
    rows = events.scan_storm_events(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")]).collect()
    assert sorted((r["EVENT_ID"], r["STATE"], r["EVENT_TYPE"]) for r in rows) == [
        (1, "TEXAS", "Hail"), (2, "OHIO", "Hail"), (3, "UTAH", None)]


def test_latest_names_a_run_and_copies_nothing(spark, tmp_path):
    base = str(tmp_path / "runs")
    for name in ("one", "two"):
        spark.createDataFrame([(name, DAY)], "region_id string, timestamp timestamp_ntz").write.parquet(
            f"{base}/{name}/predictions.parquet")
        tables.update_latest(spark, base, f"{base}/{name}")
    assert artifacts.read_predictions(spark, f"{base}/latest").first()["region_id"] == "two"
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["latest", "one", "two"]


def test_latest_survives_interrupted_writes_and_two_writers(spark, tmp_path):
    base = str(tmp_path)
    tables.update_latest(spark, base, f"{base}/first")
    # what a writer leaves that was stopped before its commit, or in the middle of a line
    for number, text in (("99990101000000000000-a/_temporary/0", '{"number": "9999", "run": "never"}'), ("99980101000000000000-b", '{"number": "99')):
        (tmp_path / "latest" / number).mkdir(parents=True)
        (tmp_path / "latest" / number / "part-00000.txt").write_text(text)
    assert artifacts.run_of(spark, f"{base}/latest") == f"{base}/first"
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: tables.update_latest(spark, base, f"{base}/run{k}", DAY + timedelta(days=40_000, seconds=k)), range(4)))
    assert artifacts.run_of(spark, f"{base}/latest") == f"{base}/run3"
    assert artifacts.run_of(spark, f"{base}/other/latest") == f"{base}/other/latest"



def test_safe_columns_do_not_tell_the_target(spark):
    names = ["failures", "failures_lag_1", "failures_rollmean_2", "failures_diff_1", "tmax_c", "hail", "hail_rollmax_3"]
    df = spark.createDataFrame([tuple(1.0 for _ in names)], names)
    kept = clean.select_feature_columns(df, "failures", {"leak_safe": True, "same_day": ["hail"]})
    assert kept == ["failures_lag_1", "tmax_c"]


def test_observations_must_be_numbers(spark):
    df = spark.createDataFrame([(v, " ") for v in ("12", " 7", "12D", "NaN", "-9999", "")], "value string, quality string")
    kept = df.where(weather.valid_observation(F.col("value"), F.col("quality"))).collect()
    assert [r["value"] for r in kept] == ["12", " 7"]


def test_series_keeps_its_other_fields():
    assert replace(Series(chunk_rows=7), counted=True).chunk_rows == 7


def test_fills_of_a_dense_hour_spread_over_ranges(spark):
    """One region with nearly all rows within an hour: no range holds more than its share."""
    rows = [("hot", DAY + timedelta(milliseconds=k), float(k) if k % 211 == 0 else None, k) for k in range(3_000)]
    rows += [("a", DAY + timedelta(days=k), None if k % 3 else float(k), k) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    series = Series(frequency=None)
    ranged = in_ranges(df, series, F.spark_partition_id().alias("part"))
    assert ranged.groupBy("part").count().agg(F.max("count")).first()[0] < 0.5 * len(rows)
    made = fill_gaps(df, ["v"], series, backward=True)
    for r in made.collect():
        step = 211 if r["region_id"] == "hot" else 3
        assert r["v"] == r["n"] // step * step


@pytest.mark.parametrize("few", [3, 50, 20_000])
@pytest.mark.parametrize("values", [
    [1.0] * 500, [5.0] * 300 + [7.0] * 2, list(range(1000)), [0.0] * 400 + list(range(300)), [2.0], [1.0, 2.0], []])
def test_selection_narrows_its_bracket(spark, monkeypatch, values, few):
    monkeypatch.setattr(ranked, "FEW", few)
    monkeypatch.setattr(ranked, "SKETCH", 40)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    for fraction in (0.0, 0.25, 0.8, 0.999, 1.0):
        got = ranked.exact_percentile(df, "v", fraction).first()["value"]
        assert got == (pytest.approx(np.percentile(values, 100 * fraction)) if values else None)


def test_scaler_moments_leave_nulls_out(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([1e9 + rng.normal(size=200), rng.normal(size=200), np.full(200, 7.0), rng.normal(size=200)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    df = spark.createDataFrame([("train", *(None if np.isnan(v) else float(v) for v in row)) for row in x],
                               "split string, a double, b double, c double, d double").repartition(6)
    rows = split.scaler_rows(split.fit_scaler(df, ["a", "b", "c"])).collect()
    for k, r in enumerate(rows):
        assert r["mean"] == pytest.approx(np.nanmean(x[:, k]), abs=1e-9)
        assert r["scale"] == pytest.approx(np.nanstd(x[:, k]) if k < 2 else 1.0, rel=1e-6)
