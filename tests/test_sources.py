from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelgrid.sources import artifacts, context, events, weather


def _line(station, year, month, element, values):
    """Day slots from (value, quality) pairs; days without one are missing."""
    slots = "".join(
        f"{values[d][0]:>5} {values[d][1]}S" if d in values else "-9999   " for d in range(1, 32)
    )
    return f"{station}{year}{month:02d}{element}{slots}"


def test_daily_lines(spark):
    lines = [
        _line("USW00000001", 2023, 2, "TMAX", {1: ("100", " "), 2: ("110", "X"), 30: ("5", " ")}),
        _line("USW00000001", 2023, 2, "TMIN", {1: ("-50", " "), 28: ("abc", " ")}),
        _line("USW00000001", 2023, 2, "TOBS", {1: ("1", " ")}),
        _line("USW00000001", 2023, 4, "PRCP", {30: ("7", " "), 31: ("9", " ")}),
        _line("USW00000001", 2023, 4, "SNOW", {1: ("12", " ")})[:29],
    ]
    df = weather.daily_observations(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = {(r["timestamp"], r["element"], r["raw"]) for r in df.collect()}
    assert found == {
        (datetime(2023, 2, 1), "TMAX", 100.0), (datetime(2023, 2, 1), "TMIN", -50.0),
        (datetime(2023, 4, 30), "PRCP", 7.0), (datetime(2023, 4, 1), "SNOW", 12.0),
    }


def test_measures_of_a_partial_day(spark):
    long = spark.createDataFrame(
        [("s", datetime(2023, 1, 1), "TMAX", 100.0), ("s", datetime(2023, 1, 1), "TMAX", 120.0),
         ("s", datetime(2023, 1, 1), "SNOW", 3.0)],
        "station string, timestamp timestamp_ntz, element string, raw double",
    )
    wide = weather.pivot_elements(long, ["station", "timestamp"])
    row = weather.to_measures(wide, ["station", "timestamp"]).first().asDict()
    assert (row["tmax_c"], row["tavg_c"], row["tmin_c"], row["snow_mm"]) == (11.0, 11.0, None, 3.0)


def test_stations_and_missing_ones(spark, tmp_path):
    line = f"{'USW00000001':<11} {'34.05':>8} {'-118.25':>9} {'71.0':>6} CA {'LOS ANGELES':<30}"
    (tmp_path / "stations.txt").write_text(line + "\n" + line.replace("0001", "0002") + "\n")
    wanted = spark.createDataFrame([("USW00000001",), ("USW00000009",)], "station string")
    found = weather.scan_stations(spark, str(tmp_path / "stations.txt"), wanted)
    assert [r.asDict() for r in found.collect()] == [{
        "station": "USW00000001", "latitude": 34.05, "longitude": -118.25, "elevation": 71.0,
        "state": "CA", "name": "LOS ANGELES",
    }]
    assert [r["station"] for r in weather.missing_stations(found, wanted).collect()] == ["USW00000009"]


def test_wide_and_long_responses_agree(spark, tmp_path):
    (tmp_path / "wide").mkdir()
    (tmp_path / "long").mkdir()
    (tmp_path / "wide" / "a.json").write_text(
        '{"results":[{"STATION":"s","DATE":"2023-01-01",\n"TMAX":100,"TMIN":50,"PRCP":0,"SNOW":0,'
        '"SNWD":0,"AWND":31},{"STATION":"s","DATE":"2023-01-02","TMAX":80}]}'
    )
    cells = [("2023-01-01", "TMAX", 100), ("2023-01-01", "TMIN", 50), ("2023-01-01", "PRCP", 0),
             ("2023-01-01", "SNOW", 0), ("2023-01-01", "SNWD", 0), ("2023-01-01", "AWND", 31),
             ("2023-01-02", "TMAX", 80)]
    results = ",".join(
        f'{{"station":"s","date":"{d}T00:00:00","datatype":"{k}","value":{v}}}' for d, k, v in cells
    )
    (tmp_path / "long" / "a.json").write_text(f'{{"results":[{results}]}}')
    wide = weather.weather_from_wide_json(
        weather.read_responses(spark, str(tmp_path / "wide"), weather.WIDE_RESULTS)
    )
    long = weather.weather_from_long_json(
        weather.read_responses(spark, str(tmp_path / "long"), weather.LONG_RESULTS)
    )
    first, second = sorted(wide.collect(), key=lambda r: r["timestamp"])
    assert (first["tavg_c"], first["awnd_ms"]) == (7.5, 3.1)
    assert (second["tmax_c"], second["tavg_c"]) == (8.0, None)
    assert sorted(map(tuple, long.collect()), key=repr) == sorted(map(tuple, wide.collect()), key=repr)


def test_census_bodies(spark):
    bodies = [
        ("CA", '[["B01001_001E","state"],["39000000","06"]]'), ("OH", '[["B01001_001E","state"]]'),
        ("TX", '[["B01001_001E","state"],["many","48"]]'), ("FL", "Invalid Key"), ("NY", None),
        ("ME", '[["B01001_001E","state"],["1300000","23"]]'),
    ]
    found = context.population_from_census_json(
        spark.createDataFrame(bodies, "region_id string, body string")
    )
    assert sorted(map(tuple, found.collect())) == [
        ("CA", 39000000, 253.6, 80.0), ("ME", 1300000, 100.0, 80.0)
    ]


def test_infrastructure_defaults(spark):
    regions = spark.createDataFrame([("CA",), ("ZZ",)], "region_id string")
    found = sorted(map(tuple, context.infrastructure_context(regions).collect()))
    assert found == [("CA", 30, 6.5, 6.5), ("ZZ", 27, 6.5, 6.5)]


def test_empty_sources_add_columns_and_no_rows(spark):
    panel = spark.createDataFrame(
        [("CA", datetime(2020, 1, 1))], "region_id string, timestamp timestamp_ntz"
    )
    for source in ("outages", "extra_weather", "storm_events"):
        joined = panel.join(
            context.empty_with_schema(spark, source), ["region_id", "timestamp"], "left"
        )
        assert joined.count() == 1


def test_event_listing(spark):
    names = [
        "StormEvents_details-ftp_v1.0_d2020_c20210101.csv.gz",
        "stormevents_details-FTP_v1.0_d2020_c20220101.csv.gz",
        "StormEvents_details-ftp_v1.0_d2021_c20210601.csv.gz", "readme.txt",
    ]
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    assert events.files_for_years(listing, [2020, 2019]) == [
        "StormEvents_details-ftp_v1.0_d2020_c20220101.csv.gz"
    ]
    with pytest.raises(RuntimeError):
        events.files_for_years(listing, [1999])


def test_event_files_may_hold_more_columns_in_any_order(spark, tmp_path):
    header = ["MAGNITUDE", "EPISODE_NARRATIVE", *[
        c for c in events.EVENT_SCHEMA.fieldNames() if c != "MAGNITUDE"]]
    row = {"MAGNITUDE": "1.5", "EPISODE_NARRATIVE": '"hail, ""large"""', "EVENT_ID": "7",
           "STATE": "TEXAS", "EVENT_TYPE": "Hail", "BEGIN_DATE_TIME": "01-JAN-20 10:00:00",
           "DAMAGE_PROPERTY": "1K"}
    (tmp_path / "a.csv").write_text(
        ",".join(header) + "\n" + ",".join(row.get(c, "") for c in header) + "\n"
    )
    found = events.scan_storm_events(spark, [str(tmp_path / "a.csv")]).first()
    assert (found["EVENT_ID"], found["MAGNITUDE"], found["BEGIN_LAT"]) == (7, 1.5, None)


def test_first_source_with_rows_wins(spark):
    def source(rows):
        return spark.createDataFrame(rows, "station string, v int")

    chosen = weather.first_available(
        [source([("a", 1)]), source([("a", 2), ("b", 2)]), source([("a", 3), ("b", 3), ("c", 3)])],
        "station",
    )
    assert sorted(map(tuple, chosen.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(RuntimeError):
        weather.assert_any(source([]), "weather")


def test_absent_predictions(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.read_predictions(spark, str(tmp_path))
    assert artifacts.read_predictions(spark, str(tmp_path), missing_ok=True).count() == 0


def test_density_is_per_state(spark):
    regions = spark.createDataFrame([("CA",), ("TX",)], "region_id string")
    constant = context.economic_constant(regions).where(F.col("poverty_rate") == 12.0)
    assert constant.count() == 2
