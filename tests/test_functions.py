from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelgrid.functions import numeric, text

DAMAGE = {
    "12K": 12000.0, "1.5M": 1500000.0, "2b": 2e9, ".5K": 500.0, "1e3": 1000.0, "0.00K": 0.0,
    "K": 0.0, "": 0.0, " 3 ": 3.0, "2H": 0.0, "-5K": -5000.0, "1d": 0.0, None: 0.0,
    "nan": 0.0, "1_0K": 0.0, "1KK": 0.0,
}
TIMES = {
    "03-OCT-98 12:30:00": datetime(1998, 10, 3, 12, 30),
    "1-jan-68 00:00:01": datetime(2068, 1, 1, 0, 0, 1),
    "01-Jan-69 00:00:00": datetime(1969, 1, 1),
    "31-FEB-20 00:00:00": None,
    "01-XXX-20 00:00:00": None,
    "01-ANF-20 00:00:00": None,
    "2020-03-04 05:06:07": datetime(2020, 3, 4, 5, 6, 7),
    "3/4/2021 7:08": datetime(2021, 3, 4, 7, 8),
    "junk": None,
    None: None,
}


def _values(spark, inputs, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_damage_text(spark):
    assert _values(spark, DAMAGE, text.parse_damage) == list(DAMAGE.values())


def test_event_time(spark):
    assert _values(spark, TIMES, text.parse_event_time) == list(TIMES.values())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_event_time_does_not_move_with_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on that day.
        found = _values(spark, ["08-MAR-20 02:30:00"], text.parse_event_time)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [datetime(2020, 3, 8, 2, 30)]


def test_state_codes(spark):
    assert _values(spark, ["Texas", "TEXAS", "guam", None], text.state_code) == [
        "TX", "TX", "GUAM", None
    ]


def test_event_kinds(spark):
    found = _values(
        spark, ["Winter Storm", "blizzard", "Heavy Snow", "Hail", None],
        lambda c: text.contains_any(c, "WINTER|BLIZZARD|SNOW"),
    )
    assert found == [True, True, True, False, False]


def test_numbers(spark):
    row = spark.range(1).select(
        numeric.mean_of_two(F.lit(None).cast("double"), F.lit(4.0)).alias("one"),
        numeric.fraction_change(F.lit(5.0), F.lit(0.0)).alias("by_zero"),
        numeric.fraction_change(F.lit(5.0), F.lit(4.0)).alias("change"),
        numeric.clip_unit(F.lit(1.5)).alias("clipped"),
        numeric.sigmoid(F.lit(0.0)).alias("half"),
        numeric.nan_to_null(F.lit(float("nan"))).alias("none"),
        text.pretty_label(F.lit("tabular_ensemble")).alias("label"),
    ).first()
    assert row.asDict() == {
        "one": 4.0, "by_zero": 0.0, "change": 0.25, "clipped": 1.0, "half": 0.5, "none": None,
        "label": "Tabular Ensemble",
    }
