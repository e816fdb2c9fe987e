"""Panels on calendar steps: months, quarters, weeks and business days."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query, r, rounded
from panelgrid.operators import features, sequences
from panelgrid.operators.grid import align_time_series
from panelgrid.operators.series import Series

CUSTOMERS = Series(region="customer", time="moment", frequency="MS", chunk_rows=16)
PRIORITIES = Series(region="priority", time="moment", frequency="B", chunk_rows=128)
_CENTS = "cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents"
_MONTHS = f"select o_custkey as customer, date_trunc('month', o_orderdate) as moment, {_CENTS} from orders group by all"
_DAYS = f"select o_orderpriority as priority, date_trunc('day', o_orderdate) as moment, {_CENTS} from orders group by all"


def _sums(spark, sf_dir, column, name, unit):
    return st.table(spark, sf_dir, "orders").groupBy(
        F.col(column).alias(name), F.expr(f"cast(date_trunc('{unit}', o_orderdate) as timestamp_ntz)").alias("moment")
    ).agg(F.expr("sum(cast(round(o_totalprice * 100) as bigint))").alias("cents"))


def _aligned(sums: str, region: str, grid: str) -> str:
    """CTEs ``sums`` and ``filled``, where ``grid`` gives (region, moment) of all steps."""
    return f"""with sums as ({sums}), bounds as (select {region}, min(moment) as a, max(moment) as b from sums group by all),
        grid as ({grid}), filled as (select g.{region}, g.moment, coalesce(last_value(cents ignore nulls) over (
        partition by g.{region} order by g.moment rows between unbounded preceding and current row), 0) as cents
        from grid g left join sums s on g.{region} = s.{region} and g.moment = s.moment)"""


_MONTH_GRID = "select customer, unnest(generate_series(a, b, interval 1 month)) as moment from bounds"
_DAY_GRID = """select * from (select priority, unnest(generate_series(a, b, interval 1 day)) as moment from bounds)
    where isodow(moment) <= 5"""
_BY_MONTH = _aligned(_MONTHS, "customer", _MONTH_GRID)
_BY_BUSINESS_DAY = _aligned(_DAYS, "priority", _DAY_GRID)


def months(spark, sf_dir):
    return align_time_series(_sums(spark, sf_dir, "o_custkey", "customer", "month"), CUSTOMERS)


def business_days(spark, sf_dir):
    return align_time_series(_sums(spark, sf_dir, "o_orderpriority", "priority", "day"), PRIORITIES)


@query("w08_align_month_start", f"{_BY_MONTH} select * from filled")
def _(spark, sf_dir):
    return months(spark, sf_dir)


@query("w08_align_business_day", f"{_BY_BUSINESS_DAY} select * from filled")
def _(spark, sf_dir):
    """Orders of weekends lie off the grid."""
    return business_days(spark, sf_dir)


@query("w08_align_quarter_end", _aligned(_DAYS, "priority", """select * from (select priority,
    unnest(generate_series(a, b, interval 1 day)) as moment from bounds)
    where last_day(moment) = moment and month(moment) % 3 = 2""") + " select * from filled")
def _(spark, sf_dir):
    """Quarters that end in February, May, August and November."""
    days = _sums(spark, sf_dir, "o_orderpriority", "priority", "day")
    return align_time_series(days, replace(PRIORITIES, frequency="QE-FEB"))


@query("w08_align_every_second_wednesday", _aligned(_DAYS, "priority", """select priority, unnest(generate_series(
    cast(a + to_days(cast((10 - isodow(a)) % 7 as integer)) as timestamp), b, interval 14 day)) as moment from bounds""") + " select * from filled")
def _(spark, sf_dir):
    days = _sums(spark, sf_dir, "o_orderpriority", "priority", "day")
    return align_time_series(days, replace(PRIORITIES, frequency="2W-WED"))


# Months of all orders of a priority have no gap, so their step is seen to be a month; years are kept as
# rows of December, whose gaps are twelve months.
_EVEN = f"""select priority, moment, cast(sum(cents) as bigint) as cents from (
        select priority, case when priority < '3' then date_trunc('month', moment) else
            date_trunc('year', moment) + interval 11 month end as moment, cents from ({_DAYS})) group by all"""


@query("w08_align_inferred_months", _aligned(_EVEN, "priority", """select priority, unnest(generate_series(a, b,
    case when priority < '3' then interval 1 month else interval 12 month end)) as moment from bounds""") + " select * from filled")
def _(spark, sf_dir):
    days = _sums(spark, sf_dir, "o_orderpriority", "priority", "day")
    month = F.expr("""case when priority < '3' then cast(date_trunc('month', moment) as timestamp_ntz)
        else cast(date_trunc('year', moment) + interval 11 months as timestamp_ntz) end""")
    even = days.groupBy("priority", month.alias("moment")).agg(F.sum("cents").alias("cents"))
    return align_time_series(even, PRIORITIES.irregular())


# Each priority's hours begin at another part of a second.
_PARTS = """select event_type, date_trunc('hour', ts) + to_microseconds(125000 * (1 + length(event_type) % 5)) as moment,
    cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by all"""


@query("w08_align_parts_of_seconds", _aligned(
    _PARTS, "event_type", "select event_type, unnest(generate_series(a, b, interval 1 hour)) as moment from bounds") + " select * from filled")
def _(spark, sf_dir):
    moment = F.expr("""timestampadd(MICROSECOND, 125000 * (1 + length(event_type) % 5),
        cast(date_trunc('hour', ts) as timestamp_ntz))""").alias("moment")
    sums = st.table(spark, sf_dir, "events").groupBy("event_type", moment).agg(
        F.expr("sum(cast(round(value * 100) as bigint))").alias("cents"))
    return align_time_series(sums, Series(region="event_type", time="moment", frequency="1h", chunk_rows=48))


def _features_sql(region: str) -> str:
    over = f"over (partition by {region} order by moment"
    return f""" select {region}, moment, coalesce(lag(cents, 1) {over}), 0) as cents_lag_1,
        coalesce(lag(cents, 12) {over}), 0) as cents_lag_12,
        {r(f'avg(cents) {over} rows between 5 preceding and current row)', 'cents_rollmean_6', 2)} from filled"""


def _features(panel, series):
    return rounded(features.over_chunks(panel, series, 12, lambda w: [
        *features.lag_features(["cents"], [1, 12], w), *features.rolling_features(["cents"], [6], ["mean"], w)]).drop("cents"), 2)


@query("w01_lag_features_months", _BY_MONTH + _features_sql("customer"))
def _(spark, sf_dir):
    return _features(months(spark, sf_dir), CUSTOMERS)


@query("w01_lag_features_business_days", _BY_BUSINESS_DAY + _features_sql("priority"))
def _(spark, sf_dir):
    return _features(business_days(spark, sf_dir), PRIORITIES)


def _windows_sql(region: str, length: int, stride: int) -> str:
    over = f"over (partition by {region} order by moment"
    frame = f"{over} rows between {length - 1} preceding and current row)"
    return f""" select {region}, moment, oldest, total from (select *, row_number() {over}) - 1 as rn,
        lag(cents, {length - 1}) {over}) as oldest, cast(sum(cents) {frame} as bigint) as total from filled)
        where rn >= {length - 1} and (rn - {length - 1}) % {stride} = 0"""


def _windows(panel, series, length, stride):
    marked = panel.withColumns({"split": F.lit("train"), "latitude": F.lit(0.0), "longitude": F.lit(0.0), "row": F.array("cents")})
    made = sequences.sliding_windows(marked, series, "cents", length, stride, "row")
    values = F.flatten("features")
    return made.select(series.region, "moment", values[0].alias("oldest"),
                       F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("w10_sliding_windows_months", _BY_MONTH + _windows_sql("customer", 12, 1))
def _(spark, sf_dir):
    return _windows(months(spark, sf_dir), CUSTOMERS, 12, 1)


@query("w10_sliding_windows_business_days", _BY_BUSINESS_DAY + _windows_sql("priority", 20, 5))
def _(spark, sf_dir):
    return _windows(business_days(spark, sf_dir), PRIORITIES, 20, 5)
