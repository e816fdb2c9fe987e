"""Projections, filters, scalar functions, sorting and unions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query, r, rounded
from checks.standins import sql
from panelgrid.fixed_values import EVENT_COUNT_COLUMNS, WEATHER_COLUMNS
from panelgrid.functions import numeric, text
from panelgrid.operators import aggregate, clean, joins, reports
from panelgrid.operators.ensemble import finish_predictions
from panelgrid.operators.features import over_chunks
from panelgrid.operators.ranked import exact_percentile
from panelgrid.operators.split import (
    chronological_split, fit_scaler, with_scaled_features, with_target_class,
)
from panelgrid.session import scratch_path
from panelgrid.sources import weather
from panelgrid.sources.events import scan_storm_events

# -- filters and projections --------------------------------------------------------------


@query("p01_drop_null_time_or_state", sql(
    "select event_id from storm where t is not null and region_id is not null", "storm"))
def _(spark, sf_dir):
    raw = st.storm_rows(spark, sf_dir).withColumn("t", text.parse_event_time(F.col("BEGIN_DATE_TIME")))
    return clean.require(raw, ["t", "STATE"]).select(F.col("EVENT_ID").alias("event_id"))


@query("p02_regions_in_list", sql(
    f"""select event_id, region_id from storm
    where region_id in ({str(st.WANTED_REGIONS)[1:-1]})""", "storm"))
def _(spark, sf_dir):
    raw = st.storm_rows(spark, sf_dir).select(
        F.col("EVENT_ID").alias("event_id"), text.state_code(F.col("STATE")).alias("region_id")
    )
    return clean.in_values(raw, "region_id", st.WANTED_REGIONS)


@query("p02_regions_in_table", sql(
    """select event_id, region_id from storm where region_id in
    (select region_id from coords where latitude > 0)""", "storm", "coords"))
def _(spark, sf_dir):
    raw = st.storm_rows(spark, sf_dir).select(
        F.col("EVENT_ID").alias("event_id"), text.state_code(F.col("STATE")).alias("region_id")
    )
    return clean.in_values(raw, "region_id", st.coordinates(spark, sf_dir).where("latitude > 0"))


@query("p03_inclusive_date_range", sql(
    f"""select l_orderkey, l_linenumber, l_shipdate from lineitem
    where l_shipdate between timestamp '{st.START}' and timestamp '{st.END}'"""))
def _(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return clean.between_days(rows, "l_shipdate", st.START, st.END)


@query("p04_weather_validity", sql(
    "select station, element, count(*) as kept from wx_long group by station, element", "wx_long"))
def _(spark, sf_dir):
    seen = st.observations(spark, sf_dir)
    valid = weather.valid_observation(F.col("value"), F.col("quality"))
    return seen.where(F.col("element").isin(weather.ELEMENTS) & valid).groupBy(
        "station", "element"
    ).agg(F.count(F.lit(1)).alias("kept"))


@query("p05_select_or_null", sql(
    """select region_id, timestamp, cast(null as double) as tavg_c, tmax_c,
        cast(null as double) as tmin_c, prcp_mm, cast(null as double) as snow_mm,
        cast(null as double) as snwd_mm, cast(null as double) as awnd_ms from sales""", "sales"))
def _(spark, sf_dir):
    return clean.select_or_null(
        st.sales(spark, sf_dir), ["region_id", "timestamp", *WEATHER_COLUMNS]
    )


@query("p06_rename", sql(
    "select region_id as state_code, timestamp as day, failures from sales", "sales"))
def _(spark, sf_dir):
    renamed = st.sales(spark, sf_dir).withColumnsRenamed(
        {"region_id": "state_code", "timestamp": "day"}
    )
    return renamed.select("state_code", "day", "failures")


@query("p07_select_feature_columns", sql(
    "select region_id, timestamp, event_count, tmax_c from panel", "panel"))
def _(spark, sf_dir):
    panel = st.panel(spark, sf_dir)
    columns = clean.select_feature_columns(panel, "failures", {"exclude": ["prcp_mm"]})
    return panel.select("region_id", "timestamp", *columns)


@query("p07_included_feature_columns", sql(
    "select region_id, timestamp, prcp_mm, event_count from panel", "panel"))
def _(spark, sf_dir):
    panel = st.panel(spark, sf_dir)
    columns = clean.select_feature_columns(
        panel, "failures", {"include": ["prcp_mm", "absent", "failures", "event_count"]}
    )
    return panel.select("region_id", "timestamp", *columns)


@query("p08_resolve_base_columns", sql(
    "select region_id, timestamp, event_count, tmax_c, prcp_mm from panel", "panel"))
def _(spark, sf_dir):
    panel = st.panel(spark, sf_dir)
    return panel.select("region_id", "timestamp", *clean.resolve_base_columns(panel, "failures"))


@query("p08_configured_base_columns", sql(
    "select region_id, timestamp, tmax_c from panel", "panel"))
def _(spark, sf_dir):
    panel = st.panel(spark, sf_dir)
    columns = clean.resolve_base_columns(panel, "failures", ["tmax_c", "humidity"])
    return panel.select("region_id", "timestamp", *columns)


@query("p09_drop_incomplete_rows", sql(
    """select region_id, timestamp, failures, event_count from sales_grid
    where failures is not null""", "sales_grid"))
def _(spark, sf_dir):
    grid = st.sales_grid(spark, sf_dir).select("region_id", "timestamp", "failures", "event_count")
    return clean.drop_incomplete(grid, st.SERIES, "failures")


@query("p10_zero_fill", sql(
    """select region_id, timestamp, coalesce(failures, 0) as failures,
        coalesce(event_count, 0) as event_count, tmax_c from sales_grid""", "sales_grid"))
def _(spark, sf_dir):
    grid = st.sales_grid(spark, sf_dir).select(
        "region_id", "timestamp", "failures", "event_count", "tmax_c"
    )
    return clean.zero_fill(grid, [*EVENT_COUNT_COLUMNS, "failures"])


@query("p11_filter_predictions", sql(
    f"""select region_id, timestamp, target, {r('hybrid_pred', 'hybrid_pred')} from preds
    where split = 'val' and region_id = 'TX' and timestamp >= timestamp '1999-09-01'
      and timestamp <= timestamp '2000-03-01'""", "preds"))
def _(spark, sf_dir):
    kept = clean.filter_predictions(
        st.predictions(spark, sf_dir), "val", "TX", "1999-09-01", "2000-03-01"
    )
    return rounded(kept.select("region_id", "timestamp", "target", "hybrid_pred"))


@query("p11_filter_all", sql(
    "select region_id, timestamp, target from preds where timestamp >= timestamp '2001-01-01'",
    "preds"))
def _(spark, sf_dir):
    kept = clean.filter_predictions(st.predictions(spark, sf_dir), "all", None, "2001-01-01")
    return kept.select("region_id", "timestamp", "target")


@query("p12_filter_split_or_fail", sql(
    "select region_id, timestamp, target from preds where split = 'test'", "preds"))
def _(spark, sf_dir):
    kept = clean.filter_split_or_fail(st.predictions(spark, sf_dir), "test")
    return kept.select("region_id", "timestamp", "target")


@query("p13_valid_pairs", sql(
    """select region_id, timestamp, lstm_pred, tabular_ensemble from preds
    where lstm_pred is not null and tabular_ensemble is not null""", "preds"))
def _(spark, sf_dir):
    pairs = reports.valid_pairs(st.predictions(spark, sf_dir), "lstm_pred", "tabular_ensemble")
    return pairs.select("region_id", "timestamp", "lstm_pred", "tabular_ensemble")


# -- scalar functions ---------------------------------------------------------------------


@query("f01_parse_damage", sql(
    f"select event_id, {r('damage_usd', 'damage_usd', 2)} from storm", "storm"))
def _(spark, sf_dir):
    return rounded(st.storm_rows(spark, sf_dir).select(
        F.col("EVENT_ID").alias("event_id"),
        text.parse_damage(F.col("DAMAGE_PROPERTY")).alias("damage_usd"),
    ), 2)


@query("f02_parse_event_time", sql("select event_id, t as timestamp from storm", "storm"))
def _(spark, sf_dir):
    return st.storm_rows(spark, sf_dir).select(
        F.col("EVENT_ID").alias("event_id"),
        text.parse_event_time(F.col("BEGIN_DATE_TIME")).alias("timestamp"),
    )


@query("f03_day_floor", sql(
    "select event_id, cast(date_trunc('day', ts) as timestamp) as day from events"))
def _(spark, sf_dir):
    return st.table(spark, sf_dir, "events").select(
        "event_id", text.day_floor(F.col("ts")).alias("day")
    )


@query("f04_fixed_fields", sql(
    """select c_custkey, upper(trim(substring(c_name, 1, 8))) as kind,
        trim(substring(c_name, 10, 9)) as number from customer"""))
def _(spark, sf_dir):
    return st.table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(text.fixed_field(F.col("c_name"), 0, 8)).alias("kind"),
        text.fixed_field(F.col("c_name"), 9, 18).alias("number"),
    )


@query("f05_event_flags", sql(
    """select event_id, cast(coalesce(kind = 0, false) as integer) as wind_event_count,
        cast(kind = 1 as integer) as flood_event_count,
        cast(kind in (2, 6, 7) as integer) as winter_event_count,
        cast(kind = 3 as integer) as hail_event_count,
        cast(kind = 4 as integer) as tornado_event_count,
        cast(kind = 5 as integer) as lightning_event_count from storm""", "storm"))
def _(spark, sf_dir):
    return st.storm_rows(spark, sf_dir).select(
        F.col("EVENT_ID").alias("event_id"), *aggregate.event_flags()
    )


@query("f06_unit_scaling", sql(
    """select station, timestamp, TMAX / 10 as tmax_c, TMIN / 10 as tmin_c, PRCP / 10 as prcp_mm,
        SNOW as snow_mm, SNWD as snwd_mm, AWND / 10 as awnd_ms from wx_wide""", "wx_wide"))
def _(spark, sf_dir):
    return _wide(spark, sf_dir).select("station", "timestamp", *numeric.scale_measures())


def _wide(spark, sf_dir):
    """Valid observations of each station and day, a column per element."""
    seen = st.observations(spark, sf_dir)
    valid = seen.where(weather.valid_observation(F.col("value"), F.col("quality")))
    long = valid.select(
        "station", F.col("day").alias("timestamp"), "element",
        F.col("value").try_cast("double").alias("raw"),
    )
    return weather.pivot_elements(long, ["station", "timestamp"])


@query("f07_mean_of_two", sql(
    f"""select station, timestamp, {r('coalesce((TMAX / 10 + TMIN / 10) / 2, TMAX / 10, TMIN / 10)',
        'tavg_c')} from wx_wide""", "wx_wide"))
def _(spark, sf_dir):
    scaled = _wide(spark, sf_dir).select("station", "timestamp", *numeric.scale_measures())
    mean = numeric.mean_of_two(F.col("tmax_c"), F.col("tmin_c"))
    return rounded(scaled.select("station", "timestamp", mean.alias("tavg_c")))


@query("f08_make_day", sql(
    """select o_orderkey, try_cast(concat(year(o_orderdate), '-', lpad(cast(o_orderkey % 14 as varchar), 2, '0'),
        '-', lpad(cast(o_orderkey % 33 as varchar), 2, '0')) as timestamp) as day from orders"""))
def _(spark, sf_dir):
    return st.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.make_day(
            F.year("o_orderdate"), (F.col("o_orderkey") % 14).cast("int"),
            (F.col("o_orderkey") % 33).cast("int"),
        ).alias("day"),
    )


@query("f09_clip_unit", sql(
    f"""select c_custkey, {r('least(greatest(c_acctbal / 5000, 0), 1)', 'share', 6)}
    from customer"""))
def _(spark, sf_dir):
    return rounded(st.table(spark, sf_dir, "customer").select(
        "c_custkey", numeric.clip_unit(F.col("c_acctbal") / 5000).alias("share")
    ), 6)


@query("f10_target_class", sql(
    """select region_id, timestamp, cast(failures >= (select quantile_cont(failures, 0.9)
        from sales) as integer) as target_class from sales""", "sales"))
def _(spark, sf_dir):
    sales = st.sales(spark, sf_dir)
    classed = with_target_class(sales, "failures", exact_percentile(sales, "failures", 0.9))
    return classed.select("region_id", "timestamp", "target_class")


@query("f11_residual_and_weights", sql(
    f"""select region_id, timestamp, {r('target - hybrid_pred', 'residual')},
        1.0::double as weight_tabular, 0.0::double as weight_lstm from preds""", "preds"))
def _(spark, sf_dir):
    table = finish_predictions(st.predictions(spark, sf_dir), 1.5, "regression")
    return rounded(table.select(
        "region_id", "timestamp", "residual", "weight_tabular", "weight_lstm"
    ))


@query("f11_hybrid_class", sql(
    """select region_id, timestamp, cast(hybrid_pred >= 100 as integer) as hybrid_class
    from preds""", "preds"))
def _(spark, sf_dir):
    table = finish_predictions(st.predictions(spark, sf_dir), 0.25, "classification", 100.0)
    return table.select("region_id", "timestamp", "hybrid_class")


@query("f12_sigmoid", sql(
    f"select event_id, {r('1 / (1 + exp(-(value - 20) / 10))', 'p', 6)} from events"))
def _(spark, sf_dir):
    score = (F.col("value") - 20) / 10
    return rounded(st.table(spark, sf_dir, "events").select(
        "event_id", numeric.sigmoid(score).alias("p")
    ), 6)


@query("f13_pretty_label", sql(
    """select p_partkey, concat(upper(left(w[1], 1)), lower(substring(w[1], 2)), ' ',
        upper(left(w[2], 1)), lower(substring(w[2], 2))) as label
    from (select p_partkey, string_split(p_name, ' ') as w from part)"""))
def _(spark, sf_dir):
    parts = st.table(spark, sf_dir, "part").withColumn("name", F.replace("p_name", F.lit(" "), F.lit("_")))
    return parts.select("p_partkey", text.pretty_label(F.col("name")).alias("label"))


@query("f14_scale_features", sql(
    f"""select region_id, timestamp,
        {r('(event_count - m1) / s1', 'event_count', 3)}, {r('(tmax_c - m2) / s2', 'tmax_c', 3)}
    from (select *, (select avg(event_count) from split_panel where split = 'train') as m1,
        (select stddev_pop(event_count) from split_panel where split = 'train') as s1,
        (select avg(tmax_c) from split_panel where split = 'train') as m2,
        (select stddev_pop(tmax_c) from split_panel where split = 'train') as s2 from split_panel)""",
    "split_panel"))
def _(spark, sf_dir):
    labelled = chronological_split(st.panel(spark, sf_dir), st.SERIES)
    columns = ["event_count", "tmax_c"]
    scaled = with_scaled_features(labelled, columns, fit_scaler(labelled, columns))
    return rounded(scaled.select(
        "region_id", "timestamp", *[F.col("features")[i].alias(c) for i, c in enumerate(columns)]
    ), 3)


# -- order and unions -----------------------------------------------------------------------


@query("o01_sort_by_region_and_time", sql(
    "select region_id, timestamp, failures from sales order by region_id, timestamp", "sales"))
def _(spark, sf_dir):
    sales = st.sales(spark, sf_dir).select("region_id", "timestamp", "failures")
    return clean.in_time_order(sales, st.SERIES)


@query("o02_first_rows", sql(
    f"""select timestamp, region_id, {r('hybrid_pred', 'hybrid_pred')}, target from preds
    order by timestamp, region_id limit 100""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.first_rows(st.predictions(spark, sf_dir)))


@query("o03_sorted_distinct_regions", sql(
    "select distinct region_id from preds order by region_id", "preds"))
def _(spark, sf_dir):
    return aggregate.distinct_values(st.predictions(spark, sf_dir), "region_id")


@query("o03_sorted_distinct_times", sql(
    "select distinct timestamp from sales order by timestamp", "sales"))
def _(spark, sf_dir):
    return aggregate.distinct_values(st.sales(spark, sf_dir), "timestamp")


@query("u01_union_of_event_files", sql(
    "select event_id, region_id from storm", "storm"))
def _(spark, sf_dir):
    rows = st.storm_rows(spark, sf_dir)
    time = text.parse_event_time(F.col("BEGIN_DATE_TIME"))
    base = scratch_path(spark, "years")
    rows.withColumn("y", F.coalesce(F.year(time), F.lit(0))).write.partitionBy("y").option(
        "header", True
    ).option("compression", "gzip").csv(base)
    years = [0, *range(1995, 2002)]
    scanned = scan_storm_events(spark, [f"{base}/y={y}" for y in years])
    return scanned.select(
        F.col("EVENT_ID").alias("event_id"), text.state_code(F.col("STATE")).alias("region_id")
    )


@query("u02_union_of_station_weather", sql(
    "select region_id, timestamp, tavg_c, tmax_c, tmin_c, prcp_mm, snow_mm, snwd_mm, awnd_ms from "
    f"(select region_id, timestamp, {r('tavg_c', 'tavg_c')}, tmax_c, tmin_c, prcp_mm, snow_mm, "
    "snwd_mm, awnd_ms from wx_daily)", "wx_daily"))
def _(spark, sf_dir):
    measures = weather.to_measures(_wide(spark, sf_dir), ["station", "timestamp"])
    return rounded(joins.tag_region(measures, st.station_names(spark, sf_dir)))


@query("u03_union_of_splits", sql(
    "select split, region_id, timestamp, target, case when split <> 'test' then lstm_pred end as lstm_pred from preds",
    "preds"))
def _(spark, sf_dir):
    predictions = st.predictions(spark, sf_dir)
    columns = ["region_id", "timestamp", "target", "lstm_pred"]
    frames = []
    for split in ("train", "val", "test"):
        kept = [c for c in columns if not (split == "test" and c == "lstm_pred")]
        one = predictions.where(F.col("split") == split).select(*kept)
        frames.append(one.withColumn("split", F.lit(split)))
    return joins.union_by_name(frames)


@query("u04_columns_side_by_side", sql(
    """select *, failures * 2 as doubled, event_count + 1 as one_more from sales""", "sales"))
def _(spark, sf_dir):
    return over_chunks(
        st.sales(spark, sf_dir), replace(st.SERIES, frequency=None), 1, lambda w: [
            (F.col("failures") * 2).alias("doubled"), (F.col("event_count") + 1).alias("one_more")
        ],
    )
