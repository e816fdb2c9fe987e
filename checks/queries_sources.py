"""Sources and sinks: text made from the tables is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query, r, rounded
from checks.standins import sql
from panelgrid.fixed_values import (
    CENSUS_DENSITY, ECONOMY, INFRASTRUCTURE, POPULATION,
)
from panelgrid.operators import joins, metrics, split
from panelgrid.operators.grid import region_table
from panelgrid.plans import panel as plans
from panelgrid.session import scratch_path
from panelgrid.sinks import tables
from panelgrid.sources import artifacts, context, events, weather


def _case(column: str, table: dict, pick=lambda v: v, default: str = "null") -> str:
    cells = " ".join(f"when '{k}' then {pick(v)!r}" for k, v in table.items())
    return f"case {column} {cells} else {default} end"


def event_files(spark, sf_dir):
    path = scratch_path(spark, "events")
    st.storm_rows(spark, sf_dir).withColumn("EPISODE_ID", F.lit(1)).write.option(
        "header", True
    ).option("compression", "gzip").csv(path)
    return path


@query("s01_scan_storm_events", sql(
    f"""select event_id, kind, {r('lat', 'begin_lat')}, {r('lon', 'begin_lon')},
        cast(deaths as bigint) as deaths, cast(injuries as bigint) as injuries,
        {r('magnitude', 'magnitude')} from storm""", "storm"))
def _(spark, sf_dir):
    kinds = F.array(*[F.lit(t) for t in st.EVENT_TYPES])
    scanned = events.scan_storm_events(spark, event_files(spark, sf_dir))
    position = F.array_position(kinds, F.col("EVENT_TYPE")) - 1
    return rounded(scanned.select(
        F.col("EVENT_ID").alias("event_id"), F.coalesce(position, F.lit(8)).alias("kind"),
        F.col("BEGIN_LAT").alias("begin_lat"), F.col("BEGIN_LON").alias("begin_lon"),
        F.col("DEATHS_DIRECT").alias("deaths"), F.col("INJURIES_DIRECT").alias("injuries"),
        F.col("MAGNITUDE").alias("magnitude"),
    ))


@query("s01_event_files_of_other_layouts", sql(
    f"""select event_id, kind, {r('lat', 'begin_lat')}, cast(deaths as bigint) as deaths,
        case when event_id % 2 = 1 then 'two' || chr(10) || 'lines' else 'one' end as damage
    from storm""", "storm"))
def _(spark, sf_dir):
    rows = st.storm_rows(spark, sf_dir).withColumn("DAMAGE_PROPERTY", F.expr(
        "if(EVENT_ID % 2 = 1, 'two\\nlines', 'one')"))
    base = scratch_path(spark, "layouts")
    for part, columns in ((0, rows.columns), (1, [*reversed(rows.columns)])):
        rows.where(F.col("EVENT_ID") % 2 == part).select(*columns).write.option("header", True).option(
            "quoteAll", True).option("escape", '"').csv(f"{base}/{part}")
    scanned = events.scan_storm_events(spark, [f"{base}/0", f"{base}/1"])
    kinds = F.array(*[F.lit(t) for t in st.EVENT_TYPES])
    position = F.array_position(kinds, F.col("EVENT_TYPE")) - 1
    return rounded(scanned.select(
        F.col("EVENT_ID").alias("event_id"), F.coalesce(position, F.lit(8)).alias("kind"),
        F.col("BEGIN_LAT").alias("begin_lat"), F.col("DEATHS_DIRECT").alias("deaths"),
        F.col("DAMAGE_PROPERTY").alias("damage"),
    ))


@query("s01_landed_events_by_year", sql(
    f"""select event_id, kind, {r('lat', 'begin_lat')}, case when year(t) = 1997 then 9 else deaths end as deaths
    from storm where year(t) between 1996 and 1998 and not (year(t) = 1997 and event_id % 2 = 0)""", "storm"))
def _(spark, sf_dir):
    """All years are landed, one is replaced by other rows, and a range of years is read."""
    folder = scratch_path(spark, "landed-events")
    rows = st.storm_rows(spark, sf_dir)
    tables.land_events(rows, folder)
    again = events.with_year(rows).where("year = 1997 and EVENT_ID % 2 <> 0").drop("year")
    tables.land_events(again.withColumn("DEATHS_DIRECT", F.lit(9).cast("long")), folder)
    kinds = F.array(*[F.lit(t) for t in st.EVENT_TYPES])
    return rounded(events.read_landed_events(spark, folder, 1996, 1998).select(
        F.col("EVENT_ID").alias("event_id"), F.coalesce(F.array_position(kinds, F.col("EVENT_TYPE")) - 1, F.lit(8)).alias("kind"),
        F.col("BEGIN_LAT").alias("begin_lat"), F.col("DEATHS_DIRECT").alias("deaths")))


@query("s02_latest_file_per_year", sql(
    """select year, concat('StormEvents_details-ftp_v1.0_d', year, '_c', max(stamp), '.csv.gz') as file
    from (select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%Y%m%d') as stamp,
        o_orderkey from orders) where o_orderkey % 5 <> 0 group by year"""))
def _(spark, sf_dir):
    listing = st.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """concat('StormEvents_details-ftp_v1.0_d', year(o_orderdate), '_c',
            date_format(o_orderdate, 'yyyyMMdd'), '.csv.gz') AS file""",
    ).selectExpr(
        """CASE WHEN o_orderkey % 5 = 0 THEN concat('notes_', o_orderkey, '.txt')
                WHEN o_orderkey % 2 = 0 THEN upper(file) ELSE file END AS name"""
    )
    return events.latest_file_per_year(listing)


@query("s03_scan_daily_files", sql(
    "select station, timestamp, element, raw from wx_long", "wx_long"))
def _(spark, sf_dir):
    path = scratch_path(spark, "daily")
    st.daily_lines(spark, sf_dir).write.text(path)
    return weather.scan_daily_files(spark, path)


@query("s04_scan_stations", sql(
    f"""select concat('USC', lpad(cast(c_custkey as varchar), 8, '0')) as station,
        {r('c_custkey % 90', 'latitude')}, {r('-(c_custkey % 180)', 'longitude')},
        {r('c_custkey % 4000', 'elevation')}, left(region_id, 2) as state, c_name as name
    from customer join places on c_nationkey = n_nationkey where c_custkey % 3 <> 0""", "places"))
def _(spark, sf_dir):
    customers = st.table(spark, sf_dir, "customer").join(
        st.places(spark, sf_dir), F.expr("c_nationkey = n_nationkey")
    )
    lines = customers.selectExpr(
        """concat('USC', lpad(cast(c_custkey as string), 8, '0'), ' ',
            lpad(concat(c_custkey % 90, '.0000'), 8, ' '), ' ',
            lpad(concat('-', c_custkey % 180, '.0000'), 9, ' '), ' ',
            lpad(concat(c_custkey % 4000, '.0'), 6, ' '), ' ', substring(region_id, 1, 2), ' ',
            rpad(c_name, 30, ' '), ' GSN') AS value"""
    )
    path = scratch_path(spark, "stations")
    lines.write.text(path)
    wanted = customers.where("c_custkey % 3 <> 0").selectExpr(
        "concat('USC', lpad(cast(c_custkey as string), 8, '0')) AS station"
    )
    return rounded(weather.scan_stations(spark, path, wanted))


def _write_responses(spark, rows, label):
    path = scratch_path(spark, label)
    rows.write.text(path)
    return path


@query("s05_wide_weather_from_json", sql(
    """select station, timestamp, round((TMAX / 10 + TMIN / 10) / 2, 4) + 0.0 as tavg_c,
        TMAX / 10 as tmax_c, TMIN / 10 as tmin_c, PRCP / 10 as prcp_mm, SNOW as snow_mm,
        SNWD as snwd_mm, AWND / 10 as awnd_ms from wx_wide""", "wx_wide"))
def _(spark, sf_dir):
    values = st.observations(spark, sf_dir).where(
        "element <> 'TOBS' and quality = ' ' and value <> '-9999'"
    ).withColumn("raw", F.col("value").cast("double"))
    wide = weather.pivot_elements(values, ["station", "day"])
    body = F.to_json(F.struct(F.array(F.struct(
        F.col("station").alias("STATION"), F.date_format("day", "yyyy-MM-dd").alias("DATE"),
        *weather.ELEMENTS,
    )).alias("results")))
    path = _write_responses(spark, wide.select(body.alias("value")), "wide-json")
    return rounded(weather.weather_from_wide_json(
        weather.read_responses(spark, path, weather.WIDE_RESULTS, per_line=True)
    ))


@query("s06_wide_weather_from_long_json", sql(
    """select station, timestamp, round((TMAX / 10 + TMIN / 10) / 2, 4) + 0.0 as tavg_c,
        TMAX / 10 as tmax_c, TMIN / 10 as tmin_c, PRCP / 10 as prcp_mm, SNOW as snow_mm,
        SNWD as snwd_mm, AWND / 10 as awnd_ms from wx_wide""", "wx_wide"))
def _(spark, sf_dir):
    values = st.observations(spark, sf_dir).where(
        "element <> 'TOBS' and quality = ' ' and value <> '-9999'"
    )
    result = F.struct(
        "station", F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("element").alias("datatype"), F.col("value").cast("double").alias("value"),
    )
    responses = values.groupBy("station", F.year("day").alias("y"), F.month("day").alias("m")).agg(
        F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("value")
    )
    path = _write_responses(spark, responses.select("value"), "long-json")
    return rounded(weather.weather_from_long_json(
        weather.read_responses(spark, path, weather.LONG_RESULTS, per_line=True)
    ))


@query("s07_population_from_census_json", sql(
    f"""select region_id, c_custkey * 7 as total_population,
        {_case('region_id', CENSUS_DENSITY, default='100.0')}::double as population_density,
        80.0::double as urban_percentage
    from customer join places on c_nationkey = n_nationkey
    where c_custkey % 11 <> 0 and c_custkey % 13 <> 0 and c_custkey % 17 <> 0""", "places"))
def _(spark, sf_dir):
    responses = st.table(spark, sf_dir, "customer").join(
        st.places(spark, sf_dir), F.expr("c_nationkey = n_nationkey")
    ).selectExpr(
        "region_id",
        """CASE WHEN c_custkey % 11 = 0 THEN '[["B01001_001E","state"]]'
                WHEN c_custkey % 13 = 0 THEN '[["B01001_001E","state"],["x12","06"]]'
                WHEN c_custkey % 17 = 0 THEN 'Invalid Key'
                ELSE concat('[["B01001_001E","state"],["', c_custkey * 7, '","06"]]') END AS body""",
    )
    return context.population_from_census_json(responses)


INFRASTRUCTURE_SQL = f"""select region_id,
    cast({_case('region_id', INFRASTRUCTURE, lambda v: v[0], '27')} as integer) as avg_infrastructure_age,
    {_case('region_id', INFRASTRUCTURE, lambda v: v[1], '6.5')}::double as maintenance_score,
    {_case('region_id', INFRASTRUCTURE, lambda v: v[2], '6.5')}::double as condition_rating
    from regions"""
POPULATION_SQL = f"""select region_id,
    cast({_case('region_id', POPULATION, lambda v: v[0])} as bigint) as total_population,
    {_case('region_id', POPULATION, lambda v: v[1])}::double as population_density,
    {_case('region_id', POPULATION, lambda v: v[2])}::double as urban_percentage from regions"""
ECONOMY_SQL = f"""select region_id,
    {_case('region_id', ECONOMY, lambda v: v[0])}::double as gdp_per_capita,
    {_case('region_id', ECONOMY, lambda v: v[1])}::double as infrastructure_investment,
    {_case('region_id', ECONOMY, lambda v: v[2])}::double as poverty_rate from regions"""


@query("s08_infrastructure_context", sql(INFRASTRUCTURE_SQL, "regions"))
def _(spark, sf_dir):
    return context.infrastructure_context(st.regions(spark, sf_dir))


@query("s09_population_context", sql(POPULATION_SQL, "regions"))
def _(spark, sf_dir):
    return context.population_context(st.regions(spark, sf_dir))


@query("s09_economic_context", sql(ECONOMY_SQL, "regions"))
def _(spark, sf_dir):
    return context.economic_context(st.regions(spark, sf_dir))


@query("s10_economic_constant", sql(
    """select region_id, 65.0::double as gdp_per_capita, 10.0::double as infrastructure_investment,
        12.0::double as poverty_rate from regions""", "regions"))
def _(spark, sf_dir):
    return context.economic_constant(st.regions(spark, sf_dir))


@query("s11_empty_with_schema", sql(
    """select region_id, timestamp, failures, cast(null as bigint) as customers_affected,
        cast(null as double) as outage_duration_hours, cast(null as varchar) as cause
    from sales""", "sales"))
def _(spark, sf_dir):
    outages = context.empty_with_schema(spark, "outages")
    return st.sales(spark, sf_dir).select("region_id", "timestamp", "failures").join(
        outages, ["region_id", "timestamp"], "left"
    )


@query("s12_first_available_source", sql(
    """select station, timestamp, element, raw, 'api' as origin from wx_long
        where s_nationkey % 3 = 0 and element = 'TMAX'
    union all select station, timestamp, element, raw, 'second' from wx_long
        where s_nationkey % 2 = 0 and element = 'PRCP' and station not in
            (select station from wx_long where s_nationkey % 3 = 0 and element = 'TMAX')
    union all select station, timestamp, element, raw, 'file' from wx_long
        where station not in (select station from wx_long where s_nationkey % 3 = 0 and element = 'TMAX')
        and station not in (select station from wx_long where s_nationkey % 2 = 0 and element = 'PRCP')""",
    "wx_long"))
def _(spark, sf_dir):
    path = scratch_path(spark, "daily")
    st.daily_lines(spark, sf_dir).write.text(path)
    everything = weather.scan_daily_files(spark, path)
    nation = F.substring("station", 4, 8).cast("int")
    first = everything.where((nation % 3 == 0) & (F.col("element") == "TMAX"))
    second = everything.where((nation % 2 == 0) & (F.col("element") == "PRCP"))
    return weather.first_available(
        [first.withColumn("origin", F.lit("api")), second.withColumn("origin", F.lit("second")),
         everything.withColumn("origin", F.lit("file"))], "station",
    )


@query("s13_read_predictions", sql(
    f"""select region_id, timestamp, latitude, longitude, split, target, rf_pred, xgb_pred,
        lstm_pred, tabular_ensemble, {r('hybrid_pred', 'hybrid_pred')} from preds""", "preds"))
def _(spark, sf_dir):
    folder = scratch_path(spark, "run")
    tables.save_table(st.predictions(spark, sf_dir), f"{folder}/predictions.csv")
    return rounded(artifacts.read_predictions(spark, folder))


_METRICS_SQL = f"""select split, model, metric, {r('value', 'value')} from
    (select split, model, unnest(['mae', 'rmse', 'r2']) as metric,
        unnest([avg(abs(y - p)), sqrt(avg((y - p) * (y - p))),
                1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))]) as value
    from (select split, model, target as y, p from (select split, target, rf_pred as rf,
        xgb_pred as xgb, tabular_ensemble, hybrid_pred as hybrid_ensemble, lstm_pred as lstm
        from preds) unpivot (p for model in (rf, xgb, tabular_ensemble, hybrid_ensemble, lstm)))
    group by split, model)"""


def _stored_metrics(spark, sf_dir):
    folder = scratch_path(spark, "run")
    values = metrics.evaluate(st.predictions(spark, sf_dir))
    tables.save_metrics_json(values, f"{folder}/metrics.json", {"note": 1}, 12.5)
    return folder


@query("s14_read_metrics", sql(_METRICS_SQL, "preds"))
def _(spark, sf_dir):
    return rounded(artifacts.read_metrics(spark, _stored_metrics(spark, sf_dir)))


@query("s14_read_metrics_of_any_name", sql(
    """select r_name as split, c_mktsegment as model, 'mape' as metric, cast(count(*) as double) as value
    from region, nation, customer where r_regionkey = n_regionkey and n_nationkey = c_nationkey
    group by 1, 2"""))
def _(spark, sf_dir):
    named = st.table(spark, sf_dir, "customer").join(
        st.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    ).join(st.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    figures = named.groupBy(F.col("r_name").alias("split"), F.col("c_mktsegment").alias("model")).agg(
        F.lit("mape").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")
    )
    folder = scratch_path(spark, "run")
    tables.save_metrics_json(figures, f"{folder}/metrics.json")
    return artifacts.read_metrics(spark, folder)


@query("s14_read_threshold", sql(
    "select quantile_cont(failures, 0.8) as classification_threshold from split_panel where split = 'train'",
    "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    value = split.target_threshold(labelled, "failures", 0.8).first()["value"]
    folder = scratch_path(spark, "run")
    values = metrics.evaluate(labelled.withColumns(
        {"target": F.col("failures"), "rf_pred": F.col("tmax_c")}
    ))
    tables.save_metrics_json(values, f"{folder}/metrics.json", {}, value)
    return artifacts.read_threshold(spark, folder)


@query("s14_read_feature_columns", sql(
    """select kind, cast(position as integer) as position, feature from
    (select 'tabular' as kind, generate_subscripts(l, 1) - 1 as position, unnest(l) as feature
        from (select list(r_name order by r_name) as l from region)
    union all select 'sequence', generate_subscripts(l, 1) - 1, unnest(l)
        from (select list(distinct o_orderpriority order by o_orderpriority) as l from orders))"""))
def _(spark, sf_dir):
    def names(table, column):
        return st.table(spark, sf_dir, table).agg(
            F.array_sort(F.collect_set(column)).alias("names")).first()["names"]

    folder = scratch_path(spark, "run")
    tables.save_text(spark, tables.to_json_text({
        "tabular_features": names("region", "r_name"),
        "sequence_features": names("orders", "o_orderpriority"),
    }), f"{folder}/feature_columns.json")
    return artifacts.read_feature_columns(spark, folder)


@query("s15_load_panel_adapter", sql(
    "select region_id, timestamp, failures, event_count, tmax_c, prcp_mm from sales", "sales"))
def _(spark, sf_dir):
    def orders_loader(session, config):
        return st.sales(session, config["folder"])

    return plans.load_panel(spark, {"real": orders_loader}, {"folder": sf_dir})


def raw_files(spark, sf_dir):
    """Event, daily and station files made from the tables: loader arguments by name."""
    daily = scratch_path(spark, "daily")
    st.daily_lines(spark, sf_dir).write.text(daily)
    named = st.station_names(spark, sf_dir).where(F.col("region_id").isin(st.WANTED_REGIONS))
    station_file = scratch_path(spark, "stations")
    named.join(st.coordinates(spark, sf_dir), "region_id").selectExpr(
        """concat(station, ' ', lpad(cast(latitude as string), 8, ' '), ' ',
            lpad(cast(longitude as string), 9, ' '), ' ', lpad('12.5', 6, ' '), ' ', 'XX ',
            rpad(region_id, 30, ' ')) AS value"""
    ).write.text(station_file)
    stations = {row["region_id"]: row["station"] for row in named.take(len(st.WANTED_REGIONS))}
    config = {"data": {"real": {
        "start_date": st.START, "end_date": st.END, "ghcn": {"stations": stations},
    }}}
    return {"config": config, "event_paths": [event_files(spark, sf_dir)],
            "daily_paths": [daily], "station_path": station_file}


def real_panel(spark, files):
    """The panel of those files with its context."""
    regions = region_table(spark, st.WANTED_REGIONS, "region_id")
    return plans.load_real_panel(
        spark, context=context.load_context(regions, use_apis=False), **files
    )


@query("s17_load_context", sql(
    f"""select p.*, e.gdp_per_capita, e.infrastructure_investment, e.poverty_rate,
        i.avg_infrastructure_age, i.maintenance_score, i.condition_rating
    from ({POPULATION_SQL}) p join ({ECONOMY_SQL}) e on p.region_id = e.region_id
    join ({INFRASTRUCTURE_SQL}) i on p.region_id = i.region_id""", "regions"))
def _(spark, sf_dir):
    regions = st.regions(spark, sf_dir)
    return joins.attach_context(regions, context.load_context(regions, use_apis=False))


@query("k01_save_table_csv", sql(
    "select region_id, timestamp, failures, event_count from sales", "sales"))
def _(spark, sf_dir):
    path = scratch_path(spark, "table") + ".csv"
    tables.save_table(
        st.sales(spark, sf_dir).select("region_id", "timestamp", "failures", "event_count"), path
    )
    return spark.read.schema(
        "region_id string, timestamp timestamp_ntz, failures double, event_count long"
    ).csv(path, header=True)


@query("k01_save_table_parquet", sql(
    "select region_id, timestamp, failures, event_count, tmax_c, prcp_mm from sales", "sales"))
def _(spark, sf_dir):
    path = scratch_path(spark, "table") + ".parquet"
    tables.save_table(st.sales(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("k02_save_metrics_json", sql(
    f"select split, count(*) as cells, {r('sum(value)', 'total')} from ({_METRICS_SQL}) group by split",
    "preds"))
def _(spark, sf_dir):
    stored = artifacts.read_metrics(spark, _stored_metrics(spark, sf_dir))
    return rounded(rounded(stored).groupBy("split").agg(
        F.count("value").alias("cells"), F.sum("value").alias("total")
    ))


@query("k03_latest_run", sql("select region_id, timestamp, split, target from preds", "preds"))
def _(spark, sf_dir):
    base = scratch_path(spark, "runs")
    folder = tables.run_folder(base, "trial")
    tables.save_table(st.predictions(spark, sf_dir), f"{folder}/predictions.parquet")
    tables.update_latest(spark, base, folder)
    latest = artifacts.read_predictions(spark, f"{base}/latest")
    return latest.select("region_id", "timestamp", "split", "target")


@query("k04_stored_scaler", sql(
    f"""select feature, {r('mean', 'mean')}, {r('scale', 'scale')} from
    (select unnest(['event_count', 'failures', 'tmax_c']) as feature,
        unnest([avg(event_count), avg(failures), avg(tmax_c)]) as mean,
        unnest([stddev_pop(event_count), stddev_pop(failures), stddev_pop(tmax_c)]) as scale
    from split_panel where split = 'train')""", "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    path = scratch_path(spark, "scaler") + ".parquet"
    tables.save_table(split.fit_scaler(labelled, ["event_count", "failures", "tmax_c"]), path)
    return rounded(split.scaler_rows(spark.read.parquet(path)))
