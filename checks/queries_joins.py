"""Joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_sources import (
    ECONOMY_SQL, INFRASTRUCTURE_SQL, POPULATION_SQL, event_files, raw_files, real_panel,
)
from checks.registry import query, r, rounded
from checks.standins import sql
from panelgrid.fixed_values import EVENT_COUNT_COLUMNS, EVENT_FILE_NAME, STATE_FIPS, WEATHER_COLUMNS
from panelgrid.functions import text
from panelgrid.operators import aggregate, joins, metrics, ranked, reports, split
from panelgrid.operators.grid import align_reindex, region_date_grid, region_table
from panelgrid.operators.series import Series
from panelgrid.plans import panel as plans
from panelgrid.session import scratch_path
from panelgrid.sources import weather
from panelgrid.sources.context import load_context
from panelgrid.sources.events import scan_storm_events

# -- joins ----------------------------------------------------------------------------------


@query("j01_region_date_grid", sql("select region_id, timestamp from grid", "grid"))
def _(spark, sf_dir):
    return region_date_grid(
        st.regions(spark, sf_dir), st.SERIES, st.GRID_START, st.GRID_END
    )


def _weather(spark, sf_dir):
    long = st.observations(spark, sf_dir)
    valid = long.where(
        F.col("element").isin(weather.ELEMENTS)
        & weather.valid_observation(F.col("value"), F.col("quality"))
    ).select("station", F.col("day").alias("timestamp"), "element",
             F.col("value").try_cast("double").alias("raw"))
    return plans.daily_weather(valid, st.station_names(spark, sf_dir), "1900-01-01", "2100-01-01")


@query("j02_grid_with_weather", sql(
    f"""select g.region_id, g.timestamp, tmax_c, prcp_mm, {r('tavg_c', 'tavg_c')} from grid g
    left join wx_daily w on g.region_id = w.region_id and g.timestamp = w.timestamp""",
    "grid", "wx_daily"))
def _(spark, sf_dir):
    grid = region_date_grid(st.regions(spark, sf_dir), st.SERIES, st.GRID_START, st.GRID_END)
    seen = _weather(spark, sf_dir).select("region_id", "timestamp", "tmax_c", "prcp_mm", "tavg_c")
    return rounded(joins.left_on_key(grid, seen, st.SERIES))


@query("j03_grid_with_events", sql(
    f"""select g.region_id, g.timestamp, {r('failures', 'failures', 2)}, event_count, deaths
    from real_grid g left join daily_events e
    on g.region_id = e.region_id and g.timestamp = e.timestamp""", "real_grid", "daily_events"))
def _(spark, sf_dir):
    grid = region_date_grid(
        region_table(spark, st.WANTED_REGIONS, "region_id"), st.SERIES, st.START, st.END
    )
    daily = plans.daily_events(
        st.storm_rows(spark, sf_dir), st.WANTED_REGIONS, st.START, st.END
    ).select("region_id", "timestamp", "failures", "event_count", "deaths")
    return rounded(joins.left_on_key(grid, daily, st.SERIES), 2)


@query("j04_attach_coordinates", sql(
    """select s.region_id, timestamp, failures, latitude, longitude from sales s
    left join coords c on s.region_id = c.region_id""", "sales", "coords"))
def _(spark, sf_dir):
    sales = st.sales(spark, sf_dir).select("region_id", "timestamp", "failures")
    return joins.attach_coordinates(sales, st.coordinates(spark, sf_dir))


@query("j05_attach_context", sql(
    f"""select s.region_id, timestamp, {r('a.balance', 'balance')}, a.customers,
        {r('b.supplier_balance', 'supplier_balance')}, r_name
    from sales s
    left join (select region_id, avg(c_acctbal) as balance, count(*) as customers from customer
        join places on c_nationkey = n_nationkey group by region_id) a on s.region_id = a.region_id
    left join (select region_id, avg(s_acctbal) as supplier_balance from supplier
        join places on s_nationkey = n_nationkey group by region_id) b on s.region_id = b.region_id
    left join (select p.region_id, r_name from places p join nation n
        on p.n_nationkey = n.n_nationkey join region on n_regionkey = r_regionkey) c
        on s.region_id = c.region_id""", "sales", "places"))
def _(spark, sf_dir):
    places = st.places(spark, sf_dir)
    customers = st.table(spark, sf_dir, "customer").join(
        places, F.expr("c_nationkey = n_nationkey")
    ).groupBy("region_id").agg(
        F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("customers")
    )
    suppliers = st.table(spark, sf_dir, "supplier").join(
        places, F.expr("s_nationkey = n_nationkey")
    ).groupBy("region_id").agg(F.avg("s_acctbal").alias("supplier_balance"))
    continents = (
        places.join(st.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
        .join(st.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .select("region_id", "r_name")
    )
    enriched = joins.attach_context(
        st.sales(spark, sf_dir).select("region_id", "timestamp"),
        {"population": customers, "economic": suppliers, "infrastructure": continents},
    )
    return rounded(enriched)


@query("j06_state_codes", sql(
    "select event_id, region_id from storm where region_id is not null", "storm"))
def _(spark, sf_dir):
    return st.storm_rows(spark, sf_dir).where("STATE is not null").select(
        F.col("EVENT_ID").alias("event_id"), text.state_code(F.col("STATE")).alias("region_id")
    )


@query("j06_attach_fips", sql(
    f"""select region_id, fips, c_custkey from (select region_id, c_custkey, case region_id
        {" ".join(f"when '{k}' then '{v}'" for k, v in STATE_FIPS.items())} end as fips
    from customer join places on c_nationkey = n_nationkey) where fips is not null""", "places"))
def _(spark, sf_dir):
    customers = st.table(spark, sf_dir, "customer").join(
        st.places(spark, sf_dir), F.expr("c_nationkey = n_nationkey")
    )
    return joins.attach_fips(customers.select("region_id", "c_custkey"))


HOURLY = Series(region="event_type", time="hour", frequency="1h", chunk_rows=48)
_HOURS = """select event_type, date_trunc('hour', ts) as hour, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
    from events group by 1, 2"""


def hourly_sums(spark, sf_dir):
    return st.table(spark, sf_dir, "events").groupBy(
        "event_type", F.expr("cast(date_trunc('hour', ts) as timestamp_ntz)").alias("hour")
    ).agg(F.expr("sum(cast(round(value * 100) as bigint))").alias("cents"))


@query("j07_align_reindex", f"""with h as ({_HOURS}), g as (select event_type,
        unnest(generate_series(min(hour), max(hour), interval 6 hour)) as hour from h group by event_type)
    select g.event_type, g.hour, cents from g left join h
    on g.event_type = h.event_type and g.hour = h.hour""")
def _(spark, sf_dir):
    six_hours = Series(region="event_type", time="hour", frequency="6h")
    return align_reindex(hourly_sums(spark, sf_dir), six_hours)


@query("j08_rows_for_window_ends", sql(
    """select p.region_id, p.timestamp, p.split, failures, event_count from split_panel p join
    (select distinct c_nationkey, timestamp from (select c_nationkey, o_orderdate as timestamp
        from orders join customer on o_custkey = c_custkey)) k
    on p.timestamp = k.timestamp join places on c_nationkey = n_nationkey
        and p.region_id = places.region_id""", "split_panel", "places"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    keys = labelled.where("event_count > 0").select("split", "region_id", "timestamp")
    kept = joins.rows_for_keys(labelled, keys.unionByName(keys), st.SERIES, "failures")
    return kept.select("region_id", "timestamp", "split", "failures", "event_count")


@query("j09_combine_predictions", sql(
    f"""select split, region_id, timestamp, tabular_ensemble, lstm_pred,
        {r('hybrid_pred', 'hybrid_pred')} from preds""", "preds"))
def _(spark, sf_dir):
    predictions = st.predictions(spark, sf_dir)
    key = ["split", "region_id", "timestamp"]
    temporal = predictions.where("lstm_pred is not null").select(*key, "lstm_pred")
    return rounded(joins.combine_predictions(
        predictions.select(*key, "tabular_ensemble"), temporal, 0.25
    ))


# -- aggregations -----------------------------------------------------------------------------

_DAILY = ", ".join(
    [r("failures", "failures", 2), *EVENT_COUNT_COLUMNS]
    + [r(c, c) for c in ("avg_magnitude", "avg_latitude", "avg_longitude")]
)


@query("a01_daily_event_agg", sql(
    f"select region_id, timestamp, {_DAILY} from daily_events", "daily_events"))
def _(spark, sf_dir):
    return _daily(spark, sf_dir)


def _daily(spark, sf_dir):
    daily = plans.daily_events(st.storm_rows(spark, sf_dir), st.WANTED_REGIONS, st.START, st.END)
    return rounded(daily.withColumn("failures", F.round("failures", 2)))


@query("a02_pivot_mean", sql(
    f"""select day, {r("avg(value) filter (event_type = 'click')", 'click')},
        {r("avg(value) filter (event_type = 'error')", 'error')},
        {r("avg(value) filter (event_type = 'purchase')", 'purchase')},
        {r("avg(value) filter (event_type = 'signup')", 'signup')},
        {r("avg(value) filter (event_type = 'view')", 'view')}
    from (select cast(date_trunc('day', ts) as timestamp) as day, event_type, value from events)
    group by day"""))
def _(spark, sf_dir):
    rows = st.table(spark, sf_dir, "events").withColumn("day", text.day_floor(F.col("ts")))
    wide = rows.groupBy("day").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("value"))
    return rounded(wide)


@query("a02_pivot_elements", sql(
    "select station, timestamp, TMAX, TMIN, PRCP, SNOW, SNWD, AWND from wx_wide", "wx_wide"))
def _(spark, sf_dir):
    seen = st.observations(spark, sf_dir)
    valid = seen.where(weather.valid_observation(F.col("value"), F.col("quality"))).select(
        "station", F.col("day").alias("timestamp"), "element",
        F.col("value").try_cast("double").alias("raw"),
    )
    return weather.pivot_elements(valid, ["station", "timestamp"])


@query("a03_resolve_sequence_length", sql(
    """select cast(greatest(1, least(2000, max(n))) as integer) as sequence_length
    from (select region_id, count(*) as n from split_panel where split = 'train' group by region_id)""",
    "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    length = aggregate.resolve_sequence_length(labelled, "region_id", 2000)
    return spark.range(1).select(F.lit(length).alias("sequence_length"))


@query("a04_sample_counts", sql("select split, count(*) as rows from preds group by split", "preds"))
def _(spark, sf_dir):
    return aggregate.sample_counts(st.predictions(spark, sf_dir))


@query("a04_load_summary", sql(
    "select count(*) as rows, count(distinct region_id) as regions from sales", "sales"))
def _(spark, sf_dir):
    return aggregate.load_summary(st.sales(spark, sf_dir))


@query("a05_fit_scaler", sql(
    f"""select feature, {r('mean', 'mean')}, {r('scale', 'scale')} from
    (select unnest(['event_count', 'tmax_c', 'prcp_mm', 'level']) as feature,
        unnest([avg(event_count), avg(tmax_c), avg(prcp_mm), 7.5]) as mean,
        unnest([stddev_pop(event_count), stddev_pop(tmax_c), stddev_pop(prcp_mm), 1.0]) as scale
    from split_panel where split = 'train')""", "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    labelled = labelled.withColumn("level", F.lit(7.5))
    return rounded(split.scaler_rows(
        split.fit_scaler(labelled, ["event_count", "tmax_c", "prcp_mm", "level"])
    ))


@query("a06_target_threshold", sql(
    f"""select {r('quantile_cont(failures, 0.85)', 'value')} from split_panel
    where split = 'train'""", "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    return rounded(split.target_threshold(labelled, "failures", 0.85))


@query("a06_exact_percentile", f"""select {r('quantile_cont(l_extendedprice, 0.333)', 'value')}
    from lineitem""")
def _(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem")
    return rounded(ranked.exact_percentile(rows, "l_extendedprice", 0.333))


@query("a07_regression_metrics", sql(
    f"""select region_id, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')},
        {r('case when var_pop(target) > 0 then 1 - sum(e * e) / (var_pop(target) * count(*)) '
           'when sum(e * e) = 0 then 1 else 0 end', 'r2')}
    from (select region_id, target, target - xgb_pred as e from preds) group by region_id""",
    "preds"))
def _(spark, sf_dir):
    return rounded(metrics.regression_metrics(
        st.predictions(spark, sf_dir), "target", "xgb_pred", ["region_id"]
    ))


@query("a08_classification_metrics", sql(
    f"""select lang, {r('ok / n', 'accuracy')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
        {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
        {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}
    from (select lang, count(*) as n, count(*) filter ((p >= 0.6) = (quality = 1)) as ok,
        count(*) filter (p >= 0.6 and quality = 1) as tp,
        count(*) filter (p >= 0.6 and quality = 0) as fp,
        count(*) filter (p < 0.6 and quality = 1) as fn from scores group by lang)""", "scores"))
def _(spark, sf_dir):
    return rounded(metrics.classification_metrics(
        st.scores(spark, sf_dir), "quality", "p", 0.6, ["lang"]
    ))


@query("a09_roc_auc", sql(
    f"""select * from (with by_score as (select p, sum(quality) as pos, count(*) - sum(quality) as neg
        from scores group by p),
    cum as (select pos, neg, coalesce(sum(neg) over (order by p rows between unbounded preceding
        and 1 preceding), 0) as below from by_score)
    select {r('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))', 'roc_auc', 6)} from cum)""", "scores"))
def _(spark, sf_dir):
    return rounded(metrics.ranking_metrics(st.scores(spark, sf_dir), "quality", "p"), 6).select("roc_auc")


@query("a10_average_precision", sql(
    f"""select * from (with by_score as (select lang, p, sum(quality) as pos, count(*) as n
        from scores group by lang, p),
    cum as (select lang, pos, sum(pos) over w as hits, sum(n) over w as called from by_score
        window w as (partition by lang order by p desc rows unbounded preceding))
    select lang, {r('coalesce(sum(pos * hits / called) / nullif(sum(pos), 0), 0)', 'pr_auc', 6)}
    from cum group by lang)""", "scores"))
def _(spark, sf_dir):
    made = metrics.ranking_metrics(st.scores(spark, sf_dir), "quality", "p", ["lang"])
    return rounded(made, 6).select("lang", "pr_auc")


@query("a11_metrics_by_split_and_model", sql(
    f"""select split, model, metric, {r('value', 'value')} from
    (select split, model, unnest(['mae', 'rmse', 'r2']) as metric,
        unnest([avg(abs(y - p)), sqrt(avg((y - p) * (y - p))),
                1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))]) as value
    from (select split, model, target as y, p from (select split, target, rf_pred as rf,
        xgb_pred as xgb, tabular_ensemble, hybrid_pred as hybrid_ensemble, lstm_pred as lstm
        from preds) unpivot (p for model in (rf, xgb, tabular_ensemble, hybrid_ensemble, lstm)))
    group by split, model)""", "preds"))
def _(spark, sf_dir):
    return rounded(metrics.evaluate(st.predictions(spark, sf_dir)))


st.CTE["class_scores"] = (
    """select split, model, y, p from (select split, cast(target >= 50 as integer) as y, rf_pred as rf,
        xgb_pred as xgb, tabular_ensemble, hybrid_pred as hybrid_ensemble, lstm_pred as lstm from preds)
    unpivot (p for model in (rf, xgb, tabular_ensemble, hybrid_ensemble, lstm))""", ("preds",),
)


st.CTE["class_calls"] = (
    """select split, model, cast(count(*) filter (p >= 60 and y = 1) as double) as tp,
        count(*) filter (p >= 60) as called, sum(y) as positive
    from class_scores group by split, model""",
    ("class_scores",),
)


@query("a11_class_metrics_by_split_and_model", sql(
    f"""select split, model, 'accuracy' as metric,
        {r('cast(count(*) filter ((p >= 60) = (y = 1)) as double) / count(*)', 'value')}
    from class_scores group by split, model
    union all select split, model, 'precision', {r('coalesce(tp / nullif(called, 0), 0)', 'value')} from class_calls
    union all select split, model, 'recall', {r('coalesce(tp / nullif(positive, 0), 0)', 'value')} from class_calls
    union all select split, model, 'f1', {r('coalesce(2 * tp / nullif(called + positive, 0), 0)', 'value')} from class_calls
    union all select split, model, 'pr_auc', {r('sum(pos * hits / (hits + negs)) / sum(pos)', 'value')}
    from (select split, model, pos, sum(pos) over w as hits, sum(neg) over w as negs
        from (select split, model, p, cast(sum(y) as double) as pos, count(*) - sum(y) as neg from class_scores
            group by split, model, p)
        window w as (partition by split, model order by p desc)) group by split, model
    union all select split, model, 'roc_auc',
        {r('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))', 'value')}
    from (select split, model, pos, neg, coalesce(sum(neg) over (partition by split, model order by p
            rows between unbounded preceding and 1 preceding), 0) as below
        from (select split, model, p, sum(y) as pos, count(*) - sum(y) as neg from class_scores
            group by split, model, p)) group by split, model""", "class_calls"))
def _(spark, sf_dir):
    classed = st.predictions(spark, sf_dir).withColumn("target", F.expr("cast(target >= 50 as int)"))
    made = metrics.evaluate(classed, "classification", 60.0)
    return rounded(made)


@query("a12_region_risk", sql(
    f"""select region_id, arg_min(latitude, timestamp) as latitude,
        arg_min(longitude, timestamp) as longitude, {r('avg(hybrid_pred)', 'hybrid_pred')},
        {r('avg(hybrid_pred)', 'hybrid_class')} from preds group by region_id""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.region_risk(st.predictions(spark, sf_dir)))


@query("a12_region_risk_class", sql(
    f"""select region_id, arg_min(latitude, timestamp) as latitude,
        arg_min(longitude, timestamp) as longitude, {r('avg(hybrid_pred)', 'hybrid_pred')},
        max(cast(hybrid_pred >= 400 as integer)) as hybrid_class from preds group by region_id""",
    "preds"))
def _(spark, sf_dir):
    classed = st.predictions(spark, sf_dir).withColumn(
        "hybrid_class", F.expr("cast(hybrid_pred >= 400 as int)")
    )
    return rounded(reports.region_risk(classed))


@query("a13_risk_map_table", sql(
    f"""select region_id, arg_min(latitude, timestamp) as latitude,
        arg_min(longitude, timestamp) as longitude, {r('avg(hybrid_pred)', 'hybrid_pred')}
    from preds where latitude is not null and longitude is not null and hybrid_pred is not null
    group by region_id""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.risk_map_table(st.predictions(spark, sf_dir)))


@query("a14_daily_mean", sql(
    f"""select timestamp, {r('avg(hybrid_pred)', 'hybrid_pred')}, {r('avg(target)', 'target')}
    from preds group by timestamp""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.daily_mean(st.predictions(spark, sf_dir)))


@query("a15_kpi_summary", sql(
    f"""select count(*) as total_predictions, count(distinct region_id) as regions,
        min(timestamp) as first_timestamp, max(timestamp) as last_timestamp,
        {r('avg(hybrid_pred)', 'avg_prediction')}, {r('max(hybrid_pred)', 'max_prediction')}
    from preds""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.kpi_summary(st.predictions(spark, sf_dir)))


@query("a16_axis_bounds", sql(
    f"""select {r('least(min(target), min(hybrid_pred))', 'lower')},
        {r('greatest(max(target), max(hybrid_pred))', 'upper')} from preds""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.axis_bounds(st.predictions(spark, sf_dir)))


@query("a17_residual_histogram", sql(
    f"""select cast(b as integer) as bin, {r('lo + b * (hi - lo) / 25', 'bin_start')},
        {r('lo + (b + 1) * (hi - lo) / 25', 'bin_end')}, coalesce(n, 0) as residuals
    from (select min(target - hybrid_pred) as lo, max(target - hybrid_pred) as hi from preds),
        range(25) as bins(b)
    left join (select least(cast(floor((target - hybrid_pred - lo) / (hi - lo) * 25) as bigint), 24) as k,
        count(*) as n from preds, (select min(target - hybrid_pred) as lo,
            max(target - hybrid_pred) as hi from preds) group by 1) on k = b""", "preds"))
def _(spark, sf_dir):
    return rounded(reports.residual_histogram(st.predictions(spark, sf_dir)))


@query("a18_residual_density", sql(
    f"""select cast(i as integer) as point, {r('g', 'residual')},
        {r('avg(exp(-0.5 * ((g - x) / h) ** 2)) / (max(h) * sqrt(2 * pi()))', 'density', 8)},
        {r('avg(exp(-0.5 * ((g - x) / h) ** 2)) / (max(h) * sqrt(2 * pi())) * count(*) * max(w)',
           'curve', 3)}
    from (select i, lo + i * (hi - lo) / 199 as g, h, (hi - lo) / 25 as w from
        (select min(target - hybrid_pred) as lo, max(target - hybrid_pred) as hi,
            stddev_samp(target - hybrid_pred) * pow(count(*), -0.2) as h from preds),
        range(200) as points(i)),
        (select target - hybrid_pred as x from preds) group by i, g""", "preds"))
def _(spark, sf_dir):
    made = reports.residual_density(st.predictions(spark, sf_dir))
    return made.select("point", F.round("residual", 4).alias("residual"),
                       F.round("density", 8).alias("density"), F.round("curve", 3).alias("curve"))


@query("a19_available_splits", sql("select distinct split from preds", "preds"))
def _(spark, sf_dir):
    return aggregate.distinct_values(st.predictions(spark, sf_dir), "split")


@query("a20_distinct_keys", sql(
    """select distinct region_id, cast(o_orderdate as timestamp) as timestamp from orders
    join customer on o_custkey = c_custkey join places on c_nationkey = n_nationkey""", "places"))
def _(spark, sf_dir):
    rows = st.table(spark, sf_dir, "orders").join(
        st.table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")
    ).join(st.places(spark, sf_dir), F.expr("c_nationkey = n_nationkey"))
    return aggregate.distinct_keys(
        rows.withColumnRenamed("o_orderdate", "timestamp"), ["region_id", "timestamp"]
    )


@query("a21_metrics_table", sql(
    f"""select concat(upper(left(split, 1)), substring(split, 2)) as "Split",
        case model when 'lstm' then 'Lstm' when 'hybrid_ensemble' then 'Hybrid Ensemble'
            else 'Tabular Ensemble' end as "Model", {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}
    from (select split, model, target as y, p from (select split, target, tabular_ensemble,
        hybrid_pred as hybrid_ensemble, lstm_pred as lstm from preds)
        unpivot (p for model in (tabular_ensemble, hybrid_ensemble, lstm))) group by split, model""",
    "preds"))
def _(spark, sf_dir):
    return rounded(metrics.metrics_table(metrics.evaluate(st.predictions(spark, sf_dir)), "rmse"))


# -- panels from raw feeds ----------------------------------------------------------------------

_PANEL = ", ".join(
    ["region_id", "timestamp", r("tavg_c", "tavg_c")]
    + [c for c in WEATHER_COLUMNS if c != "tavg_c"] + [_DAILY, "latitude", "longitude"]
)


@query("e05_daily_events", sql(
    f"select region_id, timestamp, {_DAILY} from daily_events", "daily_events"))
def _(spark, sf_dir):
    raw = scan_storm_events(spark, event_files(spark, sf_dir))
    daily = plans.daily_events(raw, st.WANTED_REGIONS, st.START, st.END)
    return rounded(daily.withColumn("failures", F.round("failures", 2)))


@query("e06_daily_weather", sql(
    f"""select region_id, timestamp, {r('tavg_c', 'tavg_c')}, tmax_c, tmin_c, prcp_mm, snow_mm,
        snwd_mm, awnd_ms from wx_daily where timestamp between timestamp '{st.START}'
        and timestamp '{st.END}'""", "wx_daily"))
def _(spark, sf_dir):
    long = weather.daily_observations(st.daily_lines(spark, sf_dir))
    return rounded(plans.daily_weather(long, st.station_names(spark, sf_dir), st.START, st.END))


@query("e07_combine_panel", sql(f"select {_PANEL} from real_panel", "real_panel"))
def _(spark, sf_dir):
    panel = joins.combine_panel(
        _weather(spark, sf_dir), st.coordinates(spark, sf_dir),
        plans.daily_events(st.storm_rows(spark, sf_dir), st.WANTED_REGIONS, st.START, st.END),
        region_table(spark, st.WANTED_REGIONS, "region_id"), st.START, st.END, st.SERIES,
    )
    return rounded(panel.withColumn("failures", F.round("failures", 2)))


_CONTEXT_COLUMNS = (
    "total_population", "population_density", "urban_percentage", "gdp_per_capita",
    "infrastructure_investment", "poverty_rate", "avg_infrastructure_age", "maintenance_score",
    "condition_rating",
)


_REAL_PANEL = sql(
    f"""select {_PANEL}, {", ".join(_CONTEXT_COLUMNS)}
    from (select real_panel.*, p.* exclude (region_id), e.* exclude (region_id),
        i.* exclude (region_id) from real_panel
        left join ({POPULATION_SQL}) p on p.region_id = real_panel.region_id
        left join ({ECONOMY_SQL}) e on e.region_id = real_panel.region_id
        left join ({INFRASTRUCTURE_SQL}) i on i.region_id = real_panel.region_id)""",
    "real_panel", "regions")


@query("s16_load_real_panel", _REAL_PANEL)
def _(spark, sf_dir):
    panel = real_panel(spark, raw_files(spark, sf_dir))
    return rounded(panel.withColumn("failures", F.round("failures", 2)))


@query("s16_panel_from_a_listing", _REAL_PANEL)
def _(spark, sf_dir):
    """The latest event file of each year; rows without a readable time are in the first one."""
    files = raw_files(spark, sf_dir)
    folder = scratch_path(spark, "listed")
    rows = st.storm_rows(spark, sf_dir)
    year = F.coalesce(F.year(text.parse_event_time(F.col("BEGIN_DATE_TIME"))), F.lit(1995))
    years = range(int(st.START[:4]), int(st.END[:4]) + 1)
    names = {y: EVENT_FILE_NAME % (y, 20240101) for y in years}
    for y in years:
        rows.where(year == y).write.option("header", True).option("compression", "gzip").csv(f"{folder}/{names[y]}")
    listed = [*names.values(), *[EVENT_FILE_NAME % (y, 20200101) for y in years], "readme.txt"]
    listing = spark.createDataFrame([(name,) for name in listed], "name string")
    regions = region_table(spark, st.WANTED_REGIONS, "region_id")
    panel = plans.load_listed_panel(
        spark, files["config"], listing, folder, files["daily_paths"], files["station_path"],
        context=load_context(regions, use_apis=False),
    )
    return rounded(panel.withColumn("failures", F.round("failures", 2)))
