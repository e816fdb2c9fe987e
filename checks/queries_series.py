"""Windows over panels: features, fills, alignment, splits and sliding windows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_joins import HOURLY, hourly_sums
from checks.registry import query, r, rounded
from checks.standins import sql
from panelgrid import config as cfg
from panelgrid.operators import ensemble, features, sequences, split
from panelgrid.operators.grid import align_time_series
from panelgrid.operators.metrics import evaluate
from panelgrid.operators.series import fill_gaps
from panelgrid.plans.panel import build_model_inputs, engineered_panel
from panelgrid.plans.reporting import report_tables, risk_map
from panelgrid.plans.training import train_and_evaluate
from panelgrid.session import scratch_path
from panelgrid.sinks import tables
from panelgrid.sources.artifacts import read_metrics

W = "over (partition by region_id order by timestamp"
LAGS = (1, 3, 6, 12, 24)
WINDOWS = (3, 6, 12, 24)


def _lag(column: str, k: int) -> str:
    return f"coalesce(lag({column}, {k}) {W}), 0) as {column}_lag_{k}"


def _rolling(function: str, name: str, column: str, n: int, places: int = 6) -> str:
    return r(f"{function}({column}) {W} rows between {n - 1} preceding and current row)",
             f"{column}_roll{name}_{n}", places)


_DIFF = f"coalesce(failures - lag(failures) {W}), 0) as failures_diff_1"
_PCT = r(f"case when lag(failures) {W}) <> 0 then (failures - lag(failures) {W})) "
         f"/ lag(failures) {W}) else 0 end", "failures_pct_change", 6)


def _over_panel(spark, sf_dir, reach, build, columns=("failures", "event_count", "tmax_c")):
    panel = st.panel(spark, sf_dir).select("region_id", "timestamp", *columns)
    return features.over_chunks(panel, st.SERIES, reach, build).drop(*columns)


@query("w01_lag_features", sql(
    f"select region_id, timestamp, {', '.join(_lag(c, k) for c in ('failures', 'tmax_c') for k in LAGS)} from panel",
    "panel"))
def _(spark, sf_dir):
    return _over_panel(
        spark, sf_dir, 24, lambda w: features.lag_features(["failures", "tmax_c"], LAGS, w)
    )


@query("w01_lag_features_irregular", sql(
    f"select region_id, timestamp, {', '.join(_lag('failures', k) for k in LAGS)} from sales", "sales"))
def _(spark, sf_dir):
    sparse = st.sales(spark, sf_dir).select("region_id", "timestamp", "failures")
    series = replace(st.SERIES, frequency=None, chunk_rows=200)
    return features.over_chunks(
        sparse, series, 24, lambda w: features.lag_features(["failures"], LAGS, w)
    ).drop("failures")


@query("w02_rolling_mean", sql(
    f"select region_id, timestamp, {', '.join(_rolling('avg', 'mean', c, n) for c in ('tmax_c', 'event_count') for n in WINDOWS)} from panel",
    "panel"))
def _(spark, sf_dir):
    return rounded(_over_panel(spark, sf_dir, 23, lambda w: features.rolling_features(
        ["tmax_c", "event_count"], WINDOWS, ["mean"], w)), 6)


@query("w03_rolling_max", sql(
    f"""select region_id, timestamp, {', '.join(
        f'max({c}) {W} rows between {n - 1} preceding and current row) as {c}_rollmax_{n}'
        for c in ('tmax_c', 'event_count') for n in WINDOWS)} from panel""", "panel"))
def _(spark, sf_dir):
    return _over_panel(spark, sf_dir, 23, lambda w: features.rolling_features(
        ["tmax_c", "event_count"], WINDOWS, ["max"], w))


@query("w04_rolling_std", sql(
    f"select region_id, timestamp, {', '.join(_rolling('stddev_pop', 'std', c, n, 4) for c in ('tmax_c', 'event_count') for n in WINDOWS)} from panel",
    "panel"))
def _(spark, sf_dir):
    return rounded(_over_panel(spark, sf_dir, 23, lambda w: features.rolling_features(
        ["tmax_c", "event_count"], WINDOWS, ["std"], w)))


@query("w05_target_diff_and_pct_change", sql(
    f"select region_id, timestamp, {_DIFF}, {_PCT} from panel", "panel"))
def _(spark, sf_dir):
    return rounded(
        _over_panel(spark, sf_dir, 1, lambda w: features.change_features("failures", w)), 6
    )


_FILLED = ("failures", "tmax_c", "prcp_mm")


def _fill(column: str, both: bool) -> str:
    back = (f"last_value({column} ignore nulls) {W} rows between unbounded preceding and current row)")
    ahead = f"first_value({column} ignore nulls) {W} rows between current row and unbounded following)"
    return f"coalesce({back}, {ahead}) as {column}" if both else f"{back} as {column}"


@query("w06_forward_fill", sql(
    f"select region_id, timestamp, {', '.join(_fill(c, False) for c in _FILLED)} from sales_grid",
    "sales_grid"))
def _(spark, sf_dir):
    grid = st.sales_grid(spark, sf_dir).select("region_id", "timestamp", *_FILLED)
    return fill_gaps(grid, list(_FILLED), replace(st.SERIES, chunk_rows=64))


@query("w07_forward_then_backward_fill", sql(
    f"select region_id, timestamp, {', '.join(_fill(c, True) for c in _FILLED)} from sales_grid",
    "sales_grid"))
def _(spark, sf_dir):
    grid = st.sales_grid(spark, sf_dir).select("region_id", "timestamp", *_FILLED)
    return fill_gaps(
        grid, list(_FILLED), replace(st.SERIES, chunk_rows=64), backward=True,
        observed=st.sales(spark, sf_dir),
    )


_HOURS = """select event_type, date_trunc('hour', ts) as hour,
    cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
    from events group by 1, 2"""


@query("w08_align_time_series", f"""with h as ({_HOURS}), g as (select event_type,
        unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from h group by event_type)
    select g.event_type, g.hour, coalesce(last_value(cents ignore nulls) over (partition by g.event_type
        order by g.hour rows between unbounded preceding and current row), 0) as cents
    from g left join h on g.event_type = h.event_type and g.hour = h.hour""")
def _(spark, sf_dir):
    return align_time_series(hourly_sums(spark, sf_dir), HOURLY)


# Clicks are summed up by eight hours, so that their step is another one than that of the rest.
_UNEVEN = """select event_type, case when event_type = 'click' then time_bucket(interval 8 hour, ts) else
    date_trunc('hour', ts) end as hour, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
    from events group by 1, 2"""


@query("w08_align_inferred_step", f"""with even as ({_UNEVEN}),
    steps as (select event_type, min(hour) as a, max(hour) as b, case when count(*) >= 3
        and min(gap) = max(gap) then min(gap) else 1 end as step from (select *,
        date_diff('hour', lag(hour) over (partition by event_type order by hour), hour) as gap
        from even) group by event_type),
    g as (select event_type, unnest(generate_series(a, b, to_hours(cast(step as integer)))) as hour
        from steps)
    select g.event_type, g.hour, coalesce(last_value(cents ignore nulls) over (partition by g.event_type
        order by g.hour rows between unbounded preceding and current row), 0) as cents
    from g left join even h on g.event_type = h.event_type and g.hour = h.hour""")
def _(spark, sf_dir):
    hour = F.expr("""case when event_type = 'click' then timestampadd(HOUR, -(hour(ts) % 8), date_trunc('hour', ts))
        else date_trunc('hour', ts) end""").cast("timestamp_ntz")
    sums = st.table(spark, sf_dir, "events").groupBy("event_type", hour.alias("hour")).agg(
        F.expr("sum(cast(round(value * 100) as bigint))").alias("cents"))
    return align_time_series(sums, HOURLY.irregular())


@query("w09_chronological_split", sql(
    "select region_id, timestamp, split from split_panel", "split_panel"))
def _(spark, sf_dir):
    panel = st.panel(spark, sf_dir).select("region_id", "timestamp")
    return split.chronological_split(panel, st.SERIES)


LENGTH, STRIDE = 10, 3
_FRAME = f"{W} rows between {LENGTH - 1} preceding and current row)"


def _windows_sql(stride: int) -> str:
    return sql(
        f"""select split, region_id, timestamp, latitude, longitude, cast(failures as double) as target,
            {r('oldest', 'oldest', 3)}, {r('newest', 'newest', 3)}, {r('total', 'total', 2)}
        from (select *, row_number() {W}) - 1 as rn, count(*) {_FRAME} as n,
            min(split) {_FRAME} as s1, max(split) {_FRAME} as s2,
            lag(z1, {LENGTH - 1}) {W}) as oldest, z2 as newest,
            sum(z1 + z2) {_FRAME} as total
        from (select p.*, (tmax_c - m1) / d1 as z1, (event_count - m2) / d2 as z2 from split_panel p,
            (select avg(tmax_c) as m1, stddev_pop(tmax_c) as d1, avg(event_count) as m2,
                stddev_pop(event_count) as d2 from split_panel where split = 'train')))
        where n = {LENGTH} and s1 = s2 and (rn - {LENGTH - 1}) % {stride} = 0""", "split_panel")


def _windows(spark, sf_dir, stride):
    columns = ["tmax_c", "event_count"]
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    scaled = split.with_scaled_features(labelled, columns, split.fit_scaler(labelled, columns))
    made = sequences.sliding_windows(scaled, st.SERIES, "failures", LENGTH, stride)
    entries = F.transform(F.flatten("features"), lambda x: x.cast("double"))
    return made.select(
        "split", "region_id", "timestamp", "latitude", "longitude",
        F.col("target").cast("double").alias("target"),
        F.round(F.col("features")[0][0].cast("double"), 3).alias("oldest"),
        F.round(F.col("features")[LENGTH - 1][1].cast("double"), 3).alias("newest"),
        F.round(F.aggregate(entries, F.lit(0.0), lambda a, x: a + x), 2).alias("total"),
    )


@query("w10_sliding_windows", _windows_sql(1))
def _(spark, sf_dir):
    return _windows(spark, sf_dir, 1)


@query("w10_sliding_windows_stride", _windows_sql(STRIDE))
def _(spark, sf_dir):
    return _windows(spark, sf_dir, STRIDE)


# -- models: with one yes-or-no feature, every model has a closed form ----------------------------

# A tree of depth 1 predicts the training mean (or class share) of either value; so does the
# first boosting round, and a window of one row is that row.
STUMP = {
    "sequence": {"length": 1, "features": ["busy"]},
    "features": {"include": ["busy"], "lags": [1], "rolling_windows": [2],
                 "rolling_statistics": ["mean"], "base_weather_cols": ["busy"]},
    "training": {
        "temporal": {"kind": "trees", "iterations": 1, "patience": 1, "max_depth": 1,
                     "learning_rate": 1.0, "reg_lambda": 0.0},
        "tabular": {"rf": {"n_estimators": 1, "max_depth": 1, "bootstrap": False},
                    "gbt": {"n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0,
                            "learning_rate": 1.0, "reg_lambda": 0.0}},
    },
}
st.CTE["stump"] = (
    """select region_id, timestamp, split, latitude, longitude, failures as target,
        avg(failures) filter (split = 'train') over (partition by event_count > 0) as pred
    from split_panel""",
    ("split_panel",),
)
st.CTE["class_stump"] = (
    """select region_id, timestamp, split, y, avg(y) filter (split = 'train') over (partition by event_count > 0) as p
    from (select *, cast(failures >= (select quantile_cont(failures, 0.8) from split_panel
        where split = 'train') as integer) as y from split_panel)""",
    ("split_panel",),
)


def _busy_panel(spark, sf_dir):
    return st.panel(spark, sf_dir).withColumn("busy", F.expr("cast(event_count > 0 as double)"))


def _inputs(spark, sf_dir, **target):
    config = cfg.deep_merge(STUMP, {"target": target})
    return build_model_inputs(_busy_panel(spark, sf_dir), config, align=False, store=True)


def _tree_scores(spark, sf_dir, name, fit, target_type="regression"):
    inputs = _inputs(spark, sf_dir, type=target_type)
    rows = ensemble.tabular_vectors(inputs.tabular, inputs.feature_columns).select(
        "region_id", "timestamp", "split", ensemble.VECTOR,
        F.col(inputs.target_column).alias("target"),
    )
    model = fit(rows.where("split = 'train'"), target_type)
    scored = ensemble.with_prediction(rows, model, name, target_type)
    return rounded(scored.select("region_id", "timestamp", "split", "target", name))


@query("m01_random_forest", sql(
    f"select region_id, timestamp, split, target, {r('pred', 'rf_pred')} from stump", "stump"))
def _(spark, sf_dir):
    params = STUMP["training"]["tabular"]["rf"]
    return _tree_scores(
        spark, sf_dir, "rf_pred", lambda train, kind: ensemble.fit_forest(train, kind, params)
    )


@query("m02_boosted_trees", sql(
    f"select region_id, timestamp, split, target, {r('pred', 'xgb_pred')} from stump", "stump"))
def _(spark, sf_dir):
    params = STUMP["training"]["tabular"]["gbt"]
    return _tree_scores(
        spark, sf_dir, "xgb_pred", lambda train, kind: ensemble.fit_boosted(train, kind, params)
    )


@query("m03_temporal_model", sql(
    f"select split, region_id, timestamp, {r('pred', 'lstm_pred')} from stump", "stump"))
def _(spark, sf_dir):
    windows = _inputs(spark, sf_dir).windows
    model, _ = ensemble.fit_temporal(windows, "regression", STUMP["training"]["temporal"])
    return rounded(ensemble.score_windows(windows, model, "regression"))


@query("m03_temporal_linear_model", sql(
    f"select split, region_id, timestamp, {r('pred', 'lstm_pred')} from stump", "stump"))
def _(spark, sf_dir):
    """A line through two points: both means again."""
    windows = _inputs(spark, sf_dir).windows
    model = ensemble.fit_temporal_linear(windows, "regression", 0.0)
    return rounded(ensemble.score_windows(windows, model, "regression"))


@query("m04_training_history", sql(
    f"""select 1 as epoch, {r("avg((target - pred) ** 2) filter (split = 'train')", 'train_loss', 3)},
        {r("avg((target - pred) ** 2) filter (split = 'val')", 'val_loss', 3)} from stump""", "stump"))
def _(spark, sf_dir):
    windows = _inputs(spark, sf_dir).windows
    _, history = ensemble.fit_temporal(windows, "regression", STUMP["training"]["temporal"])
    return rounded(ensemble.history_table(spark, history), 3)


@query("m05_blend_tabular", sql(
    f"""select region_id, timestamp, {r('0.3 * rf_pred + 0.7 * xgb_pred', 'tabular_ensemble')}
    from preds""", "preds"))
def _(spark, sf_dir):
    rows = st.predictions(spark, sf_dir).drop("tabular_ensemble")
    return rounded(ensemble.blend_tabular(rows, 0.3).select(
        "region_id", "timestamp", "tabular_ensemble"
    ))


@query("m06_blend_hybrid", sql(
    f"""select region_id, timestamp, {r('0.6 * tabular_ensemble + 0.4 * lstm_pred', 'hybrid')},
        {r('tabular_ensemble', 'clipped')} from preds""", "preds"))
def _(spark, sf_dir):
    tabular, temporal = F.col("tabular_ensemble"), F.col("lstm_pred")
    blended = ensemble.blend_hybrid(tabular, temporal, 0.6)
    known = F.coalesce(temporal, F.lit(0.0))
    return rounded(st.predictions(spark, sf_dir).select(
        "region_id", "timestamp", blended.alias("hybrid"),
        ensemble.blend_hybrid(tabular, known, 1.7).alias("clipped"),
    ))


@query("m07_score_all", sql(
    f"""select region_id, timestamp, latitude, longitude, split, target, {r('pred', 'rf_pred')},
        {r('pred', 'xgb_pred')}, {r('pred', 'tabular_ensemble')}, {r('pred', 'hybrid_pred')},
        {r('pred', 'lstm_pred')}, 0.5::double as weight_tabular, 0.5::double as weight_lstm,
        {r('target - pred', 'residual')} from stump""", "stump"))
def _(spark, sf_dir):
    inputs = _inputs(spark, sf_dir)
    config = cfg.resolve(STUMP)
    train = ensemble.tabular_vectors(
        inputs.tabular.where("split = 'train'").withColumnRenamed("failures", "target"),
        inputs.feature_columns,
    )
    tabular = config["training"]["tabular"]
    forest = ensemble.fit_forest(train, "regression", tabular["rf"])
    boosted = ensemble.fit_boosted(train, "regression", tabular["gbt"])
    temporal, _ = ensemble.fit_temporal(inputs.windows, "regression", config["training"]["temporal"])
    return rounded(ensemble.score_all(
        inputs.tabular, inputs.windows, inputs.feature_columns, forest, boosted, temporal,
        config, inputs.target_column, inputs.series,
    ))


@query("m08_classification_scores", sql(
    f"select region_id, timestamp, split, y as target, {r('p', 'hybrid_pred')} from class_stump",
    "class_stump"))
def _(spark, sf_dir):
    params = STUMP["training"]["tabular"]["rf"]
    return _tree_scores(
        spark, sf_dir, "hybrid_pred",
        lambda train, kind: ensemble.fit_forest(train, kind, params), "classification",
    )


@query("m08_target_classes", sql(
    """select region_id, timestamp, cast(failures >= (select quantile_cont(failures, 0.8)
        from split_panel where split = 'train') as integer) as target_class from split_panel""",
    "split_panel"))
def _(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    threshold = split.target_threshold(labelled, "failures", 0.8)
    return split.with_target_class(labelled, "failures", threshold).select(
        "region_id", "timestamp", "target_class"
    )


# -- jobs -----------------------------------------------------------------------------------------

_FEATURES = {"lags": [1, 6], "rolling_windows": [3, 6, 12], "rolling_statistics": ["mean", "max", "std"],
             "base_weather_cols": ["event_count", "tmax_c"]}
_ENGINEERED = ", ".join(
    ["region_id", "timestamp", "failures", "event_count", "tmax_c", "prcp_mm", "latitude", "longitude"]
    + [_lag("failures", k) for k in (1, 6)]
    + [made for c in ("event_count", "tmax_c") for made in (
        *[_lag(c, k) for k in (1, 6)],
        *[cell for n in (3, 6, 12) for cell in (
            _rolling("avg", "mean", c, n, 4), _rolling("max", "max", c, n, 4),
            _rolling("stddev_pop", "std", c, n, 4))])]
    + [_DIFF, _PCT.replace(", 6)", ", 4)")]
)


@query("e01_feature_build", sql(
    f"""select kind, split, count(*) as rows from
    (select split, unnest(['tabular', 'sequence']) as kind from
        (select split, count(*) {_FRAME.replace(str(LENGTH - 1), '23')} as n,
            min(split) {_FRAME.replace(str(LENGTH - 1), '23')} as s1,
            max(split) {_FRAME.replace(str(LENGTH - 1), '23')} as s2 from split_panel)
    where n = 24 and s1 = s2) group by kind, split""", "split_panel"))
def _(spark, sf_dir):
    config = {"features": {**_FEATURES}, "sequence": {"features": ["event_count", "tmax_c"]}}
    return build_model_inputs(st.panel(spark, sf_dir), config).counts()


@query("e02_train_and_evaluate", sql(
    f"""select split, model, metric, {r('value', 'value', 3)} from
    (select split, unnest(['rf', 'xgb', 'tabular_ensemble', 'hybrid_ensemble', 'lstm']) as model, mae, rmse, r2
    from (select split, avg(abs(target - pred)) as mae, sqrt(avg((target - pred) ** 2)) as rmse,
        1 - sum((target - pred) ** 2) / (count(*) * var_pop(target)) as r2 from stump group by split))
    unpivot (value for metric in (mae, rmse, r2))""", "stump"))
def _(spark, sf_dir):
    base = scratch_path(spark, "models")
    folder = train_and_evaluate(_busy_panel(spark, sf_dir), STUMP, base, "trial", align=False)
    return rounded(read_metrics(spark, folder), 3)


def _stored_run(spark, sf_dir):
    folder = scratch_path(spark, "run")
    predictions = st.predictions(spark, sf_dir)
    tables.save_table(predictions, f"{folder}/predictions.csv")
    tables.save_metrics_json(evaluate(predictions), f"{folder}/metrics.json")
    return folder


@query("e03_risk_map", sql(
    f"""select region_id, arg_min(latitude, timestamp) as latitude,
        arg_min(longitude, timestamp) as longitude, {r('avg(hybrid_pred)', 'hybrid_pred')},
        {r('avg(hybrid_pred)', 'hybrid_class')} from preds where split = 'test' group by region_id""",
    "preds"))
def _(spark, sf_dir):
    return rounded(risk_map(spark, _stored_run(spark, sf_dir), "test"))


def _report(name, statement, **filters):
    @query(f"e04_report_{name}", statement)
    def _(spark, sf_dir):
        return rounded(report_tables(spark, _stored_run(spark, sf_dir), **filters)[name])


_report("overview", sql(
    f"""select count(*) as total_predictions, count(distinct region_id) as regions,
        min(timestamp) as first_timestamp, max(timestamp) as last_timestamp,
        {r('avg(hybrid_pred)', 'avg_prediction')}, {r('max(hybrid_pred)', 'max_prediction')}
    from preds""", "preds"))
_report("overview_curve", sql(
    f"""select timestamp, {r('avg(hybrid_pred)', 'hybrid_pred')}, {r('avg(target)', 'target')}
    from preds group by timestamp""", "preds"))
_report("map", sql(
    f"""select region_id, arg_min(latitude, timestamp) as latitude,
        arg_min(longitude, timestamp) as longitude, {r('avg(hybrid_pred)', 'hybrid_pred')}
    from preds where latitude is not null and longitude is not null and split = 'val'
    group by region_id""", "preds"), split="val")
_report("predictions", sql(
    f"""select timestamp, region_id, {r('hybrid_pred', 'hybrid_pred')}, target from preds
    where split = 'test' and region_id = 'CA' and timestamp >= timestamp '2001-01-01'
    order by timestamp, region_id limit 100""", "preds"),
    split="test", region="CA", start="2001-01-01")
_report("predictions_curve", sql(
    f"""select timestamp, {r('avg(hybrid_pred)', 'hybrid_pred')}, {r('avg(target)', 'target')}
    from preds where split = 'train' group by timestamp""", "preds"), split="train")
_report("mae", sql(
    f"""select concat(upper(left(split, 1)), substring(split, 2)) as "Split",
        case model when 'lstm' then 'Lstm' when 'hybrid_ensemble' then 'Hybrid Ensemble'
            else 'Tabular Ensemble' end as "Model", {r('avg(abs(y - p))', 'mae')}
    from (select split, model, target as y, p from (select split, target, tabular_ensemble,
        hybrid_pred as hybrid_ensemble, lstm_pred as lstm from preds)
        unpivot (p for model in (tabular_ensemble, hybrid_ensemble, lstm))) group by split, model""",
    "preds"))
_report("comparison_bounds", sql(
    f"""select {r('least(min(target), min(hybrid_pred))', 'lower')},
        {r('greatest(max(target), max(hybrid_pred))', 'upper')} from preds""", "preds"))
_report("comparison_pairs", sql(
    f"""select {r('lstm_pred', 'lstm_pred')}, {r('tabular_ensemble', 'tabular_ensemble')}
    from preds where lstm_pred is not null""", "preds"))


@query("e08_engineer_features", sql(
    f"""select * from (select {_ENGINEERED} from panel)""", "panel"))
def _(spark, sf_dir):
    return rounded(features.engineer_features(
        st.panel(spark, sf_dir), st.SERIES, "failures", _FEATURES
    ))


@query("e08_engineered_panel_with_split", sql(
    f"select p.*, split from (select {_ENGINEERED} from panel) p "
    "join (select region_id, timestamp, split from split_panel) s "
    "on p.region_id = s.region_id and p.timestamp = s.timestamp", "split_panel"))
def _(spark, sf_dir):
    return rounded(engineered_panel(st.panel(spark, sf_dir), {"features": _FEATURES}))


@query("e08_engineer_features_with_gaps", sql(
    f"""select * from (select {_ENGINEERED} from (select *, 1.0 as latitude, 2.0 as longitude from sales))""",
    "sales"))
def _(spark, sf_dir):
    """Rows are counted where days are missing, whatever the chunk size."""
    sparse = st.sales(spark, sf_dir).withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    return rounded(features.engineer_features(
        sparse, replace(st.SERIES, chunk_rows=8), "failures", _FEATURES
    ))
