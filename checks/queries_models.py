"""Models beyond one split: several rounds with a penalty, early stopping, a recurrent cell."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query, r, rounded
from checks.standins import sql
from panelgrid.operators import ensemble, sequences, split
from panelgrid.operators.boosting import BoostedTrees, tree_columns
from panelgrid.operators.recurrent import Cell, RecurrentModel, fit_recurrent
from panelgrid.session import scratch_path

def _with(extra: str, select: str) -> str:
    """The panel's CTEs, further ones, and a statement over them."""
    head = sql("select 0", "split_panel")
    assert head.lower().lstrip().startswith("with ") and head.endswith("select 0")
    return "with recursive " + head.lstrip()[len("with "): -len("select 0")].rstrip() + ", " + extra.strip() + " " + select


# -- two rounds of depth 2 on three yes-or-no features, each tree with two of them ------------------

FLAGS = ("event_count > 0", "tmax_c > 20", "prcp_mm > 2")
BOOSTED = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.5, "reg_lambda": 3.0, "subsample": 1.0,
           "colsample_bytree": 0.67}
SEED = 42
_PAIRS = [", ".join(f"f{k}" for k in tree_columns(SEED, number, 3, BOOSTED["colsample_bytree"])) for number in range(2)]


def _round(source: str, flags: str) -> str:
    """A leaf is the sum of what is left of its training rows over their number and the penalty."""
    return f"""select *, pred + 0.5 * coalesce(sum(target - pred) filter (split = 'train') over (partition by {flags})
        / (count(*) filter (split = 'train') over (partition by {flags}) + 3.0), 0) as next from {source}"""


def _flags(panel):
    vector = array_to_vector(F.array(*[F.expr(f"cast({f} as double)") for f in FLAGS]))
    return panel.select("region_id", "timestamp", "split", F.col("failures").alias("target"), vector.alias(ensemble.VECTOR))


_FLAG_ROWS = f"""select region_id, timestamp, split, failures as target, {', '.join(f'{f} as f{k}' for k, f in enumerate(FLAGS))},
    avg(failures) filter (split = 'train') over () as pred from split_panel"""


@query("m02_second_order_boosting", sql(
    f"""select region_id, timestamp, {r('next', 'xgb_pred', 3)} from ({_round(
        f"(select * exclude (pred, next), next as pred from ({_round(f'({_FLAG_ROWS})', _PAIRS[0])}))", _PAIRS[1])})""", "split_panel"))
def _(spark, sf_dir):
    """The model is stored and read back before it scores."""
    rows = _flags(split.chronological_split(st.panel(spark, sf_dir), st.SERIES))
    model = ensemble.fit_boosted(rows.where("split = 'train'"), "regression", BOOSTED, SEED)
    folder = scratch_path(spark, "boosted")
    model.save(spark, folder)
    scored = ensemble.with_prediction(rows, BoostedTrees.load(spark, folder), "xgb_pred", "regression")
    return rounded(scored.select("region_id", "timestamp", "xgb_pred"), 3)


# -- early stopping -------------------------------------------------------------------------------

# The two halves of a year differ less in validation than in training, so a part of the way from the common
# mean to the halves' means is best, and later rounds are worse.
HALF = "month(timestamp) > 6"
STOPPED = {"kind": "trees", "iterations": 12, "patience": 4, "min_delta": 0.0, "max_depth": 1, "learning_rate": 0.06,
           "reg_lambda": 0.0}
_EPOCHS = f"""rounds as (select unnest(range(1, 13)) as epoch),
    rows as (select split, failures as target, avg(failures) filter (split = 'train') over () as base,
        avg(failures) filter (split = 'train') over (partition by {HALF}) as half from split_panel),
    losses as (select epoch, avg((target - base - (1 - 0.94 ** epoch) * (half - base)) ** 2) filter (split = 'train') as train_loss,
        avg((target - base - (1 - 0.94 ** epoch) * (half - base)) ** 2) filter (split = 'val') as val_loss
        from rows, rounds group by epoch),
    best as (select arg_min(epoch, val_loss) as best from losses)"""


def _half_windows(spark, sf_dir):
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    row = F.array(F.expr(f"cast({HALF} as float)"))
    return sequences.sliding_windows(labelled.withColumn("row", row), st.SERIES, "failures", 1, 1, "row")


@query("m04_early_stopping", _with(_EPOCHS, f"""select cast(epoch as integer) as epoch, cast(best as integer) as best,
    {r('train_loss', 'train_loss', 3)}, {r('val_loss', 'val_loss', 3)} from losses, best where epoch <= least(best + 4, 12)"""))
def _(spark, sf_dir):
    """The losses of every round, and the one whose trees are kept: neither the first nor the last."""
    model, history = ensemble.fit_temporal(_half_windows(spark, sf_dir), "regression", STOPPED)
    return rounded(ensemble.history_table(spark, history).withColumn("best", F.lit(len(model.trees))), 3)


# -- a recurrent cell of two units ------------------------------------------------------------------

LENGTH, HIDDEN, RIDGE = 24, 2, 0.05
CELL = Cell.drawn(2, HIDDEN, 0.9, 1.0, SEED)
_IN, _BACK = CELL.inputs.tolist(), CELL.recurrence.tolist()


def _state(unit: int) -> str:
    return (f"tanh(z1 * ({_IN[0][unit]!r}) + z2 * ({_IN[1][unit]!r}) + h0 * ({_BACK[0][unit]!r}) + h1 * ({_BACK[1][unit]!r}))")


def _determinant(columns: tuple[str, str, str]) -> str:
    """Of three columns (a, b, c) named by their prefix."""
    x, y, z = columns
    return (f"({x}a * ({y}b * {z}c - {y}c * {z}b) - {y}a * ({x}b * {z}c - {x}c * {z}b) + {z}a * ({x}b * {y}c - {x}c * {y}b))")


_RECURRENT = f"""
    scaled as (select p.*, cast(cast((tmax_c - m1) / d1 as float) as double) as z1,
        cast(cast((event_count - m2) / d2 as float) as double) as z2, row_number() over (partition by region_id order by timestamp) as place
        from split_panel p, (select avg(tmax_c) as m1, stddev_pop(tmax_c) as d1, avg(event_count) as m2,
            stddev_pop(event_count) as d2 from split_panel where split = 'train')),
    ends as (select region_id, place, timestamp, split, cast(failures as double) as target from (select *,
        count(*) over w as n, min(split) over w as s1, max(split) over w as s2 from scaled
        window w as (partition by region_id order by timestamp rows between {LENGTH - 1} preceding and current row))
        where n = {LENGTH} and s1 = s2),
    cell as (select region_id, place, 0 as step, 0.0::double as h0, 0.0::double as h1 from ends
        union all
        select c.region_id, c.place, step + 1, {_state(0)}, {_state(1)}
        from cell c join scaled s on s.region_id = c.region_id and s.place = c.place - {LENGTH - 1} + step where step < {LENGTH}),
    states as (select e.*, h0, h1 from ends e join cell c on e.region_id = c.region_id and e.place = c.place where step = {LENGTH}),
    sums as (select avg(h0 * h0) + {RIDGE} as xa, avg(h0 * h1) as xb, avg(h0) as xc, avg(h0 * h1) as ya, avg(h1 * h1) + {RIDGE} as yb,
        avg(h1) as yc, avg(h0) as za, avg(h1) as zb, 1.0::double as zc, avg(h0 * target) as ta, avg(h1 * target) as tb, avg(target) as tc
        from states where split = 'train'),
    readout as (select {_determinant(('t', 'y', 'z'))} / {_determinant(('x', 'y', 'z'))} as w0,
        {_determinant(('x', 't', 'z'))} / {_determinant(('x', 'y', 'z'))} as w1,
        {_determinant(('x', 'y', 't'))} / {_determinant(('x', 'y', 'z'))} as w2 from sums)"""


@query("m03_recurrent_model", _with(_RECURRENT, f"""select split, region_id, timestamp,
    {r('w0 * h0 + w1 * h1 + w2', 'lstm_pred', 3)} from states, readout"""))
def _(spark, sf_dir):
    """Windows of 24 rows through the cell; the readout is the exact ridge solution, stored and read back."""
    columns = ["tmax_c", "event_count"]
    labelled = split.chronological_split(st.panel(spark, sf_dir), st.SERIES)
    scaled = split.with_scaled_features(labelled, columns, split.fit_scaler(labelled, columns))
    windows = sequences.sliding_windows(scaled, st.SERIES, "failures", LENGTH)
    model, _ = fit_recurrent(windows, "regression", {"hidden": HIDDEN, "reg_param": RIDGE, "iterations": 8}, SEED)
    folder = scratch_path(spark, "recurrent")
    model.save(spark, folder)
    return rounded(ensemble.score_windows(windows, RecurrentModel.load(spark, folder), "regression"), 3)
