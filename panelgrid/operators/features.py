"""Lag, rolling and change features of a panel, all in one windowed pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelgrid.config import DEFAULTS as CONFIGURED
from panelgrid.functions.numeric import fraction_change
from panelgrid.operators.clean import drop_incomplete, resolve_base_columns
from panelgrid.operators.series import (
    POSITION, Series, on_steps, with_halo, with_position, without_halo,
)

DEFAULTS = CONFIGURED["features"]

ROLLING: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "max": F.max,
    "std": F.stddev_pop,
}


def lag_features(columns: Sequence[str], lags: Sequence[int], w: WindowSpec) -> list[Column]:
    """Value ``k`` rows earlier, 0 where there is no such row."""
    return [
        F.coalesce(F.lag(c, k).over(w), F.lit(0)).alias(f"{c}_lag_{k}")
        for c in columns for k in lags
    ]


def rolling_features(
    columns: Sequence[str], windows: Sequence[int], statistics: Sequence[str], w: WindowSpec
) -> list[Column]:
    """Statistics over the last ``n`` rows, the current one included; shorter at the start."""
    return [
        ROLLING[s](c).over(w.rowsBetween(1 - n, 0)).alias(f"{c}_roll{s}_{n}")
        for c in columns for n in windows for s in ROLLING if s in statistics
    ]


def _rolled(column: str, statistic: str, size: int) -> Column:
    return F.col(f"_{statistic}_{size}_{column}")


def _merged(column: str, half: int, statistic: str) -> Column:
    """A statistic of two adjoining windows from theirs: the later one's in
    ``_{statistic}_{half}``, the earlier one's, null or of no rows at the start of a
    region, in ``_earlier_{statistic}``."""
    late = {s: _rolled(column, s, half) for s in ("count", "mean", "max", "std")}
    early = {s: F.col(f"_earlier_{s}_{column}") for s in late}
    n1, n2 = late["count"], F.coalesce(early["count"], F.lit(0))
    if statistic == "count":
        return n1 + n2
    if statistic == "max":
        return F.greatest(late["max"], early["max"])
    # Differences of means only, so equal windows merge without a rounding trace.
    apart, share = early["mean"] - late["mean"], n2 / (n1 + n2)
    if statistic == "mean":
        both = late["mean"] + apart * share
    else:
        within = (n1 * F.pow(late["std"], F.lit(2)) + n2 * F.pow(early["std"], F.lit(2))) / (n1 + n2)
        both = F.sqrt(within + apart * apart * share * (1 - share))
    return F.when(n2 == 0, late[statistic]).when(n1 == 0, early[statistic]).otherwise(both)


def with_rolling(
    chunks: DataFrame, columns: Sequence[str], windows: Sequence[int],
    statistics: Sequence[str], w: WindowSpec,
) -> DataFrame:
    """Rolling statistics as working columns, longer windows merged from shorter ones.

    A frame is summed up anew for every row, so its cost grows with its length. A
    window twice as long as another is two of those, half a window apart: one lag
    each. All steps keep the same partitioning and order.
    """
    kept = [s for s in ROLLING if s in statistics]
    if "std" in kept and "mean" not in kept:
        kept.append("mean")
    functions = {**ROLLING, "count": F.count}
    if {"mean", "std"} & set(kept):
        kept.append("count")
    sizes = sorted(set(windows))
    direct = [n for n in sizes if n % 2 or n // 2 not in sizes]
    chunks = chunks.select("*", *[
        functions[s](c).over(w.rowsBetween(1 - n, 0)).alias(f"_{s}_{n}_{c}")
        for c in columns for n in direct for s in kept
    ])
    for n in (n for n in sizes if n not in direct):
        half = n // 2
        both = chunks.select("*", *[
            F.lag(_rolled(c, s, half), half).over(w).alias(f"_earlier_{s}_{c}")
            for c in columns for s in kept
        ])
        chunks = both.select(*chunks.columns, *[
            _merged(c, half, s).alias(f"_{s}_{n}_{c}") for c in columns for s in kept
        ])
    return chunks


def change_features(target: str, w: WindowSpec) -> list[Column]:
    """Difference to the previous row and the same as a fraction of it."""
    previous = F.lag(target, 1).over(w)
    return [
        F.coalesce(F.col(target) - previous, F.lit(0)).alias(f"{target}_diff_1"),
        fraction_change(F.col(target), previous).alias(f"{target}_pct_change"),
    ]


def over_chunks(
    df: DataFrame, series: Series, reach: int, build: Callable[[WindowSpec], list[Column]],
    dense: bool = False,
) -> DataFrame:
    """``df`` plus the columns ``build`` makes from frames of at most ``reach`` rows back.

    All of them share one exchange and one sort on (region, chunk).
    """
    series = series if dense else on_steps(df, series)
    chunks = with_halo(with_position(df, series), series, reach)
    window = series.chunk_window(POSITION)
    return without_halo(chunks.select("*", *build(window)))


def engineer_features(
    panel: DataFrame,
    series: Series,
    target: str = "failures",
    features: Mapping[str, Any] | None = None,
    more: Callable[[WindowSpec], list[Column]] | None = None,
    more_reach: int = 0,
    dense: bool = False,
) -> DataFrame:
    """Panel plus, in order: target lags; per base column its lags and rolling
    statistics; target difference and relative change.

    ``more`` adds columns over frames of up to ``more_reach`` rows back. Everything
    shares one exchange and one sort on (region, chunk). ``dense`` promises that every
    region has a row on every step, as an aligned panel has; otherwise that is looked at,
    and rows of a panel with gaps are counted.
    """
    series = series if dense else on_steps(panel, series)
    features = features or {}
    lags = features.get("lags", DEFAULTS["lags"])
    windows = features.get("rolling_windows", DEFAULTS["rolling_windows"])
    statistics = features.get("rolling_statistics", DEFAULTS["rolling_statistics"])
    base = resolve_base_columns(panel, target, features.get("base_weather_cols"))

    reach = max([1, more_reach, *lags, *[n - 1 for n in windows]])
    chunks = with_halo(with_position(panel, series), series, reach)
    w = series.chunk_window(POSITION)
    rolled = with_rolling(chunks, base, windows, statistics, w)
    columns = lag_features([target], lags, w)
    for c in base:
        if c != target:  # its lags are there already
            columns += lag_features([c], lags, w)
        columns += [
            _rolled(c, s, n).alias(f"{c}_roll{s}_{n}")
            for n in windows for s in ROLLING if s in statistics
        ]
    columns += change_features(target, w) + (more(w) if more else [])
    made = without_halo(rolled.select(*chunks.columns, *columns))
    return drop_incomplete(made, series, target)
