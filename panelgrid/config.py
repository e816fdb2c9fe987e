"""Configuration: one nested dict, defaults merged deeply with what the caller gives."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from panelgrid.fixed_values import DEFAULT_STATIONS

DEFAULTS: dict[str, Any] = {
    "experiment": {"name": "run", "mode": "real"},
    "data": {
        "group_column": "region_id",
        "timestamp_column": "timestamp",
        "frequency": "1D",
        "real": {
            "start_date": "2018-01-01",
            "end_date": "2024-12-31",
            "storm_events": {"years": None},
            "ghcn": {"stations": DEFAULT_STATIONS},
        },
    },
    "split": {"val_size": 0.15, "test_size": 0.15},
    "sequence": {"length": 24, "stride": 1, "features": None},
    "features": {
        "include": None,
        "exclude": [],
        "exclude_auto": ["longitude", "latitude"],
        "lags": [1, 3, 6, 12, 24],
        "rolling_windows": [3, 6, 12, 24],
        "rolling_statistics": ["mean", "max", "std"],
        "base_weather_cols": None,
        "leak_safe": False,
    },
    "target": {
        "column": "failures",
        "type": "regression",
        "classification_threshold_percentile": 0.8,
        "probability_threshold": 0.5,
    },
    "training": {
        "random_seed": 42,
        "temporal": {
            "kind": "recurrent",
            "iterations": 25,
            "hidden": 64,
            "reg_param": 0.1,
            "patience": 5,
            "min_delta": 0.0005,
        },
        "tabular": {
            "rf": {"n_estimators": 400, "max_depth": 12, "min_samples_leaf": 2},
            "gbt": {
                "method": "second_order",
                "n_estimators": 500,
                "learning_rate": 0.05,
                "max_depth": 5,
                "subsample": 0.9,
                "colsample_bytree": 0.8,
                "reg_lambda": 1.0,
            },
            "blend_alpha": 0.5,
        },
        "ensemble": {"weight_tabular": 0.5},
    },
    "paths": {"artifacts_dir": "models"},
}

# Caps applied to a quick run.
QUICK_CAPS = {
    "temporal_iterations": 3,
    "rf_trees": 100,
    "rf_depth": 8,
    "gbt_trees": 120,
    "gbt_depth": 4,
}


def deep_merge(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Nested merge: a nested dict in ``override`` changes only the keys it names."""
    merged = {k: deepcopy(v) for k, v in base.items()}
    for key, value in (override or {}).items():
        both_dicts = isinstance(value, Mapping) and isinstance(merged.get(key), Mapping)
        # A station list replaces the default list; it never adds to it.
        if both_dicts and key != "stations":
            merged[key] = deep_merge(merged[key], value)
        else:
            merged[key] = deepcopy(value)
    return merged


def resolve(config: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return deep_merge(DEFAULTS, config)


def quick(config: Mapping[str, Any]) -> dict[str, Any]:
    """The same run with fewer trees and iterations."""
    cfg = resolve(config)
    temporal = cfg["training"]["temporal"]
    temporal["iterations"] = min(temporal["iterations"], QUICK_CAPS["temporal_iterations"])
    temporal["patience"] = 1
    rf = cfg["training"]["tabular"]["rf"]
    rf["n_estimators"] = min(rf["n_estimators"], QUICK_CAPS["rf_trees"])
    rf["max_depth"] = min(rf["max_depth"], QUICK_CAPS["rf_depth"])
    gbt = cfg["training"]["tabular"]["gbt"]
    gbt["n_estimators"] = min(gbt["n_estimators"], QUICK_CAPS["gbt_trees"])
    gbt["max_depth"] = min(gbt["max_depth"], QUICK_CAPS["gbt_depth"])
    return cfg
