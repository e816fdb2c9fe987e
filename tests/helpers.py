"""Small panels and brute-force answers to compare with."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd


def random_rows(seed: int, regions: dict[str, int], missing: float = 0.0, gaps: float = 0.0):
    """(region_id, timestamp, v, n) rows; sizes per region may differ a lot."""
    rng = random.Random(seed)
    rows = []
    for region, size in regions.items():
        day = datetime(2020, 1, 1) + timedelta(days=rng.randrange(5))
        for _ in range(size):
            while gaps and rng.random() < gaps:
                day += timedelta(days=1)
            value = None if rng.random() < missing else float(rng.randrange(100))
            rows.append((region, day, value, rng.randrange(10)))
            day += timedelta(days=1)
    rng.shuffle(rows)
    return rows


SCHEMA = "region_id string, timestamp timestamp_ntz, v double, n long"


def as_pandas(rows) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["region_id", "timestamp", "v", "n"])
    return frame.sort_values(["region_id", "timestamp"]).reset_index(drop=True)


def collected(df) -> pd.DataFrame:
    frame = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    return frame.sort_values(["region_id", "timestamp"]).reset_index(drop=True)
