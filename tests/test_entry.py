"""The driver contract, and a sample of the checked queries on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare

TABLES = "/root/testdata/sf0.001"
SAMPLE = ["a01_daily_event_agg", "a10_average_precision", "a17_residual_histogram", "e07_combine_panel",
          "e08_engineer_features", "s03_scan_daily_files", "w07_forward_then_backward_fill",
          "w09_chronological_split", "w10_sliding_windows_stride"]

needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables absent")


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
def test_flagship_query(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "split" in df.columns


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, note = compare(
        spark, name, contract.queries()[name], contract.oracle_sql()[name], TABLES
    )
    assert ok, note
