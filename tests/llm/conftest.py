from __future__ import annotations

import pytest

from panelgrid.llm.queries import QUERIES


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir) -> list[tuple]:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def result(spark, sf_dir):
    """Rows of a registered query by document."""
    known: dict[str, dict] = {}

    def of(name: str) -> dict:
        if name not in known:
            known[name] = {r["doc_id"]: r.asDict() for r in QUERIES[name](spark, sf_dir).collect()}
        return known[name]

    return of


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, band string, part long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "src1", 35, "x", "y", 9),
        (1, "Alpha beta gamma delta epsilon zeta", "en", "src1", 35, "x", "y", 9),
        (2, "alpha BETA gamma delta\tepsilon\n zeta", "en", None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (None, "text without a key but with words", "en", "src2", 10, "x", "y", 9),
        (None, None, None, None, None, None, None, None),
        (4, "", "de", "src3", 0, "x", "y", 9),
        (5, " \n\t ", "de", "src3", 4, "x", "y", 9),
        (6, long_text, "en", "src1", len(long_text), "x", "y", 9),
        (7, long_text + " end", "en", "src1", len(long_text) + 4, "x", "y", 9),
        (8, "1234 5678 !!", None, "odd", 12, "x", "y", 9),
        (9, "größe 中文 ‎ 😀 ｆｕｌｌ", "de", "src19", 20, "x", "y", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
