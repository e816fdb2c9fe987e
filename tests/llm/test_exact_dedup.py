from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from panelgrid.llm import exact_dedup


def brute_force(documents):
    groups = defaultdict(list)
    for doc, text, *_ in documents:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    return {(doc, hashlib.sha256(content.encode()).hexdigest()): (min(rows)[2], len(rows))
            for content, rows in groups.items() for _, _, doc in rows}


def test_query(documents, result):
    want = brute_force(documents)
    rows = result("op5_exact_dedup")
    assert len(rows) == len(documents)
    for doc, row in rows.items():
        assert want[doc, row["text_sha256"]] == (row["keep_id"], row["group_size"])
        assert row["kept"] == (row["keep_id"] == doc)


def test_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    want = brute_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert len(rows) == 12
    assert all(want[r["doc_id"], r["text_sha256"]] == (r["keep_id"], r["group_size"]) for r in rows)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_equal_hashes_of_different_bytes_stay_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    monkeypatch.setattr(F, "md5", lambda column: F.lit("same"))
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert rows == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_bytes_decide_where_all_hashes_collide(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (None, "b"), (4, None), (5, " ")], "doc_id long, text string")
    monkeypatch.setattr(F, "md5", lambda column: F.lit("same"))
    monkeypatch.setattr(F, "sha2", lambda column, bits: F.lit("same"))
    rows = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert rows == {(1, 3, 2), (3, 3, 2), (2, 2, 2), (None, 2, 2), (4, 5, 2), (5, 5, 2)}


def test_single_texts_are_not_stored(spark, monkeypatch):
    stored = []
    plain = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, label: stored.append((label, plain(df, label))) or stored[-1][1])
    docs = spark.createDataFrame([(k, f"text {k // 2 if k < 6 else k}") for k in range(20)], "doc_id long, text string")
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 17
    assert dict(stored)["candidates"].count() == 6


def test_a_full_map_only_lets_more_texts_through(spark, monkeypatch, documents):
    docs = spark.createDataFrame([(d, t) for d, t, _ in documents], "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "SLOTS", 8)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == want
