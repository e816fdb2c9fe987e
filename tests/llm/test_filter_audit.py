from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from panelgrid.llm import filter_audit as fa
from panelgrid.llm.queries import QUERIES

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {x for x, failed in (
        ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search(r"[#$%&*|]", text)), ("E", earlier)) if failed}


def brute_force(documents, labels):
    """Applies the filters one after the other, order by order; ``documents`` are (id, text, source)."""
    least = {}
    for doc, text, _ in documents:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({doc for doc, *marks in labels if marks[k] == 1} - {None} for k in (0, 1))
    parts = defaultdict(list)
    for doc, text, source in documents:
        parts[source or ""].append((doc, failures(text or "", doc is not None and least[text or ""] < doc)))
    out = {}
    for part, rows in parts.items():
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[1]]
                stay = [r for r in left if x not in r[1]]
                out[part, order, step] = [
                    len(stay), len(here), sum(x in f for _, f in rows) - len(here), sum(f == {x} for _, f in rows),
                    sum(d in good for d, _ in here), sum(d in toxic for d, _ in here)]
                total[x] += len(here)
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = rows_of(QUERIES["op12_filter_audit"](spark, sf_dir))
    assert got == brute_force(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})


LABELS = "doc_id long, quality int, toxic int, part string, bits string"


def test_odd_rows(spark, odd, none):
    marks = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, None, 1), (7, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "x", "y") for m in marks], LABELS)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert rows_of(fa.audit_filters(odd, labels)) == brute_force(docs, marks)
    assert fa.audit_filters(none, labels).collect() == []
    no_labels = labels.where("false")
    assert rows_of(fa.audit_filters(odd, no_labels)) == brute_force(docs, [])


def test_ties_copies_and_shared_keys(spark):
    """Copies over parts and under one key; equal keys with other texts; keys that are null."""
    docs = [(5, "a b", "x"), (3, "a b", "y"), (3, "a b", "y"), (9, "a b", None), (9, "c", ""), (None, "a b", "x"), (None, "a b", "x"),
            (2, None, "x"), (1, "", "y"), (7, "a b ", "x")]
    frame = spark.createDataFrame([(*d, "k", "h", 1) for d in docs], "doc_id long, text string, source string, key string, hash string, own int")
    assert rows_of(fa.audit_filters(frame, spark.createDataFrame([], LABELS))) == brute_force(docs, [])


def test_equal_hashes_of_different_texts_are_no_copies(spark, monkeypatch):
    docs = [(1, "a", "x"), (2, "b", "x"), (3, "a", "x")]
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows_of(fa.audit_filters(frame, spark.createDataFrame([], LABELS))) == brute_force(docs, [])


def test_own_filters_without_copies(spark):
    docs = spark.createDataFrame([(1, "aa", 3, "s"), (2, "b", None, "s"), (2, "b", 9, "s")], "doc_id long, text string, n int, source string")
    rows = rows_of(fa.audit_filters(
        docs, spark.createDataFrame([(2, 1, 0, "", "")], LABELS), {"L": F.length("text") > 1, "N": F.col("n") > 5}, copies=None))
    assert rows == {("s", "LN", 1): [2, 1, 0, 1, 0, 0, 2], ("s", "LN", 2): [1, 1, 0, 1, 1, 0, 2],
                    ("s", "NL", 1): [2, 1, 0, 1, 1, 0, 2], ("s", "NL", 2): [1, 1, 0, 1, 0, 0, 2]}
