from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import quality as q


def test_query_on_labels_that_were_not_trained_on(spark, result):
    rows = result("op4_quality")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    good = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert all(0 <= rows[d][c] <= 1 for d in rows for c in ("content", "metadata", "score"))


def test_labels_of_other_documents_score_well(spark):
    """Trained on half of the labels, tried on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    scored = q.score_quality(docs, labels.where(part), out="found").join(labels.where(~part), "doc_id").select(
        "found.score", "quality")
    rows = scored.collect()
    right = [(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]
    assert len(rows) > 100 and np.mean(right) > 0.97


def frame_of(spark, content, metadata, label, held):
    rows = [(c.tolist(), m.tolist(), float(y), bool(h)) for c, m, y, h in zip(content, metadata, label, held)]
    return spark.createDataFrame(rows, "content array<float>, metadata array<float>, label double, held boolean").repartition(5)


@pytest.fixture(scope="module")
def two_views():
    """The metadata view sees no labelled row of one kind."""
    rng = np.random.default_rng(1)
    n = 3000
    good, kind = rng.random(n) < 0.6, rng.random(n) < 0.5
    content = np.column_stack([np.where(good, 1.0, -1.0) + rng.normal(0, 0.3, n), np.ones(n)]).astype(np.float32)
    metadata = np.column_stack([np.where(kind, np.where(good, 1.0, -1.0), 0.0), np.where(kind, 0.0, np.where(good, 1.0, -1.0)), np.ones(n)])
    label = np.where(kind & (rng.random(n) < 0.3), good.astype(float), np.nan)
    held = (rng.random(n) < 0.25) & ~np.isnan(label)
    return content, metadata.astype(np.float32), label, held, good, kind


def test_views_teach_each_other(spark, two_views):
    """It learns that kind from the other view."""
    content, metadata, label, held, good, kind = two_views
    rows = frame_of(spark, content, metadata, label, held)
    apart, taught = q.co_train(rows, rounds=0), q.co_train(rows, rounds=3)

    def right(model):
        return np.mean(((metadata[~kind] @ model.metadata) * model.metadata_line[0] + model.metadata_line[1] > 0) == good[~kind])

    assert right(taught) > 0.95 > right(apart)


def plain_logistic(x, y, ridge=1e-3):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
    return w


def plain_co_training(content, metadata, label, held, rounds, sure=0.97):
    """The same exchange with all rows in one place."""
    views, taught = (content.astype(float), metadata.astype(float)), [np.full(len(label), np.nan)] * 2
    for number in range(rounds + 1):
        weights, lines = [], []
        for x, own in zip(views, taught):
            target = np.where(np.isnan(label), own, np.where(held, np.nan, label))
            use = ~np.isnan(target)
            weights.append(plain_logistic(x[use], target[use]))
            odds, y = x[held] @ weights[-1], label[held]
            drawn = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
            line = plain_logistic(np.column_stack([odds, np.ones(len(odds))]), drawn, 1e-6)
            lines.append((max(line[0], 0.0), line[1]))
        taught = []
        for other in (1, 0):
            p = 1 / (1 + np.exp(-np.clip(views[other] @ weights[other] * lines[other][0] + lines[other][1], -40, 40)))
            taught.append(np.where(np.isnan(label), np.where(p >= sure, 1.0, np.where(p <= 1 - sure, 0.0, np.nan)), np.nan))
    return weights, lines


@pytest.mark.parametrize("rounds", [0, 2])
def test_sums_over_tasks_give_the_plain_exchange(spark, two_views, rounds):
    content, metadata, label, held, *_ = two_views
    model = q.co_train(frame_of(spark, content, metadata, label, held), rounds=rounds)
    weights, lines = plain_co_training(content, metadata, label, held, rounds)
    assert np.allclose(model.content, weights[0], atol=2e-3) and np.allclose(model.metadata, weights[1], atol=2e-3)
    assert np.allclose([model.content_line, model.metadata_line], lines, rtol=0.05, atol=0.05)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1), (77, 0)], "doc_id long, quality int")
    rows = q.score_quality(odd, labels).collect()
    assert len(rows) == 12
    assert all((r["quality"]["score"] == 0) == (not (r["text"] or "").split()) for r in rows)
    assert q.keep_good(odd, labels).columns == odd.columns
    assert q.score_quality(odd, labels.limit(0)).where("quality.score = 1").count() == 8
    assert q.score_quality(none, labels).collect() == []


def test_model_with_both_classes_takes_odd_rows(spark, odd):
    rows = [(1000 + k, "good words here and there " * 3 if k % 2 else "BAD!! BAD!! $$$ " * 4, "en", "src1", 9, None, None, None) for k in range(200)]
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    labels = spark.createDataFrame([(1000 + k, k % 2) for k in range(150)], "doc_id long, quality int")
    scored = {(r["doc_id"], r["text"]): r["quality"]["score"] for r in q.score_quality(docs, labels).collect()}
    assert all((scored[1000 + k, rows[k][1]] > 0.5) == bool(k % 2) for k in range(200))


def test_every_document_takes_part(spark):
    docs = spark.createDataFrame([(k, "some words here", "en", "src1", 15) for k in range(100)] + [(None, "x", "en", "src1", 1), (7, None, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (500, 1), (None, 1)], "doc_id int, quality int")
    rows = q.training_rows(docs, labels).collect()
    assert len(rows) == 100 and sum(np.isnan(r["label"]) for r in rows) == 40
    assert 0 < sum(r["held"] for r in rows) < 60 and sum(r["label"] == 1 for r in rows if not np.isnan(r["label"])) == 30
