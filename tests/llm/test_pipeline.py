from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_near_dedup



@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each, written and read again between stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(columns) <= set(docs.columns) and (name == "sharding" or len(columns) == len(docs.columns))
        kept.append(docs.collect())
    return kept


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_quality_rejects_bad_and_keeps_good(spark, sf_dir, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in steps[1]}
    good = [d in left for d, q in labels.items() if q == 1]
    bad = [d in left for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad) and len(steps[1]) < len(steps[0])


def test_one_of_each_near_duplicate_group_stays(steps):
    want = test_near_dedup.brute_force(texts(steps[1]), 5, 80)
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(d for d, (_, _, kept) in want.items() if kept)
    assert len(steps[2]) < len(steps[1])


def test_no_benchmark_window_is_left(spark, sf_dir, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = test_decontaminate.brute_force([t for _, t in texts(steps[2])], items)
    assert sorted(texts(steps[3])) == sorted(d for d, (_, hit, _) in zip(texts(steps[2]), found) if not hit)


def test_mixture(steps):
    rows = [(r["doc_id"], test_mixing.words(r["text"]), test_mixing.path_of(r["source"], r["lang"])) for r in steps[3]]
    want = test_mixing.brute_force(rows, test_mixing.WEIGHTS, corpus_pipeline.MIX_PERCENT, 2, 11)
    assert Counter(r["doc_id"] for r in steps[4]) == Counter(d for d, _ in want)


def test_shards(steps):
    assert Counter(texts(steps[4])) == Counter(texts(steps[5]))
    slots = defaultdict(list)
    shard_of = {}
    for r in steps[5]:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_rows_of_the_stages(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[5]))


def test_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 2 * docs.count()
            assert set(docs.columns) <= set(out.columns)
