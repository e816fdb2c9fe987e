from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import near_dedup as nd
from panelgrid.llm.components import components
from panelgrid.llm.frames import with_block_pairs
from panelgrid.llm.words import shingles, word_hashes


def shingle_set(text, length):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))) if w else frozenset()


def brute_force(documents, length, percent):
    """Component of each document by comparing all pairs of different sets."""
    sets = {doc: shingle_set(text, length) for doc, text in documents}
    classes = defaultdict(list)
    for doc, s in sets.items():
        classes[s].append(doc)
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = [s for s in classes if s]
    for docs in (classes[s] for s in distinct):
        for doc in docs:
            a, b = sorted((find(docs[0]), find(doc)))
            parent[b] = a
    for i, s in enumerate(distinct):
        for t in distinct[:i]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                k = len(s & t)
                if 100 * k >= percent * (len(s) + len(t) - k):
                    a, b = sorted((find(classes[s][0]), find(classes[t][0])))
                    parent[b] = a
    return {doc: (len(s), find(doc), find(doc) == doc) for doc, s in sets.items()}


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query(documents, result):
    want = brute_force([(d, t) for d, t, _ in documents], 3, 85)
    got = {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in result("op7_near_dedup").items()}
    assert got == want
    assert sum(not kept for _, _, kept in want.values()) > 3


@pytest.fixture(scope="module")
def family():
    """Variants of one text around the threshold, copies of one of them, and other texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for doc in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        rows.append((doc, " ".join(words)))
    rows += [(200 + k, rows[7][1].upper()) for k in range(60)]
    rows += [(300 + k, " ".join(f"x{rng.randrange(900)}" for _ in range(80))) for k in range(30)]
    return rows


def test_links_between_variants_near_the_threshold(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string")
    want = brute_force(family, 3, 85)
    assert 20 < len({c for _, c, _ in want.values()}) < 200
    assert rows_of(nd.near_duplicates(docs, 3, 85)) == want


def test_blocks_of_a_hot_family_lose_no_link(spark, family, monkeypatch):
    monkeypatch.setattr(nd, "FAMILY_SHINGLES", 3000)
    monkeypatch.setattr(nd, "BUCKET_ROWS", 20)
    docs = spark.createDataFrame(family, "doc_id long, text string")
    assert rows_of(nd.near_duplicates(docs, 3, 85)) == brute_force(family, 3, 85)


def test_block_pairs_meet_every_pair_once_at_least(spark):
    df = spark.range(50).select("id", F.lit(1).alias("g"), F.lit(1).alias("w")).union(
        spark.range(50, 53).select("id", F.lit(2), F.lit(1)))
    rows = with_block_pairs(df, ["g"], "id", "w", 10).collect()
    tasks = defaultdict(set)
    for r in rows:
        tasks[r["g"], r["first_block"], r["second_block"]].add(r["id"])
    for g, ids in ((1, range(50)), (2, range(50, 53))):
        assert all(any({a, b} <= t for k, t in tasks.items() if k[0] == g) for a in ids for b in ids)
    assert max(len(t) for t in tasks.values()) < 40


def test_estimates_correct_for_collisions():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    for share in (0, 400, 1400):
        b = np.unique(np.concatenate([a[:share], rng.integers(0, 2**63, 2000 - share, dtype=np.uint64)]))
        true = share / (len(a) + len(b) - share)
        got = nd.estimates(nd.low_bit_planes(nd.minima(a)), nd.low_bit_planes(nd.minima(b))[None])[0]
        assert abs(got - true) < 0.16


def test_bands_miss_next_to_nothing_at_the_threshold():
    for t in (0.8, 0.85):
        r = nd.rows_per_band(t)
        assert (1 - t**r) ** (nd.HASHES // r) <= 1e-6
        assert nd.least_estimate(t) < t - 0.1


def test_shingles_of_short_texts():
    assert len(shingles(word_hashes(b"a b"), 3)) == 1 and len(shingles(word_hashes(b"a b c d"), 3)) == 2
    assert len(shingles(word_hashes(b" \n"), 3)) == 0 and len(word_hashes(None)) == 0
    assert set(shingles(word_hashes(b"a b"), 3)) != set(shingles(word_hashes(b"b a"), 3))


def test_odd_rows(odd, none):
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(odd).collect()), key=str)
    by = defaultdict(list)
    for doc, *rest in rows:
        by[doc].append(tuple(rest))
    assert by[1] == [(2, 1, True)] * 2 and by[2] == [(2, 1, False)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6][0][1:] == (6, True) and by[7][0][1:] == (6, False)
    assert sorted(by[None]) == [(0, None, True), (3, None, True)]
    assert nd.near_duplicates(none).collect() == []
    left = nd.drop_near_duplicates(odd)
    assert sorted(left.columns) == sorted(odd.columns) and left.count() == 9
    assert nd.drop_near_duplicates(none).collect() == []


def test_one_row_stays_of_repeated_and_keyless_copies(spark):
    text = "one passage of some eight words or more"
    rows = [(5, text), (5, text), (4, text.upper()), (None, text), (None, text), (5, "other words under the same key here"),
            (None, "no key and no copy of these words"), (None, None), (None, "")]
    left = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(4, text.upper()), *rows[5:]], key=str)
    keyless = nd.drop_near_duplicates(spark.createDataFrame(rows[3:5], "doc_id string, text string")).collect()
    assert [tuple(r) for r in keyless] == [(None, text)]


def test_components_of_a_long_path_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_hubs_and_small_groups(spark):
    # one node with many links beside many with one
    links = [(5000, k) for k in range(1000, 1400)] + [(k, k + 1) for k in range(2000, 2900, 2)] + [(1399, 3000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 1000 for k in (*range(1000, 1400), 3000, 5000)} | {k: k - k % 2 for k in range(2000, 2900)}
    assert got == want


def test_rows_are_dropped_without_a_shuffle_of_texts(spark):
    rows = spark.range(200, numPartitions=3).selectExpr("monotonically_increasing_id() as row", "id", "'t' as text")
    gone = rows.where("id % 7 = 0").select("row")
    left = nd.without_rows(rows, gone, "row")
    assert sorted(r["id"] for r in left.collect()) == [k for k in range(200) if k % 7]
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
