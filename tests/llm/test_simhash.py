from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from panelgrid.llm import simhash as sh
from panelgrid.llm.queries import QUERIES


def fingerprint(text, length=3):
    lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[k : k + length]) for k in range(max(1, len(words) - length + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(documents, radius=3):
    """(fingerprint, component) of each row, comparing all pairs of different fingerprints."""
    own = [fingerprint(text) for _, text in documents]
    values = sorted(set(own))
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    packed = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(packed[:i] ^ packed[i]) <= radius):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    component = {v: find(i) for i, v in enumerate(values)}
    least = {}
    for (doc, _), v in zip(documents, own):
        if doc is not None:
            c = component[v]
            least[c] = min(doc, least.get(c, doc))
    return sorted(((doc, f"{v:016x}", least.get(component[v])) for (doc, _), v in zip(documents, own)), key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_query(spark, sf_dir, documents):
    got = rows_of(QUERIES["op13_simhash"](spark, sf_dir))
    assert got == brute_force([(d, t) for d, t, _ in documents])
    assert sum(d != c for d, _, c in got) > 3


def test_odd_rows(odd, none):
    assert rows_of(sh.simhash_duplicates(odd)) == brute_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sh.simhash_duplicates(none).collect() == []


def test_only_null_keys_have_no_component(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "A B C"), (4, "x")], "doc_id long, text string")
    assert {r["component_id"] for r in sh.simhash_duplicates(docs).where("doc_id is null").collect()} == {None}


@pytest.mark.parametrize("text", [None, "", " \v\f", "One", "one two", "one two three", "A a A a A a A", "größe ＡＢ 😀\tx", "w " * 70_000])
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) == fingerprint(text)


def ball(rng, count, flips):
    """Values around a few centres, some of them in chains of single bits."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {0, 2**64 - 1}
    while len(out) < count:
        value = rng.choice(centres)
        for _ in range(rng.randrange(flips)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return np.array(sorted(out, key=lambda _: rng.random()), np.uint64)


def components_of(values, a, b):
    place = {int(v): i for i, v in enumerate(values)}
    label = sh._roots_of(np.arange(len(values)), np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    return label.tolist()


def plain_components(values, radius):
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    return sh._roots_of(np.arange(len(values)), near[:, 0], near[:, 1]).tolist()


@pytest.mark.parametrize("radius", [0, 1, 3])
@pytest.mark.parametrize("flips", [4, 9, 30])
def test_trees_find_every_link(radius, flips):
    values = ball(random.Random(flips), 700, flips)
    a, b = sh.tree_links(values, np.zeros(len(values), np.int64), radius)
    assert len(a) < len(values)
    assert components_of(values, a.view(np.uint64), b.view(np.uint64)) == plain_components(values, radius)
    one, other = values[:400], values[400:]
    links = [sh.tree_links(one, np.zeros(400, np.int64), radius), sh.tree_links(other, np.zeros(len(other), np.int64), radius),
             sh.cross_links(one, other, radius)]
    a, b = (np.concatenate([x[k] for x in links]).view(np.uint64) for k in (0, 1))
    assert components_of(values, a, b) == plain_components(values, radius)


def test_children_are_keyed_by_their_distance():
    values = ball(random.Random(1), 500, 20)
    tree = np.repeat([0, 1, 2], [200, 1, len(values) - 201])
    forest = sh.build_forest(values, tree)
    assert sorted(forest.value.tolist()) == sorted(values.tolist())
    assert (forest.value == values[forest.item]).all() and (np.diff(forest.edge[3:]) > 0).all()
    for node in range(3, len(values)):
        parent = forest.parent[node]
        assert parent < node and tree[forest.item[parent]] == tree[forest.item[node]]
        assert forest.edge[node] == parent * 128 + int(forest.value[parent] ^ forest.value[node]).bit_count()


def test_searches_follow_only_edges_within_the_radius(monkeypatch):
    rng = random.Random(3)
    values = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    looked = []
    plain = sh.distance
    forest = sh.build_forest(values, np.zeros(4000, np.int64))
    monkeypatch.setattr(sh, "distance", lambda a, b: looked.append(len(a)) or plain(a, b))
    places = np.arange(4000)
    sh.link_labels(forest, forest.value[:500], np.zeros(500, np.int64), places.copy(), places[:500], 1)
    assert sum(looked) < 0.6 * 500 * 4000


def test_shards_of_many_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sh, "TREE_NODES", 20)
    values = ball(random.Random(8), 600, 8)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "value long")
    links = sh.near_fingerprints(frame, 3).collect()
    a, b = (np.array([r[k] for r in links], np.int64).view(np.uint64) for k in (0, 1))
    assert components_of(values, a, b) == plain_components(values, 3)


def test_two_fingerprints_within_the_radius_share_a_shard(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        value = rng.getrandbits(64)
        other = value
        for bit in rng.sample(range(64), 3):
            other ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (value, other)))
    frame = spark.createDataFrame(rows, "a long, b long")
    shared = frame.select((sh.F.size(sh.F.array_intersect(
        sh.shard_keys(sh.F.col("a"), 3, sh.PARTS), sh.shard_keys(sh.F.col("b"), 3, sh.PARTS))) > 0).alias("s"))
    assert shared.where("not s").count() == 0
