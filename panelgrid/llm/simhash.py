"""Near duplicates by simhash, searched in BK-trees.

A fingerprint bit is set if more than half of the shingles' hashes have it. Fingerprints within
a radius are linked. In a BK-tree a node's children are keyed by their integer distance to it,
so a search at distance d from a node follows only the edges from d - radius to d + radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.components import components
from panelgrid.llm.frames import materialize

SEED = 42
#: Parts that a fingerprint is cut into; two within the radius agree on all but ``radius`` of them.
PARTS = 5
#: Fingerprints of one tree. Shards beyond that are several trees, and every pair of them meets.
TREE_NODES = 100_000
#: Pairs of a searched fingerprint and a node that are looked at together.
FRONT = 1 << 21
_MANY = 2000


def fingerprint(text: bytes | None, length: int = 3) -> int:
    """Simhash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    run = min(length, len(words))
    starts, stops = (ends - sizes)[: len(words) - run + 1].tolist(), ends[run - 1 :].tolist()
    hashed = xxhash.xxh64_digest
    votes, count = np.zeros(64, np.int64), len(starts)
    for at in range(0, count, 1 << 16):
        digests = b"".join([hashed(data[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", length: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long in ``out``."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, length) for t in texts.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, fingerprints(F.col(text).cast("binary")))


class Forest(NamedTuple):
    """BK-trees as arrays: nodes in breadth-first order, children of a node next to each other."""

    value: np.ndarray
    #: Parent times 128 plus the distance to it, ascending; below zero for roots.
    edge: np.ndarray
    parent: np.ndarray
    #: Place of each node among the given values, and where each tree starts.
    item: np.ndarray
    roots: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def build_forest(values: np.ndarray, tree: np.ndarray) -> Forest:
    """A tree for each number in ``tree`` (ascending from 0), holding its values, all different.

    Level by level: of the values that reach a node at one distance the first becomes its
    child at that edge, and the others go on below the child.
    """
    n = len(values)
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.empty(0, np.int64)
    order, edges, parents = [roots], [np.full(len(roots), -1)], [np.full(len(roots), -1)]
    placed, at = len(roots), np.arange(len(roots))[tree] if n else tree
    rest = np.ones(n, bool)
    rest[roots] = False
    rest = np.flatnonzero(rest)
    node_value = values[roots]
    base = 0
    above = at[rest]
    while len(rest):
        key = above * 128 + distance(values[rest], node_value[above - base])
        by = np.argsort(key, kind="stable")
        rest, key = rest[by], key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        order.append(rest[first])
        edges.append(key[first])
        parents.append(key[first] >> 7)
        node_value, base = values[rest[first]], placed
        below = placed + np.cumsum(first) - 1
        placed += int(first.sum())
        rest, above = rest[~first], below[~first]
    item = np.concatenate(order)
    return Forest(values[item], np.concatenate(edges), np.concatenate(parents), item, np.arange(len(roots)))


def _roots_of(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining those of ``a`` and ``b``; each is the least of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label


def _uniform(forest: Forest, label: np.ndarray) -> np.ndarray:
    """The label that all nodes at and below a node share, or -1."""
    same = label.copy()
    for lo, hi in reversed(_levels(forest)):
        parent = forest.parent[lo:hi]
        differs = same[lo:hi] != label[parent]
        same[parent[differs]] = -1
    return same


def _levels(forest: Forest) -> list[tuple[int, int]]:
    """Ranges of nodes of one depth below the roots."""
    found, lo, hi = [], 0, len(forest.roots)
    while hi < len(forest.value):
        stop = int(np.searchsorted(forest.parent, hi, "left"))
        found.append((hi, stop))
        lo, hi = hi, stop
    return found


def link_labels(forest: Forest, values: np.ndarray, start: np.ndarray, label: np.ndarray, searched: np.ndarray,
                radius: int) -> np.ndarray:
    """Joins ``label`` over all pairs of a searched value and a node within the radius.

    ``label`` has a place for each node, then others; ``searched`` are the places of ``values`` in
    it, ``start`` the root each search begins at. Searches skip what lies below a node once all
    of it has the value's own label: such links would join nothing. No pair is ever listed.
    """
    nodes = len(forest.value)
    at, wave = 0, 64
    while at < len(values):
        same = _uniform(forest, label[:nodes])
        some = np.arange(at, min(at + wave, len(values)))
        fronts = [(some, start[some])]
        hit_a, hit_b = [], []
        while fronts:
            q, node = fronts.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                fronts += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            open_ = same[node] != label[searched[q]]
            q, node = q[open_], node[open_]
            if not len(q):
                continue
            far = distance(values[q], forest.value[node])
            near = far <= radius
            hit_a.append(searched[q[near]])
            hit_b.append(node[near])
            lo = np.searchsorted(forest.edge, node * 128 + np.maximum(far - radius, 1), "left")
            hi = np.searchsorted(forest.edge, node * 128 + far + radius, "right")
            number = np.maximum(hi - lo, 0)
            q = np.repeat(q, number)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(number) - number, number)
            if len(q):
                fronts.append((q, np.repeat(lo, number) + offset))
        if hit_a:
            label = _roots_of(label, np.concatenate(hit_a), np.concatenate(hit_b))
        at += wave
        wave = min(wave * 4, 1 << 16)
    return label


def _links(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = np.flatnonzero(label != np.arange(len(label)))
    return values[other].view(np.int64), values[label[other]].view(np.int64)


def tree_links(values: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the values of each tree that lie within the radius."""
    forest = build_forest(values, tree)
    start = tree[forest.item]
    places = np.arange(len(values))
    label = link_labels(forest, forest.value, start, places.copy(), places, radius)
    return _links(forest.value, label)


def cross_links(one: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the values of one tree and those searched in it."""
    forest = build_forest(one, np.zeros(len(one), np.int64))
    places = np.arange(len(one) + len(other))
    label = link_labels(forest, other, np.zeros(len(other), np.int64), places.copy(), places[len(one) :], radius)
    return _links(np.concatenate([forest.value, other]), label)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = ([x[k] for x in found] for k in (0, 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], names=["a", "b"])


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column side by side, and the number of the list that each is in."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(column)), lengths)


def _within_shards(radius: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _MANY):
                values, tree = _arrays(batch.column(0).slice(at, _MANY))
                yield _edges([tree_links(values, tree, radius)] if len(values) else [])

    return find


def _between_trees(radius: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one, other = (_arrays(batch.column(c).slice(k, 1))[0] for c in (0, 1))
                yield _edges([cross_links(one, other, radius)])

    return find


def shard_keys(value: Column, radius: int, parts: int) -> Column:
    """Numbers of the shards a fingerprint belongs to: one for each choice of parts that agree.

    Two fingerprints within the radius differ in at most ``radius`` parts, so they share the
    shard of some choice of ``parts - radius`` parts.
    """
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    return F.array(*[
        F.struct(F.lit(k).alias("choice"), value.bitwiseAND(F.lit(signed(sum(chosen)))).alias("bits"))
        for k, chosen in enumerate(combinations(masks, parts - radius))])


def near_fingerprints(values: DataFrame, radius: int = 3, parts: int = PARTS) -> DataFrame:
    """Spanning links (a, b) of the different fingerprints in the one column of ``values``.

    Joined, they reach what all pairs within the radius reach. A shard's trees go to the tasks that search
    them: a shard of at most ``TREE_NODES`` fingerprints is one tree and one task; a larger
    one is cut into trees by a hash, and each pair of its trees is a task.
    """
    value = values.columns[0]
    filed = values.select(F.col(value).alias("value"), F.explode(shard_keys(F.col(value), radius, parts)).alias("shard"))
    counted = filed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = materialize(
        filed.join(counted, "shard").withColumn("trees", F.ceil(F.col("n") / TREE_NODES).cast("int"))
        .withColumn("tree", F.pmod(F.xxhash64("value"), F.col("trees")).cast("int"))
        .groupBy("shard", "trees", "tree").agg(F.collect_list("value").alias("nodes")), "shards")
    links = shards.select("nodes").mapInArrow(_within_shards(radius), "a long, b long")
    large = shards.where("trees > 1").select("shard", "tree", "nodes")
    pairs = large.join(
        large.select("shard", F.col("tree").alias("other_tree"), F.col("nodes").alias("searched")), "shard"
    ).where("tree < other_tree").select("nodes", "searched")
    return links.unionByName(pairs.mapInArrow(_between_trees(radius), "a long, b long"))


def simhash_duplicates(docs: DataFrame, length: int = 3, radius: int = 3, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    Words are runs other than ASCII white space, A-Z lowered; a text of fewer words than
    ``length`` is one shingle. Null and empty texts, and those of white space only, have the fingerprint zero and
    are linked like any other. ``fingerprint`` is 16 hexadecimal digits. ``component_id`` is the
    least key reachable through fingerprints that differ in at most ``radius`` bits; equal
    fingerprints are one class, so copies of any number cost one fingerprint. Rows that repeat
    a key keep a row each. Null keys are linked by their texts, but are never the
    least; a component without any key has a null id. Other columns are ignored, and no rows
    give no rows. Texts of any length are read whole.
    """
    marks = materialize(
        with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("content")), "value", "content", length)
        .select("key", "value"), "fingerprints")
    classes = materialize(marks.groupBy("value").agg(F.min("key").alias("least")), "classes")
    linked = components(near_fingerprints(classes.select("value"), radius)).withColumnsRenamed(
        {"node": "value", "component": "root"})
    rooted = classes.join(linked, "value", "left").withColumn("root", F.coalesce("root", "value"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("value", "component_id"), "named")
    return marks.join(named, "value").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")
