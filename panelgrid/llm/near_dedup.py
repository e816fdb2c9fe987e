"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles. Minima of 128 hash functions are grouped into
bands; the lowest bits of the minima are packed into bit planes. Sets that share a band are
candidates; counting equal low bits estimates their similarity, corrected for bits that agree
by chance. What the estimate leaves is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.components import components
from panelgrid.llm.frames import fresh, materialize, with_block_pairs
from panelgrid.llm.words import mix, shingles, word_hashes

HASHES = 128
#: Low bits kept of each minimum.
BITS = 4
#: A pair at the threshold may miss all bands with at most this chance.
MISSED = 1e-6
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Rows that meet in one task for one band value, and shingles for one family.
BUCKET_ROWS, FAMILY_SHINGLES = 20_000, 1_000_000

_RNG = np.random.default_rng(128)
_FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACES = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def rows_per_band(similarity: float) -> int:
    """The most minima per band that still catch pairs at the threshold."""
    fit = [r for r in range(1, 17) if (1 - similarity**r) ** (HASHES // r) <= MISSED]
    return max(fit, default=1)


def least_estimate(similarity: float) -> float:
    """Estimates below this are no candidates."""
    chance = 2.0**-BITS
    agree = similarity + (1 - similarity) * chance
    return similarity - SLACK * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def minima(shingle_set: np.ndarray) -> np.ndarray:
    """Least hash of the set under each of the functions."""
    least = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingle_set), 4096):
        hashed = (shingle_set[at : at + 4096, None] * _FACTORS + _TERMS) >> np.uint64(32)
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def band_values(least: np.ndarray, rows: int) -> np.ndarray:
    """One value per band, which holds the band's number."""
    bands = HASHES // rows
    used = least[: bands * rows].reshape(bands, rows)
    total = (used * _PLACES[:rows]).sum(axis=1, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64))
    return mix(total)


def low_bit_planes(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima as bit planes of 64-bit words, plane after plane."""
    planes = [np.packbits(((least >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)) for p in range(BITS)]
    return np.concatenate(planes).view(np.uint64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature with each row of ``many``."""
    differ = np.bitwise_or.reduce((many ^ one).reshape(len(many), BITS, -1), axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _set_of(text: bytes | None, length: int) -> np.ndarray:
    return shingles(word_hashes(text.lower() if text else text), length)


def _sketcher(length: int, rows: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = _set_of(text, length)
                if not len(own):
                    out.append((0, 0, 0, [], []))
                    continue
                least = minima(own)
                out.append((len(own), int(_signed(mix(own).sum(keepdims=True))[0]),
                            int(_signed(np.bitwise_xor.reduce(mix(own + np.uint64(1)), keepdims=True))[0]),
                            _signed(band_values(least, rows)), _signed(low_bit_planes(least))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), schema.types[1:])]], schema=schema)

    return sketch


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by their first ``keys`` columns."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        now = now.combine_chunks()
        change = np.zeros(max(len(now) - 1, 0), bool)
        for k in range(keys):
            column = now.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield now.slice(a, b - a)
        held = now.slice(cuts[-1])
    if held is not None and len(held) > 1:
        yield held


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component number of each of ``n`` items, each new one compared with those not yet reached."""
    group, rest = np.full(n, -1), np.arange(n)
    for first in range(n):
        if group[first] >= 0:
            continue
        group[first], queue = first, [first]
        rest = rest[group[rest] < 0]
        while queue and len(rest):
            reached = rest[near(queue.pop(), rest)]
            group[reached] = first
            queue.extend(reached.tolist())
            rest = rest[group[rest] < 0]
    return group


def _families(least: float) -> Callable:
    """Spanning links of the sets of a bucket whose estimates connect them."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for bucket in _groups(batches, 3):
            ids = bucket.column(3).to_numpy()
            planes = bucket.column(4).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            group = _spread(len(ids), lambda one, rest: estimates(planes[one], planes[rest]) >= least)
            other = group != np.arange(len(ids))
            if other.any():
                found.append((ids[other], ids[group[other]]))
            if len(found) >= 2000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return find


def similar_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number of each set: links at 100 * intersection >= percent * union, on full sets.

    Posting lists of the shingles give the intersections of one set with all others at once.
    """
    sizes = np.array([len(s) for s in sets])
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingle, kind="stable")
    owner = owner[order]
    values, first = np.unique(shingle[order], return_index=True)
    last = np.append(first[1:], len(owner))

    def near(one: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) <= 2:
            common = np.array([len(np.intersect1d(sets[one], sets[r], assume_unique=True)) for r in rest])
        else:
            at = np.searchsorted(values, sets[one])
            common = np.bincount(np.concatenate([owner[first[k] : last[k]] for k in at]), minlength=len(sets))[rest]
        return 100 * common >= percent * (sizes[one] + sizes[rest] - common)

    return _spread(len(sets), near)


def _confirmed(length: int, percent: int) -> Callable:
    """Links of each set of a family to the least id of its component there."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for family in _groups(batches, 3):
            ids = family.column(3).to_numpy()
            sets = [_set_of(t, length) for t in family.column(4).to_pylist()]
            group = similar_components(sets, percent)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids)
            root = least[group]
            other = root != ids
            if other.any():
                found.append((ids[other], root[other]))
            if len(found) >= 2000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return confirm


def near_duplicates(
    docs: DataFrame, length: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each document.

    Words are runs other than ASCII white space, A-Z lowered. A text of fewer words than
    ``length`` has its whole word sequence as its one shingle; null and empty texts have none
    and are linked with nothing. Documents link at 100 * intersection >= percent * union;
    ``component_id`` is the least key reachable, ``kept`` says it is the document's own. Rows
    that share a key are one document with all their links; a null key is linked with nothing
    and kept. Other columns are ignored. No rows give no rows.

    Equal sets become one class, so copies cost one row each. Classes that share a band value,
    and whose estimates connect them there, form families; links are confirmed inside each
    family on the full sets. Families and buckets of any size are cut into blocks, each pair of
    blocks a task that gives at most one link per row. Nothing is capped.
    """
    rows = rows_per_band(percent / 100)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sketches = materialize(texts.mapInArrow(_sketcher(length, rows), (
        "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, planes array<long>")), "sketches")

    same = ["set_a", "set_b", "n_shingles"]
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(
        F.min("doc_id").alias("class_id"))
    leaders = sketches.join(
        classes.select(F.col("class_id").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(
        ["doc_id", *same])
    banded = leaders.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = banded.join(shared, "band").withColumn("weight", F.lit(1))
    buckets = with_block_pairs(members, ["band"], "doc_id", "weight", BUCKET_ROWS).join(
        leaders.select("doc_id", "planes"), "doc_id")
    near = (
        buckets.select("band", "first_block", "second_block", "doc_id", "planes")
        .repartition("band", "first_block", "second_block")
        .sortWithinPartitions("band", "first_block", "second_block")
        .mapInArrow(_families(least_estimate(percent / 100)), "a long, b long")
    )
    families = components(near).withColumnsRenamed({"node": "doc_id", "component": "family"})
    sized = families.join(leaders.select("doc_id", "n_shingles"), "doc_id")
    dealt = with_block_pairs(sized, ["family"], "doc_id", "n_shingles", FAMILY_SHINGLES).drop("n_shingles")
    links = (
        texts.join(dealt, "doc_id").select("family", "first_block", "second_block", "doc_id", "text")
        .repartition("family", "first_block", "second_block")
        .sortWithinPartitions("family", "first_block", "second_block")
        .mapInArrow(_confirmed(length, percent), "a long, b long")
    )
    linked = components(links).withColumnsRenamed({"node": "class_id", "component": "linked"})
    found = classes.join(linked, "class_id", "left").select(*same, F.coalesce("linked", "class_id").alias("component_id"))
    own = F.coalesce("component_id", "doc_id")
    return sketches.select("doc_id", *same).join(found, same, "left").select(
        F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"),
        own.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The documents that stay, one row of each component, columns unchanged.

    Every row is searched as a document of its own, whether its key is null, repeated or no
    number; of a component the row with the least key stays, null keys last, one of equal ones.
    Rows without words are linked with nothing and stay. No rows give no rows.
    """
    row = fresh(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, length, percent, row, text).where("not kept")
    moved = materialize(found.select(F.col(row).alias("row"), F.col("component_id").alias("component")), "moved")
    members = moved.unionByName(moved.select(F.col("component").alias("row"), "component").distinct())
    keys = numbered.select(F.col(row).alias("row"), F.col(key).alias("key"))
    ranked = members.join(keys, "row").withColumn("rank", F.struct(F.col("key").isNull(), "key", "row"))
    stays = ranked.groupBy("component").agg(F.min("rank")["row"].alias("row")).select("row")
    gone = members.select("row").join(stays, "row", "left_anti")
    return without_rows(numbered, gone, row).select(*docs.columns)


def without_rows(numbered: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``numbered`` without the rows whose number is in the ``row`` of ``gone``; texts are not shuffled.

    Row numbers are dense within a partition, so those of ``gone`` are broadcast as bits, one
    64-bit word for each 64 numbers that hold one of them.
    """
    word, bits, at = fresh(numbered, "word"), fresh(numbered, "bits"), F.col(row)
    words = gone.groupBy(F.shiftright("row", 6).alias(word)).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(row & 63 as int))")).alias(bits))
    marked = numbered.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word, "left")
    bit = F.getbit(F.coalesce(bits, F.lit(0).cast("long")), at.bitwiseAND(63).cast("int"))
    return marked.where(bit == 0).drop(word, bits)
