"""Benchmark decontamination by Wu-Manber search over words.

Test strings are word windows. A table of two-word blocks says how far the search may jump; a
block that ends a window leads to a bucket of windows with that suffix, and a direct comparison
confirms each occurrence.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

#: Words of lower-cased UTF-8: ASCII letters and digits and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words before lowering, as Spark's expressions write them.
JAVA_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Places of words in a window's hash.
_FACTOR = 6364136223846793005
HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_HITS = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered (other letters keep their case); null has none."""
    return WORD.findall(text.encode().lower()) if text else []


class WordSearch:
    """Windows of one length, in arrays of about 30 bytes a window; those of all lengths share their words.

    Slots are remainders of two-word blocks. A slot's shift is the least of its blocks', and its
    bucket holds the windows whose last two words fall there, by their hash.
    """

    def __init__(self, length: int, radix: int, tokens: array, starts: np.ndarray, owners: np.ndarray) -> None:
        self.length, self.radix, self.tokens = length, radix, tokens
        words = np.frombuffer(tokens, np.int32)
        self.size = 4 * len(starts) | 1
        last = length - 1
        shift = np.full(self.size, min(last, 255), np.uint8)
        # later ends have lesser shifts, so the last value set is the least
        for end in range(1, length):
            shift[self._slots(words, starts, end)] = min(last - end, 255)
        self.shift = shift.tobytes()
        hashes = np.zeros(len(starts), np.uint64)
        for k in range(length):
            hashes = hashes * np.uint64(_FACTOR) + words[starts + k].astype(np.uint64)
        slots = self._slots(words, starts, last)
        order = np.lexsort((hashes, slots))
        self.slots, self.hashes = array("i", slots[order].tobytes()), array("Q", hashes[order].tobytes())
        self.starts, self.owners = array("i", starts[order].tobytes()), array("i", owners[order].tobytes())

    def _slots(self, words: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        block = words[starts + end].astype(np.int64)
        if self.length > 1:
            block += words[starts + end - 1].astype(np.int64) * self.radix
        return (block % self.size).astype(np.int32)

    def find(self, words: list[int]):
        """(start, owners) of each occurrence, by start."""
        last, size, radix, shift = self.length - 1, self.size, self.radix, self.shift
        end, n = last, len(words)
        while end < n:
            word = words[end]
            if not word:
                end += last + 1
                continue
            slot = (words[end - 1] * radix + word if last else word) % size
            if ahead := shift[slot]:
                end += ahead
                continue
            if owners := self._confirmed(words[end - last : end + 1], slot):
                yield end - last, owners
            end += 1

    def _confirmed(self, window: list[int], slot: int) -> set[int]:
        """Owners of the windows of a bucket that are this one, word for word."""
        a = bisect_left(self.slots, slot)
        if a == len(self.slots) or self.slots[a] != slot or 0 in window:
            return set()
        value = 0
        for word in window:
            value = (value * _FACTOR + word) & (2**64 - 1)
        b = bisect_right(self.slots, slot, a)
        low = bisect_left(self.hashes, value, a, b)
        high = bisect_right(self.hashes, value, low, b)
        same, length = array("i", window), self.length
        return {self.owners[k] for k in range(low, high)
                if self.tokens[self.starts[k] : self.starts[k] + length] == same}


class Matcher:
    """All windows of a block of items. Word 0 is every word that no item has."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        tokens = array("i")
        ends = [0]
        for _, text in items:
            tokens.extend(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            ends.append(len(tokens))
        ends = np.array(ends, np.int64)
        counts = np.diff(ends)
        lengths = np.minimum(counts, window)
        self.searches = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == length)
            windows = counts[own] - length + 1
            owners = np.repeat(own, windows)
            within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = (ends[owners] + within).astype(np.int32)
            self.searches.append(WordSearch(length, len(self.ids) + 1, tokens, starts, owners.astype(np.int32)))

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, word spans covered by windows, items of these windows."""
        known = self.ids.get
        words = [known(w, 0) for w in words_of(text)]
        found, owners = [], set()
        for search in self.searches:
            for start, own in search.find(words):
                found.append((start, start + search.length))
                owners |= own
        return len(words), merged(found), {self.items[k] for k in owners} - {None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, joined where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _searched(text: Column, matcher: Matcher) -> Column:
    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        found = [matcher.hits(t) for t in texts.to_pylist()]
        return pa.array(
            [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)}
             for n, spans, items in found], _HITS)

    return search(text)


def _joined(parts: Column) -> Column:
    """The hits of all blocks of items in the same text."""

    @F.arrow_udf(HITS)
    def join(lists: pa.Array) -> pa.Array:
        rows = []
        for found in lists.to_pylist():
            spans = merged([(s["start"], s["end"]) for part in found for s in part["spans"]])
            rows.append({"n_words": found[0]["n_words"], "spans": [{"start": s, "end": e} for s, e in spans],
                         "items": sorted({i for part in found for i in part["items"]})})
        return pa.array(rows, _HITS)

    return join(parts)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id",
    item_text: str = "text", out: str = "contamination", block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with a struct ``out``: number of words, hit word spans, items with occurring windows.

    An item's windows are its runs of ``window`` words; an item of fewer words, but not none, is
    one window. Null texts have no words and no hits; null and empty items have no windows. A
    null item id takes part in the hits and is not listed. Repeated documents are searched each;
    repeated items count once. Columns of ``docs`` stay; one called ``out`` is replaced. Without
    items nothing is hit; without documents there are no rows. Texts of any length are searched whole.

    Items reach the tasks in blocks of about ``block_bytes`` of text, so what a task holds does
    not grow with the benchmark. One block is one pass that stores nothing. Of more, each is a
    pass over the texts that stores the hits of the texts it hits, by the texts' sha256, and the
    documents meet the hits of all blocks at the end.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(
        F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    own = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))

    def matcher(block: int) -> Matcher:
        rows = items.where(own == block).orderBy("id", "text").collect()
        return Matcher([(r["id"], r["text"]) for r in rows], window)

    if blocks == 1:
        return docs.withColumn(out, _searched(F.col(text), matcher(0)))
    texts = docs.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    parts = []
    for block in range(blocks):
        found = texts.select("digest", _searched(F.col("text"), matcher(block)).alias("found"))
        hit = found.where(F.size("found.spans") > 0).groupBy("digest").agg(F.any_value("found").alias("found"))
        parts.append(materialize(hit, "hits"))
    digest, more = fresh(docs, "digest"), fresh(docs, "more")
    hits = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.collect_list("found").alias("found")).select(
        F.col("digest").alias(digest), _joined(F.col("found")).alias(more))
    none = F.struct(F.coalesce(F.regexp_count(F.col(text), F.lit(JAVA_WORD)), F.lit(0)).cast("long").alias("n_words"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                    F.array().cast("array<string>").alias("items"))
    met = docs.withColumn(digest, F.sha2(F.col(text), 256)).join(hits, digest, "left")
    return met.withColumn(out, F.coalesce(more, none)).drop(digest, more)


def hit_words(contamination: Column) -> Column:
    """Number of words in the hit spans."""
    return F.aggregate(contamination["spans"], F.lit(0).cast("long"),
                       lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **names) -> DataFrame:
    """The documents without any hit word, columns unchanged."""
    out = fresh(docs, "contamination")
    found = find_contamination(docs, benchmark, window, out=out, **names)
    return found.where(F.size(F.col(out)["spans"]) == 0).select(*docs.columns)
