"""Substring dedup with suffix automata of reference passages.

A window of words is removed where the same words start earlier. Each window is filed under the
least of its short word-run hashes, so equal windows are filed under equal hashes; all passages
filed under one hash are a reference shard. A task that owns a shard takes its passages in
order, streams each through the suffix automaton of the earlier ones and cuts out the maximal
spans whose matching statistics reach the window length.

An automaton of all text broadcast to all documents would cost text times text; filing sends a
passage only to the one automaton that may hold its windows. A run that too many passages share
for one task is made longer to its left or right, so that its passages part; at last the run is the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import compress, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.frames import materialize
from panelgrid.llm.words import PLACES, hashes_of, mix, run_hashes

#: Words in a run whose hash may file a window.
RUN = 8
#: Passages of a shard; a mark that has more is replaced by longer ones.
HOT = 2_000
#: Words beside a run that a longer run takes in: eight words become 14, then 17, then the window.
LONGER = (6, 3)
#: Parts of a hot key.
PARTS = 1024
#: Spans that are handed on together.
SPANS_TOGETHER = 10_000


class SuffixAutomaton:
    """Recognises every run of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, state: int, via: int, symbol: int) -> int:
        """The target of a transition, cut so that it ends runs no longer than the source's."""
        target = self.next[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while via >= 0 and self.next[via].get(symbol) == target:
            self.next[via][symbol] = copy
            via = self.link[via]
        return copy

    def add(self, sequence: list[int]) -> None:
        """Adds one sequence; runs don't reach from one sequence into another."""
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, last, symbol)
                continue
            new, at = self._state(self.length[last] + 1, 0, {}), last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, at, symbol)
            last = new

    def matching_statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest known run that ends there."""
        state, length, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            out.append(length)
        return out


class Filing:
    """Windows of some documents and the places they are filed under.

    ``words`` are the word hashes of all documents, one after the other, ``first`` where each
    document begins; ``runs`` the hashes of short runs. ``starts`` are the windows that lie in
    one document and ``places`` where the first least run of each begins; both ascend.
    """

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        split = [t.split() if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.words = hashes_of([w for words in split for w in words])
        self.document = np.repeat(np.arange(len(texts)), counts)
        self.runs = run_hashes(self.words, RUN)
        each = window - RUN + 1
        n = max(0, len(self.runs) - each + 1)
        least = np.lib.stride_tricks.as_strided(self.runs, (n, each), self.runs.strides * 2).argmin(axis=1) if n else (
            np.empty(0, np.int64))
        inside = self.document[:n] == self.document[window - 1 : window - 1 + n]
        self.starts = np.flatnonzero(inside)
        self.places = (least + np.arange(n))[inside]


#: Documents and bytes of text whose words are hashed together; a longer text is alone.
TOGETHER, BYTES_TOGETHER = 128, 4 << 20


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded by the bytes of their texts, the second column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy().tolist()
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and (at - first >= TOGETHER or held + size > BYTES_TOGETHER):
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += size
    if sizes:
        yield batch.slice(first)


def _marks(window: int) -> Callable:
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                rows, texts = part.columns
                filing = Filing(texts.to_pylist(), window)
                places = np.unique(filing.places)
                owner = filing.document[places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filing.runs[places].view(np.int64)), rows.take(pa.array(owner)),
                     pa.array((places - filing.first[owner]).astype(np.int32))], names=["mark", "row", "place"])

    return mark


_FILED = [("mark", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32())]
#: Of a hot mark also where its run begins in the passage, and 64-bit hashes of the passage and its words.
_HOT = [*_FILED, ("at", pa.int32()), ("passage", pa.int64()), ("words", pa.binary())]
_HOT_KIND = "mark long, doc long, row long, start int, at int, passage long, words binary"


def _passages(window: int, of_hot: bool) -> Callable:
    """Passages filed under shared marks, with the hashes of their words.

    A passage is the run of words that the consecutive windows filed under one place cover.
    Words are 32-bit hashes, beside the 64-bit hash of the run they are filed under; those of hot marks have
    64 bits, so that hashes of longer runs can be made of them.
    Places come as twice the place, plus one for a hot mark. Equal rows that follow one another
    give their passages once.
    """
    schema = pa.schema(_HOT if of_hot else [*_FILED, ("words", pa.binary())])

    def passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            ids = batch.column(3).to_numpy()
            new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            last = ids[-1]
            for part in parts_of(batch.filter(pa.array(new))):
                docs, texts, shared, ids = part.columns
                codes, lengths = shared.flatten().to_numpy(), pa.compute.list_value_length(shared).to_numpy()
                owner = np.repeat(np.arange(len(docs)), lengths)[codes % 2 == of_hot]
                codes = codes[codes % 2 == of_hot]
                if not len(codes):
                    continue
                filing = Filing(texts.to_pylist(), window)
                places = filing.first[owner] + codes // 2
                # places of another text whose id is the same by chance are no places here
                own = (codes // 2 < np.diff(filing.first)[owner]) & np.isin(places, filing.places)
                owner, places = owner[own], places[own]
                firsts = filing.starts[np.searchsorted(filing.places, places, "left")]
                ends = filing.starts[np.searchsorted(filing.places, places, "right") - 1] + window
                rows = [filing.runs[places].view(np.int64), docs.take(pa.array(owner)), ids.take(pa.array(owner)),
                        (firsts - filing.first[owner]).astype(np.int32)]
                spans = list(zip(firsts.tolist(), ends.tolist()))
                if of_hot:
                    own = filing.words[_ranges(firsts, ends - firsts)]
                    rows += [(places - firsts).astype(np.int32), _hashes(own, ends - firsts),
                             [filing.words[a:b].tobytes() for a, b in spans]]
                else:
                    short = filing.words.astype("<u4").tobytes()
                    rows.append([short[4 * a : 4 * b] for a, b in spans])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    return passages


def _longer(window: int, run: int, more: int) -> Callable:
    """Copies as spans, other passages under runs of ``run + more`` words, two at most for each.

    A window has at least ``2 * more`` words beside its run. Those with as many as ``more`` on the
    left share the run lengthened to the left, the others the one lengthened to the right, and
    equal windows share the same one. With ``more`` 0 each window is its own run.
    """
    schema = pa.schema([*_HOT, ("end", pa.int32())])

    def refile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, start, at, words, copy = (batch.column(c) for c in ("doc", "row", "start", "at", "words", "copy"))
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // 8 if len(words) else (
                np.zeros(1, np.int32))
            all_words = np.frombuffer(words.buffers()[2], "<u8") if len(words) and words.buffers()[2] else np.empty(0, np.uint64)
            starts, counts = start.to_numpy(), np.diff(offsets)
            gone = np.flatnonzero(copy.to_numpy(zero_copy_only=False))
            none = [pa.nulls(len(gone), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(
                [none[0], doc.take(pa.array(gone)), row.take(pa.array(gone)), pa.array(starts[gone]), *none[4:7],
                 pa.array((starts + counts)[gone].astype(np.int32))], schema=schema)
            stay = np.flatnonzero(~copy.to_numpy(zero_copy_only=False))
            latest, place = (counts - window)[stay], at.to_numpy()[stay]
            # owner, first and last window of each group, and where its longer run begins
            if more:
                groups = [(stay, np.zeros_like(latest), np.minimum(latest, place - more), place - more),
                          (stay, np.maximum(0, place - more + 1), latest, place)]
            else:
                owner = np.repeat(stay, latest + 1)
                each = np.arange(len(owner)) - np.repeat(np.cumsum(latest + 1) - (latest + 1), latest + 1)
                groups = [(owner, each, each, each)]
            owner, first, final, begin = (np.concatenate([g[k] for g in groups]) for k in range(4))
            some = first <= final
            owner, first, final, begin = owner[some], first[some], final[some], begin[some]
            size = run + more if more else window
            base = offsets[owner].astype(np.int64)
            lengths = final - first + window
            own = all_words[_ranges(base + first, lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hashes(all_words[_ranges(base + begin, np.full(len(owner), size))], np.full(len(owner), size))),
                 doc.take(pa.array(owner)), row.take(pa.array(owner)), pa.array((starts[owner] + first).astype(np.int32)),
                 pa.array((begin - first).astype(np.int32)), pa.array(_hashes(own, lengths)),
                 pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.tobytes())]),
                 pa.array((starts[owner] + final + window).astype(np.int32))], schema=schema)

    return refile


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``first`` to ``first + length - 1`` of each, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _hashes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The run hash of each of the sequences that lie side by side, as signed numbers."""
    if not len(lengths):
        return np.empty(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    within = np.arange(len(words)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(words * PLACES[within], starts) + lengths.astype(np.uint64)).view(np.int64)


class Shard:
    """The passages of one mark, taken in order of document and place.

    Rows of one document tie: their windows are told apart by their starts alone.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.seen: set[bytes] = set()
        self.waiting: bytes | None = None
        self.automaton: SuffixAutomaton | None = None

    def known(self, words: bytes) -> list[tuple[int, int]]:
        """Spans of a passage covered by windows of the passages that count so far."""
        n = len(words) // 4
        if words in self.seen:
            return [(0, n)]
        if self.waiting is not None:
            self.automaton = self.automaton or SuffixAutomaton()
            self.automaton.add(np.frombuffer(self.waiting, "<u4").tolist())
            self.waiting = None
        if self.automaton is None:
            return []
        lengths = self.automaton.matching_statistics(np.frombuffer(words, "<u4").tolist())
        spans: list[tuple[int, int]] = []
        for end, length in enumerate(lengths, 1):
            if length >= self.window:
                start = end - self.window
                if spans and start <= spans[-1][1]:
                    start = spans.pop()[0]
                spans.append((start, end))
        return spans

    def count(self, words: bytes) -> None:
        """From now on the passage counts as an earlier one; what is known of it is asked before."""
        if words not in self.seen:
            self.seen.add(words)
            self.waiting = words

    def repeats(self, passages: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        """(row, start, end) of repeated spans in all passages (row, start, words) of a document."""
        passages = list(dict.fromkeys(passages))  # equal rows may give theirs more than once
        if all(row == passages[0][0] for row, _, _ in passages):
            for row, start, words in passages:
                yield from ((row, start + a, start + b) for a, b in self.known(words))
                self.count(words)
            return
        earliest: dict[bytes, int] = {}
        windows = [(row, start + k, words[4 * k : 4 * (k + self.window)])
                   for row, start, words in passages for k in range(len(words) // 4 - self.window + 1)]
        for _, at, words in windows:
            earliest[words] = min(at, earliest.get(words, at))
        yield from ((row, at, at + self.window) for row, at, words in windows if earliest[words] < at)
        for row, start, words in passages:
            yield from ((row, start + a, start + b) for a, b in self.known(words))
        for _, _, words in passages:
            self.known(words)
            self.count(words)


def _matched(window: int, bits: int = 32) -> Callable:
    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        if bits == 64:
            rows = ((*row[:-1], np.frombuffer(row[-1], "<u8").astype("<u4").tobytes()) for row in rows)
        shard, current, out = Shard(window), None, []
        for (mark, doc), group in groupby(rows, itemgetter(0, 1)):
            if mark != current:
                shard, current = Shard(window), mark
            out += [(doc, *span) for span in shard.repeats([row[2:] for row in group])]
            if len(out) >= SPANS_TOGETHER:
                yield _span_batch(out)
                out = []
        yield _span_batch(out)

    return match


def _span_batch(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*spans)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "row", "start", "end"])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        docs, texts, spans = batch.columns
        found = spans.flatten()
        owner = np.repeat(np.arange(len(docs)), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy())
        of, start, end = (column.to_numpy() for column in found.flatten())
        own = of == docs.to_numpy()[owner]
        start, end = start[own], end[own]
        last = np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=len(docs)))]).tolist()
        for k, text in enumerate(texts.to_pylist()):
            words = text.split() if text else []
            a, b = last[k], last[k + 1]
            if a < b:
                # a word is gone where more spans have begun than ended
                n = len(words)
                begun, ended = (np.bincount(np.minimum(x[a:b], n), minlength=n + 1) for x in (start, end))
                left = list(compress(words, (np.cumsum(begun - ended)[:n] == 0).tolist()))
            else:
                left = words
            counts.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc", "n_words", "n_removed", "kept"])


def _with_later(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds whether a row of the same key is earlier, by document and start.

    Rows of a key are ranked in parts first, and only one of the earliest of each part meets those
    of the others, so a hot key is never in one task, however many rows tie; then each part
    learns how its own did. One flow, in which nothing is computed twice.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS))
    within = Window.partitionBy(*key, "part")
    ordered = within.orderBy("doc", "start")
    ranked = rows.withColumn("part", part).withColumn("here", F.rank().over(ordered)).withColumn(
        "group", F.when(F.row_number().over(ordered) > 1, F.col("part")))
    among = F.rank().over(Window.partitionBy(*key, "group").orderBy("doc", "start"))
    beaten = F.max(F.col("group").isNull() & (F.col("among") > 1)).over(within)
    return ranked.withColumn("among", among).withColumn("beaten", beaten).withColumn(
        name, (F.col("here") > 1) | F.col("beaten")).drop("part", "here", "group", "among", "beaten")


def _streamed(passages: DataFrame, window: int, bits: int = 32) -> DataFrame:
    """Spans of passages (mark, doc, row, start, words), each streamed through its shard's automaton."""
    return passages.repartition("mark").sortWithinPartitions("mark", "doc", "start").mapInArrow(
        _matched(window, bits), _SPAN)


_SPAN = "doc long, row long, start int, end int"


def _hot_spans(hot: DataFrame, window: int) -> DataFrame:
    """Spans of passages whose mark very many share, by longer and longer marks.

    A passage met before goes whole, and only the earliest of equal ones goes on. Under a longer
    mark there are fewer; marks that occur once are dropped, and those of few passages are
    shards like any other. When the mark is the window itself, all but the earliest go.
    """
    found, run = [], RUN
    for more in (*LONGER, 0):
        kind = _HOT_KIND + ", end int"
        refiled = materialize(
            _with_later(hot, ["mark", "passage"], "copy").mapInArrow(_longer(window, run, more), kind), "longer")
        found.append(refiled.where("mark is null").select("doc", "row", "start", "end"))
        single = refiled.where("mark is not null")
        run += more
        if not more:
            found.append(_with_later(single, ["mark"], "again").where("again").select("doc", "row", "start", "end"))
            break
        counted = materialize(single.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "longer-marks")
        again = single.drop("end").join(counted, "mark")
        found.append(_streamed(again.where(F.col("n") <= HOT).select("mark", "doc", "row", "start", "words"), window, 64))
        hot = again.where(F.col("n") > HOT).drop("n")
    return reduce(DataFrame.unionByName, found)


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """(doc, row, start, end) of word spans whose windows start earlier, from (doc, text, row).

    ``doc`` orders documents and ``row`` is the id of a document's text, the same for equal rows.

    Marks are counted first, with one row per mark and task; only passages under marks that
    occur again go on. Passages of a hot mark don't meet in one task; they are filed anew.
    """
    marks = texts.select("row", "text").mapInArrow(_marks(window), "mark long, row long, place int")
    counted = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(counted.select("mark", (F.col("n") > HOT).alias("hot")), "marks")
    places = marks.join(again, "mark").groupBy("row").agg(
        F.collect_set(F.col("place") * 2 + F.col("hot").cast("int")).alias("places"))
    placed = texts.join(places, "row", "left").select("doc", "text", "places", "row")
    cold = placed.mapInArrow(_passages(window, False), "mark long, doc long, row long, start int, words binary")
    hot = placed.where(F.exists("places", lambda p: p % 2 == 1)).mapInArrow(_passages(window, True), _HOT_KIND)
    return _streamed(cold, window).unionByName(_hot_spans(hot, window))


def substring_dedup(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept text) for each document.

    Words are runs other than ASCII white space, unchanged. A word goes where a window of
    ``window`` words covers it whose words also start earlier, in a document of smaller key or
    earlier in the same one; windows are judged on the input. Kept words are joined by one
    space. Null and empty texts have no words; shorter texts lose none. A null key counts as
    the least. Rows that share a key, or have none, tie: a start is earlier in one of them than a
    greater one in another, equal starts are not earlier than one another, and each row loses
    only its own spans, so repeated rows have equal results. Rows are told apart by key and a
    64-bit hash of key and text. Other columns are ignored. No rows give no rows.
    """
    if window < RUN + 2 * LONGER[0]:
        raise ValueError(f"windows have at least {RUN + 2 * LONGER[0]} words")
    least = -(1 << 63)
    texts = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("doc"), F.col(text).cast("binary").alias("text")
    ).withColumn("row", F.xxhash64("doc", "text"))
    spans = repeated_spans(texts, window).groupBy("row").agg(
        F.collect_set(F.struct("doc", "start", "end")).alias("spans"))
    cut = texts.join(spans, "row", "left").select("doc", "text", "spans").mapInArrow(
        _cut, "doc long, n_words long, n_removed long, kept binary")
    return cut.select(
        F.when(F.col("doc") != least, F.col("doc")).alias(key), "n_words", "n_removed",
        F.col("kept").cast("string").alias("kept_text"))
