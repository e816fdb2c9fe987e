"""Token ids in a chunked binary format: byte or bit planes, each compressed with zstandard.

A chunk holds whole documents in key order and is read on its own. Its ids, as little-endian
unsigned 32-bit integers, are cut into blocks of ``BLOCK`` ids. A block is transposed into
planes (all lowest bytes, then all second bytes, ... or the same by bits), each plane is one
zstandard frame. Chunks are binary cells of a Parquet table, so Spark's commit protocol covers
lost executors and any store Spark writes to; the chunk index is a second table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Ids after which a chunk is closed.
CHUNK_IDS = 1 << 18
#: Words and pieces whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text after which a worker encodes the texts it has read.
TEXT_BYTES = 1 << 22
CHUNK = ("part int, chunk int, n_ids long, kind string, doc_ids array<long>, lengths array<long>, "
         "planes array<binary>")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of 32-bit ids, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of ``to_planes`` for ``n`` ids."""
    columns = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(c, bitorder="little")[:n] for c in columns], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack(columns, axis=1).reshape(-1).view("<u4")


def pack(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of all blocks, block after block."""
    coder = zstandard.ZstdCompressor(level=level)
    return [coder.compress(p) for at in range(0, len(ids), BLOCK) for p in to_planes(ids[at : at + BLOCK], kind)]


def unpack(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids of a chunk."""
    decoder, each, blocks = zstandard.ZstdDecompressor(), 4 if kind == "byte" else 32, []
    for at in range(0, n, BLOCK):
        first = at // BLOCK * each
        block = [decoder.decompress(p) for p in planes[first : first + each]]
        blocks.append(from_planes(block, min(BLOCK, n - at), kind))
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


class WordEncoder:
    """Ids of a text through a tokenizer that cuts texts at white space before it merges.

    The ids of a text are then those of the pieces between its spaces and line feeds, one after
    the other; other white space stays inside its piece, for the tokenizer to treat. Arrow cuts
    many texts at a time and numbers their distinct pieces, so that Python looks up each piece
    once, not each time it occurs; Arrow then puts the ids in their places.

    Where the tokenizer takes the steps of ``STEPS``, a new piece of ``PLAIN`` characters is cut
    on into the lower-case words that these make of it, so that pieces which differ in case and
    marks share the ids of their words. New words are encoded many at a time, joined by spaces:
    the model marks the last token of each word, so the ids can be cut again. Where the counts
    differ, and for all other pieces and tokenizers, each is encoded alone. Words and pieces are
    remembered, as many as ``REMEMBERED``, which costs time beyond, not ids.
    """

    #: The words that the word-level BPE file cuts a lower-cased piece into.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[^\W_]|(?:[^\w\s]|_)+")
    #: Pieces that ``WORDS`` cuts as the file does: ASCII and composed Latin letters, without the
    #: letters, numbers and soft hyphen among the Latin-1 signs, and without the dotted capital I.
    PLAIN = re.compile("[!-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0131-\u024f]*")
    #: What the word-level BPE file does before it merges.
    STEPS = (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
                "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    )
    TOGETHER = 200

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        made = json.loads(self.tokenizer.to_str())
        self.cuts = (made["normalizer"], made["pre_tokenizer"]) == self.STEPS and all(
            "<|" in t["content"] for t in made["added_tokens"])
        self.known: dict[str, bytes] = {}

    def _alone(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(
            pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))}

    def _together(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(ids) != ends[-1]:
            return self._alone(words)
        cuts = [0, *(4 * ends).tolist()]
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not remembered, and of their new words."""
        known, words, cut, odd = self.known, set(), {}, []
        for p in pieces:
            if not self.cuts or not self.PLAIN.fullmatch(p) or "<|" in p:
                odd.append(p)
            elif p.isalpha() and p.islower():
                words.add(p)
            else:
                cut[p] = some = self.WORDS.findall(p.lower())
                words.update([w for w in some if w not in known])
        fresh, new = self._alone(odd), list(words)
        for at in range(0, len(new), self.TOGETHER):
            fresh |= self._together(new[at : at + self.TOGETHER])
        for p, some in cut.items():
            fresh[p] = b"".join([fresh[w] if w in fresh else known[w] for w in some])
        return fresh

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        fresh = self._fresh([pieces[i] for i in new])
        for i in new:
            found[i] = fresh[pieces[i]]
        self.known.update(islice(fresh.items(), max(0, REMEMBERED - len(self.known))))
        return found

    def encode(self, texts: pa.Array | list[str | None], end: int) -> list[bytes]:
        """Ids of each text with ``end`` after it, little-endian; null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = split.flatten().dictionary_encode()
        found = [*self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([end], "<u4").tobytes()]
        starts = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(ids) // 4 for ids in found], out=starts[1:])
        each = pa.ListArray.from_arrays(starts, np.frombuffer(b"".join(found), "<u4"))
        stops = split.offsets.to_numpy()[1:]
        placed = each.take(pa.array(np.insert(pieces.indices.to_numpy(), stops, len(found) - 1)))
        cuts = [0, *(4 * placed.offsets.to_numpy()[stops + np.arange(1, len(texts) + 1)].astype(np.int64)).tolist()]
        data = placed.values.to_numpy().tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, so many at a time that their texts begin within ``TEXT_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    turns = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TEXT_BYTES)) + 1
    cuts = [0, *turns.tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _writer(path: str, end: int, kind: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, parts, held, number = None, [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([kind]), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                 pa.array([pack(ids, kind)], pa.list_(pa.binary()))],
                names=["part", "chunk", "n_ids", "kind", "doc_ids", "lengths", "planes"])

        for batch in batches:
            for some in _slices(batch):
                part = some.column(2)[0].as_py() if part is None else part
                for doc, ids in zip(some.column(0).to_pylist(), encoder(path).encode(some.column(1), end)):
                    docs.append(doc)
                    parts.append(ids)
                    held += len(ids) // 4
                    if held >= CHUNK_IDS:
                        yield chunk()
                        docs, parts, held, number = [], [], 0, number + 1
        if docs:
            yield chunk()

    return write


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end: int = 2, kind: str = "byte",
    key: str = "doc_id", text: str = "text",
) -> None:
    """Encodes every whole text and writes ``chunks`` and ``index`` below ``folder``.

    Documents are written in ascending key order (nulls first, rows of one key by text), in
    range partitions of about equal row counts; each ends with the id ``end``. A null or empty
    text is just that id. A last range key keeps rows that repeat a key splittable. The index
    has, for each chunk, its place and the number of ids before it. No rows give empty tables.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                    F.monotonically_increasing_id().alias("tie"))
        .repartitionByRange(tasks, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    ordered.mapInArrow(_writer(tokenizer, end, kind), CHUNK).write.parquet(f"{folder}/chunks")
    sizes = spark.read.parquet(f"{folder}/chunks").select("part", "chunk", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select(
        "part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    index.select("part", "chunk", "n_ids", (F.col("part_start") + F.col("inside")).alias("start")).write.parquet(
        f"{folder}/index")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["planes"], row["n_ids"], row["kind"])
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths),
                 pa.array(lengths), pa.array([ids[a:b].tobytes() for a, b in zip(ends - lengths, ends)])],
                names=["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of written files: key, first id's place, number of ids, ids as little-endian bytes."""
    chunks = spark.read.parquet(f"{folder}/chunks").join(
        spark.read.parquet(f"{folder}/index").drop("n_ids"), ["part", "chunk"])
    chunks = chunks.select("start", "n_ids", "kind", "doc_ids", "lengths", "planes")
    return chunks.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
