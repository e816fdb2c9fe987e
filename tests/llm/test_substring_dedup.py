from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from panelgrid.llm import substring_dedup as sd


def brute_force(documents, window=20):
    seen, out = {}, []
    ordered = sorted(enumerate(documents), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    for place, (doc, text) in ordered:
        words, gone = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set()
        for s in range(len(words) - window + 1):
            run = tuple(words[s : s + window])
            first = seen.setdefault(run, (doc, s))
            if first != (doc, s):
                gone |= set(range(s, s + window))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


def test_query(documents, result):
    removed = 0
    for doc, n, gone, kept in brute_force([(d, t) for d, t, _ in documents]):
        row = result("op10_substring_dedup")[doc]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        removed += gone
    assert removed > 1000


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    shared = [[f"p{k}_{rng.randrange(50)}" for _ in range(rng.randrange(8, 60))] for k in range(6)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"own{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]
            part = rng.choice(shared)
            words += part[rng.randrange(0, 5) :]
        if doc % 10 == 0:
            words += ["again"] * 45 + ["a", "b"] * 30
        rows.append((doc, " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [2_000, 5])
def test_passages_that_many_documents_share(spark, passages, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    assert rows_of(sd.substring_dedup(docs)) == brute_force(passages)


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(80):
        known = [[rng.randrange(3) for _ in range(rng.randrange(0, 15))] for _ in range(3)]
        automaton = sd.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        text = [rng.randrange(3) for _ in range(30)]
        runs = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
        want = [max((n for n in range(e + 1) if not n or tuple(text[e - n : e]) in runs)) for e in range(1, 31)]
        assert automaton.matching_statistics(text) == want


def test_odd_rows(odd, none):
    rows = rows_of(sd.substring_dedup(odd))
    assert rows == brute_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sd.substring_dedup(none).collect() == []


def strict_brute_force(documents, window=20):
    """By (key, start) alone: ties are not earlier, and each row loses its own spans."""
    places = {}
    split = [((doc is not None, doc or 0), re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in documents]
    for key, words in split:
        for s in range(len(words) - window + 1):
            places.setdefault(tuple(words[s : s + window]), []).append((key, s))
    first = {run: min(p) for run, p in places.items()}
    out = []
    for (doc, _), (key, words) in zip(documents, split):
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (key, s):
                gone |= set(range(s, s + window))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_repeated_rows_keep_their_words(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    one, two = (" ".join(f"{name}{k}" for k in range(45)) for name in ("a", "b"))
    rows = [(1, one), (1, one), (None, two), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sd.substring_dedup(docs)) == sorted([(d, 45, 0, t) for d, t in rows], key=str)
    later = spark.createDataFrame([*rows, (2, one), (2, one)], "doc_id long, text string")
    assert rows_of(sd.substring_dedup(later)) == sorted([(d, 45, 0, t) for d, t in rows] + [(2, 45, 45, "")] * 2, key=str)


@pytest.mark.parametrize("hot", [2_000, 5, 1])
def test_rows_that_share_a_key_are_cut_apart(spark, passages, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = [(None if doc % 3 == 0 else doc // 4, text) for doc, text in passages]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sd.substring_dedup(docs)) == strict_brute_force(rows)


def test_spans_of_a_batch_are_cut_together():
    kind = pa.list_(pa.struct([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    spans = [[(1, 0, 2), (1, 1, 3), (9, 3, 5)], None, [(3, 4, 9)], []]
    batch = pa.RecordBatch.from_arrays([
        pa.array([8, 1, 2, 3, 4]), pa.array([b"x", b"a b c d e", None, b"f g h i j k", b" l "]),
        pa.array([None, *[s and [dict(zip(("doc", "start", "end"), x)) for x in s] for s in spans]], kind)],
        names=["doc", "text", "spans"]).slice(1)
    made, = sd._cut([batch])
    assert made.column(2).to_pylist() == [3, 0, 2, 0]
    assert made.column(3).to_pylist() == [b"d e", b"", b"f g h i", b"l"]
