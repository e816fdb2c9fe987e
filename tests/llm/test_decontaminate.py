from __future__ import annotations

import hashlib
import pickle
import random
import re
import tracemalloc
from collections import defaultdict

from panelgrid.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute_force(documents, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows[tuple(w[s : s + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in documents:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= items_here
        out.append((len(w), hit, found - {None}))
    return out


def test_query(spark, sf_dir, documents, result):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = result("op6_decontamination")
    hits = 0
    for (doc, _, _), (n, hit, found) in zip(documents, brute_force([t for _, t, _ in documents], items)):
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        row = rows[doc]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == (
            n, len(hit), len(found), digest, bool(hit))
        hits += bool(hit)
    assert hits


def test_search_jumps_no_occurrence_over():
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice("abc") for _ in range(80))
        items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for k in range(5)]
        n, spans, found = dc.Matcher(items, 4).hits(text)
        assert (n, {p for a, b in spans for p in range(a, b)}, found) == brute_force([text], items, 4)[0]


def test_blocks_of_items_give_the_same_hits(spark, odd):
    items = [(k, f"Alpha beta gamma delta number{k}") for k in range(30)] + [
        (40, "alpha beta gamma"), (None, "delta epsilon"), (41, None), (42, "!!"), (40, "alpha beta gamma")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "text", "contamination"]
    whole = dc.find_contamination(odd, benchmark, 4).select(names)
    parts = dc.find_contamination(odd, benchmark, 4, block_bytes=300).select(names)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    one = [r["contamination"] for r in whole.collect() if r["doc_id"] == 1]
    assert len(one) == 2 and one[0]["items"] == sorted(map(str, [*range(30), 40]))
    assert [(s["start"], s["end"]) for s in one[0]["spans"]] == [(0, 5)]


def test_a_block_of_items_is_small():
    rng = random.Random(6)
    vocabulary = [f"w{k:x}" for k in range(100_000)]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=500))) for k in range(600)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    matcher = dc.Matcher(items, 10)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # a block of 16 MB stays below 400 MB while it is built, and its windows cost below 100 bytes
    assert most / size < 400 / 16
    assert len(pickle.dumps(matcher.searches)) / sum(len(s.starts) for s in matcher.searches) < 100
    n, spans, found = matcher.hits("x " + items[7][1] + " y")
    assert (n, spans, found) == (502, [(1, 501)], {"7"})


def test_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "größe 中文")], "item_id long, text string")
    left = dc.decontaminate(odd, benchmark, 10)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "1", "2", "3", "None", "None", "4", "5", "6", "7", "8"])
    assert dc.decontaminate(none, benchmark).collect() == []
    assert dc.decontaminate(odd, benchmark.limit(0)).count() == 12
