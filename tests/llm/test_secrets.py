from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from panelgrid.llm import secrets as sc

NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_force(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_query(documents, result):
    rows = result("op9_secrets")
    for doc, text, _ in documents:
        want, row = brute_force(text), rows[doc]
        digest = ",".join(f"{sc.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in sc.KINDS] == [sum(x[1] == j for x in want) for j in range(3)]
        assert set(filter(None, digest.split(","))) <= set(row["spans"].split(","))


def test_base_spans_on_hard_texts():
    rng = random.Random(4)
    parts = ["token", "TOKEN", "ſecret", "secret", "api_key", "apiKey", " ", "=", ":", '"', "'", "abcdef01", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJKL", "password", "é", "x", "\n", "Z9" * 9]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert [(a, k, b) for a, k, b, _, _ in sc.base_spans(text)] == brute_force(text)


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(8)
    letters = "the and over under reading parser value number table_index buffer count".split()
    def name():
        return "_".join(rng.choice(letters) for _ in range(4)) + str(rng.randrange(10))
    def key():
        return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    rows = [(k, " ".join(name()[:-1] for _ in range(30)) + f" token = {key()} " + name()) for k in range(200)]
    tests = [(1000 + k, f"call {key() if k % 2 else name() + name()} now") for k in range(100)]
    docs = spark.createDataFrame(rows + tests, "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in sc.scan_documents(docs).collect()}
    assert np.mean([got[1000 + k] == ["markov"] for k in range(1, 100, 2)]) > 0.95
    assert all(got[1000 + k] == [] for k in range(0, 100, 2))
    assert all(got[k] == ["assign"] for k in range(200))


def test_odd_rows(odd, none):
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 9, F.concat("text", F.lit(" token=ABCDEFGH12"))).otherwise(F.col("text")))
    rows = {(r["doc_id"], r["text"]): r["secrets"] for r in sc.scan_documents(docs).collect()}
    assert rows[3, None] == [] and rows[4, ""] == []
    span = next(v for (d, _), v in rows.items() if d == 9)
    text = next(t for d, t in rows if d == 9)
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in span] == [("assign", "token=ABCDEFGH12")]
    assert sc.scan_documents(none).collect() == []


def test_random_strings_without_a_digit_are_found(spark, sf_dir):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keys = ["".join(rng.choice(string.ascii_letters) for _ in range(24)) for _ in range(50)]
    words = ["parser_value_number_table", "read/value/number/table", "-" * 40, "=" * 40]
    tests = spark.createDataFrame([(-1 - k, f"call {t} now") for k, t in enumerate(keys + words)], docs.schema)
    ratios = sc.train(docs)
    got = dict(tests.select("doc_id", sc.find_secrets(F.col("text"), ratios)).collect())
    found = [[(s["kind"], s["start"], s["end"]) for s in got[-1 - k]] for k in range(len(keys + words))]
    assert sum(f == [("markov", 5, 29)] for f in found[:50]) >= 48
    assert found[50:] == [[]] * 4
    numbers = sc.find_secrets(F.col("text"), np.ones(128 * 128, np.float32))
    digits = spark.createDataFrame([("id 4465758382889437",)], "text string").select(numbers.alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in digits] == [(3, 19)]
