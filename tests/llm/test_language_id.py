from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import language_id as li


def test_query(documents, result):
    rows, right, of = result("op3_language_id"), 0, 0
    assert len(rows) == len(documents)
    for doc, text, lang in documents:
        row = rows[doc]
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not li.LETTER.search(text or ""))
        if row["held_out"] and lang:
            of += 1
            right += row["lang_pred"] == lang
    assert right / of > 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 40])
def test_codewords_differ(n):
    code = li.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert all(d >= 1 for d in apart) and set(np.unique(code)) <= {-1.0, 1.0}
    if n in (4, 9):
        assert min(apart) >= 3  # one wrong bit is corrected


def test_a_wrong_bit_is_corrected():
    rng = np.random.default_rng(0)
    counts = rng.random((4, li.BUCKETS)) ** 8
    model = li.fit(list("abcd"), li.codewords(4), counts)
    for k in range(4):
        margins = model.code[k] * 4.0
        margins[np.argmax(model.trust)] *= -1
        losses = np.logaddexp(0, -model.code * margins) @ model.trust
        assert losses.argmin() == k


def test_close_languages_are_flagged(spark):
    rows = [(k, "abab cdcd " * 5 if k % 2 else "xyxy zwzw " * 5, "one" if k % 2 else "two") for k in range(80)]
    docs = spark.createDataFrame(rows + [(900, "abab zwzw", None), (901, "abab cdcd", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["language"] for r in li.identify_languages(docs).collect()}
    assert got[901]["lang"] == "one" and not got[901]["ambiguous"] and got[901]["score"] > got[900]["score"]


def test_learns_from_training_rows_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    changed = docs.withColumn("lang", F.when(li.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    def rows(df):
        return sorted((r["doc_id"], r["language"]["lang"], round(r["language"]["score"], 9)) for r in li.identify_languages(df).collect())
    assert rows(docs) == rows(changed)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["text"]): r["language"]["lang"] for r in li.identify_languages(odd).collect()}
    assert {got[k, t] for k, t in got if not t or not li.LETTER.search(t)} == {"und"}
    assert got[9, "größe 中文 ‎ 😀 ｆｕｌｌ"] in ("en", "de")
    assert li.identify_languages(none).collect() == []
    alone = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"]["lang"] for r in li.identify_languages(alone).collect()} == {"und"}
    assert {r["language"]["lang"] for r in li.identify_languages(odd.withColumn("lang", F.lit("en"))).collect()} == {"und", "en"}
