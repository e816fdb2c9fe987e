from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from panelgrid.llm import mixing


def order(seed, epoch, key):
    return hashlib.md5(f"{seed}:{epoch}:{'' if key is None else key}".encode()).hexdigest()


def split(budget, children):
    """Budget of each (name, weight, capacity): filled ones leave the rest to their siblings."""
    left, out = dict((n, (w, c)) for n, w, c in children), {}
    while left:
        weight = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c <= Fraction(budget * w, weight)]
        if not full:
            return out | {n: budget * w // weight for n, (w, _) in left.items()}
        name = min(full, key=lambda n: (Fraction(left[n][1], left[n][0]), n))
        out[name] = left.pop(name)[1]
        budget -= out[name]
    return out


def brute_force(rows, weights, percent, epochs, seed):
    """Copies of each row's epochs; rows are (key, tokens, path)."""
    leaves = defaultdict(list)
    for key, tokens, path in rows:
        leaves[path].append((key, tokens))
    leaves = {p: r for p, r in leaves.items() if sum(t for _, t in r)}
    total = {p: sum(t for _, t in r) for p, r in leaves.items()}

    def down(prefix, budget):
        depth = len(prefix)
        if depth == len(weights):
            return {prefix: budget}
        capacity = Counter()
        for p, t in total.items():
            if p[:depth] == prefix:
                capacity[p[depth]] += t * epochs
        shares = split(budget, [(n, weights[depth].get(n, 1), c) for n, c in capacity.items()])
        return {k: v for n, share in shares.items() for k, v in down((*prefix, n), share).items()}

    out = []
    for path, share in down((), sum(total.values()) * percent // 100).items():
        full, rest = divmod(share, total[path])
        for key, _ in leaves[path]:
            out += [(key, e) for e in range(1, full + 1)]
        by_place = defaultdict(list)
        for key, tokens in leaves[path]:
            by_place[order(seed, full + 1, key)].append((key, tokens))
        start = 0
        for place in sorted(by_place):
            if start < rest:
                out += [(key, full + 1) for key, _ in by_place[place]]
            start += sum(t for _, t in by_place[place])
    return sorted(out, key=str)


def path_of(source, lang):
    m = re.search(r"(\d+)$", source or "")
    number = int(m[1]) if m else None
    domain = "unknown" if number is None else ["web", "forum", "news"][number // 5] if number < 15 else "books"
    return domain, lang or "unknown", source or "unknown"


WEIGHTS = [mixing.LEVEL_WEIGHTS["domain"], mixing.LEVEL_WEIGHTS["lang"], {}]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark, sf_dir):
    from panelgrid.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r["doc_id"], words(r["text"]), path_of(r["source"], r["lang"])) for r in docs]
    got = QUERIES["op2_mixing"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == brute_force(rows, WEIGHTS, 60, 2, 11)


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = []
    sizes = {("web", "en", "src1"): 5, ("web", "de", "src2"): 400, ("books", "en", "src16"): 300, ("books", "en", "src17"): 3}
    for path, n in sizes.items():
        rows += [(len(rows) + k, "w " * (1 + k % 4), path[1], path[2]) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain = [(i, words(t), path_of(s, g)) for i, t, g, s in rows]
    for percent in (10, 60, 130, 500):
        got = mixing.mix_documents(docs, percent).collect()
        assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == brute_force(plain, WEIGHTS, percent, 2, 11)
    # within web, what the small language lacks goes to the other one, not to books
    web = sum(words(r["text"]) for r in mixing.mix_documents(docs, 40).collect() if r["source"] in ("src1", "src2"))
    assert abs(web - 0.4 * sum(t for _, t, _ in plain) * 4 / 6) < 8


def test_a_leaf_of_many_buckets_keeps_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"),
                                   F.concat(F.lit("src"), (F.col("id") % 50 == 0).cast("int")).alias("source"))
    plain = [(i, 3, path_of(f"src{int(i % 50 == 0)}", "en")) for i in range(900)]
    got = mixing.mix_documents(docs, 55).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == brute_force(plain, WEIGHTS, 55, 2, 11)


def test_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], words(r["text"]), path_of(r["source"], r["lang"])) for r in odd.collect()]
    got = mixing.mix_documents(odd.withColumns(
        {"epoch": F.lit("old"), "level_0": F.lit(1), "full": F.lit(7), "cut": F.lit("x"), "tokens": F.lit(3), "key": F.lit("k")}), 60).collect()
    assert sorted(((r["doc_id"], r["epoch"]) for r in got), key=str) == brute_force(rows, WEIGHTS, 60, 2, 11)
    assert mixing.mix_documents(none).collect() == []
