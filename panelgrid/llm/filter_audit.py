"""What each text filter removes in every order of the filters.

Each document gets the set of filters it fails, as bits. Copies of an earlier document are found
by an existential self-join; its ids are united with those that fail on their own, and from the
counts of each bit combination the outcome of any order of filters follows without the texts.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

WORDS = r"[^\x20\x09-\x0D]+"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure of a text as such: short (A), repetitive (B), capitals (C), odd signs (D)."""
    content = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(content, F.lit(WORDS), F.lit(0))
    capitals = F.length(F.regexp_replace(content, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(content),
        "D": content.rlike(r"[#$%&*|]"),
    }


def earlier_copies(docs: DataFrame, key: str, content: str, content_hash: str) -> DataFrame:
    """Rows of ``docs`` whose ``content`` also stands in a row of smaller ``key``.

    A left-semi join on hash, exact text and smaller key. Only texts whose hash occurs under
    different keys are shuffled, and the joined side holds the least key of each text, combined
    before the shuffle, so a text of very many copies is one row there.
    """
    repeated = materialize(
        docs.groupBy(content_hash).agg(F.min(key).alias("low"), F.max(key).alias("high"))
        .where("low < high").select(content_hash), "repeated")
    candidates = materialize(docs.join(repeated, content_hash, "left_semi"), "candidates")
    firsts = materialize(
        candidates.where(F.col(key).isNotNull()).groupBy(
            F.col(content_hash).alias("first_hash"), F.col(content).alias("first_content")
        ).agg(F.min(key).alias("first_key")), "firsts")
    return candidates.join(
        firsts,
        (F.col(content_hash) == F.col("first_hash")) & (F.col(content) == F.col("first_content"))
        & (F.col("first_key") < F.col(key)), "left_semi")


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = "E",
                   key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, bits, documents, good, toxic) for each bit combination of each part.

    Bit k is set for documents that fail the k-th letter of ``filters`` and, last, of ``copies``.
    """
    letters = [*filters, *([copies] if copies else [])]
    own, group, content, hashed = (fresh(docs, n) for n in ("own_bits", "part_name", "content", "content_hash"))
    own_bits = reduce(lambda a, b: a + b, (
        F.coalesce(failed, F.lit(False)).cast("int") * (1 << k) for k, failed in enumerate(filters.values())), F.lit(0))
    texts = docs.withColumns({
        content: F.coalesce(F.col(text).cast("string"), F.lit("")),
        hashed: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))),
        group: F.coalesce(F.col(part).cast("string"), F.lit("")), own: own_bits,
    }).select(F.col(key).alias("key"), F.col(group).alias("part"), F.col(own).alias("own"),
              F.col(hashed).alias("hash"), F.col(content).alias("content"))
    identity = ["key", "hash", "part", "own"]
    failures = texts.select(*identity, F.lit(1).alias("rows"), F.lit(0).alias("copy"))
    if copies:
        # The marks of all rows are stored without their texts; the self-join reads texts again.
        failures = materialize(failures, "failures")
        copied = earlier_copies(texts, "key", "content", "hash")
        failures = failures.unionByName(copied.select(*identity, F.lit(0).alias("rows"), F.lit(1).alias("copy")))
    combined = failures.groupBy(*identity).agg(F.sum("rows").alias("rows"), F.max("copy").alias("copy")).withColumn(
        "bits", F.col("own") + F.col("copy") * (1 << (len(letters) - 1)) if copies else F.col("own"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    return combined.join(marks, "key", "left").groupBy("part", "bits").agg(
        F.sum("rows").alias("documents"),
        F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("rows") * F.coalesce("bad", F.lit(0))).alias("toxic"))


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of ``letters`` and step, from the counts of bit combinations."""
    orders = ["".join(p) for p in permutations(letters)]
    cells = counts.groupBy("part").agg(
        F.collect_list(F.struct("bits", "documents", "good", "toxic")).alias("cells"))

    def mask(chosen: Column) -> Column:
        return reduce(lambda a, b: a + b, (
            F.when(F.instr(chosen, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(letters)))

    steps = cells.withColumn("filter_order", F.explode(F.lit(orders))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn(
        "own", mask(F.expr("substring(filter_order, step, 1)"))).withColumn(
        "before", mask(F.expr("substring(filter_order, 1, step - 1)")))

    def total(condition: str, value: str = "c.documents") -> Column:
        return F.expr(
            f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + {value})")

    here = "c.bits & own <> 0 and c.bits & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("c.bits & (own | before) = 0").alias("kept"), total(here).alias("removed"),
        total("c.bits & own <> 0 and c.bits & before <> 0").alias("redundant"),
        total("c.bits = own").alias("unique_fails"), total(here, "c.good").alias("good_lost"),
        total(here, "c.toxic").alias("toxic_lost"),
        # Of all orders, the filter comes first among the n that a document fails in one n-th.
        total("c.bits & own <> 0", f"c.documents * ({len(orders)} div bit_count(c.bits))").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None,
                  copies: str | None = "E", key: str = "doc_id", text: str = "text",
                  part: str = "source") -> DataFrame:
    """How filters act in every order: one row per part, order and step, zeros included.

    ``filters`` maps one-letter names to conditions under which a document fails, the standard
    four by default; ``copies`` names the filter for texts that a smaller key also has, anywhere
    in the table. Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removed by this filter, summed over all orders).

    Null texts count as empty, a condition that is null as passed, a null part as the part "".
    A null key is neither smaller nor greater than another, so its row is nobody's copy, and it has no labels. Rows that
    repeat a key and a text are as many documents, none the copy of the other; rows that share
    a key but not the text are documents of their own, with the labels of the key. A document
    is good or toxic if any label of its key says so. Other columns are ignored, whatever their
    names. Texts are read whole. No documents give no rows.
    """
    filters = standard_filters(F.col(text)) if filters is None else filters
    letters = "".join([*filters, copies or ""])
    return audit_orders(failure_counts(docs, labels, filters, copies, key, text, part), letters)
