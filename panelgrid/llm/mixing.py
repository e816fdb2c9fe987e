"""Mixing sources to target weights by hierarchical budgeting.

Leaves are paths of a tree such as domain, language, source. A token budget is handed down by
weight; what a node cannot use goes to its siblings first, and to its parent's siblings only
when all of them are used up. Each leaf then takes a token prefix of its seeded epochs. Built
from DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

#: Rows of a leaf that share a bucket of the epoch order, about.
BUCKET_ROWS = 20_000
ORDER_BITS = 32


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def epoch_order(key: Column, seed: int, epoch: Column) -> Column:
    """A row's place in an epoch: a hash text of seed, epoch and key, compared as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def weight_of(level: Column, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its name; names that are not listed weigh 1."""
    out = F.lit(1)
    for name, weight in weights.items():
        if weight < 1:
            raise ValueError("weights are positive whole numbers")
        out = F.when(level == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str, budget: str = "parent_budget") -> DataFrame:
    """Adds ``share``: each node's part of its parent's budget, by weight and capped by capacity.

    Nodes are taken by capacity per weight. While a node's capacity is below its part of what is
    left, it gets its capacity; the rest is split by weight. Exact whole numbers; rounding down
    leaves less than one token per node unspent.
    """
    siblings = Window.partitionBy(*parent).orderBy(
        F.col("capacity") / F.col("weight"), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    used = F.coalesce(F.sum("capacity").over(siblings), F.lit(0))
    gone = F.coalesce(F.sum("weight").over(siblings), F.lit(0))
    decimal = "decimal(38,0)"
    out = (
        nodes.withColumn("left_weight", F.sum("weight").over(whole) - gone)
        .withColumn("left_budget", F.greatest(F.col(budget) - used, F.lit(0)))
        .withColumn("filled", F.col("capacity").cast(decimal) * F.col("left_weight")
                    <= F.col("left_budget").cast(decimal) * F.col("weight"))
    )
    # the first node that is not filled fixes the rate for itself and all after it
    ordered = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name))
    rate = F.first(F.when(~F.col("filled"), F.struct("left_budget", "left_weight")), ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("rate", rate).withColumn(
        "share",
        F.when(F.col("rate").isNull(), F.col("capacity")).otherwise(
            F.floor(F.col("rate.left_budget").cast(decimal) * F.col("weight") / F.col("rate.left_weight"))
            .cast("long")),
    ).drop("left_weight", "left_budget", "filled", "rate")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]],
                 budget: Column, most_epochs: int) -> DataFrame:
    """Adds ``share`` to leaves with ``tokens``, handing the budget down level by level.

    ``budget`` is an aggregate over the leaves. A leaf's capacity is its tokens times the
    epochs it may run; a node's is the sum of its leaves'.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * most_epochs)
    above = leaves.agg(budget.cast("long").alias("parent_budget")).withColumn("root", F.lit(0))
    parent: list[str] = ["root"]
    for depth, level in enumerate(levels, 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0))
        nodes = nodes.withColumn("weight", weight_of(F.col(level), weights.get(level, {}))).join(above, parent)
        shared = share_out(nodes, parent, level)
        above = shared.select("root", *path, F.col("share").alias("parent_budget"))
        parent = ["root", *path]
    return leaves.join(above.withColumnRenamed("parent_budget", "share").drop("root"), levels)


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]],
    budget_percent: int = 60, most_epochs: int = 2, seed: int = 11, key: str = "doc_id",
    tokens: Column | None = None, epoch: str = "epoch",
) -> DataFrame:
    """Rows of the mixture: columns of ``docs`` and ``epoch``, once for each epoch a row is in.

    ``levels`` name the tree's levels from the top and say how a row's node is computed; a null
    node is called ``unknown``. The budget is ``budget_percent`` of all tokens (words of
    ``text`` unless given). A leaf whose share is ``q`` of its ``t`` tokens takes its rows
    ``q div t`` times, and in one more epoch the prefix, in that epoch's order, of rows that
    start within the remaining tokens; the last of them may reach beyond. Rows that repeat a
    key stand together in every order. Rows without tokens come with the prefix they stand in;
    leaves without any tokens are left out, and so is everything when there are none. A column
    called ``epoch`` is replaced.

    The order is a hash, so a leaf's prefix is everything up to one hash. To find it, tokens are
    summed per bucket of hashes, and only the bucket where the budget ends is sorted. A leaf
    with a third of all rows has its share of buckets, and its rows are never moved: they meet
    one cut-off per leaf.
    """
    docs = docs.drop(epoch)
    names = [fresh(docs, f"level_{k}") for k in range(len(levels))]
    node = {n: F.coalesce(c.cast("string"), F.lit("unknown")) for n, c in zip(names, levels.values())}
    by_name = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    counted = word_count(F.col("text")) if tokens is None else tokens
    lean = materialize(docs.select(F.col(key).alias("key"), counted.alias("tokens"), *[c.alias(n) for n, c in node.items()]), "tokens")

    leaves = lean.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("leaf_rows")).where(
        "tokens > 0")
    budget = F.expr(f"sum(tokens) * {int(budget_percent)} div 100")
    shares = materialize(
        leaf_budgets(leaves, names, by_name, budget, most_epochs)
        .withColumn("full", F.floor(F.col("share") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("share") - F.col("full") * F.col("tokens"))
        .withColumn("buckets", F.ceil(F.col("leaf_rows") / BUCKET_ROWS)),
        "shares")

    partial = lean.join(shares.where("rest > 0").select(*names, "full", "rest", "buckets"), names)
    ordered = partial.withColumn("place", epoch_order(F.col("key"), seed, F.col("full") + 1)).withColumn(
        "bucket", F.floor(F.conv(F.substring("place", 1, ORDER_BITS // 4), 16, 10).cast("long") * F.col("buckets")
                          / (1 << ORDER_BITS)))
    sums = ordered.groupBy(*names, "bucket").agg(F.sum("tokens").alias("bucket_tokens"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).where(
        "before < rest and before + bucket_tokens >= rest").select(*names, "bucket", "before")
    inside = ordered.join(ends, [*names, "bucket"]).groupBy(*names, "bucket", "place", "before", "rest").agg(
        F.sum("tokens").alias("tokens"))
    running = Window.partitionBy(*names, "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cuts = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(running), F.lit(0))).where(
        "start < rest").groupBy(*names).agg(F.max("place").alias("cut"))
    # stored, so that Spark knows its size: one row per leaf is broadcast while it is small, and
    # the rows of the documents then stay where they are
    full, cut = fresh(docs, "full"), fresh(docs, "cut")
    decided = materialize(shares.join(cuts, names, "left").select(
        *names, F.col("full").alias(full), F.col("cut").alias(cut)), "decided")

    own = epoch_order(F.col(key), seed, F.col(full) + 1)
    copies = F.col(full) + F.when(own <= F.col(cut), 1).otherwise(0)
    return (
        docs.withColumns(node).join(decided, names)
        .withColumn(epoch, F.explode(F.filter(F.sequence(F.lit(1), F.lit(most_epochs + 1)), lambda e: e <= copies)))
        .select(*docs.columns, epoch)
    )


def domain_of(source: Column) -> Column:
    """The domain a source belongs to, by the number in its name."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "news").when(number.isNotNull(), "books")


#: Production weights of the tree's nodes; sources of a language weigh the same.
LEVEL_WEIGHTS = {
    "domain": {"web": 4, "forum": 1, "news": 3, "books": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}


def mix_documents(docs: DataFrame, budget_percent: int = 60, epoch: str = "epoch") -> DataFrame:
    """The production mixture of documents: domain, language, source."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, LEVEL_WEIGHTS, budget_percent, epoch=epoch)
