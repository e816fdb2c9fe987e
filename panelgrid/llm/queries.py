"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm import (
    conversation_repair, decontaminate, exact_dedup, filter_audit, language_id, mixing, near_dedup, quality, secrets,
    sharding, simhash, substring_dedup, token_files,
)
from panelgrid.llm.queries_sql import SQL as SQL
from panelgrid.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


QUERIES["pipeline"] = corpus_pipeline.run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the mixture of all documents, once per epoch."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "epoch", "lang", "source")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify_languages(docs)
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.ambiguous").alias("ambiguous"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.col("quality.content").alias("content"), F.col("quality.metadata").alias("metadata"),
        F.col("quality.score").alias("score"), (F.col("quality.score") >= 0.5).alias("kept"))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the benchmark items found in it."""
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10)
    hit = decontaminate.hit_words(F.col("contamination"))
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("contamination.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: 3-word shingles, similarity 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the written token files."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.KINDS))
    return found.select(
        "doc_id", *[number(kind) for kind in secrets.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the words of windows that start earlier."""
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), 20)
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a faulty export would leave them, by crc32 of conversation and turn."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    fate = F.col("fate")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                (F.crc32(named.cast("binary")) % 20).alias("fate")).where("fate <> 0").select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair_conversations(damaged(conversations))
    digests = conversation_repair.transcript_digests(repaired)
    found = summary.join(digests.withColumnRenamed("conv_id", "digest_of"), F.col("conv_id").eqNullSafe(F.col("digest_of")), "left")
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, per source."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simhash component of every document: 3-word shingles, 3 bits."""
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"), 3, 3)
