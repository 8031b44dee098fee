"""One query per corpus operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hamming, lines, mixing, order_minhash, packing, sharding, simhash, suffix_tree, tokenfile, toxicity
from .common import new_folder, table, text_of


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_minhash.with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
    both = docs.withColumn("_edited", order_minhash.edited(F.col("text"), F.col("next_text"))).withColumn(
        "_edited_sig", order_minhash.signature(F.col("_edited"))
    )
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        order_minhash.as_string(F.col("sig")).alias("fingerprint"),
        order_minhash.as_string(F.col("_edited_sig")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sig"), F.col("_edited_sig")).alias("near_edited"),
        order_minhash.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.scores(docs, labels).select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def op4_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.place_words(docs).select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return sharding.interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    split = F.when(text_of() == "", 0).otherwise(F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"))) + 1)
    return docs.select(
        "doc_id",
        split.cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = new_folder(spark, "token-ids")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = tokenfile.write(docs, folder, path, vocabulary=49_408, caseless=True, apart=True)
    return tokenfile.read(docs, folder, manifest)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    codes = rows.select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(codes, F.col("id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_tree,
        op2_order_minhash,
        op3_toxicity,
        op4_sainte_lague,
        op5_best_fit,
        op6_simhash,
        op7_interleaving,
        op8_fuzzy_lines,
        op9_token_index,
        op10_multi_index,
    )
    return {f.__name__: f for f in found}
