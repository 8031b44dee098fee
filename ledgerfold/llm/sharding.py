"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded key and ranked; row r of n gets
the fractional rank (2r - 1) / 2n. Sorting all rows by fractional rank interleaves the
sources in proportion, so any contiguous cut has the mixture of the whole, and cutting
at equal row counts gives shards whose counts differ by one at most (law `rows`).

Built-in functions only. Ranks are prefix sums over key buckets: a hot source is spread
over all of its buckets, and no task holds a source or the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BITS, cut, running_offsets, seeded_key, text_of

#: Buckets of a source's key range, and of the range of fractional ranks.
SOURCE_BITS, RANK_BUCKETS = 10, 4096


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row.

    docs: doc_id, text, source; other columns are ignored. A null text has no bytes and
    counts as empty; a null source is a source of its own; a null doc_id is allowed.
    Repeated rows each get a slot, and which of two equal rows gets which is open. An
    empty table gives an empty result. Shards may be empty when rows are fewer.
    """
    rows = cut(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text_of()) + 16).cast("long").alias("size"),
            F.crc32(text_of().cast("binary")).alias("text_crc32"),
            seeded_key(seed, F.col("doc_id"), F.md5(text_of().cast("binary"))).alias("key"),
            F.lit(1).alias("one"),
        ),
        "sharding",
    )
    ranked = running_offsets(
        rows,
        ["source"],
        F.shiftright("key", KEY_BITS - SOURCE_BITS),
        [F.col("key"), F.col("doc_id"), F.col("text_crc32")],
        "one",
        "rank",
    )
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "of")
    placed = cut(
        ranked.join(counts, F.col("source").eqNullSafe(F.col("of"))).select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            "one",
            "rank",
            ((2 * F.col("rank") + 1) / (2 * F.col("n"))).alias("part"),
        ),
        "sharding",
    )
    order = [F.col("part"), F.col("source").asc_nulls_last(), F.col("rank")]
    bucket = F.floor(F.col("part") * RANK_BUCKETS)
    n = placed.count()
    return (
        running_offsets(placed, [], bucket, order, "one", "at")
        .withColumn("shard", F.expr(f"at * {n_shards} div {max(n, 1)}").cast("int"))
        .withColumn("slot", F.expr(f"at - (shard * {n}L + {n_shards - 1}) div {n_shards}").cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
