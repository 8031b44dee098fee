"""Event batches that mutations carry, and the history nodes they become.

A batch belongs to a node of a branch of a tree and is told apart by the transaction that
wrote it. The fold keeps every batch of a window, in the order of the log; a store upserts
them by key, before anything else of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import long

KEY = ["tree", "branch", "node", "txn"]
NODE = ["shard", *KEY]


def batches(entries: DataFrame) -> DataFrame:
    """shard, win, seqno, ordinal, tree, branch, node, txn, events of each event batch:
    updates with k divisible by 5 carry one, by 10 also one of a new run's."""
    slots = F.array(
        F.struct(F.concat(F.lit("e"), F.col("k").cast("string")).alias("events")),
        F.when(F.col("k") % 10 == 0, F.struct(F.concat(F.lit("n"), F.col("k").cast("string")).alias("events"))),
    )
    return (
        entries.filter("kind = 'update' AND k % 5 = 0")
        .select("shard", "win", "seqno", "workflow", "run", "version", "k", F.posexplode(slots).alias("ordinal", "slot"))
        .filter("slot IS NOT NULL")
        .select(
            "shard",
            "win",
            "seqno",
            long(F.col("ordinal")).alias("ordinal"),
            F.col("workflow").alias("tree"),
            (F.col("run") % 2).alias("branch"),
            (F.col("version") + F.col("ordinal")).alias("node"),
            F.col("seqno").alias("txn"),
            "slot.events",
        )
    )


def stripped(entries: DataFrame) -> DataFrame:
    """Batches without their events, as a log keeps them once a store has them."""
    return batches(entries).withColumn("events", F.lit(None).cast("string"))


def collected(entries: DataFrame) -> DataFrame:
    """What each window hands to the store: its batches in the order of the log, none left
    out for another of its key, and the position of the last."""
    place = F.struct("seqno", "ordinal", "node")
    text = F.transform(F.array_sort(F.collect_list(place)), lambda x: F.concat_ws(".", x["seqno"], x["ordinal"], x["node"]))
    return batches(entries).groupBy("shard", "win").agg(F.count(F.lit(1)).alias("batches"), F.array_join(text, ",").alias("in_order"), F.max("seqno").alias("tail"))


def branch_page(entries: DataFrame, branch: int, batch: int = 3) -> DataFrame:
    """The first nodes of one branch of each tree, of that branch of that tree only: nodes
    ascend and of a node the last transaction comes first."""
    order = Window.partitionBy("shard", "tree").orderBy("node", F.col("txn").desc(), "ordinal")
    return (
        batches(entries)
        .filter(F.col("branch") == branch)
        .withColumn("ord", long(F.row_number().over(order)))
        .filter(F.col("ord") <= max(batch, 1))
        .select("shard", "tree", "branch", "ord", "node", "txn", "events")
    )


def slot_counts(entries: DataFrame) -> DataFrame:
    """Batches and characters of events by shard, with them and stripped."""
    size = lambda df, name: df.groupBy("shard").agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum(F.length("events")), F.lit(0)).cast("long").alias(f"{name}_chars"))
    return size(batches(entries), "batches").join(size(stripped(entries), "stripped"), "shard")
