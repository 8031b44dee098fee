"""The change log as a view over an event table.

A row of `events` is a mutation of a workflow (its user) in the shard of the user. All
of a log's columns are longs or strings, so that results compare with other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.running import before, is_small
from .shared import written

#: Mutations of a window, entries of an epoch, shards of the view.
WINDOW, EPOCH, SHARDS = 256, 1000, 4
#: Ids, or positions, of a bucket of a shard: what a task sorts at most.
BUCKET = 1 << 16


#: A key of the scheduled queue, in microseconds, that pages go on from.
PAGE_AFTER = 1_705_300_000_000_000
KINDS = ("delete", "snapshot", "add_tasks", "range_complete", "update")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(value) -> Column:
    return (F.lit(value) if not isinstance(value, Column) else value).cast("long")


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def kind() -> Column:
    k, event = F.col("k"), F.col("event_type")
    return (
        F.when(event == "error", "delete")
        .when(event == "signup", "snapshot")
        .when((event == "purchase") & (k < 80), "add_tasks")
        .when(event == "purchase", "range_complete")
        .otherwise("update")
    )


def log(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """shard, seqno, owner and epoch, win, workflow, run, version, kind, k, op, key, value,
    ts and size of every entry.

    Entries are numbered by bucketed sums over ranges of event ids, so that no task gets a
    shard; what runs need is partitioned by (shard, workflow) and streams through one sort.
    Events of equal ids are numbered by time, type and the other columns; a null user is a
    workflow in a shard of their own (both null). Null types are updates."""
    base = events.select(
        long(F.col("user_id") % SHARDS + 1).alias("shard"),
        long(F.col("user_id")).alias("workflow"),
        long(F.col("event_id")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        long(F.get_json_object("props", "$.k")).alias("k"),
        long(F.length("props") + 64).alias("size"),
    ).withColumn("kind", kind())
    order = [F.col(c) for c in ("event_id", "ts", "event_type", "workflow", "k", "value", "size")]
    sequenced = before(base, ["shard"], F.shiftright("event_id", BUCKET.bit_length() - 1), order, {"seqno": long(1)})
    sequenced = sequenced.withColumn("seqno", F.col("seqno") + 1)
    own = Window.partitionBy("shard", "workflow").orderBy("seqno")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    runs = sequenced.withColumn("run", F.coalesce(F.sum(long(F.col("kind") == "delete")).over(earlier), long(0)))
    touch = F.col("kind").isin("update", "snapshot")
    in_run = Window.partitionBy("shard", "workflow", "run").orderBy("seqno").rowsBetween(Window.unboundedPreceding, 0)
    owner = 1 + div(F.col("seqno"), EPOCH)
    update = F.col("kind") == "update"
    drops = update & (F.col("event_type") == "click") & (F.col("k") % 3 == 0)
    return runs.select(
        "shard",
        "seqno",
        owner.alias("owner"),
        long(owner - long((F.col("event_type") == "error") & (F.col("k") < 5))).alias("epoch"),
        div(F.col("seqno") - 1, window).alias("win"),
        "workflow",
        "run",
        long(F.sum(long(touch)).over(in_run)).alias("version"),
        "kind",
        "k",
        F.when(drops, "D").when(update, "U").alias("op"),
        F.when(update, F.col("k") % 10).alias("key"),
        F.when(update & ~drops, F.col("value")).alias("value"),
        "ts",
        "size",
        "event_type",
    )


def at_rest(entries: DataFrame, often: bool = True) -> DataFrame:
    """The same log, written once and read again: for what reads it several times. What
    doesn't read it often reads a small one as it is."""
    if not often and is_small(entries):
        return entries
    return entries.sparkSession.read.schema(entries.schema).parquet(written(entries, "log"))


def cuts(entries: DataFrame) -> DataFrame:
    """shard, last, applied: a position that divides each shard's log, three fifths in."""
    return entries.groupBy("shard").agg(F.max("seqno").alias("last")).withColumn("applied", div(F.col("last") * 3, 5))


def tasks(entries: DataFrame) -> DataFrame:
    """The task slots of add-tasks entries: an immediate task (category 1, keyed by id) and,
    for even k, a scheduled one (category 2, keyed by fire time and id). at: where ranges
    find a task, its id or its fire time in microseconds."""
    slots = F.array(
        F.struct(long(1).alias("category"), F.lit(None).cast("timestamp").alias("fire_time")),
        F.when(
            F.col("k") % 2 == 0,
            F.struct(long(2).alias("category"), (F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias("fire_time")),
        ),
    )
    return (
        entries.filter("kind = 'add_tasks'")
        .select("shard", "win", "seqno", "workflow", "run", F.posexplode(slots).alias("slot", "task"))
        .filter("task IS NOT NULL")
        .select("shard", "win", "seqno", "workflow", "run", long(F.col("slot")).alias("slot"), "task.*", F.col("seqno").alias("task_id"))
        .withColumn("at", F.when(F.col("category") == 1, F.col("task_id")).otherwise(F.unix_micros("fire_time")))
    )


def ranges(entries: DataFrame) -> DataFrame:
    """The ranges [lo, hi) that range-complete entries delete: of task ids (category 1) and,
    for even k, of fire times in microseconds (category 2)."""
    us = F.unix_micros("ts")
    minutes = lambda n: n * 60_000_000
    slots = F.array(
        F.struct(long(1).alias("category"), (F.col("seqno") - 64).alias("lo"), (F.col("seqno") + F.when(F.col("k") >= 90, 32).otherwise(0)).alias("hi")),
        F.when(
            F.col("k") % 2 == 0,
            F.struct(long(2).alias("category"), (us - minutes(90)).alias("lo"), (us + F.when(F.col("k") >= 90, minutes(30)).otherwise(0)).alias("hi")),
        ),
    )
    return (
        entries.filter("kind = 'range_complete'")
        .select("shard", "win", "seqno", F.explode(slots).alias("r"))
        .filter("r IS NOT NULL")
        .select("shard", "win", "seqno", "r.*")
    )


def history_nodes(conversations: DataFrame) -> DataFrame:
    """tree, node, txn, events of history nodes."""
    return conversations.select(
        long(F.col("conv_id")).alias("tree"),
        long(F.col("turn")).alias("node"),
        long(F.length("text") % 7).alias("txn"),
        F.col("text").alias("events"),
    )
