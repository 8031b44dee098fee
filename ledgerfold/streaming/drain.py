"""The fold as a stream: each micro-batch is a window, drained into versioned tables.

A drain folds its batch, overlays the change on the buckets of the tables that it touches,
and commits tables and positions together, in the order of a store's transaction: history,
range deletes, merged requests, tasks, watermark. A batch that comes again after a failure
finds itself committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, history, queues
from ..sources.shared import shared_dir
from ..sources.tables import Tables
from ..sources.views import KINDS, long, ranges

KEY = ["shard", "workflow", "run"]


class RefusedBatch(Exception):
    """A batch that the sink doesn't take; nothing was written."""


def preflight(batch: DataFrame, epoch: int, shards: list[int] | None = None) -> list[int]:
    """The shards of a batch of entries; refuses, before anything is written, epoch 0, an
    empty batch, shards that aren't ours, and unknown kinds."""
    if epoch < 1:
        raise RefusedBatch("zero epoch")
    found = batch.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.coalesce("kind", F.lit("none")))).alias("unknown"))
    rows = found.collect()  # one for each shard
    if not rows:
        raise RefusedBatch("empty batch")
    for r in rows:
        if r["shard"] is None or (shards is not None and r["shard"] not in shards):
            raise RefusedBatch(f"foreign shard {r['shard']}")
        if r["unknown"] is not None:
            raise RefusedBatch(f"unknown kind {r['unknown']} in shard {r['shard']}")
    return [r["shard"] for r in rows]


def apply(tables: Tables, epoch: int, batch: DataFrame, batch_id: int, shards: list[int] | None = None) -> bool:
    """Folds a batch of entries into the tables `runs`, `items`, `current`, `buffered`,
    `tasks` and `history`."""
    spark = batch.sparkSession
    preflight(batch, epoch, shards)
    held = tables.manifest()
    at = [(int(s), n) for s, n in held["applied"].items()]
    known = spark.createDataFrame(at, "shard long, applied long")
    window = batch.withColumn("win", long(0))
    fresh = window.join(F.broadcast(known), "shard", "left").filter(F.col("seqno") > F.coalesce("applied", long(0))).drop("applied").cache()
    try:
        last = {str(r["shard"]): r["last"] for r in fresh.groupBy("shard").agg(F.max("seqno").alias("last")).collect()}
        if not last:
            return False
        of_runs = tables.bucket("shard", "workflow")
        touched = {"workflow": of_runs, "shard": tables.bucket("shard"), "tree": tables.bucket("tree")}
        within = {
            name: [r[0] for r in (history.batches(fresh) if name == "tree" else fresh).select(c).distinct().collect()]
            for name, c in touched.items()
        }

        def old(name: str, by: str, like: DataFrame) -> DataFrame:
            found = tables.read(name, within[by], held)
            return like.limit(0) if found is None else found.select(*like.columns)

        runs = fold.runs(fresh)
        whole = runs.filter("shape <> 'delta'").select(*KEY)
        new_runs = runs.filter("shape <> 'tombstone' AND version > 0").select(*KEY, "version", F.col("tail").alias("last_seqno"))
        items = fold.items(fresh).select(*KEY, "key", "op", "value")
        new_items = items.filter("op = 'U'").drop("op")
        current = fold.current(fresh).select("shard", "workflow", "run", "version", "removed")
        new_current = current.filter("removed = 0").drop("removed")
        queued = fold.buffered_batches(fresh).select(*KEY, "seqno")
        row = ["shard", "category", "task_id", "slot", "workflow", "fire_time", "at"]
        new_tasks = queues.swept(fresh).select(*row)
        swept = queues.without(old("tasks", "shard", new_tasks), ranges(fresh), ["shard"])
        nodes = history.batches(fresh).select(*history.NODE, "events")
        if not tables.history and not nodes.isEmpty():
            raise RefusedBatch("the tables take no event batches")
        made = {
            "runs": ("workflow", old("runs", "workflow", new_runs).join(runs.select(*KEY), KEY, "left_anti").unionByName(new_runs)),
            "items": (
                "workflow",
                old("items", "workflow", new_items)
                .join(whole, KEY, "left_anti")
                .join(items.select(*KEY, "key"), [*KEY, "key"], "left_anti")
                .unionByName(new_items),
            ),
            "current": ("workflow", old("current", "workflow", new_current).join(current.select("shard", "workflow"), ["shard", "workflow"], "left_anti").unionByName(new_current)),
            "buffered": ("workflow", old("buffered", "workflow", queued).join(whole, KEY, "left_anti").unionByName(queued)),
            "tasks": ("shard", swept.unionByName(new_tasks)),
            "history": ("tree", old("history", "tree", nodes).join(nodes, history.KEY, "left_anti").unionByName(nodes)),
        }
        out = {name: (df.withColumn("bucket", touched[by]), within[by]) for name, (by, df) in made.items()}
        return tables.commit(epoch, out, last, batch_id, held)
    finally:
        fresh.unpersist()


def read_drained(tables: Tables, epoch: int, pending: DataFrame, batch_id: int, name: str) -> DataFrame | None:
    """A table after what is pending of the log was drained: a reader that waits for the
    drain, and needs no merge."""
    if not pending.isEmpty():
        apply(tables, epoch, pending, batch_id)
    return tables.read(name)


def drain(spark: SparkSession, source: str, schema, tables: Tables, epoch: int, checkpoint: str, files: int = 1) -> None:
    """Drains what a folder of Parquet files of entries holds, `files` of them a window."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda batch, i: (batch.isEmpty() or apply(tables, epoch, batch, i)) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drained(spark: SparkSession, entries: DataFrame, windows: int = 4) -> Tables:
    """The tables after a log, cut into `windows` files by position, was streamed. The
    position's part is of the shard's last one, so files hold a stretch of every shard."""
    folder = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    source = f"{folder}/log"
    last = entries.groupBy("shard").agg(F.max("seqno").alias("last"))
    part = F.expr(f"(seqno - 1) * {windows} div last")
    parted = entries.join(F.broadcast(last), "shard").withColumn("part", part).drop("last").persist()
    try:
        for i in range(windows):
            parted.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    finally:
        parted.unpersist()
    tables = Tables(spark, f"{folder}/tables", buckets=4)
    tables.fence(1)
    drain(spark, source, entries.schema, tables, 1, f"{folder}/checkpoint")
    return tables


def drained_items(spark: SparkSession, entries: DataFrame) -> DataFrame:
    found = drained(spark, entries).read("items")
    return found if found is not None else spark.createDataFrame([], "shard long, workflow long, run long, key long, value double")


def drained_sums(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Of every table at rest after the stream: rows of each shard and sums that tell them."""
    tables = drained(spark, entries)
    sums = {
        "runs": "version * 7 + last_seqno",
        "current": "run * 13 + version",
        "buffered": "seqno",
        "tasks": "category * 3 + task_id * 5 + slot + workflow",
        "history": "node * 3 + txn + branch",
    }
    out = None
    for name, of in sums.items():
        found = tables.read(name)
        if found is not None:
            rows = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(of)).cast("long").alias("told")).select(F.lit(name).alias("tables"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "tables string, shard long, n long, told long")
