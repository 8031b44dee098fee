"""Merge on read and apply: base rows under a window's changes, and the tables they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import cuts, long
from . import queues
from .fold import current, items, of_runs, runs

KEY = ["shard", "workflow", "run"]


def split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log up to its applied positions and above, each as a single window."""
    marked = entries.join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").withColumn("win", long(0))
    return marked.filter("seqno <= applied").drop("applied"), marked.filter("seqno > applied").drop("applied")


def overlay_runs(entries: DataFrame) -> DataFrame:
    """Every run as a reader sees it: absent from the window, the base's; a snapshot, the
    window's; a delta, the base's with the window's changes; a tombstone, none."""
    before, after = split(entries)
    base = runs(before).filter("shape <> 'tombstone'").select(*KEY, F.col("version").alias("base_version"))
    win = runs(after).select(*KEY, F.col("shape"), F.col("version").alias("win_version"))
    shape = F.coalesce("shape", F.lit("absent"))
    version = F.when(shape == "absent", F.col("base_version")).when(shape != "tombstone", F.col("win_version"))
    return (
        base.join(win, KEY, "full_outer")
        .select(*KEY, shape.alias("shape"), version.alias("version"), long(shape.isin("absent", "delta")).alias("needs_base"))
        .filter("version > 0 OR shape = 'tombstone'")
    )


def overlay_items(entries: DataFrame) -> DataFrame:
    """The items of every live run: the base's but where the window resets or deletes the
    run or touches the key, and the window's."""
    before, after = split(entries)
    reset = runs(after).filter("shape <> 'delta'").select(*KEY)
    upper = items(after).select(*KEY, "key", "op", "value")
    lower = items(before).filter("op = 'U'").select(*KEY, "key", "value")
    kept = lower.join(reset, KEY, "left_anti").join(upper.select(*KEY, "key"), [*KEY, "key"], "left_anti")
    return kept.unionByName(upper.filter("op = 'U'").drop("op"))


def overlay_current(entries: DataFrame) -> DataFrame:
    """Current rows as a reader sees them: unheld, the base's; written, the window's; gone,
    none."""
    before, after = split(entries)
    key = ["shard", "workflow"]
    base = current(before).filter("removed = 0").select(*key, F.col("run").alias("base_run"), F.col("version").alias("base_version"))
    win = current(after).select(*key, F.col("run").alias("win_run"), F.col("version").alias("win_version"), "removed")
    source = F.when(F.col("removed").isNull(), "base").when(F.col("removed") == 1, "gone").otherwise("window")
    pick = lambda name: F.when(source == "base", F.col(f"base_{name}")).when(source == "window", F.col(f"win_{name}"))
    return base.join(win, key, "full_outer").select(*key, source.alias("source"), pick("run").alias("run"), pick("version").alias("version"))


def whole(entries: DataFrame) -> DataFrame:
    return entries.withColumn("win", long(0))


def final_runs(entries: DataFrame) -> DataFrame:
    """Run rows after every window is applied, each as one change on what is there."""
    folded = runs(entries)
    return (
        folded.groupBy(*KEY)
        .agg(
            F.max("version").alias("version"),
            F.max("tail").alias("last_seqno"),
            F.max(long(F.col("shape") == "tombstone")).alias("gone"),
            F.count(F.lit(1)).alias("transactions"),
            F.sum("mutations").alias("mutations"),
        )
        .filter("gone = 0 AND version > 0")
        .drop("gone")
    )


def final_items(entries: DataFrame) -> DataFrame:
    """Items after every window's folded changes are applied in turn: a window that resets
    a run clears it, one that deletes it leaves nothing, the last change of a key stands."""
    flags = runs(entries).groupBy(*KEY).agg(
        F.max(F.when(F.col("shape") == "snapshot", F.col("win")).when(F.col("barrier") > 0, F.col("win"))).alias("reset"),
        F.max(long(F.col("shape") == "tombstone")).alias("gone"),
    )
    last = Window.partitionBy(*KEY, "key").orderBy(F.col("win").desc())
    return (
        items(entries)
        .join(flags, KEY)
        .filter("gone = 0 AND win >= coalesce(reset, 0)")
        .withColumn("nth", F.row_number().over(last))
        .filter("nth = 1 AND op = 'U'")
        .select(*KEY, "key", "value")
    )


def final_current(entries: DataFrame) -> DataFrame:
    """Current rows after every window: the last window's word, none where that removed it."""
    last = Window.partitionBy("shard", "workflow").orderBy(F.col("win").desc())
    return (
        current(entries)
        .withColumn("nth", F.row_number().over(last))
        .filter("nth = 1 AND removed = 0")
        .select("shard", "workflow", "run", "version")
    )


def final_tasks(entries: DataFrame) -> DataFrame:
    """Tasks after every window: each window's surviving tasks, less what ranges of later
    windows delete (a window's own ranges run before its inserts)."""
    left = queues.without(queues.swept(entries), queues.ranges(entries), ["shard"], "win")
    return left.select("shard", "category", "task_id", "slot", "workflow", long(F.unix_micros("fire_time")).alias("fire_us"))


def equivalence(entries: DataFrame) -> DataFrame:
    """Rows that folding by windows and applying one mutation at a time leave of items, runs,
    current rows and tasks, and differences both ways: 0 if folding changes nothing."""
    single = entries.withColumn("win", F.col("seqno"))

    def differ(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*a.columns)
        marked = a.withColumn("arm", F.lit(1)).unionByName(b.withColumn("arm", F.lit(-1)))
        folded, single = F.col("arm") == 1, F.col("arm") == -1
        # rows by value: how many each arm has, so that copies count
        met = marked.groupBy(*a.columns).agg(F.count_if(folded).alias("f"), F.count_if(single).alias("s"))
        total = lambda c: F.coalesce(F.sum(c), long(0)).cast("long")
        return met.agg(
            total("f").alias("folded"),
            total("s").alias("single"),
            total(F.greatest(F.col("f") - F.col("s"), long(0))).alias("only_folded"),
            total(F.greatest(F.col("s") - F.col("f"), long(0))).alias("only_single"),
        ).select(F.lit(name).alias("tables"), "folded", "single", "only_folded", "only_single")

    keep = [*KEY, "version", "last_seqno"]
    return (
        differ("items", final_items(entries), final_items(single))
        .unionByName(differ("runs", final_runs(entries).select(*keep), final_runs(single).select(*keep)))
        .unionByName(differ("current", final_current(entries), final_current(single)))
        .unionByName(differ("tasks", final_tasks(entries), final_tasks(single)))
    )


def overlay_differences(entries: DataFrame) -> DataFrame:
    """Items per shard in the overlay of base and tail and in the fold of all, and how many
    are in only one of them."""
    a, b = overlay_items(entries), final_items(whole(entries)).select(*KEY, "key", "value")
    n = a.groupBy("shard").agg(F.count(F.lit(1)).alias("items"))
    off = a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy("shard").agg(F.count(F.lit(1)).alias("off"))
    return n.join(off, "shard", "left").select("shard", "items", F.coalesce("off", long(0)).alias("differences"))


def guarded_deletes(entries: DataFrame) -> DataFrame:
    """Guarded deletes of current rows: an entry with k < 3 removes its workflow's row only
    while that names the run it was written for. shard, workflow, run, left."""
    rows = final_current(entries)
    guards = of_runs(entries).filter("kind = 'delete' OR k < 3").groupBy("shard", "workflow").agg(F.max("run").alias("guard"))
    hit = (F.col("c.shard") == F.col("g.shard")) & (F.col("c.workflow") == F.col("g.workflow")) & (F.col("c.run") == F.col("g.guard"))
    return rows.alias("c").join(guards.alias("g"), hit, "left_anti").select("shard", "workflow", "run", "version")
