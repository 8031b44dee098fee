"""The fold: a window's mutations of a run merged into one change.

The assertion comes from a run's first mutation of the window, its scalars from the last,
its items from the last operation on each key since the last snapshot; a delete leaves a
tombstone. Everything groups by run within a window, so one shuffle serves all of it and
hot runs are bounded by the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import long, tasks

RUN = ["shard", "win", "workflow", "run"]
#: Assertions of a head: a created run must not exist; a tombstone without one asserts none.
MUST_NOT_EXIST, NO_HEAD = -1, -2


def of_runs(entries: DataFrame) -> DataFrame:
    """The entries that touch a run, with what each asserts: the version it stands on."""
    mine = entries.filter(F.col("kind").isin("update", "snapshot", "delete"))
    base = F.when(F.col("kind") == "delete", NO_HEAD).when(F.col("version") == 1, MUST_NOT_EXIST).otherwise(F.col("version") - 1)
    return mine.withColumn("base", long(base))


def _run_columns() -> list:
    return [
        F.count(F.lit(1)).alias("mutations"),
        F.min("seqno").alias("head"),
        F.max("seqno").alias("tail"),
        F.min_by("base", "seqno").alias("base"),
        F.max("version").alias("version"),
        F.max_by("kind", "seqno").alias("last_kind"),
        F.coalesce(F.max(F.when(F.col("kind") == "snapshot", F.col("seqno"))), long(0)).alias("barrier"),
    ]


def _shaped(folded: DataFrame) -> DataFrame:
    shape = F.when(F.col("last_kind") == "delete", "tombstone").when(F.col("barrier") > 0, "snapshot").otherwise("delta")
    return folded.withColumn("shape", shape).drop("last_kind")


def runs(entries: DataFrame) -> DataFrame:
    """One row for each run that a window touches."""
    return _shaped(of_runs(entries).groupBy(*RUN).agg(*_run_columns()))


def _ranked(entries: DataFrame) -> DataFrame:
    """The entries that touch a run; live: an operation on a key since the run's last
    snapshot in the window, of a run that the window doesn't delete; nth: 1 for the last
    of a key. All windows and what groups by run share one partitioning."""
    of_run = Window.partitionBy(*RUN)
    barrier = F.max(F.when(F.col("kind") == "snapshot", F.col("seqno"))).over(of_run)
    gone = F.max(long(F.col("kind") == "delete")).over(of_run)
    live = F.col("op").isNotNull() & (F.col("seqno") > F.coalesce(barrier, long(0))) & (gone == 0)
    last = Window.partitionBy(*RUN, "key").orderBy(F.col("live").desc(), F.col("seqno").desc(), F.col("op").desc())
    return of_runs(entries).withColumn("live", live).withColumn("nth", F.row_number().over(last))


def items(entries: DataFrame) -> DataFrame:
    """The last operation on each key since the run's last snapshot in the window; runs that
    the window deletes have none."""
    return _ranked(entries).filter("live AND nth = 1").select(*RUN, "key", "op", "value", "seqno")


def shapes(entries: DataFrame) -> DataFrame:
    """Runs with how many keys they leave written and removed."""
    left = lambda op: F.count_if(F.col("live") & (F.col("nth") == 1) & (F.col("op") == op))
    return _shaped(_ranked(entries).groupBy(*RUN).agg(*_run_columns(), left("U").alias("upserts"), left("D").alias("deletes")))


def current(entries: DataFrame) -> DataFrame:
    """What a window does to a workflow's current row: the first assertion, and the run it
    is left at; removed if the last write of the window deletes that run."""
    return (
        of_runs(entries)
        .groupBy("shard", "win", "workflow")
        .agg(
            F.min_by("run", "seqno").alias("asserted_run"),
            F.min_by("base", "seqno").alias("asserted_base"),
            F.max_by("run", "seqno").alias("run"),
            F.max_by("version", "seqno").alias("version"),
            long(F.max_by("kind", "seqno") == "delete").alias("removed"),
        )
    )


def requests(entries: DataFrame) -> DataFrame:
    """The requests of a drain in order of their last mutation: which comes first of its
    workflow, and which carries its run's assertion."""
    by_tail = Window.partitionBy("shard", "win").orderBy("tail")
    of_workflow = Window.partitionBy("shard", "win", "workflow").orderBy("tail")
    return runs(entries).select(
        *RUN,
        "tail",
        long(F.row_number().over(by_tail)).alias("ord"),
        long(F.row_number().over(of_workflow) == 1).alias("first_of_workflow"),
        long(F.col("base") != NO_HEAD).alias("carries_head"),
        "shape",
    )


def tombstones(entries: DataFrame) -> DataFrame:
    """Runs that a window deletes, with the tasks of theirs that ride along."""
    gone = runs(entries).filter("shape = 'tombstone'").select(*RUN, "head", "tail", "base")
    own = tasks(entries).groupBy(*RUN).agg(F.count(F.lit(1)).alias("orphans"))
    return gone.join(own, RUN, "left").withColumn("orphans", F.coalesce("orphans", long(0)))


def _buffering(entries: DataFrame) -> DataFrame:
    """Buffered batches (updates with k of 90 and more) since a run's last snapshot of the
    window; gone: the window deletes the run."""
    of_run = Window.partitionBy(*RUN)
    barrier = F.coalesce(F.max(F.when(F.col("kind") == "snapshot", F.col("seqno"))).over(of_run), long(0))
    gone = F.max(long(F.col("kind") == "delete")).over(of_run)
    return of_runs(entries).withColumns({"barrier": barrier, "gone": gone}).filter("kind = 'update' AND k >= 90 AND seqno > barrier")


def buffered_batches(entries: DataFrame) -> DataFrame:
    """The batches that a store keeps, a row each."""
    return _buffering(entries).filter("gone = 0").select(*RUN, "seqno")


def buffered(entries: DataFrame) -> DataFrame:
    """Buffered batches of a run in order, and whether the window clears what was there
    before it."""
    return (
        _buffering(entries)
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.concat_ws(",", F.array_sort(F.collect_list("seqno")).cast("array<string>")).alias("seqnos"),
            long(F.max("barrier") > 0).alias("cleared"),
        )
    )


def windows(entries: DataFrame) -> DataFrame:
    """Window statistics: mutations, bytes, dirty workflows, how much they collapse, and
    which trigger closes it (mutations are named before bytes)."""
    n = F.count(F.lit(1))
    return (
        entries.groupBy("shard", "win")
        .agg(
            n.alias("mutations"),
            F.sum("size").alias("bytes"),
            F.countDistinct("workflow").alias("workflows"),
            F.round(n / F.countDistinct("workflow"), 6).alias("collapse"),
        )
        .withColumn("trigger", F.when(F.col("mutations") >= 256, "mutations").when(F.col("bytes") >= 256 << 10, "bytes").otherwise("age"))
    )


def watermarks(entries: DataFrame) -> DataFrame:
    """A drain's watermark: the last of its requests, its tasks and its ranges."""
    last = lambda *kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("seqno"))), long(0))
    return (
        entries.groupBy("shard", "win")
        .agg(last("update", "snapshot", "delete").alias("requests"), last("add_tasks").alias("tasks"), last("range_complete").alias("ranges"))
        .withColumn("watermark", F.greatest("requests", "tasks", "ranges"))
    )


def coverage(entries: DataFrame) -> DataFrame:
    """Of the assertions of a window: how many are a run's first (to be settled by the
    base), and how many the window itself answers."""
    order = Window.partitionBy(*RUN).orderBy("seqno")
    first = F.row_number().over(order) == 1
    return (
        of_runs(entries)
        .withColumn("first", first)
        .groupBy("shard", "win")
        .agg(
            F.count_if(F.col("base") != NO_HEAD).alias("asserted"),
            F.count_if(F.col("first") & (F.col("base") != NO_HEAD)).alias("delegated"),
            F.count_if(~F.col("first") & (F.col("base") != NO_HEAD)).alias("answered"),
            F.count_if(F.col("base") == NO_HEAD).alias("unasserted"),
        )
    )
