"""The observable series of a log's life, as one long table, and claims about them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import calls as record
from ..sources.shared import shared_dir
from ..sources.views import KINDS, cuts, long
from . import fold, life, queues
from .log import positions


def series(entries: DataFrame) -> DataFrame:
    """shard, name, tag, value of each series. The entries are read once for each source of
    series: give a log at rest."""

    def of(df: DataFrame, **series: tuple[Column, Column]) -> DataFrame:
        """shard and one row for each series: (tag, value); none where the value is null."""
        rows = F.array(*(F.struct(F.lit(name).alias("name"), tag.alias("tag"), long(value).alias("value")) for name, (tag, value) in series.items()))
        return df.select("shard", F.explode(rows).alias("s")).select("shard", "s.*").filter("value IS NOT NULL")

    c, n, none = F.col, F.count(F.lit(1)), F.lit("-")
    category = c("category").cast("string")
    stats = fold.windows(entries)
    ages = entries.groupBy("shard", "win").agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("us"))
    writes = entries.groupBy("shard", "kind").agg(n.alias("n"))
    answered = entries.groupBy("shard").agg(F.count_if((c("k") == 1) & (c("epoch") >= c("owner"))).alias("n"))
    reads = tail_entries(entries).groupBy("shard").agg(F.count_if((c("kind") == "update") & (c("k") % 4 == 1)).alias("n"))
    drains = stats.groupBy("shard", "trigger").agg(n.alias("n"))
    drained = stats.groupBy("shard").agg(F.sum("mutations").alias("m"), F.sum("workflows").alias("w"), F.floor(n / 16).alias("trims"))
    sweeps = queues.sweep_counts(entries).groupBy("shard", "category").agg(F.sum("written").alias("w"), F.sum("dropped").alias("d"))
    merged = queues.merged(entries).groupBy("shard", "category").agg(n.alias("keys"), F.count_if(c("copies") > 1).alias("collisions"))
    replay = life.replay_report(entries)
    parts = [
        of(writes, intercepted_writes=(c("kind"), c("n"))),
        of(reads, overlaid_reads=(none, c("n"))),
        of(drains, drains=(c("trigger"), c("n"))),
        of(drained, drained_mutations=(none, c("m")), drained_workflows=(none, c("w")), trims=(none, c("trims"))),
        of(ages.groupBy("shard").agg(F.sum("us").alias("us")), window_age=(none, c("us"))),
        of(answered, answered_condition_failures=(none, c("n"))),
        of(sweeps, written_tasks=(category, c("w")), dropped_tasks=(category, c("d"))),
        of(
            positions(entries),
            tail_entries=(none, c("entries")),
            tail_bytes=(none, c("bytes")),
            unapplied_entries=(none, c("last") - c("applied")),
            backpressure_refusals=(F.lit("entries"), F.greatest(c("entries") - 8192, F.lit(0))),
        ),
        of(merged, merged_task_collisions=(category, c("collisions")), merged_task_pages=(category, F.ceil(c("keys") / 50))),
        of(life.halts(entries).filter("state <> 'running'"), halts=(c("state"), F.lit(1))),
        of(replay, replayed_entries=(none, c("folded") + c("alone") + c("dropped")), replay_dropped_entries=(none, c("dropped"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def tail_entries(entries: DataFrame) -> DataFrame:
    return entries.join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter("seqno > applied")


def claims(entries: DataFrame) -> DataFrame:
    """Claims that a windowed run must bear out, with whether it does."""
    totals = series(entries).groupBy("name").agg(F.sum("value").alias("v"))
    wide = totals.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("name") == s, F.col("v"))), long(0)).alias(s) for s in SERIES))
    kinds = entries.agg(F.count_if(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).alias("unnamed"), F.countDistinct("kind").alias("kinds"))
    wide = wide.join(kinds)  # one row each
    held = {
        "every acknowledged entry names a kind": F.col("unnamed") == 0,
        "every kind is there": F.col("kinds") == len(KINDS),
        "something was acknowledged": F.col("intercepted_writes") > 0,
        "something was written": F.col("written_tasks") > 0,
        "something was applied": F.col("intercepted_writes") > F.col("unapplied_entries"),
        "every shard has a tail": F.col("tail_entries") > 0,
        "reads met the window": F.col("overlaid_reads") > 0,
        "pages were merged": F.col("merged_task_pages") > 0,
        "ranges and tasks reached the log": F.col("written_tasks") + F.col("dropped_tasks") > 0,
        "some task was dropped": F.col("dropped_tasks") > 0,
        "something collapsed": F.col("drained_mutations") > F.col("drained_workflows"),
        "a page met both sides": F.col("merged_task_collisions") > 0,
        "all writes were drained": F.col("drained_mutations") == F.col("intercepted_writes"),
        "nothing halted": F.col("halts") == 0,
        "no condition reached a drain": F.col("answered_condition_failures") == 0,
        "replays dropped no more than they read": F.col("replay_dropped_entries") <= F.col("replayed_entries"),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("claim"), long(c).alias("holds")) for name, c in held.items()))
    return wide.select(F.inline(rows))


SERIES = (
    "intercepted_writes",
    "overlaid_reads",
    "unapplied_entries",
    "drained_mutations",
    "drained_workflows",
    "written_tasks",
    "dropped_tasks",
    "tail_entries",
    "merged_task_collisions",
    "merged_task_pages",
    "halts",
    "answered_condition_failures",
    "replayed_entries",
    "replay_dropped_entries",
)


def calls(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A record of calls and one of outcomes: the outcome of every 17th was never written."""
    made = entries.select("shard", F.col("seqno").alias("call"), "workflow", "run", "kind")
    known = F.when(F.col("epoch") < F.col("owner"), "ownership_lost").when(F.col("k") == 1, "condition").otherwise("none")
    return made, entries.filter("seqno % 17 <> 0").select("shard", F.col("seqno").alias("call"), known.alias("outcome"))


def matched_calls(entries: DataFrame) -> DataFrame:
    """Calls by kind and outcome, written to a record of JSON lines and read back; one
    without an outcome is unknown, never refused."""
    spark = entries.sparkSession
    folder = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    record.write(*calls(entries), folder)
    return record.matched(*record.read(spark, folder)).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def effects(entries: DataFrame) -> DataFrame:
    """What each mutation claims of its run: exists, removed, or nothing."""
    effect = F.when(F.col("kind").isin("update", "snapshot"), "exists").when(F.col("kind") == "delete", "removed").otherwise("no_claim")
    return entries.groupBy("shard", effect.alias("effect")).agg(F.count(F.lit(1)).alias("n"))


def lag(entries: DataFrame) -> DataFrame:
    """Per shard what a shutdown would leave behind, as a part of its log."""
    return cuts(entries).select("shard", (F.col("last") - F.col("applied")).alias("residue"), F.round((F.col("last") - F.col("applied")) / F.col("last"), 6).alias("part"))
