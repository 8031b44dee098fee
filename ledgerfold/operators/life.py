"""The life of a drain loop, over records of its runs: starts and replays, halts, the
account of the tail, trims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import before
from ..sources.views import cuts, long
from ..streaming.policy import Policy
from ..streaming.policy import trims as trims_of


# ---- replay ----------------------------------------------------------------------------


def replayed(entries: DataFrame) -> DataFrame:
    """What a new owner's replay does with each entry above the applied position: shard,
    seqno, size, outcome.

    An entry that can't be decoded (here k = 33 of an update) or is another shard's (k = 34)
    strands the shard: it is charged to the tail, the shard halts, and nothing behind it is
    reached. A provisional entry is drained alone; one whose condition fails (its writer
    stood on an old version, as every 13th workflow's does) is dropped, and the applied
    position stays. All others are folded.
    """
    tail = entries.join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter(F.col("seqno") > F.col("applied"))
    update = F.col("kind") == "update"
    fault = F.when(update & (F.col("k") == 33), "undecodable").when(update & (F.col("k") == 34), "foreign_shard")
    provisional = F.col("epoch") < F.col("owner")
    marked = tail.withColumn("fault", fault)
    first = marked.filter("fault IS NOT NULL").groupBy("shard").agg(F.min("seqno").alias("halt_at"))  # a row for each shard
    outcome = (
        F.when(F.col("seqno") > F.col("halt_at"), "unreached")
        .when(F.col("seqno") == F.col("halt_at"), "stranded")
        .when(provisional & (F.col("workflow") % 13 == 0), "dropped")
        .when(provisional, "alone")
        .otherwise("folded")
    )
    return marked.join(F.broadcast(first), "shard", "left").select("shard", "seqno", "applied", "size", "fault", outcome.alias("outcome"))


def replay_report(entries: DataFrame) -> DataFrame:
    """Of each shard's replay: entries by outcome, where and why it halted, the applied
    position that it leaves, and what the tail then holds."""
    some = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    names = ("folded", "alone", "dropped", "stranded", "unreached")
    moved = F.max(F.when(F.col("outcome").isin("folded", "alone"), F.col("seqno")))
    return replayed(entries).groupBy("shard").agg(
        *map(some, names),
        F.coalesce(F.min(F.when(F.col("outcome") == "stranded", F.col("seqno"))), long(0)).alias("halted_at"),
        F.coalesce(F.min(F.when(F.col("outcome") == "stranded", F.col("fault"))), F.lit("none")).alias("why"),
        F.coalesce(moved, F.min("applied")).alias("applied"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "stranded", F.col("size"))), long(0)).alias("tail_bytes"),
    )


def start_gate(readable: Column, replay: Column) -> Column:
    """What a start comes to. readable: the applied position; replay: ok, lost, stranded or
    log_error. What can't be read is tried again at the next request."""
    return (
        F.when(readable == 0, "retry")
        .when(replay == "ok", "serve")
        .when(replay == "lost", "halt_lost")
        .when(replay == "stranded", "halt_invariant")
        .otherwise("retry")
    )


def write_path(halted: Column, shard: Column, started: Column, refusal: Column, condition: Column, append: Column, fold: Column) -> Column:
    """How far a write gets: what stops it first, else what becomes of it. fold: ok, refused
    (drained, then folded again), refused_twice."""
    return (
        F.when(halted == 1, "halted")
        .when(shard == 0, "foreign_shard")
        .when(started == 0, "not_started")
        .when(refusal != "accept", refusal)
        .when(condition == 0, "condition_failed")
        .when(append != "accept", append)
        .when(fold == "ok", "folded")
        .when(fold == "refused", "drained_and_folded")
        .otherwise("halt_invariant")
    )


# ---- halts -------------------------------------------------------------------------------


def halts(entries: DataFrame) -> DataFrame:
    """How each shard's loop ended: of halts (here k = 97 of an update loses the shard, k = 98
    breaks an invariant) the first stands, whatever comes after. shard, halted_at, state,
    later."""
    state = F.when(F.col("k") == 97, "halted_lost").when(F.col("k") == 98, "halted_invariant")
    events = entries.withColumn("state", F.when(F.col("kind") == "update", state))
    ends = events.filter("state IS NOT NULL").groupBy("shard").agg(
        F.min("seqno").alias("halted_at"), F.min_by("state", "seqno").alias("state"), (F.count(F.lit(1)) - 1).alias("later")
    )
    every = entries.select("shard").distinct()
    return every.join(ends, "shard", "left").select(
        "shard", F.coalesce("halted_at", long(0)).alias("halted_at"), F.coalesce("state", F.lit("running")).alias("state"), F.coalesce("later", long(0)).alias("later")
    )


# ---- the account of the tail -------------------------------------------------------------


def settlements(entries: DataFrame) -> DataFrame:
    """What became of each window's drain, as a run may record it: move (committed), keep
    (nothing was written: the applied position stays), stall (the outcome can't be read; the
    next drain finds that it was committed)."""
    action = F.when(F.col("win") % 7 == 5, "stall").when(F.col("win") % 5 == 3, "keep").otherwise("move")
    return entries.groupBy("shard", "win").agg(F.max("seqno").alias("end"), F.sum("size").alias("bytes")).withColumn("action", action)


def tail_account(entries: DataFrame) -> DataFrame:
    """The account of the tail after each window's drain: acknowledged (committed), resolved
    and applied positions, entries and bytes held, and the position that it is stalled at
    (0: none). A stalled window stays in the tail with its bytes until the next drain."""
    end, action = F.col("end"), F.col("action")
    rows = before(
        settlements(entries),
        ["shard"],
        F.shiftright("win", 12),
        [F.col("win")],
        maxima={"last_end": end, "last_moved": F.when(action != "keep", end)},
    )
    stalled = action == "stall"
    resolved = F.when(stalled, F.coalesce("last_end", long(0))).otherwise(end)
    moved = F.coalesce("last_moved", long(0))
    return rows.select(
        "shard",
        "win",
        "action",
        end.alias("acknowledged"),
        resolved.alias("resolved"),
        F.when(action == "move", end).otherwise(moved).alias("applied"),
        (end - resolved).alias("entries"),
        F.when(stalled, F.col("bytes")).otherwise(0).cast("long").alias("bytes"),
        F.when(stalled, end).otherwise(0).cast("long").alias("stalled"),
    )


# ---- trims -------------------------------------------------------------------------------


def trim_points(entries: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The drains after which a shard's log is trimmed, and up to where: every so many
    drains, or so much time after the last trim. When that was depends on all before it, so
    a shard's drains (a row for each window) pass through one task in order."""
    drains = entries.groupBy("shard", "win").agg(F.max("seqno").alias("end"), F.unix_micros(F.max("ts")).alias("us"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {"shard": [], "win": [], "end": [], "us": []}

        def flush() -> pd.DataFrame:
            at = trims_of([u / 1e6 for u in held["us"]], policy)
            return pd.DataFrame({c: [held[c][i] for i in at] for c in ("shard", "win", "end")} | {"drains": [b - a for a, b in zip([-1, *at], at)]})

        for frame in frames:
            for shard, win, end, us in zip(*(frame[c].tolist() for c in ("shard", "win", "end", "us"))):
                if held["shard"] and held["shard"][0] != shard:
                    yield flush()
                    held = {c: [] for c in held}
                for c, v in zip(("shard", "win", "end", "us"), (shard, win, end, us)):
                    held[c].append(v)
        if held["shard"]:
            yield flush()

    ordered = drains.repartition("shard").sortWithinPartitions("shard", "win").select("shard", "win", "end", "us")
    return ordered.mapInPandas(run, "shard long, win long, end long, drains long").withColumnRenamed("end", "up_to")
