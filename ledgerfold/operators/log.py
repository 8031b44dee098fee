"""Operators on the log itself: append verdicts, audits, reads, trims, replays, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import before
from ..sources.parquet_log import acknowledged
from ..sources.views import BUCKET, cuts, div, long

#: An append is refused for the first of these that holds; the order is part of the contract.
REFUSALS = ("zero_epoch", "bad_seqno", "unfenced", "fenced", "already_written", "gap")


def append_verdict(owner: Column, epoch: Column, seqno: Column, next_seqno: Column) -> Column:
    """What a log fenced at `owner` that continues at `next_seqno` says to an append."""
    held = (
        epoch == 0,
        seqno < 1,
        owner == 0,
        owner != epoch,
        seqno < next_seqno,
        seqno > next_seqno,
    )
    verdict = F.lit("accepted")
    for name, holds in reversed(list(zip(REFUSALS, held))):
        verdict = F.when(holds, name).otherwise(verdict)
    return verdict


def attempts(entries: DataFrame) -> DataFrame:
    """Appends as writers tried them: entries with k = 7 repeat the seqno before theirs, and
    those with k = 11 leave two out."""
    tried = F.col("seqno") + F.when(F.col("k") == 7, -1).when(F.col("k") == 11, 2).otherwise(0)
    return entries.select("shard", "seqno", "owner", "epoch", long(tried).alias("tried"))


def append_verdicts(entries: DataFrame) -> DataFrame:
    verdict = append_verdict(F.col("owner"), F.col("epoch"), F.col("tried"), F.col("seqno"))
    return attempts(entries).select("shard", "seqno", "epoch", "tried", verdict.alias("verdict"))


def _bucket() -> Column:
    return F.shiftright("seqno", BUCKET.bit_length() - 1)


def audit(entries: DataFrame) -> DataFrame:
    """The entries of a log whose seqno isn't one above the one before, or whose epoch is
    below one before: shard, seqno, tried, finding, stale. What came before is a bucketed
    total, so no task reads a shard."""
    last = F.struct("seqno", "tried")
    seen = before(attempts(entries), ["shard"], _bucket(), [F.col("seqno")], maxima={"last": last, "top": F.col("epoch")})
    step = F.col("tried") - F.col("last.tried")
    behind = F.col("epoch") < F.col("top")
    found = F.when(step < 1, "duplicate").when(step > 1, "gap").otherwise("next")
    return seen.select("shard", "seqno", "tried", found.alias("finding"), long(F.coalesce(behind, F.lit(False))).alias("stale")).filter(
        "finding <> 'next' OR stale = 1"
    )


def read_from(entries: DataFrame, shard: int, start: int, limit: int) -> DataFrame:
    """At most `limit` entries of a shard from `start` (1 at least) on, in order."""
    if limit <= 0:
        raise ValueError(f"reading shard {shard} from {start}: limit {limit} is not positive")
    return entries.filter((F.col("shard") == shard) & (F.col("seqno") >= max(start, 1))).orderBy("seqno").limit(limit)


def entry_at(entries: DataFrame, seqno: int) -> DataFrame:
    return entries.filter(F.col("seqno") == seqno)


def trim(entries: DataFrame) -> DataFrame:
    """What is left after trimming each shard up to the last multiple of 16 windows of 8
    that its applied position covers: the log goes on at the same next seqno."""
    at = cuts(entries).withColumn("up_to", div(F.col("applied"), 128) * 128)
    return (
        entries.join(F.broadcast(at), "shard")
        .groupBy("shard", "up_to")
        .agg(
            F.count_if(F.col("seqno") > F.col("up_to")).alias("kept"),
            F.min(F.when(F.col("seqno") > F.col("up_to"), F.col("seqno"))).alias("first_kept"),
            (F.max("seqno") + 1).alias("next_seqno"),
        )
    )


def replay(entries: DataFrame) -> DataFrame:
    """The entries above the applied position, with what a new owner does with each."""
    behind = F.col("epoch") < F.col("owner")
    return (
        entries.join(F.broadcast(cuts(entries)), "shard")
        .filter(F.col("seqno") > F.col("applied"))
        .select("shard", "seqno", "epoch", "kind", F.when(behind, "stale").otherwise("accept").alias("outcome"))
    )


def totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("shard", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def stream_report(entries: DataFrame) -> DataFrame:
    """Per kind: entries, workflows, runs, and the part of all entries."""
    n = F.count(F.lit(1))
    per = entries.groupBy("kind").agg(
        n.alias("n"), F.countDistinct("workflow").alias("workflows"), F.countDistinct("workflow", "run").alias("runs")
    )
    return per.withColumn("part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def positions(entries: DataFrame) -> DataFrame:
    """Tail of each shard: entries and bytes acknowledged above the applied position, and
    what the bounds say to the next write."""
    tail = F.col("seqno") > F.col("applied")
    return (
        entries.join(F.broadcast(cuts(entries)), "shard")
        .groupBy("shard", "applied", "last")
        .agg(F.count_if(tail).alias("entries"), F.sum(F.when(tail, F.col("size")).otherwise(0)).alias("bytes"))
        .withColumn("over", long((F.col("entries") >= 8192) | (F.col("bytes") >= 8 << 20)))
    )


def running_tail(entries: DataFrame) -> DataFrame:
    """Entries and bytes of the tail after each acknowledged entry above the applied position."""
    tail = entries.join(F.broadcast(cuts(entries)), "shard").filter(F.col("seqno") > F.col("applied")).select("shard", "seqno", "applied", "size")
    summed = before(tail, ["shard"], _bucket(), [F.col("seqno")], {"earlier": F.col("size")})
    return summed.select("shard", "seqno", (F.col("seqno") - F.col("applied")).alias("entries"), (F.col("earlier") + F.col("size")).alias("bytes"))


def read_back(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log as it is read back, and what writers hold acknowledged, as after faults: of the
    log every entry with k = 9 is lost and with k = 8 another's; k = 12 was never
    acknowledged."""
    held = entries.filter("k <> 9").select("shard", "seqno", F.when(F.col("k") == 8, "other").otherwise(F.col("kind")).alias("payload"))
    return held, entries.filter("k <> 12").select("shard", "seqno", F.col("kind").alias("payload"))


def acked_audit(entries: DataFrame) -> DataFrame:
    """Acknowledged appends against the log: shard, lost, other, unacknowledged, missing."""
    return acknowledged(*read_back(entries))
