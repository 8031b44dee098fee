"""The condition authority: who answers an assertion, and what the answer is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import current_verdict, run_verdict
from ..sources.views import cuts, long
from .fold import NO_HEAD, of_runs, runs


def assertions(entries: DataFrame) -> DataFrame:
    """Every assertion that an entry makes: on its run, and, for a created run, on the
    workflow's current row (none before the first run, else the run before it)."""
    of_run = F.struct(F.lit("run").alias("target"), F.when(F.col("base") == -1, "must_not_exist").otherwise("version").alias("form"), F.when(F.col("base") >= 0, F.col("base")).alias("wants"))
    on_current = F.struct(
        F.lit("current").alias("target"),
        F.when(F.col("run") == 0, "must_not_exist").otherwise("equals_with_version").alias("form"),
        F.when(F.col("run") > 0, F.col("run") - 1).alias("wants"),
    )
    both = F.when(F.col("base") == -1, F.array(on_current, of_run)).otherwise(F.array(of_run))
    return (
        of_runs(entries)
        .filter(F.col("base") != NO_HEAD)
        .select("shard", "seqno", "workflow", "run", F.posexplode(both).alias("ord", "a"))
        .select("shard", "seqno", "workflow", "run", long(F.col("ord")).alias("ord"), "a.*")
    )


def chain(entries: DataFrame) -> DataFrame:
    """The version chain: every write of a run stands on the one before it."""
    order = Window.partitionBy("shard", "workflow", "run").orderBy("seqno")
    step = F.col("version") - F.coalesce(F.lag("version").over(order), long(0))
    kept = entries.filter(F.col("kind").isin("update", "snapshot")).withColumn("step", step)
    return kept.groupBy("shard").agg(F.count(F.lit(1)).alias("writes"), F.count_if(F.col("step") != 1).alias("broken"))


def base_runs(entries: DataFrame) -> DataFrame:
    """Run rows at rest at the applied position; deleted runs have none."""
    done = entries.join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter("seqno <= applied").drop("applied")
    return runs(done.withColumn("win", long(0))).filter("shape <> 'tombstone' AND version > 0").select("shard", "workflow", "run", F.col("version").alias("actual"))


def heads(entries: DataFrame) -> DataFrame:
    """The first assertion of each run in the tail; every 13th workflow's is one too high,
    as of a writer that lost a race."""
    tail = entries.join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter("seqno > applied").drop("applied")
    staled = F.when((F.col("workflow") % 13 == 0) & (F.col("base") >= 0), F.col("base") + 1).otherwise(F.col("base"))
    return runs(tail.withColumn("win", long(0))).filter(F.col("base") != NO_HEAD).select("shard", "workflow", "run", "head", "tail", long(staled).alias("base"))


def verdicts(entries: DataFrame) -> DataFrame:
    """Each head assertion against the row at rest: the message where it fails."""
    key = ["shard", "workflow", "run"]
    met = heads(entries).join(base_runs(entries), key, "left")
    message = run_verdict(F.col("workflow"), F.col("base"), F.col("actual"))
    return met.select(*key, "head", "tail", "base", "actual", message.alias("message"))


def settlement(entries: DataFrame) -> DataFrame:
    """Per workflow the first assertion that fails, by registration order, or none."""
    judged = verdicts(entries)
    failed = F.col("message").isNotNull()
    return judged.groupBy("shard", "workflow").agg(
        F.count(F.lit(1)).alias("asserted"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.col("head"))).alias("first_failure"),
        F.min_by("message", F.when(failed, F.col("head"))).alias("message"),
    )


def attribution(entries: DataFrame) -> DataFrame:
    """Of a batch that failed: how many runs diverged, and the position below which the
    log is sound."""
    return (
        verdicts(entries)
        .filter("message IS NOT NULL")
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("diverged"), (F.min("head") - 1).alias("sound_to"), F.max("tail").alias("last_tail"))
    )


def partition(entries: DataFrame) -> DataFrame:
    """Who answers each assertion of the tail: the window, if it holds the run; else the base."""
    tail = of_runs(entries).join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter("seqno > applied")
    held = F.row_number().over(Window.partitionBy("shard", "workflow", "run").orderBy("seqno")) > 1
    by = F.when(F.col("base") == NO_HEAD, "none").when(held, "window").otherwise("base")
    return tail.withColumn("by", by).groupBy("shard", "by").agg(F.count(F.lit(1)).alias("n"))


def current_verdicts(entries: DataFrame) -> DataFrame:
    """Assertions of all four kinds against the current row that each workflow ends at."""
    rows = of_runs(entries).groupBy("shard", "workflow").agg(
        F.max_by("run", "seqno").alias("run"), F.max_by("version", "seqno").alias("version"), F.max_by("kind", "seqno").alias("last_kind")
    )
    row = rows.select(
        "shard",
        "workflow",
        F.when(F.col("workflow") % 7 != 0, F.col("run")).alias("run"),
        F.when(F.col("last_kind") == "delete", 3).otherwise(2).alias("state"),
        "version",
    )
    kinds = F.array(*map(F.lit, ("must_not_exist", "equals", "not_equals", "equals_with_version")))
    asked = row.withColumn("kind", F.explode(kinds)).withColumns(
        {"want_run": F.coalesce("run", long(0)) + F.when(F.col("workflow") % 2 == 0, 0).otherwise(1), "want_version": F.col("version") - F.when(F.col("workflow") % 3 == 0, 0).otherwise(1)}
    )
    message = current_verdict(F.col("kind"), F.col("want_run"), F.col("want_version"), F.col("run"), long(F.col("state")), F.col("version"))
    return asked.select("shard", "workflow", "kind", message.alias("message"))
