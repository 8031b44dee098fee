"""The record of a run's calls: two JSON lines a call, one before it and one with its outcome.

A recorder may die in the middle of a line: a last line that doesn't end is dropped, as of
a call that was never made or whose outcome isn't known. A whole line that isn't a record is
an error, as the record then tells nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = "phase string, shard long, call long, workflow long, run long, kind string, outcome string"


def write(calls: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """calls: shard, call, workflow, run, kind; outcomes: shard, call, outcome."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    made = calls.select(F.lit("call").alias("phase"), "shard", "call", "workflow", "run", "kind", null("string", "outcome"))
    done = outcomes.select(
        F.lit("outcome").alias("phase"), "shard", "call", null("long", "workflow"), null("long", "run"), null("string", "kind"), "outcome"
    )
    made.unionByName(done).select(F.to_json(F.struct("*"))).write.text(folder)


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The calls and the outcomes of a record."""
    lines = spark.read.text(folder, wholetext=False).select(F.from_json("value", CALL, {"mode": "PERMISSIVE"}).alias("r"), "value")
    whole = F.col("value").rlike(r"^\{.*\}\s*$")
    legal = F.col("r.phase").isin("call", "outcome") & F.col("r.call").isNotNull()
    checked = lines.filter(whole).select(
        F.when(F.coalesce(legal, F.lit(False)), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.col("value")))).alias("r")
    )
    rows = checked.select("r.*")
    return rows.filter("phase = 'call'").drop("phase", "outcome"), rows.filter("phase = 'outcome'").select("shard", "call", "outcome")


def matched(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Calls with their outcomes; a call without one is unknown, never refused."""
    return calls.join(outcomes, ["shard", "call"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))
