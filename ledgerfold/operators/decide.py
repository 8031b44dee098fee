"""The decisions of a drain loop, as pure columns over small domains."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domain(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the given values, as literal rows."""
    kinds = {str: "string", int: "long"}
    schema = ", ".join(f"{name} {kinds[type(options[0])]}" for name, options in values.items())
    return spark.createDataFrame(list(product(*values.values())), schema)


def write_refusal(stalled: Column, pressure: Column, entries: Column, bytes_: Column, max_entries: Column, max_bytes: Column) -> Column:
    """pressure: 0 none, 1 drain, 2 stop. The tail is counted without the write at hand."""
    return (
        F.when(stalled == 1, "unresolved")
        .when(pressure >= 2, "storage_pressure")
        .when(bytes_ >= max_bytes, "bytes")
        .when(entries >= max_entries, "entries")
        .otherwise("accept")
    )


def append_outcome(error: Column) -> Column:
    return (
        F.when(error == "none", "accept")
        .when(error == "fenced", "halt_lost")
        .when(error == "already_written", "halt_invariant")
        .when(error == "gap", "not_written")
        .otherwise("read_back")
    )


def read_back(found: Column) -> Column:
    """After an append of unknown outcome, by what is at its position."""
    return F.when(found == "absent", "return_error").when(found == "own", "accept").otherwise("halt_invariant")


def settlement(outcome: Column, window: Column, waits: Column, provisional: Column) -> Column:
    alone = window == 1
    return (
        F.when(outcome == "committed", "forward")
        .when(outcome == "unknown", "ask_watermark")
        .when(outcome == "shard_lost", "halt_lost")
        .when((outcome == "invariant_violated") & alone & (waits == 1), "answer_writer")
        .when((outcome == "invariant_violated") & alone & (provisional == 1), "drop_entry")
        .otherwise("halt_invariant")
    )


def unknown_outcome(readable: Column, watermark: Column, seqno: Column) -> Column:
    """watermark: null if there is none."""
    return (
        F.when(readable == 0, "stall")
        .when(watermark.isNull() | (watermark < seqno), "halt_invariant")
        .when(watermark > seqno, "halt_lost")
        .otherwise("committed")
    )


def tick(running: Column, stalled: Column, started: Column, pressure: Column, aged: Column, empty: Column) -> Column:
    urgent = (started == 1) & (pressure >= 1)
    return (
        F.when((running == 0) | (stalled == 1), "nothing")
        .when(urgent & (empty == 1), "force_trim")
        .when(urgent, "drain_pressure")
        .when(aged == 1, "drain_age")
        .otherwise("nothing")
    )


def read_route(state: Column, reader: Column, stalled: Column, tail_empty: Column) -> Column:
    """state: no_cycle, running, halted_lost, halted_invariant or retired; reader: state (it
    may be answered stale) or task (a short page would lose tasks)."""
    task = reader == "task"
    by_tail = F.when(tail_empty == 1, "pass_through")
    return (
        F.when(state == "no_cycle", F.when(task, "lost").otherwise("pass_through"))
        .when(state == "running", F.when(stalled == 1, "unresolved").otherwise("merge"))
        .when(state == "halted_lost", F.when(task, "lost").otherwise(F.coalesce(by_tail, F.lit("lost"))))
        .when(state == "halted_invariant", F.when(task, "halt").otherwise(F.coalesce(by_tail, F.lit("halt"))))
        .otherwise(F.when(task, "lost").otherwise(F.coalesce(by_tail, F.lit("halt"))))
    )


def superseded(still_current: Column, retried: Column) -> Column:
    return F.when(still_current == 1, "merge").when(retried == 0, "retry_on_successor").otherwise("lost")


def drain_cause(sync: Column, detached: Column, trip: Column, rule: Column) -> Column:
    """Why a drain ran: replay and refusal rules name it before its trigger does."""
    return (
        F.when(rule.isin("replay", "refusal", "explicit", "read"), rule)
        .when(sync == 1, "sync")
        .when((detached == 1) & (trip == "none"), "detached")
        .otherwise(trip)
    )


def store_boundary(error: Column) -> Column:
    """What a caller of the store sees of an error of the loop."""
    return F.when(error == "none", "none").when(error == "halted_lost", "ownership_lost").otherwise(error)
