"""Optimistic-concurrency conditions as columns: null where one holds, else the message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stores' wordings, which operators compare with logs.
RUN_MUST_NOT_EXIST = "Workflow %s must not exist"
RUN_MUST_EXIST = "Workflow execution %s must exist"
RUN_VERSION = "Encounter workflow db version mismatch, request db version: %s, actual db version: %s"
CURRENT_MUST_NOT_EXIST = "must not exist"
CURRENT_MUST_EXIST = "must exist"
CURRENT_EQUAL = "current run id %s must be equal to %s"
CURRENT_NOT_EQUAL = "current run id %s must not be equal to %s"
CURRENT_VERSION = (
    "state %s must be equal to %s, current run id %s must be equal to %s, last write version %s must be equal to %s"
)
COMPLETED = 3


def run_verdict(workflow: Column, base: Column, actual: Column) -> Column:
    """base: the asserted version, -1 for a run that must not exist; actual: null if absent."""
    return (
        F.when((base == -1) & actual.isNotNull(), F.format_string(RUN_MUST_NOT_EXIST, workflow.cast("string")))
        .when((base >= 0) & actual.isNull(), F.format_string(RUN_MUST_EXIST, workflow.cast("string")))
        .when((base >= 0) & (base != actual), F.format_string(RUN_VERSION, base.cast("string"), actual.cast("string")))
    )


def current_verdict(kind: Column, want_run: Column, want_version: Column, run: Column, state: Column, version: Column) -> Column:
    """kind: must_not_exist, equals, not_equals or equals_with_version; run: null if there is
    no current row. The last kind also wants the row to be completed."""
    text = lambda c: c.cast("string")
    unlike = (state != COMPLETED) | (run != want_run) | (version != want_version)
    full = F.format_string(
        CURRENT_VERSION, text(state), F.lit(str(COMPLETED)), text(run), text(want_run), text(version), text(want_version)
    )
    return (
        F.when(kind == "must_not_exist", F.when(run.isNotNull(), CURRENT_MUST_NOT_EXIST))
        .when(run.isNull(), CURRENT_MUST_EXIST)
        .when((kind == "equals") & (run != want_run), F.format_string(CURRENT_EQUAL, text(run), text(want_run)))
        .when((kind == "not_equals") & (run == want_run), F.format_string(CURRENT_NOT_EQUAL, text(run), text(want_run)))
        .when((kind == "equals_with_version") & unlike, full)
    )


def verdict_class(error: Column) -> Column:
    """What an outcome of the sink means; anything unnamed is unknown."""
    return (
        F.when(error.isNull(), "committed")
        .when(error == "refused", "refused")
        .when(error == "ownership_lost", "shard_lost")
        .when(error.isin("current_condition", "workflow_condition", "condition"), "invariant_violated")
        .otherwise("unknown")
    )
