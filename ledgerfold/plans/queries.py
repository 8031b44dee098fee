"""The registered queries over the log view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.conditions import verdict_class
from ..operators import authority, decide, fold, history, life, log, metrics, overlay, queues
from ..sources import views
from ..sources.views import long, read

Query = Callable[[SparkSession, str], DataFrame]


def on_log(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(views.log(read(spark, sf_dir, "events")))


def at_rest(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read the log several times: it is written first."""
    return lambda spark, sf_dir: operator(views.at_rest(views.log(read(spark, sf_dir, "events"))))


def twice(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read the log about twice: a large one is written first."""
    return lambda spark, sf_dir: operator(views.at_rest(views.log(read(spark, sf_dir, "events")), often=False))


def on_nodes(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(views.history_nodes(read(spark, sf_dir, "conversations")))


def entries(df: DataFrame) -> DataFrame:
    return df.select("shard", "seqno", "epoch", "win", "workflow", "run", "version", "kind", "size")


def task_slots(df: DataFrame) -> DataFrame:
    return views.tasks(df).select("shard", "seqno", "slot", "category", long(F.unix_micros("fire_time")).alias("fire_us"), "task_id")


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").cast("timestamp").alias("fire_time"))
    return queues.scheduled_cover(orders, "1995-01-01 00:00:00", "1996-01-01 00:00:00")


def history_upsert(nodes: DataFrame) -> DataFrame:
    again = nodes.filter("node % 2 = 0").withColumn("events", F.concat("events", F.lit("!")))
    out = queues.upsert_nodes(nodes, again)
    return out.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.sum("turn").alias("rewritten"), F.sum(F.length("events")).alias("chars"))


def set_changes(df: DataFrame) -> DataFrame:
    """Sets of keys that a run's windows write, merged with and less what they delete."""
    sets = fold.items(df).groupBy("shard", "workflow", "run").agg(
        F.collect_set(F.when(F.col("op") == "U", F.col("key"))).alias("u"), F.collect_set(F.when(F.col("op") == "D", F.col("key"))).alias("d")
    )
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return sets.select("shard", "workflow", "run", text(F.array_union("u", "d")).alias("touched"), text(F.array_except("u", "d")).alias("kept"))


def codec_round_trip(df: DataFrame) -> DataFrame:
    """Records that come back as they were, by kind: the arm, its parts with their versions,
    keys and values, tasks, ranges and events."""
    back = codec.decode(codec.encode(df))
    same = df.select("shard", "seqno", F.col("kind").alias("k0"), F.col("version").alias("v0"), F.col("run").alias("r0"), F.col("workflow").alias("w0"), "key", "op", "value", "k")
    c = F.col
    part = F.when(c("kind") == "set", c("set.parts")[0]).otherwise(c("update.parts")[0])
    written = F.when(c("op") == "U", F.concat(c("key").cast("string"), F.lit("="), c("value").cast("string")))
    held = F.array_join(F.transform(part["upserts"], lambda u: F.concat(u["key"].cast("string"), F.lit("="), u["value"].cast("string"))), ",")
    gone = F.coalesce(c("op") == "D", F.lit(False))
    parts = (part["version"] == c("v0")) & (part["run"] == c("r0")) & (held == F.coalesce(written, F.lit(""))) & (F.size(part["deletes"]) == gone.cast("int"))
    ok = (
        F.when(c("k0") == "update", (c("kind") == "update") & parts & (F.size("update.events") == (c("k") % 5 == 0).cast("int")))
        .when(c("k0") == "snapshot", (c("kind") == "set") & parts)
        .when(c("k0") == "delete", (c("delete.workflow") == c("w0")) & (c("delete.run") == c("r0")))
        .when(c("k0") == "add_tasks", (F.size("add_tasks.tasks") == 1 + (c("k") % 2 == 0).cast("int")) & (c("add_tasks.tasks")[0]["task_id"] == c("seqno")))
        .otherwise((c("kind") == "range_complete") & (c("range_complete.ranges")[0]["hi"] == c("seqno")))
    )
    ok &= c("reason").isNull() & (c("of_shard") == c("shard"))
    return back.join(same, ["shard", "seqno"]).groupBy(c("k0").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("same"))


def history_validity(nodes: DataFrame) -> DataFrame:
    return codec.history_validity(nodes).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cursors(df: DataFrame) -> DataFrame:
    """Cursors of the last row of each page, read back; and that a base's own is foreign."""
    last = queues.page(df).groupBy("shard", "category").agg(F.max_by(F.struct("fire_us", "task_id"), "ord").alias("at"))
    cur = last.select("shard", "category", codec.cursor(F.col("category"), F.col("at.fire_us"), F.col("at.task_id")).alias("c"))
    own, foreign = codec.parse_cursor(F.col("c")), codec.parse_cursor(F.concat(F.lit("x"), F.col("c")))
    return cur.select("shard", "category", own["task_id"].alias("task_id"), own["fire_us"].alias("fire_us"), long(foreign.isNull()).alias("foreign_refused"))


def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, stalled=[0, 1], pressure=[0, 1, 2], entries=[0, 8191, 8192], bytes=[0, 8388607, 8388608])
    c = F.col
    return d.withColumn("verdict", decide.write_refusal(c("stalled"), c("pressure"), c("entries"), c("bytes"), long(8192), long(8388608)))


def append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, error=["none", "fenced", "already_written", "gap", "timeout"], found=["absent", "own", "foreign", "unreadable"])
    return d.select("error", "found", decide.append_outcome(F.col("error")).alias("outcome"), decide.read_back(F.col("found")).alias("read_back"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(
        spark, outcome=["committed", "unknown", "shard_lost", "invariant_violated", "refused"], window=[1, 256], waits=[0, 1], provisional=[0, 1]
    )
    return d.withColumn("action", decide.settlement(*map(F.col, ("outcome", "window", "waits", "provisional"))))


def unknown_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, readable=[0, 1], at=[-1, 5, 7, 9], seqno=[7])
    mark = F.when(F.col("at") >= 0, F.col("at"))
    return d.withColumn("resolution", decide.unknown_outcome(F.col("readable"), mark, F.col("seqno")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, running=[0, 1], stalled=[0, 1], started=[0, 1], pressure=[0, 1, 2], aged=[0, 1], empty=[0, 1])
    return d.withColumn("action", decide.tick(*map(F.col, ("running", "stalled", "started", "pressure", "aged", "empty"))))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(
        spark, state=["no_cycle", "running", "halted_lost", "halted_invariant", "retired"], reader=["state", "task"], stalled=[0, 1], tail_empty=[0, 1]
    )
    return d.withColumn("route", decide.read_route(*map(F.col, ("state", "reader", "stalled", "tail_empty"))))


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, still_current=[0, 1], retried=[0, 1])
    return d.withColumn("route", decide.superseded(F.col("still_current"), F.col("retried")))


def drain_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(
        spark,
        sync=[0, 1],
        detached=[0, 1],
        trip=["mutations", "bytes", "age", "storage_pressure", "none"],
        rule=["none", "replay", "refusal", "explicit", "read"],
    )
    return d.withColumn("cause", decide.drain_cause(*map(F.col, ("sync", "detached", "trip", "rule"))))


def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = ["none", "refused", "ownership_lost", "current_condition", "workflow_condition", "condition", "timeout", "halted_lost"]
    d = decide.domain(spark, error=errors)
    known = F.when(F.col("error") != "none", F.col("error"))
    return d.select("error", verdict_class(known).alias("class"), decide.store_boundary(F.col("error")).alias("at_store"))


def exact_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.cycle import exact_windows

    return exact_windows(views.log(read(spark, sf_dir, "events")))


def exact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of a seeded corpus of all kinds, with as many mutations as there are events."""
    from ..sources.generator import corpus
    from ..streaming import accumulator

    n = read(spark, sf_dir, "events").count()
    return accumulator.exact_requests(corpus(spark, 20260730, max(1, n // views.SHARDS), views.SHARDS))


def stream_drains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.drain import drained_items

    return drained_items(spark, views.log(read(spark, sf_dir, "events")))


def stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.drain import drained_sums

    return drained_sums(spark, views.log(read(spark, sf_dir, "events")))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.domain(spark, readable=[0, 1], replay=["ok", "lost", "stranded", "log_error"])
    return d.withColumn("action", life.start_gate(F.col("readable"), F.col("replay")))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("halted", "own_shard", "started", "refusal", "holds", "append", "fold")
    d = decide.domain(
        spark,
        halted=[0, 1],
        own_shard=[0, 1],
        started=[0, 1],
        refusal=["accept", "bytes"],
        holds=[0, 1],
        append=["accept", "halt_lost"],
        fold=["ok", "refused", "refused_twice"],
    )
    return d.withColumn("ends", life.write_path(*map(F.col, names)))


QUERIES: dict[str, Query] = {
    "log_entries": on_log(entries),
    "log_read_from": on_log(lambda df: entries(log.read_from(df, 1, 100, 50))),
    "log_point_read": on_log(lambda df: entries(log.entry_at(df, 42))),
    "log_append_verdict": on_log(log.append_verdicts),
    "log_gap_dup_audit": twice(log.audit),
    "log_trim": twice(log.trim),
    "replay_tail": twice(log.replay),
    "kind_counts": on_log(log.totals),
    "stream_report": on_log(log.stream_report),
    "positions_lag": twice(log.positions),
    "acked_read_back": twice(log.acked_audit),
    "replay_report": twice(life.replay_report),
    "halts_first": twice(life.halts),
    "tail_account": twice(life.tail_account),
    "trim_points": on_log(life.trim_points),
    "running_tail": twice(log.running_tail),
    "shutdown_residue": on_log(metrics.lag),
    "task_slots_flat": on_log(task_slots),
    "window_stats": on_log(fold.windows),
    "fold_runs": on_log(fold.shapes),
    "fold_items_lww": on_log(fold.items),
    "fold_current_row": on_log(fold.current),
    "fold_requests_emitted": on_log(fold.requests),
    "fold_tombstones": twice(fold.tombstones),
    "fold_buffered": on_log(fold.buffered),
    "fold_set_changes": on_log(set_changes),
    "batch_watermark": on_log(fold.watermarks),
    "window_coverage": on_log(fold.coverage),
    "overlay_runs": twice(overlay.overlay_runs),
    "overlay_items": twice(overlay.overlay_items),
    "overlay_current": twice(overlay.overlay_current),
    "overlay_equals_fold": at_rest(overlay.overlay_differences),
    "oracle_window_equivalence": at_rest(overlay.equivalence),
    "apply_runs_final": on_log(overlay.final_runs),
    "apply_items_final": twice(overlay.final_items),
    "apply_current_final": on_log(overlay.final_current),
    "apply_tasks_final": at_rest(overlay.final_tasks),
    "apply_guarded_deletes": twice(overlay.guarded_deletes),
    "task_sweep_counts": at_rest(queues.sweep_counts),
    "task_ranges_coalesced": twice(queues.islands),
    "task_hide_deleted": at_rest(queues.hidden),
    "task_page_merge": at_rest(queues.page),
    "task_page_next": at_rest(lambda df: queues.next_page(df, 200, views.PAGE_AFTER)),
    "task_collisions": at_rest(queues.collisions),
    "task_cursors": at_rest(cursors),
    "base_page_audit": at_rest(lambda df: queues.page_audit(queues.base_pages(df))),
    "scheduled_range_cover": timers,
    "history_batch_order": on_log(history.collected),
    "history_branch_nodes": on_log(lambda df: history.branch_page(df, 1)),
    "history_event_slots": twice(history.slot_counts),
    "history_page_forward": on_nodes(queues.history_page),
    "history_page_reverse": on_nodes(lambda n: queues.history_page(n, reverse=True)),
    "history_metadata_only": on_nodes(lambda n: queues.history_page(n.filter("node >= 2 AND node < 5"), metadata_only=True)),
    "history_upsert": on_nodes(history_upsert),
    "history_validity": on_nodes(history_validity),
    "assertions_derived": on_log(authority.assertions),
    "version_chain": on_log(authority.chain),
    "assertion_verdicts": twice(authority.verdicts),
    "current_verdicts": on_log(authority.current_verdicts),
    "authority_partition": twice(authority.partition),
    "settlement_first_failure": twice(authority.settlement),
    "divergence_attribution": twice(authority.attribution),
    "codec_round_trip": twice(codec_round_trip),
    "call_outcomes": twice(metrics.matched_calls),
    "effects_identified": on_log(metrics.effects),
    "drain_metrics": at_rest(metrics.series),
    "witness_claims": at_rest(metrics.claims),
    "backpressure_decision": backpressure,
    "append_outcome": append_outcomes,
    "settlement_decision": settlements,
    "unknown_outcome_resolve": unknown_outcomes,
    "tick_decision": ticks,
    "read_routing": routes,
    "superseded_routing": superseded,
    "drain_causes": drain_causes,
    "start_gate": starts,
    "write_path": writes,
    "outcome_classes": outcome_classes,
    "fold_exact_cycle": exact_cycle,
    "fold_exact_requests": exact_requests,
    "stream_fold_state": stream_drains,
    "stream_tables_state": stream_tables,
}
