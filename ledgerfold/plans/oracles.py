"""DuckDB twins of the registered queries, written from their definitions."""

from __future__ import annotations

from ..functions import conditions as c
from ..sources.views import EPOCH, PAGE_AFTER, SHARDS, WINDOW

_LOG = f"""
e0 AS (
  SELECT user_id % {SHARDS} + 1 AS shard, user_id AS workflow, event_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(length(props) + 64 AS BIGINT) AS size
  FROM events),
e1 AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'snapshot'
         WHEN event_type = 'purchase' AND k < 80 THEN 'add_tasks' WHEN event_type = 'purchase' THEN 'range_complete'
         ELSE 'update' END AS kind,
         row_number() OVER (PARTITION BY shard ORDER BY event_id) AS seqno
  FROM e0),
e2 AS (
  SELECT *, CAST(coalesce(sum((kind = 'delete')::BIGINT) OVER (
      PARTITION BY shard, workflow ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
  FROM e1),
log AS (
  SELECT shard, seqno, 1 + seqno // {EPOCH} AS owner,
         1 + seqno // {EPOCH} - (event_type = 'error' AND k < 5)::BIGINT AS epoch, (seqno - 1) // {WINDOW} AS win,
         workflow, run,
         CAST(sum((kind IN ('update', 'snapshot'))::BIGINT) OVER (
           PARTITION BY shard, workflow, run ORDER BY seqno ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version,
         kind, k, CASE WHEN kind <> 'update' THEN NULL WHEN event_type = 'click' AND k % 3 = 0 THEN 'D' ELSE 'U' END AS op,
         CASE WHEN kind = 'update' THEN k % 10 END AS key,
         CASE WHEN kind = 'update' AND NOT (event_type = 'click' AND k % 3 = 0) THEN value END AS value, ts, size
  FROM e2),
cuts AS (SELECT shard, max(seqno) AS last, max(seqno) * 3 // 5 AS applied FROM log GROUP BY shard),
tasks AS (
  SELECT *, CASE WHEN category = 1 THEN task_id ELSE CAST(epoch_us(fire_time) AS BIGINT) END AS "at" FROM (
    SELECT shard, win, seqno, workflow, run, 0::BIGINT AS slot, 1::BIGINT AS category, NULL::TIMESTAMP AS fire_time, seqno AS task_id
    FROM log WHERE kind = 'add_tasks'
    UNION ALL
    SELECT shard, win, seqno, workflow, run, 1, 2, ts + to_minutes(k), seqno FROM log WHERE kind = 'add_tasks' AND k % 2 = 0)),
ranges AS (
  SELECT shard, win, seqno, 1::BIGINT AS category, seqno - 64 AS lo, seqno + CASE WHEN k >= 90 THEN 32 ELSE 0 END AS hi
  FROM log WHERE kind = 'range_complete'
  UNION ALL
  SELECT shard, win, seqno, 2, CAST(epoch_us(ts) AS BIGINT) - 5400000000, CAST(epoch_us(ts) AS BIGINT) + CASE WHEN k >= 90 THEN 1800000000 ELSE 0 END
  FROM log WHERE kind = 'range_complete' AND k % 2 = 0),
mine AS (
  SELECT *, CASE WHEN kind = 'delete' THEN -2 WHEN version = 1 THEN -1 ELSE version - 1 END AS base
  FROM log WHERE kind IN ('update', 'snapshot', 'delete'))
"""


def _runs(source: str, win: str = "win") -> str:
    """Runs of the entries of a relation, by window."""
    return f"""(SELECT shard, win, workflow, run, mutations, head, tail, base, version, barrier,
      CASE WHEN last_kind = 'delete' THEN 'tombstone' WHEN barrier > 0 THEN 'snapshot' ELSE 'delta' END AS shape
    FROM (SELECT shard, {win} AS win, workflow, run, count(*) AS mutations, min(seqno) AS head, max(seqno) AS tail,
      arg_min(base, seqno) AS base, max(version) AS version, arg_max(kind, seqno) AS last_kind,
      coalesce(max(CASE WHEN kind = 'snapshot' THEN seqno END), 0) AS barrier FROM {source} GROUP BY ALL))"""


def _items(source: str, win: str = "win") -> str:
    return f"""(SELECT shard, win, workflow, run, key, op, value, seqno FROM (
      SELECT *, row_number() OVER (PARTITION BY shard, win, workflow, run, key ORDER BY seqno DESC) AS nth FROM (
        SELECT shard, {win} AS win, workflow, run, key, op, value, seqno,
          coalesce(max(CASE WHEN kind = 'snapshot' THEN seqno END) OVER w, 0) AS barrier,
          max((kind = 'delete')::BIGINT) OVER w AS gone
        FROM {source} WINDOW w AS (PARTITION BY shard, {win}, workflow, run))
      WHERE op IS NOT NULL AND seqno > barrier AND gone = 0) WHERE nth = 1)"""


def _current(source: str, win: str = "win") -> str:
    return f"""(SELECT shard, {win} AS win, workflow, arg_min(run, seqno) AS asserted_run, arg_min(base, seqno) AS asserted_base,
      arg_max(run, seqno) AS run, arg_max(version, seqno) AS version, (arg_max(kind, seqno) = 'delete')::BIGINT AS removed
    FROM {source} GROUP BY ALL)"""


_SIDES = """
before_cut AS (SELECT mine.* FROM mine JOIN cuts USING (shard) WHERE seqno <= applied),
after_cut AS (SELECT mine.* FROM mine JOIN cuts USING (shard) WHERE seqno > applied)"""

_QUEUES = """
swept AS (
  SELECT t.* FROM tasks t WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.shard = t.shard AND r.win = t.win AND r.category = t.category
      AND t."at" >= r.lo AND t."at" < r.hi AND t.seqno < r.seqno)),
base_tasks AS (
  SELECT t.* FROM tasks t JOIN cuts c ON c.shard = t.shard AND t.seqno <= c.applied WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.shard = t.shard AND r.seqno <= c.applied AND r.category = t.category
      AND t."at" >= r.lo AND t."at" < r.hi AND t.seqno < r.seqno)),
tail_ranges AS (SELECT r.* FROM ranges r JOIN cuts c ON c.shard = r.shard AND r.seqno > c.applied),
visible AS (
  SELECT t.* FROM base_tasks t WHERE NOT EXISTS (
    SELECT 1 FROM tail_ranges r WHERE r.shard = t.shard AND r.category = t.category AND t."at" >= r.lo AND t."at" < r.hi)),
tail_tasks AS (
  SELECT t.* FROM tasks t JOIN cuts c ON c.shard = t.shard AND t.seqno > c.applied - 10 WHERE NOT EXISTS (
    SELECT 1 FROM tail_ranges r WHERE r.shard = t.shard AND r.category = t.category
      AND t."at" >= r.lo AND t."at" < r.hi AND t.seqno < r.seqno)),
merged AS (
  SELECT shard, category, fire_time, "at", task_id, min(side) AS side, count(*) AS copies, arg_min(workflow, side) AS workflow
  FROM (SELECT *, 0::BIGINT AS side FROM visible UNION ALL SELECT *, 1 FROM tail_tasks) GROUP BY ALL)"""

_NODES = """nodes AS (
  SELECT conv_id AS tree, turn AS node, CAST(length(text) % 7 AS BIGINT) AS txn, text AS events FROM conversations)"""

_VERDICTS = f"""
base_runs AS (
  SELECT shard, workflow, run, version AS actual FROM {_runs("before_cut", "0")} WHERE shape <> 'tombstone' AND version > 0),
heads AS (
  SELECT shard, workflow, run, head, tail, CASE WHEN workflow % 13 = 0 AND base >= 0 THEN base + 1 ELSE base END AS base
  FROM {_runs("after_cut", "0")} WHERE base <> -2),
verdicts AS (
  SELECT h.*, actual, CASE
    WHEN base = -1 AND actual IS NOT NULL THEN printf('{c.RUN_MUST_NOT_EXIST}', workflow::VARCHAR)
    WHEN base >= 0 AND actual IS NULL THEN printf('{c.RUN_MUST_EXIST}', workflow::VARCHAR)
    WHEN base >= 0 AND base <> actual THEN printf('{c.RUN_VERSION}', base::VARCHAR, actual::VARCHAR) END AS message
  FROM heads h LEFT JOIN base_runs USING (shard, workflow, run))"""


def _final_items(runs: str, items: str) -> str:
    return f"""(SELECT shard, workflow, run, key, value FROM (
      SELECT i.*, row_number() OVER (PARTITION BY i.shard, i.workflow, i.run, i.key ORDER BY i.win DESC) AS nth
      FROM {items} i JOIN (
        SELECT shard, workflow, run, max(CASE WHEN barrier > 0 THEN win END) AS reset, max((shape = 'tombstone')::BIGINT) AS gone
        FROM {runs} GROUP BY ALL) f USING (shard, workflow, run)
      WHERE gone = 0 AND i.win >= coalesce(reset, 0)) WHERE nth = 1 AND op = 'U')"""


_FINAL_RUNS = f"""(SELECT shard, workflow, run, max(version) AS version, max(tail) AS last_seqno,
    count(*) AS transactions, CAST(sum(mutations) AS BIGINT) AS mutations
  FROM {_runs("mine")} GROUP BY ALL HAVING max((shape = 'tombstone')::BIGINT) = 0 AND max(version) > 0)"""

_FINAL_CURRENT = f"""(SELECT shard, workflow, run, version FROM (
    SELECT *, row_number() OVER (PARTITION BY shard, workflow ORDER BY win DESC) AS nth FROM {_current("mine")})
  WHERE nth = 1 AND removed = 0)"""

_FINAL_TASKS = """(SELECT t.* FROM tasks t WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.shard = t.shard AND r.category = t.category AND t."at" >= r.lo AND t."at" < r.hi AND t.seqno < r.seqno))"""

_FINAL_BUFFERED = """(SELECT * FROM (SELECT *, coalesce(max(CASE WHEN kind = 'snapshot' THEN seqno END) OVER w, 0) AS barrier,
      max((kind = 'delete')::BIGINT) OVER w AS gone FROM mine WINDOW w AS (PARTITION BY shard, workflow, run))
    WHERE kind = 'update' AND k >= 90 AND seqno > barrier AND gone = 0)"""

_BATCHES = """batches AS (
  SELECT shard, win, seqno, ordinal, workflow AS tree, run % 2 AS branch, version + ordinal AS node, seqno AS txn,
    CASE ordinal WHEN 0 THEN 'e' ELSE 'n' END || k::VARCHAR AS events
  FROM log CROSS JOIN (SELECT unnest([0::BIGINT, 1::BIGINT]) AS ordinal)
  WHERE kind = 'update' AND k % 5 = 0 AND (ordinal = 0 OR k % 10 = 0))"""

_REPLAY = """marked AS (
  SELECT log.*, applied, CASE WHEN kind = 'update' AND k = 33 THEN 'undecodable' WHEN kind = 'update' AND k = 34 THEN 'foreign_shard' END AS fault
  FROM log JOIN cuts USING (shard) WHERE seqno > applied),
replayed AS (
  SELECT m.*, CASE WHEN seqno > halt_at THEN 'unreached' WHEN seqno = halt_at THEN 'stranded'
    WHEN epoch < owner AND workflow % 13 = 0 THEN 'dropped' WHEN epoch < owner THEN 'alone' ELSE 'folded' END AS outcome
  FROM marked m LEFT JOIN (SELECT shard, min(seqno) AS halt_at FROM marked WHERE fault IS NOT NULL GROUP BY shard) USING (shard)),
reports AS (
  SELECT shard, count(*) FILTER (outcome = 'folded') AS folded, count(*) FILTER (outcome = 'alone') AS alone,
    count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'stranded') AS stranded,
    count(*) FILTER (outcome = 'unreached') AS unreached,
    coalesce(min(seqno) FILTER (outcome = 'stranded'), 0) AS halted_at, coalesce(min(fault) FILTER (outcome = 'stranded'), 'none') AS why,
    coalesce(max(seqno) FILTER (outcome IN ('folded', 'alone')), min(applied)) AS applied,
    CAST(coalesce(sum(size) FILTER (outcome = 'stranded'), 0) AS BIGINT) AS tail_bytes
  FROM replayed GROUP BY shard),
ended AS (
  SELECT shard, coalesce(halted_at, 0) AS halted_at, coalesce(state, 'running') AS state, coalesce(later, 0) AS later
  FROM (SELECT DISTINCT shard FROM log) LEFT JOIN (
    SELECT shard, min(seqno) AS halted_at, arg_min(CASE k WHEN 97 THEN 'halted_lost' ELSE 'halted_invariant' END, seqno) AS state, count(*) - 1 AS later
    FROM log WHERE kind = 'update' AND k IN (97, 98) GROUP BY shard) USING (shard))"""

_OVERLAY_ITEMS = f"""
reset AS (SELECT shard, workflow, run FROM {_runs("after_cut", "0")} WHERE shape <> 'delta'),
upper_items AS (SELECT * FROM {_items("after_cut", "0")}),
overlay_items AS (
  SELECT shard, workflow, run, key, value FROM {_items("before_cut", "0")} b WHERE op = 'U'
    AND NOT EXISTS (SELECT 1 FROM reset r WHERE (r.shard, r.workflow, r.run) = (b.shard, b.workflow, b.run))
    AND NOT EXISTS (SELECT 1 FROM upper_items u WHERE (u.shard, u.workflow, u.run, u.key) = (b.shard, b.workflow, b.run, b.key))
  UNION ALL SELECT shard, workflow, run, key, value FROM upper_items WHERE op = 'U')"""


def _values(**domains: list) -> str:
    """A cross product of literal values."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT"
    parts = [f"(SELECT unnest([{', '.join(map(lit, v))}]) AS {name})" for name, v in domains.items()]
    return " CROSS JOIN ".join(parts)


def _log(body: str, *more: str) -> str:
    return f"WITH {', '.join([_LOG, *more])} {body}"


def _recursive(body: str, *more: str) -> str:
    return _log(body, *more).replace("WITH", "WITH RECURSIVE", 1)


_ENTRY = "shard, seqno, epoch, win, workflow, run, version, kind, size"
_PAGE = "shard, category, ord, CAST(epoch_us(fire_time) AS BIGINT) AS fire_us, task_id, workflow, side"


def _history(direction: str, columns: str, where: str = "TRUE") -> str:
    return f"""WITH {_NODES}, once AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node, txn ORDER BY side, events) AS nth FROM (
        SELECT *, 0::BIGINT AS side FROM nodes WHERE node <= 3 AND {where}
        UNION ALL SELECT *, 1 FROM nodes WHERE node >= 3 AND {where})) WHERE nth = 1)
    SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY {direction}) AS ord FROM once) WHERE ord <= 3"""


def _differ(name: str, a: str, b: str, columns: str) -> str:
    return f"""SELECT '{name}' AS tables,
      (SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})) AS only_folded,
      (SELECT count(*) FROM (SELECT {columns} FROM {b} EXCEPT ALL SELECT {columns} FROM {a})) AS only_single"""


def _series() -> str:
    of = lambda source, name, tag, value: f"SELECT shard, '{name}' AS name, {tag} AS tag, CAST({value} AS BIGINT) AS value FROM {source}"
    return " UNION ALL ".join(
        [
            of("(SELECT shard, kind, count(*) AS n FROM log GROUP BY ALL)", "intercepted_writes", "kind", "n"),
            of("(SELECT shard, trigger, count(*) AS n FROM stats GROUP BY ALL)", "drains", "trigger", "n"),
            of("(SELECT shard, sum(mutations) AS n FROM stats GROUP BY ALL)", "drained_mutations", "'-'", "n"),
            of("(SELECT shard, sum(workflows) AS n FROM stats GROUP BY ALL)", "drained_workflows", "'-'", "n"),
            of("(SELECT shard, category, sum(written) AS n FROM sweeps GROUP BY ALL)", "written_tasks", "category::VARCHAR", "n"),
            of("(SELECT shard, category, sum(dropped) AS n FROM sweeps GROUP BY ALL)", "dropped_tasks", "category::VARCHAR", "n"),
            of("tail", "tail_entries", "'-'", "entries"),
            of("tail", "tail_bytes", "'-'", "bytes"),
            of("tail", "unapplied_entries", "'-'", "last - applied"),
            of("tail", "backpressure_refusals", "'entries'", "greatest(entries - 8192, 0)"),
            of("(SELECT shard, category, count(*) FILTER (copies > 1) AS n FROM merged GROUP BY ALL)", "merged_task_collisions", "category::VARCHAR", "n"),
            of("(SELECT shard, category, count(*) AS n FROM merged GROUP BY ALL)", "merged_task_pages", "category::VARCHAR", "ceil(n / 50)"),
            of("(SELECT shard, count(*) // 16 AS n FROM stats GROUP BY ALL)", "trims", "'-'", "n"),
            of("(SELECT shard, sum(us) AS n FROM (SELECT shard, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM log GROUP BY shard, win) GROUP BY shard)", "window_age", "'-'", "n"),
            of("(SELECT shard, count(*) FILTER (k = 1 AND epoch >= owner) AS n FROM log GROUP BY shard)", "answered_condition_failures", "'-'", "n"),
            of("(SELECT shard, count(*) FILTER (kind = 'update' AND k % 4 = 1) AS n FROM log JOIN cuts USING (shard) WHERE seqno > applied GROUP BY shard)", "overlaid_reads", "'-'", "n"),
            of("(SELECT * FROM ended WHERE state <> 'running')", "halts", "state", "1"),
            of("reports", "replayed_entries", "'-'", "folded + alone + dropped"),
            of("reports", "replay_dropped_entries", "'-'", "dropped"),
        ]
    )


_STATS = """stats AS (
  SELECT shard, win, count(*) AS mutations, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT workflow) AS workflows,
    round(count(*) / count(DISTINCT workflow), 6) AS collapse,
    CASE WHEN count(*) >= 256 THEN 'mutations' WHEN sum(size) >= 262144 THEN 'bytes' ELSE 'age' END AS trigger
  FROM log GROUP BY ALL)"""
_SWEEPS = """sweeps AS (
  SELECT shard, win, category, coalesce(kept, 0) AS written, n - coalesce(kept, 0) AS dropped
  FROM (SELECT shard, win, category, count(*) AS n FROM tasks GROUP BY ALL)
  LEFT JOIN (SELECT shard, win, category, count(*) AS kept FROM swept GROUP BY ALL) USING (shard, win, category))"""
_TAIL = """tail AS (
  SELECT shard, applied, last, count(*) FILTER (seqno > applied) AS entries,
    CAST(coalesce(sum(size) FILTER (seqno > applied), 0) AS BIGINT) AS bytes
  FROM log JOIN cuts USING (shard) GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "log_entries": _log(f"SELECT {_ENTRY} FROM log"),
    "log_read_from": _log(f"SELECT {_ENTRY} FROM log WHERE shard = 1 AND seqno >= 100 ORDER BY seqno LIMIT 50"),
    "log_point_read": _log(f"SELECT {_ENTRY} FROM log WHERE seqno = 42"),
    "log_append_verdict": _log(
        """SELECT shard, seqno, epoch, tried, CASE WHEN epoch = 0 THEN 'zero_epoch' WHEN tried < 1 THEN 'bad_seqno'
          WHEN owner = 0 THEN 'unfenced' WHEN owner <> epoch THEN 'fenced' WHEN tried < seqno THEN 'already_written'
          WHEN tried > seqno THEN 'gap' ELSE 'accepted' END AS verdict
        FROM (SELECT *, seqno + CASE k WHEN 7 THEN -1 WHEN 11 THEN 2 ELSE 0 END AS tried FROM log)"""
    ),
    "log_gap_dup_audit": _log(
        """SELECT * FROM (SELECT shard, seqno, tried,
          CASE WHEN tried - lag(tried) OVER w < 1 THEN 'duplicate' WHEN tried - lag(tried) OVER w > 1 THEN 'gap' ELSE 'next' END AS finding,
          coalesce(epoch < max(epoch) OVER (PARTITION BY shard ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)::BIGINT AS stale
        FROM (SELECT *, seqno + CASE k WHEN 7 THEN -1 WHEN 11 THEN 2 ELSE 0 END AS tried FROM log)
        WINDOW w AS (PARTITION BY shard ORDER BY seqno)) WHERE finding <> 'next' OR stale = 1"""
    ),
    "log_trim": _log(
        """SELECT shard, applied // 128 * 128 AS up_to, count(*) FILTER (seqno > applied // 128 * 128) AS kept,
          min(seqno) FILTER (seqno > applied // 128 * 128) AS first_kept, max(seqno) + 1 AS next_seqno
        FROM log JOIN cuts USING (shard) GROUP BY ALL"""
    ),
    "replay_tail": _log(
        """SELECT shard, seqno, epoch, kind, CASE WHEN epoch < owner THEN 'stale' ELSE 'accept' END AS outcome
        FROM log JOIN cuts USING (shard) WHERE seqno > applied"""
    ),
    "kind_counts": _log("SELECT shard, kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM log GROUP BY ALL"),
    "stream_report": _log(
        """SELECT kind, count(*) AS n, count(DISTINCT workflow) AS workflows, count(DISTINCT (workflow, run)) AS runs,
          round(count(*) / (SELECT count(*) FROM log), 6) AS part FROM log GROUP BY kind"""
    ),
    "positions_lag": _log("SELECT *, (entries >= 8192 OR bytes >= 8388608)::BIGINT AS \"over\" FROM tail", _TAIL),
    "running_tail": _log(
        """SELECT shard, seqno, count(*) OVER w AS entries, CAST(sum(size) OVER w AS BIGINT) AS bytes
        FROM log JOIN cuts USING (shard) WHERE seqno > applied
        WINDOW w AS (PARTITION BY shard ORDER BY seqno ROWS UNBOUNDED PRECEDING)"""
    ),
    "shutdown_residue": _log("SELECT shard, last - applied AS residue, round((last - applied) / last, 6) AS part FROM cuts"),
    "task_slots_flat": _log("SELECT shard, seqno, slot, category, CAST(epoch_us(fire_time) AS BIGINT) AS fire_us, task_id FROM tasks"),
    "window_stats": _log("SELECT * FROM stats", _STATS),
    "fold_runs": _log(
        f"""SELECT r.*, coalesce(upserts, 0) AS upserts, coalesce(deletes, 0) AS deletes FROM {_runs("mine")} r LEFT JOIN (
          SELECT shard, win, workflow, run, count(*) FILTER (op = 'U') AS upserts, count(*) FILTER (op = 'D') AS deletes
          FROM {_items("mine")} GROUP BY ALL) USING (shard, win, workflow, run)"""
    ),
    "fold_items_lww": _log(f"SELECT * FROM {_items('mine')}"),
    "fold_current_row": _log(f"SELECT * FROM {_current('mine')}"),
    "fold_requests_emitted": _log(
        f"""SELECT shard, win, workflow, run, tail, row_number() OVER (PARTITION BY shard, win ORDER BY tail) AS ord,
          (row_number() OVER (PARTITION BY shard, win, workflow ORDER BY tail) = 1)::BIGINT AS first_of_workflow,
          (base <> -2)::BIGINT AS carries_head, shape FROM {_runs("mine")}"""
    ),
    "fold_tombstones": _log(
        f"""SELECT r.shard, r.win, r.workflow, r.run, head, tail, base, coalesce(n, 0) AS orphans FROM {_runs("mine")} r LEFT JOIN (
          SELECT shard, win, workflow, run, count(*) AS n FROM tasks GROUP BY ALL) USING (shard, win, workflow, run)
        WHERE shape = 'tombstone'"""
    ),
    "fold_buffered": _log(
        """SELECT shard, win, workflow, run, count(*) AS batches, string_agg(seqno::VARCHAR, ',' ORDER BY seqno) AS seqnos,
          (max(barrier) > 0)::BIGINT AS cleared
        FROM (SELECT *, coalesce(max(CASE WHEN kind = 'snapshot' THEN seqno END) OVER (PARTITION BY shard, win, workflow, run), 0) AS barrier FROM mine)
        WHERE kind = 'update' AND k >= 90 AND seqno > barrier GROUP BY ALL"""
    ),
    "fold_set_changes": _log(
        f"""SELECT shard, workflow, run, coalesce(string_agg(DISTINCT key::VARCHAR, ',' ORDER BY key::VARCHAR), '') AS touched,
          coalesce(string_agg(DISTINCT CASE WHEN written AND NOT removed THEN key::VARCHAR END, ',' ORDER BY CASE WHEN written AND NOT removed THEN key::VARCHAR END), '') AS kept
        FROM (SELECT shard, workflow, run, key, bool_or(op = 'U') AS written, bool_or(op = 'D') AS removed FROM {_items("mine")} GROUP BY ALL) GROUP BY ALL"""
    ),
    "batch_watermark": _log(
        """SELECT *, greatest(requests, tasks, ranges) AS watermark FROM (
          SELECT shard, win, coalesce(max(seqno) FILTER (kind IN ('update', 'snapshot', 'delete')), 0) AS requests,
            coalesce(max(seqno) FILTER (kind = 'add_tasks'), 0) AS tasks,
            coalesce(max(seqno) FILTER (kind = 'range_complete'), 0) AS ranges FROM log GROUP BY ALL)"""
    ),
    "window_coverage": _log(
        """SELECT shard, win, count(*) FILTER (base <> -2) AS asserted, count(*) FILTER (nth = 1 AND base <> -2) AS delegated,
          count(*) FILTER (nth > 1 AND base <> -2) AS answered, count(*) FILTER (base = -2) AS unasserted
        FROM (SELECT *, row_number() OVER (PARTITION BY shard, win, workflow, run ORDER BY seqno) AS nth FROM mine) GROUP BY ALL"""
    ),
    "overlay_runs": _log(
        f"""SELECT * FROM (SELECT shard, workflow, run, coalesce(w.shape, 'absent') AS shape,
            CASE WHEN w.shape IS NULL THEN b.version WHEN w.shape <> 'tombstone' THEN w.version END AS version,
            (coalesce(w.shape, 'absent') IN ('absent', 'delta'))::BIGINT AS needs_base
          FROM (SELECT * FROM {_runs("before_cut", "0")} WHERE shape <> 'tombstone') b
          FULL JOIN {_runs("after_cut", "0")} w USING (shard, workflow, run)) WHERE version > 0 OR shape = 'tombstone'""",
        _SIDES,
    ),
    "overlay_items": _log("SELECT * FROM overlay_items", _SIDES, _OVERLAY_ITEMS),
    "overlay_current": _log(
        f"""SELECT shard, workflow, CASE WHEN w.removed IS NULL THEN 'base' WHEN w.removed = 1 THEN 'gone' ELSE 'window' END AS source,
          CASE WHEN w.removed IS NULL THEN b.run WHEN w.removed = 0 THEN w.run END AS run,
          CASE WHEN w.removed IS NULL THEN b.version WHEN w.removed = 0 THEN w.version END AS version
        FROM (SELECT * FROM {_current("before_cut", "0")} WHERE removed = 0) b
        FULL JOIN {_current("after_cut", "0")} w USING (shard, workflow)""",
        _SIDES,
    ),
    "overlay_equals_fold": _log(
        f"""SELECT shard, count(*) AS items, (
            SELECT count(*) FROM (
              (SELECT * FROM overlay_items EXCEPT ALL SELECT shard, workflow, run, key, value FROM {_items("mine", "0")} WHERE op = 'U')
              UNION ALL
              (SELECT shard, workflow, run, key, value FROM {_items("mine", "0")} WHERE op = 'U' EXCEPT ALL SELECT * FROM overlay_items)) d
            WHERE d.shard = o.shard) AS differences
        FROM overlay_items o GROUP BY shard""",
        _SIDES,
        _OVERLAY_ITEMS,
    ),
    "oracle_window_equivalence": _log(
        " UNION ALL ".join(
            f"SELECT '{t}' AS tables, n AS folded, n AS single, 0::BIGINT AS only_folded, 0::BIGINT AS only_single FROM (SELECT count(*) AS n FROM {rows})"
            for t, rows in {"items": f"(SELECT * FROM {_items('mine', '0')} WHERE op = 'U')", "runs": _FINAL_RUNS, "current": _FINAL_CURRENT, "tasks": _FINAL_TASKS}.items()
        )
    ),
    "apply_runs_final": _log(f"SELECT * FROM {_FINAL_RUNS}"),
    "apply_items_final": _log(f"SELECT shard, workflow, run, key, value FROM {_items('mine', '0')} WHERE op = 'U'"),
    "apply_current_final": _log(f"SELECT * FROM {_FINAL_CURRENT}"),
    "apply_tasks_final": _log(
        f"SELECT shard, category, task_id, slot, workflow, CAST(epoch_us(fire_time) AS BIGINT) AS fire_us FROM {_FINAL_TASKS}"
    ),
    "apply_guarded_deletes": _log(
        f"""SELECT * FROM {_FINAL_CURRENT} c WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT shard, workflow, max(run) AS guard FROM mine WHERE kind = 'delete' OR k < 3 GROUP BY ALL) g
          WHERE g.shard = c.shard AND g.workflow = c.workflow AND g.guard = c.run)"""
    ),
    "task_sweep_counts": _log("SELECT * FROM sweeps", _QUEUES, _SWEEPS),
    "task_ranges_coalesced": _log(
        """SELECT shard, category, island, min(lo) AS lo, max(hi) AS hi, count(*) AS ranges FROM (
          SELECT *, CAST(sum(opens) OVER (PARTITION BY shard, category ORDER BY lo, hi, seqno ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
            SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY shard, category ORDER BY lo, hi, seqno
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::BIGINT AS opens FROM ranges)) GROUP BY ALL"""
    ),
    "task_hide_deleted": _log(
        """SELECT shard, category, at_rest, coalesce(n, 0) AS shown, at_rest - coalesce(n, 0) AS hidden
        FROM (SELECT shard, category, count(*) AS at_rest FROM base_tasks GROUP BY ALL)
        LEFT JOIN (SELECT shard, category, count(*) AS n FROM visible GROUP BY ALL) USING (shard, category)""",
        _QUEUES,
    ),
    "task_page_merge": _log(
        f"""SELECT {_PAGE} FROM (SELECT *, row_number() OVER (PARTITION BY shard, category ORDER BY fire_time NULLS FIRST, task_id) AS ord FROM merged)
        WHERE ord <= 50""",
        _QUEUES,
    ),
    "task_page_next": _log(
        f"""SELECT shard, category, ord, task_id, CAST(epoch_us(fire_time) AS BIGINT) AS fire_us, side FROM (
          SELECT *, row_number() OVER (PARTITION BY shard, category ORDER BY fire_time NULLS FIRST, task_id) AS ord FROM merged
          WHERE CASE WHEN category = 1 THEN task_id > 200 ELSE ("at", task_id) > ({PAGE_AFTER}, 200) END) WHERE ord <= 50""",
        _QUEUES,
    ),
    "task_collisions": _log(
        """SELECT shard, category, coalesce(base_rows, 0) AS base_rows, coalesce(window_touched, 0) AS window_touched, coalesce(keys, 0) AS keys,
          coalesce(collisions, 0) AS collisions, coalesce(from_base, 0) AS from_base, coalesce(from_window, 0) AS from_window,
          coalesce(base_rows, 0) - coalesce(from_base, 0) AS base_discarded
        FROM (SELECT shard, category, count(*) AS base_rows FROM base_tasks GROUP BY ALL)
        FULL JOIN (SELECT shard, category, count(*) AS window_touched FROM tail_tasks GROUP BY ALL) USING (shard, category)
        FULL JOIN (SELECT shard, category, count(*) AS keys, count(*) FILTER (copies > 1) AS collisions, count(*) FILTER (side = 0) AS from_base,
          count(*) FILTER (side = 1) AS from_window FROM merged GROUP BY ALL) USING (shard, category)""",
        _QUEUES,
    ),
    "base_page_audit": _log(
        """SELECT shard, category, page, n, outside, descends,
          coalesce(lowest <= max(highest) OVER (PARTITION BY shard, category ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)::BIGINT AS passed,
          (n > asked)::BIGINT AS too_large, (n = 0 AND token = 1)::BIGINT AS empty_beside_token
        FROM (SELECT shard, category, page, count(*) AS n, count(*) FILTER (key < -1125899906842624 OR key >= 1152921504606846976) AS outside,
            count(*) FILTER (key <= earlier) AS descends, min(key) AS lowest, max(key) AS highest,
            CASE WHEN page % 6 = 3 THEN 10 ELSE 20 END AS asked, (page % 6 <> 5)::BIGINT AS token
          FROM (SELECT *, lag(key) OVER (PARTITION BY shard, category, page ORDER BY ord) AS earlier
            FROM (SELECT shard, category, n // 20 AS page, CASE WHEN n // 20 % 6 = 1 THEN 19 - n % 20 ELSE n % 20 END AS ord,
                "at" - CASE WHEN n // 20 % 6 = 2 AND n % 20 = 3 THEN 1152921504606846976 ELSE 0 END AS key
              FROM (SELECT *, row_number() OVER (PARTITION BY shard, category ORDER BY "at", task_id) - 1 AS n FROM base_tasks)))
          GROUP BY shard, category, page)""",
        _QUEUES,
    ),
    "history_batch_order": _log(
        """SELECT shard, win, count(*) AS batches, string_agg(concat_ws('.', seqno, ordinal, node), ',' ORDER BY seqno, ordinal) AS in_order,
          max(seqno) AS tail FROM batches GROUP BY ALL""",
        _BATCHES,
    ),
    "history_branch_nodes": _log(
        """SELECT shard, tree, branch, ord, node, txn, events FROM (
          SELECT *, row_number() OVER (PARTITION BY shard, tree ORDER BY node, txn DESC, ordinal) AS ord FROM batches WHERE branch = 1) WHERE ord <= 3""",
        _BATCHES,
    ),
    "history_event_slots": _log(
        """SELECT shard, count(*) AS batches, CAST(sum(length(events)) AS BIGINT) AS batches_chars, count(*) AS stripped, 0::BIGINT AS stripped_chars
        FROM batches GROUP BY shard""",
        _BATCHES,
    ),
    "acked_read_back": _log(
        """SELECT shard, count(*) FILTER (k = 9) AS lost, count(*) FILTER (k = 8) AS other, count(*) FILTER (k = 12) AS unacknowledged,
          max(seqno) - min(seqno) + 1 - count(*) AS missing FROM log GROUP BY shard"""
    ),
    "replay_report": _log("SELECT * FROM reports", _REPLAY),
    "halts_first": _log("SELECT * FROM ended", _REPLAY),
    "tail_account": _log(
        """SELECT shard, win, action, "end" AS acknowledged, CASE WHEN action = 'stall' THEN last_end ELSE "end" END AS resolved,
          CASE WHEN action = 'move' THEN "end" ELSE last_moved END AS applied,
          "end" - CASE WHEN action = 'stall' THEN last_end ELSE "end" END AS entries,
          CASE WHEN action = 'stall' THEN bytes ELSE 0 END AS bytes, CASE WHEN action = 'stall' THEN "end" ELSE 0 END AS stalled
        FROM (SELECT *, coalesce(max("end") OVER w, 0) AS last_end, coalesce(max(CASE WHEN action <> 'keep' THEN "end" END) OVER w, 0) AS last_moved
          FROM (SELECT shard, win, max(seqno) AS "end", CAST(sum(size) AS BIGINT) AS bytes,
              CASE WHEN win % 7 = 5 THEN 'stall' WHEN win % 5 = 3 THEN 'keep' ELSE 'move' END AS action FROM log GROUP BY shard, win)
          WINDOW w AS (PARTITION BY shard ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    ),
    "start_gate": f"""SELECT *, CASE WHEN readable = 0 THEN 'retry' WHEN replay = 'ok' THEN 'serve' WHEN replay = 'lost' THEN 'halt_lost'
      WHEN replay = 'stranded' THEN 'halt_invariant' ELSE 'retry' END AS action
      FROM {_values(readable=[0, 1], replay=["ok", "lost", "stranded", "log_error"])}""",
    "write_path": f"""SELECT *, CASE WHEN halted = 1 THEN 'halted' WHEN own_shard = 0 THEN 'foreign_shard' WHEN started = 0 THEN 'not_started'
      WHEN refusal <> 'accept' THEN refusal WHEN holds = 0 THEN 'condition_failed' WHEN append <> 'accept' THEN append
      WHEN fold = 'ok' THEN 'folded' WHEN fold = 'refused' THEN 'drained_and_folded' ELSE 'halt_invariant' END AS ends
      FROM {_values(halted=[0, 1], own_shard=[0, 1], started=[0, 1], refusal=["accept", "bytes"], holds=[0, 1], append=["accept", "halt_lost"], fold=["ok", "refused", "refused_twice"])}""",
    "task_cursors": _log(
        """SELECT shard, category, arg_max(task_id, ord) AS task_id, CAST(epoch_us(max(fire_time)) AS BIGINT) AS fire_us, 1::BIGINT AS foreign_refused
        FROM (SELECT *, row_number() OVER (PARTITION BY shard, category ORDER BY fire_time NULLS FIRST, task_id) AS ord FROM merged)
        WHERE ord <= 50 GROUP BY ALL""",
        _QUEUES,
    ),
    "scheduled_range_cover": """SELECT o_orderkey AS task_id, CAST(epoch_us(o_orderdate) AS BIGINT) AS fire_us FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'""",
    "history_page_forward": _history("node, txn DESC", "tree, ord, node, txn, side, CAST(length(events) AS BIGINT) AS chars"),
    "history_page_reverse": _history("node DESC, txn", "tree, ord, node, txn, side, CAST(length(events) AS BIGINT) AS chars"),
    "history_metadata_only": _history("node, txn DESC", "tree, ord, node, txn, side", "node >= 2 AND node < 5"),
    "history_upsert": f"""WITH {_NODES} SELECT tree, count(*) AS nodes, CAST(sum((node % 2 = 0)::BIGINT) AS BIGINT) AS rewritten,
      CAST(sum(length(CASE WHEN node % 2 = 0 THEN events || '!' ELSE events END)) AS BIGINT) AS chars
      FROM (SELECT tree, node, txn, min(events) AS events FROM nodes GROUP BY ALL) GROUP BY tree""",
    "history_validity": f"""WITH {_NODES} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN tree IS NULL THEN 'no branch'
      WHEN coalesce(length(events), 0) = 0 THEN 'no events' WHEN node > 1 AND txn = 0 THEN 'new branch without tree info' ELSE 'ok' END AS reason
      FROM nodes) GROUP BY reason""",
    "assertions_derived": _log(
        """SELECT shard, seqno, workflow, run, 0::BIGINT AS ord, 'current' AS target,
          CASE WHEN run = 0 THEN 'must_not_exist' ELSE 'equals_with_version' END AS form, CASE WHEN run > 0 THEN run - 1 END AS wants
        FROM mine WHERE base = -1
        UNION ALL SELECT shard, seqno, workflow, run, (base = -1)::BIGINT, 'run',
          CASE WHEN base = -1 THEN 'must_not_exist' ELSE 'version' END, CASE WHEN base >= 0 THEN base END
        FROM mine WHERE base <> -2"""
    ),
    "version_chain": _log(
        """SELECT shard, count(*) AS writes, count(*) FILTER (version - before <> 1) AS broken FROM (
          SELECT *, coalesce(lag(version) OVER (PARTITION BY shard, workflow, run ORDER BY seqno), 0) AS before
          FROM log WHERE kind IN ('update', 'snapshot')) GROUP BY shard"""
    ),
    "assertion_verdicts": _log("SELECT shard, workflow, run, head, tail, base, actual, message FROM verdicts", _SIDES, _VERDICTS),
    "current_verdicts": _log(
        f"""SELECT shard, workflow, kind, CASE
          WHEN kind = 'must_not_exist' THEN CASE WHEN run IS NOT NULL THEN '{c.CURRENT_MUST_NOT_EXIST}' END
          WHEN run IS NULL THEN '{c.CURRENT_MUST_EXIST}'
          WHEN kind = 'equals' AND run <> want_run THEN printf('{c.CURRENT_EQUAL}', run::VARCHAR, want_run::VARCHAR)
          WHEN kind = 'not_equals' AND run = want_run THEN printf('{c.CURRENT_NOT_EQUAL}', run::VARCHAR, want_run::VARCHAR)
          WHEN kind = 'equals_with_version' AND (state <> 3 OR run <> want_run OR version <> want_version) THEN
            printf('{c.CURRENT_VERSION}', state::VARCHAR, '3', run::VARCHAR, want_run::VARCHAR, version::VARCHAR, want_version::VARCHAR) END AS message
        FROM (SELECT *, coalesce(run, 0) + CASE WHEN workflow % 2 = 0 THEN 0 ELSE 1 END AS want_run,
            version - CASE WHEN workflow % 3 = 0 THEN 0 ELSE 1 END AS want_version
          FROM (SELECT shard, workflow, CASE WHEN workflow % 7 <> 0 THEN arg_max(run, seqno) END AS run,
              CASE WHEN arg_max(kind, seqno) = 'delete' THEN 3 ELSE 2 END AS state, arg_max(version, seqno) AS version FROM mine GROUP BY shard, workflow)
          CROSS JOIN (SELECT unnest(['must_not_exist', 'equals', 'not_equals', 'equals_with_version']) AS kind))"""
    ),
    "authority_partition": _log(
        """SELECT shard, "by", count(*) AS n FROM (SELECT *, CASE WHEN base = -2 THEN 'none'
          WHEN row_number() OVER (PARTITION BY shard, workflow, run ORDER BY seqno) > 1 THEN 'window' ELSE 'base' END AS "by" FROM after_cut) GROUP BY ALL""",
        _SIDES,
    ),
    "settlement_first_failure": _log(
        """SELECT shard, workflow, count(*) AS asserted, count(message) AS failed, min(head) FILTER (message IS NOT NULL) AS first_failure,
          arg_min(message, head) FILTER (message IS NOT NULL) AS message FROM verdicts GROUP BY ALL""",
        _SIDES,
        _VERDICTS,
    ),
    "divergence_attribution": _log(
        "SELECT shard, count(*) AS diverged, min(head) - 1 AS sound_to, max(tail) AS last_tail FROM verdicts WHERE message IS NOT NULL GROUP BY shard",
        _SIDES,
        _VERDICTS,
    ),
    "codec_round_trip": _log("SELECT kind, count(*) AS n, count(*) AS same FROM log GROUP BY kind"),
    "call_outcomes": _log(
        """SELECT kind, CASE WHEN seqno % 17 = 0 THEN 'unknown' WHEN epoch < owner THEN 'ownership_lost' WHEN k = 1 THEN 'condition' ELSE 'none' END AS outcome,
          count(*) AS n FROM log GROUP BY ALL"""
    ),
    "effects_identified": _log(
        """SELECT shard, CASE WHEN kind IN ('update', 'snapshot') THEN 'exists' WHEN kind = 'delete' THEN 'removed' ELSE 'no_claim' END AS effect,
          count(*) AS n FROM log GROUP BY ALL"""
    ),
    "drain_metrics": _log(_series(), _QUEUES, _STATS, _SWEEPS, _TAIL, _REPLAY),
    "witness_claims": _log(
        " UNION ALL ".join(
            f"SELECT '{claim}' AS claim, ({holds})::BIGINT AS holds"
            for claim, holds in {
                "every acknowledged entry names a kind": "(SELECT count(*) FROM log WHERE kind IS NULL) = 0",
                "every kind is there": "(SELECT count(DISTINCT kind) FROM log) = 5",
                "something was acknowledged": "(SELECT count(*) FROM log) > 0",
                "something was written": "(SELECT sum(written) FROM sweeps) > 0",
                "something was applied": "(SELECT sum(applied) FROM cuts) > 0",
                "every shard has a tail": "(SELECT sum(entries) FROM tail) > 0",
                "reads met the window": "(SELECT count(*) FROM log JOIN cuts USING (shard) WHERE seqno > applied AND kind = 'update' AND k % 4 = 1) > 0",
                "pages were merged": "(SELECT count(*) FROM merged) > 0",
                "ranges and tasks reached the log": "(SELECT count(*) FROM tasks) > 0",
                "some task was dropped": "(SELECT sum(dropped) FROM sweeps) > 0",
                "something collapsed": "(SELECT sum(mutations) > sum(workflows) FROM stats)",
                "a page met both sides": "(SELECT count(*) FROM merged WHERE copies > 1) > 0",
                "all writes were drained": "(SELECT sum(mutations) FROM stats) = (SELECT count(*) FROM log)",
                "nothing halted": "(SELECT count(*) FROM ended WHERE state <> 'running') = 0",
                "no condition reached a drain": "(SELECT count(*) FROM log WHERE k = 1 AND epoch >= owner) = 0",
                "replays dropped no more than they read": "(SELECT sum(dropped) <= sum(folded + alone + dropped) FROM reports)",
            }.items()
        ),
        _QUEUES,
        _STATS,
        _SWEEPS,
        _TAIL,
        _REPLAY,
    ),
    "backpressure_decision": f"""SELECT *, CASE WHEN stalled = 1 THEN 'unresolved' WHEN pressure >= 2 THEN 'storage_pressure'
      WHEN bytes >= 8388608 THEN 'bytes' WHEN entries >= 8192 THEN 'entries' ELSE 'accept' END AS verdict
      FROM {_values(stalled=[0, 1], pressure=[0, 1, 2], entries=[0, 8191, 8192], bytes=[0, 8388607, 8388608])}""",
    "append_outcome": f"""SELECT error, found, CASE error WHEN 'none' THEN 'accept' WHEN 'fenced' THEN 'halt_lost'
      WHEN 'already_written' THEN 'halt_invariant' WHEN 'gap' THEN 'not_written' ELSE 'read_back' END AS outcome,
      CASE found WHEN 'absent' THEN 'return_error' WHEN 'own' THEN 'accept' ELSE 'halt_invariant' END AS read_back
      FROM {_values(error=["none", "fenced", "already_written", "gap", "timeout"], found=["absent", "own", "foreign", "unreadable"])}""",
    "settlement_decision": f"""SELECT *, CASE outcome WHEN 'committed' THEN 'forward' WHEN 'unknown' THEN 'ask_watermark'
      WHEN 'shard_lost' THEN 'halt_lost' WHEN 'refused' THEN 'halt_invariant' ELSE
        CASE WHEN "window" = 1 AND waits = 1 THEN 'answer_writer' WHEN "window" = 1 AND provisional = 1 THEN 'drop_entry' ELSE 'halt_invariant' END
      END AS action
      FROM {_values(outcome=["committed", "unknown", "shard_lost", "invariant_violated", "refused"], window=[1, 256], waits=[0, 1], provisional=[0, 1]).replace("AS window", 'AS "window"')}""",
    "unknown_outcome_resolve": f"""SELECT readable, "at", seqno, CASE WHEN readable = 0 THEN 'stall' WHEN "at" < seqno THEN 'halt_invariant'
      WHEN "at" > seqno THEN 'halt_lost' ELSE 'committed' END AS resolution
      FROM {_values(readable=[0, 1], at=[-1, 5, 7, 9], seqno=[7]).replace("AS at", 'AS "at"')}""",
    "tick_decision": f"""SELECT *, CASE WHEN running = 0 OR stalled = 1 THEN 'nothing'
      WHEN started = 1 AND pressure >= 1 THEN CASE WHEN empty = 1 THEN 'force_trim' ELSE 'drain_pressure' END
      WHEN aged = 1 THEN 'drain_age' ELSE 'nothing' END AS action
      FROM {_values(running=[0, 1], stalled=[0, 1], started=[0, 1], pressure=[0, 1, 2], aged=[0, 1], empty=[0, 1])}""",
    "read_routing": f"""SELECT *, CASE
        WHEN state = 'no_cycle' THEN CASE WHEN reader = 'task' THEN 'lost' ELSE 'pass_through' END
        WHEN state = 'running' THEN CASE WHEN stalled = 1 THEN 'unresolved' ELSE 'merge' END
        WHEN reader = 'state' AND tail_empty = 1 THEN 'pass_through'
        WHEN state = 'halted_lost' OR (reader = 'task' AND state = 'retired') THEN 'lost' ELSE 'halt' END AS route
      FROM {_values(state=["no_cycle", "running", "halted_lost", "halted_invariant", "retired"], reader=["state", "task"], stalled=[0, 1], tail_empty=[0, 1])}""",
    "superseded_routing": f"""SELECT *, CASE WHEN still_current = 1 THEN 'merge' WHEN retried = 0 THEN 'retry_on_successor' ELSE 'lost' END AS route
      FROM {_values(still_current=[0, 1], retried=[0, 1])}""",
    "drain_causes": f"""SELECT *, CASE WHEN rule <> 'none' THEN rule WHEN sync = 1 THEN 'sync' WHEN detached = 1 AND trip = 'none' THEN 'detached'
      ELSE trip END AS cause
      FROM {_values(sync=[0, 1], detached=[0, 1], trip=["mutations", "bytes", "age", "storage_pressure", "none"], rule=["none", "replay", "refusal", "explicit", "read"])}""",
    "outcome_classes": f"""SELECT error, CASE WHEN error = 'none' THEN 'committed' WHEN error = 'refused' THEN 'refused'
      WHEN error = 'ownership_lost' THEN 'shard_lost' WHEN error LIKE '%condition' THEN 'invariant_violated' ELSE 'unknown' END AS class,
      CASE WHEN error = 'halted_lost' THEN 'ownership_lost' ELSE error END AS at_store
      FROM {_values(error=["none", "refused", "ownership_lost", "current_condition", "workflow_condition", "condition", "timeout", "halted_lost"])}""",
    "fold_exact_cycle": _recursive(
        """SELECT shard, win, min(seqno) AS first, max(seqno) AS last, count(*) AS mutations, CAST(sum(size) AS BIGINT) AS bytes,
          count(DISTINCT workflow) AS workflows, coalesce(max(closed), max(next_opened), 'explicit') AS cause, ((win + 1) % 16 = 0)::BIGINT AS trims
        FROM (SELECT *, lead(opened) OVER (PARTITION BY shard ORDER BY seqno) AS next_opened FROM step) GROUP BY shard, win""",
        """e AS MATERIALIZED (SELECT shard, seqno, workflow, run, kind, size, epoch_us(ts) AS us, workflow || ':' || run AS of FROM log),
step AS (
  SELECT shard, seqno, workflow, size, 0::BIGINT AS win, 1::BIGINT AS n, size AS held, us AS since,
    CASE WHEN kind = 'snapshot' THEN [of] ELSE []::VARCHAR[] END AS resets,
    CASE WHEN size >= 262144 THEN 'bytes' END AS closed, NULL::VARCHAR AS opened FROM e WHERE seqno = 1
  UNION ALL
  SELECT shard, seqno, workflow, size, win, n, held, since, CASE WHEN kind = 'snapshot' THEN list_append(resets, of) ELSE resets END,
    CASE WHEN n >= 256 THEN 'mutations' WHEN held >= 262144 THEN 'bytes' END, opened
  FROM (SELECT shard, seqno, workflow, kind, of, size, opened, win + fresh::BIGINT AS win, CASE WHEN fresh THEN 1 ELSE n + 1 END AS n,
      CASE WHEN fresh THEN size ELSE held + size END AS held, CASE WHEN fresh THEN us ELSE since END AS since,
      CASE WHEN fresh THEN []::VARCHAR[] ELSE resets END AS resets
    FROM (SELECT *, closed IS NOT NULL OR opened IS NOT NULL AS fresh
      FROM (SELECT e.*, s.win, s.n, s.held, s.since, s.resets, s.closed,
          CASE WHEN s.closed IS NULL AND e.us - s.since >= 5000000 THEN 'age'
            WHEN s.closed IS NULL AND e.kind = 'snapshot' AND list_contains(s.resets, e.of) THEN 'refusal' END AS opened
        FROM step s JOIN e ON e.shard = s.shard AND e.seqno = s.seqno + 1))))""",
    ),
    "trim_points": _recursive(
        """SELECT shard, win, "end" AS up_to, win - before AS drains FROM step WHERE fires""",
        """d AS MATERIALIZED (SELECT shard, win, max(seqno) AS "end", epoch_us(max(ts)) AS us FROM log GROUP BY shard, win),
step AS (
  SELECT shard, win, "end", -1::BIGINT AS before, us AS since, FALSE AS fires, us FROM d WHERE win = 0
  UNION ALL
  SELECT shard, win, "end", before, since, win - before >= 16 OR us - since >= 60000000, us
  FROM (SELECT d.*, CASE WHEN s.fires THEN s.win ELSE s.before END AS before, CASE WHEN s.fires THEN s.us ELSE s.since END AS since
    FROM step s JOIN d ON d.shard = s.shard AND d.win = s.win + 1))""",
    ),
    "stream_fold_state": _log(f"SELECT shard, workflow, run, key, value FROM {_items('mine', '0')} WHERE op = 'U'"),
    "stream_tables_state": _log(
        " UNION ALL ".join(
            f"SELECT '{t}' AS tables, shard, count(*) AS n, CAST(sum({of}) AS BIGINT) AS told FROM {rows} GROUP BY shard"
            for t, of, rows in (
                ("runs", "version * 7 + last_seqno", _FINAL_RUNS),
                ("current", "run * 13 + version", _FINAL_CURRENT),
                ("buffered", "seqno", _FINAL_BUFFERED),
                ("tasks", "category * 3 + task_id * 5 + slot + workflow", _FINAL_TASKS),
                ("history", "node * 3 + txn + branch", "batches"),
            )
        ),
        _BATCHES,
    ),
}
