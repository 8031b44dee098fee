"""The fold's rules on small logs, and what must not depend on how a log is cut."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerfold.functions import codec
from ledgerfold.operators import fold, overlay, queues
from ledgerfold.sources import views
from ledgerfold.streaming.cycle import _Cycle, exact_windows

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, *rows):
    """(user, type, k, value) in order."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    full = [(i, at + timedelta(seconds=i), u, t, float(v), f'{{"k": {k}}}') for i, (u, t, k, v) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def items(spark, *rows):
    return {(r["key"], r["op"], r["value"]) for r in fold.items(views.log(events(spark, *rows))).collect()}


def test_last_write_of_a_key_stands(spark):
    assert items(spark, (4, "view", 1, 5), (4, "view", 11, 6), (4, "view", 2, 7)) == {(1, "U", 6.0), (2, "U", 7.0)}


def test_a_delete_of_a_key_stays_as_a_delete(spark):
    assert items(spark, (4, "view", 3, 5), (4, "click", 3, 0)) == {(3, "D", None)}


def test_a_snapshot_forgets_what_was_before(spark):
    assert items(spark, (4, "view", 1, 5), (4, "signup", 0, 0), (4, "view", 2, 7)) == {(2, "U", 7.0)}


def test_a_deleted_run_has_no_items_and_the_next_starts_anew(spark):
    log = views.log(events(spark, (4, "view", 1, 5), (4, "error", 50, 0), (4, "view", 2, 7)))
    found = {r["run"]: r for r in fold.runs(log).collect()}
    assert found[0]["shape"] == "tombstone" and found[1]["shape"] == "delta"
    assert found[1]["base"] == fold.MUST_NOT_EXIST and found[1]["version"] == 1
    assert {(r["run"], r["key"]) for r in fold.items(log).collect()} == {(1, 2)}


def test_the_head_asserts_and_the_tail_writes(spark):
    row = fold.runs(views.log(events(spark, *[(4, "view", i, i) for i in range(5)]))).first()
    assert (row["base"], row["version"], row["head"], row["tail"], row["mutations"]) == (fold.MUST_NOT_EXIST, 5, 1, 5, 5)


def test_a_range_deletes_only_tasks_before_it(spark):
    log = views.log(events(spark, (4, "purchase", 10, 0), (4, "purchase", 95, 0), (4, "purchase", 10, 0)))
    counts = {r["category"]: (r["written"], r["dropped"]) for r in queues.sweep_counts(log).collect()}
    assert counts == {1: (1, 1), 2: (2, 0)}


def test_ranges_merge_where_they_touch_and_keep_gaps(spark):
    log = views.log(events(spark, *[(4, "purchase", 80, 0)] * 2, *[(4, "view", 1, 0)] * 200, (4, "purchase", 80, 0)))
    assert [(r["lo"], r["hi"], r["ranges"]) for r in queues.islands(log).filter("category = 1").orderBy("lo").collect()] == [(-63, 2, 2), (139, 203, 1)]


def test_an_empty_log(spark):
    log = views.log(events(spark).limit(0))
    for operator in (fold.runs, fold.items, fold.windows, queues.page, overlay.overlay_items, overlay.final_tasks, exact_windows):
        assert operator(log).count() == 0


@pytest.mark.parametrize("window", [1, 7, 64])
def test_folding_changes_nothing(spark, sf, window):
    found = overlay.equivalence(views.log(views.read(spark, sf, "events"), window)).collect()
    assert len(found) == 4 and all(r["only_folded"] == r["only_single"] == 0 for r in found)


def test_codec_refuses(spark):
    part = '{"run":0,"version":3,"upserts":[{"key":1,"value":2.0}],"deletes":[]}'
    good = '{"format":1,"provisional":false,"shard":1,"update":{"workflow":2,"parts":[%s],"tasks":[],"events":[]}}' % part
    tasks = good.replace('"tasks":[]', '"tasks":[{"category":1,"task_id":4},{"category":2,"fire_us":5,"task_id":4}]')
    fine = [good, tasks, good.replace(part, f'{part},{part.replace("0", "1")}'), good.replace('"update"', '"create"')]
    bad = {
        "other format": [good.replace('"format":1', '"format":2'), good.replace('"format":1,', "")],
        "unknown field": [good.replace('"shard"', '"shart"'), good.replace('"workflow"', '"walk"')],
        "duplicate key": [good.replace("[{\"key", '[{"key":1,"value":9.0},{"key'), good.replace('"deletes":[]', '"deletes":[1]')],
        "no request": ['{"format":1,"provisional":false,"shard":1}'],
        "several requests": [good[:-1] + ',"delete":{"workflow":2,"run":0}}'],
        "unknown category": [tasks.replace('"category":2', '"category":7')],
        "malformed": [good[:-5], "", "7"],
    }
    texts = [(None, t) for t in fine] + [(why, t) for why, ts in bad.items() for t in ts]
    rows = [(1, i, t) for i, (_, t) in enumerate(texts)]
    found = codec.decode(spark.createDataFrame(rows, "shard long, seqno long, payload string")).orderBy("seqno").collect()
    assert [(r["reason"], t) for r, (_, t) in zip(found, texts)] == texts
    assert [r["kind"] for r in found[:4]] == ["update", "update", "update", "create"]


def test_history_cursors(spark):
    df = spark.createDataFrame([(4, 9, "base's own"), (4, 9, None)], "node long, txn long, base string")
    made = df.withColumn("c", codec.history_cursor(df.node, df.txn, df.base))
    back = [r["p"] for r in made.select(codec.parse_history_cursor(made.c).alias("p")).collect()]
    assert [tuple(p) for p in back] == [(4, 9, "base's own"), (4, 9, None)]
    foreign = df.select(codec.parse_history_cursor(df.base).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in foreign] == [(None, None, "base's own"), None]


class Entry:
    def __init__(self, shard, seqno, workflow, run, kind, size, at_us):
        self.shard, self.seqno, self.workflow, self.run, self.kind, self.size, self.at_us = shard, seqno, workflow, run, kind, size, at_us


@settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["update", "snapshot"]), st.integers(1, 50), st.integers(0, 3)), max_size=60))
def test_exact_windows_cover_the_log(rows):
    rows = sorted(rows, key=lambda r: r[0])
    cycle, at, out = _Cycle(5, 120, 4.0, 2), 0, []
    for i, (shard, kind, size, wait) in enumerate(rows):
        at += wait * 1_000_000
        out += cycle.add(Entry(shard, i, 1, 0, kind, size, at))
    if cycle.n:
        out.append(cycle._close("explicit"))
    assert sum(w[4] for w in out) == len(rows)
    assert all(w[4] <= 5 for w in out)
    for a, b in zip(out, out[1:]):
        assert b[2] == a[3] + 1
