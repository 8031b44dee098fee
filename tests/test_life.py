"""The life of a drain loop, call records, settings, ranges and the apply sink."""

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import running
from ledgerfold.operators import history, life, overlay, queues
from ledgerfold.sources import calls, views
from ledgerfold.sources.tables import Tables
from ledgerfold.streaming import drain
from ledgerfold.streaming.policy import Policy, trims


@pytest.fixture(scope="module")
def log(spark, sf):
    return views.at_rest(views.log(views.read(spark, sf, "events")))


def test_running_totals_by_buckets_and_by_one_window(spark, monkeypatch):
    rows = [(g, (i * 37) % 101, i % 7) for i in range(101) for g in (1, 2, None)]
    df = spark.createDataFrame(rows, "g long, at long, v long")
    made = lambda: running.before(df, ["g"], F.shiftright("at", 3), [F.col("at")], {"total": F.col("v")}, {"top": F.col("v"), "last": F.struct("at", "v")})
    whole = sorted(map(str, made().collect()))
    monkeypatch.setattr(running, "SMALL", 1)
    assert sorted(map(str, made().collect())) == whole and len(whole) == 303
    for r in made().filter("g IS NULL").collect():
        mine = sorted((a, v) for g, a, v in rows if g is None and a < r["at"])
        assert r["total"] == sum(v for _, v in mine) and r["top"] == max((v for _, v in mine), default=None)
        assert r["last"] == (mine[-1] if mine else None)


def test_the_log_is_the_same_in_buckets(spark, sf, log, monkeypatch):
    monkeypatch.setattr(running, "SMALL", 1)
    monkeypatch.setattr(views, "BUCKET", 64)
    assert sorted(map(str, views.log(views.read(spark, sf, "events")).collect())) == sorted(map(str, log.collect()))


def test_policies():
    p = Policy().now(mutations=10, age=1.0)
    assert (p.mutations, p.bytes) == (10, 256 << 10)
    with pytest.raises(ValueError, match="fixed at the start: max_shards"):
        p.now(max_shards=3)
    with pytest.raises(ValueError, match="budget"):
        Policy(max_bytes=16 << 20)
    Policy(max_bytes=1 << 62, max_shards=1, tail_budget=1 << 62)
    with pytest.raises(ValueError, match="not positive: age"):
        Policy(age=0)


def test_trims_by_drains_and_by_time():
    assert trims([0.0] * 40) == [15, 31]
    assert trims([0.0, 30.0, 61.0, 90.0, 120.0, 122.0]) == [2, 5]
    assert trims([]) == []


def test_call_records(spark, tmp_path):
    made = spark.createDataFrame([(1, 1, 5, 0, "update"), (1, 2, 5, 0, "delete")], "shard long, call long, workflow long, run long, kind string")
    done = spark.createDataFrame([(1, 1, "none")], "shard long, call long, outcome string")
    calls.write(made, done, f"file://{tmp_path}/r")
    found = calls.matched(*calls.read(spark, f"file://{tmp_path}/r")).orderBy("call").collect()
    assert [(r["kind"], r["outcome"]) for r in found] == [("update", "none"), ("delete", "unknown")]
    with open(f"{tmp_path}/r/zz.txt", "w") as torn:
        torn.write('{"phase":"call","shard":1,"call":3,"workflow":5,"run":0,"kind":"upd')
    assert calls.read(spark, f"file://{tmp_path}/r")[0].count() == 2, "a line that doesn't end is dropped"
    with open(f"{tmp_path}/r/zz.txt", "w") as wrong:
        wrong.write('{"phase":"never"}\n')
    with pytest.raises(Exception, match="not a record"):
        calls.read(spark, f"file://{tmp_path}/r")[0].collect()


def test_wide_ranges_take_few_buckets_and_cover_as_they_are(spark):
    wide = [(1, 0, 5_000_000), (1, 77, 78), (1, -900, 3), (1, 4_000_000_000, 2**55), (2, 0, 2**52), (1, 9, 9)]
    ranges = spark.createDataFrame([(1, c, n, lo, hi) for n, (c, lo, hi) in enumerate(wide)], "shard long, category long, seqno long, lo long, hi long")
    pieces = queues.spread(ranges).groupBy("seqno").count().toPandas().set_index("seqno")["count"]
    assert 5 not in pieces and pieces.max() < 5 * 2 * 1024
    points = [-901, -900, -1, 0, 2, 3, 76, 77, 4_999_999, 5_000_000, 4_000_000_000, 2**54, 2**55]
    tasks = spark.createDataFrame([(1, c, p) for c in (1, 2) for p in points], 'shard long, category long, "at" long'.replace('"', ""))
    left = {(r["category"], r["at"]) for r in queues.without(tasks, ranges, ["shard"]).collect()}
    assert left == {(c, p) for c in (1, 2) for p in points if not any(c == k and lo <= p < hi for k, lo, hi in wide)}


@pytest.mark.parametrize("batch", [7, 20])
def test_pages_of_both_categories_join_to_the_queue(spark, log, batch):
    whole = queues.merged(log).filter("shard = 2").select("category", "at", "task_id").distinct().collect()
    for category in (1, 2):
        want = sorted((r["at"], r["task_id"]) for r in whole if r["category"] == category)
        met, after, after_us = [], -1, -1
        for _ in range(3):
            page = queues.next_page(log, after, after_us, batch).filter((F.col("shard") == 2) & (F.col("category") == category)).orderBy("ord").collect()
            met += [(r["fire_us"] if category == 2 else r["task_id"], r["task_id"]) for r in page]
            if len(page) < batch:
                break
            after, after_us = page[-1]["task_id"], page[-1]["fire_us"] or -1
        assert met == want[: len(met)] and len(met) == min(3 * batch, len(want))


def test_base_pages_that_break_their_contract_are_found(spark):
    rows = [(1, 1, 0, 0, 10, 0, 100, 2, 1), (1, 1, 0, 1, 20, 0, 100, 2, 1), (1, 1, 1, 0, 15, 0, 100, 2, 1), (1, 1, 1, 1, 15, 0, 100, 2, 1)]
    rows += [(1, 1, 2, 0, 120, 0, 100, 2, 1), (1, 1, 3, 0, None, 0, 100, 2, 1), (1, 2, 0, 0, 1, 0, 9, 1, 0), (1, 2, 0, 1, 2, 0, 9, 1, 0)]
    pages = spark.createDataFrame(rows, "shard long, category long, page long, ord long, key long, lo long, hi long, asked long, token long")
    found = {(r["category"], r["page"]): tuple(r[3:]) for r in queues.page_audit(pages).collect()}
    assert found == {(1, 0): (2, 0, 0, 0, 0, 0), (1, 1): (2, 0, 1, 1, 0, 0), (1, 2): (1, 1, 0, 0, 0, 0), (1, 3): (0, 0, 0, 0, 0, 1), (2, 0): (2, 0, 0, 0, 1, 0)}


def test_the_account_of_the_tail(log):
    rows = log.groupBy("shard", "win").agg(F.max("seqno").alias("end")).toPandas()
    found = life.tail_account(log).toPandas().sort_values(["shard", "win"])
    for shard, mine in found.groupby("shard"):
        applied = resolved = 0
        for r in mine.itertuples():
            end = int(rows[(rows["shard"] == shard) & (rows["win"] == r.win)]["end"].iloc[0])
            if r.stalled:
                applied = max(applied, resolved) if r.win % 5 == 3 else r.applied
                assert (r.entries, r.stalled, r.resolved) == (end - resolved, end, resolved) and r.bytes > 0
            else:
                assert r.entries == 0 and r.bytes == 0 and r.resolved == end
            assert r.applied <= r.resolved <= r.acknowledged == end
            resolved = end


def test_history_goes_in_the_order_of_the_log(log):
    found = history.collected(log).collect()
    for r in found:
        at = [tuple(map(int, x.split(".")[:2])) for x in r["in_order"].split(",")]
        assert at == sorted(at) and len(at) == r["batches"] and at[-1][0] == r["tail"]
    assert history.stripped(log).filter("events IS NOT NULL").isEmpty()
    only = history.branch_page(log, 1).select("branch").distinct().collect()
    assert [r["branch"] for r in only] == [1]


def test_the_sink_refuses_before_it_writes(spark, log, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", buckets=2)
    tables.fence(1)
    some = log.filter("seqno <= 3")
    for batch, epoch, shards, why in (
        (some, 0, None, "zero epoch"),
        (some.limit(0), 1, None, "empty batch"),
        (some, 1, [1, 2], "foreign shard"),
        (some.withColumn("kind", F.lit("merge")), 1, None, "unknown kind"),
        (some.withColumn("kind", F.lit(None).cast("string")), 1, None, "unknown kind none"),
    ):
        with pytest.raises(drain.RefusedBatch, match=why):
            drain.apply(tables, epoch, batch, 0, shards)
    assert tables.manifest()["tables"] == {}


def test_tables_that_take_no_history_refuse_it(spark, log, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", buckets=2, history=False)
    tables.fence(1)
    with pytest.raises(drain.RefusedBatch, match="no event batches"):
        drain.apply(tables, 1, log, 0)
    assert drain.apply(tables, 1, log.filter("kind = 'delete'"), 0) and tables.manifest()["applied"]


def test_a_read_that_drains_first_sees_what_a_merged_read_sees(spark, log, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", buckets=2)
    tables.fence(1)
    some = log.filter("shard = 1")
    drain.apply(tables, 1, some.filter("seqno <= 200"), 0)
    found = drain.read_drained(tables, 1, some.filter("seqno > 200"), 1, "items")
    want = overlay.final_items(overlay.whole(some))
    assert want.count() and sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert drain.read_drained(tables, 1, some.limit(0), 2, "items").count() == found.count()


def test_a_batch_that_comes_again_changes_nothing(spark, log, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", buckets=2)
    tables.fence(1)
    assert drain.apply(tables, 1, log.filter("seqno <= 20"), 0)
    before = {n: sorted(map(str, tables.read(n).collect())) for n in ("runs", "items", "tasks", "history")}
    assert not drain.apply(tables, 1, log.filter("seqno <= 20"), 0)
    assert not drain.apply(tables, 1, log.filter("seqno <= 15"), 1), "what is below the watermark is applied already"
    assert {n: sorted(map(str, tables.read(n).collect())) for n in before} == before


def test_nulls_and_ties_in_events(spark):
    rows = [(1, None, "click"), (1, None, "click"), (2, 5, None), (2, 5, "error"), (2, 5, "signup"), (3, None, "purchase")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr(
        "event_id", "user_id", "event_type", "timestamp'2024-01-01 00:00:00' AS ts", "1.0D AS value", "'{\"k\": 85}' AS props"
    )
    found = views.log(events).orderBy("shard", "seqno").collect()
    assert [(r["shard"], r["seqno"], r["kind"]) for r in found] == [
        (None, 1, "update"),
        (None, 2, "update"),
        (None, 3, "range_complete"),
        (2, 1, "update"),
        (2, 2, "delete"),
        (2, 3, "snapshot"),
    ]
    assert views.log(events.limit(0)).count() == 0
