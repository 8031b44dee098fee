"""The Parquet log and the versioned tables keep the log's contract: a case for each of its rules."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerfold.sources.parquet_log import AlreadyWritten, BadRequest, Fenced, Gap, ParquetLog, acknowledged
from ledgerfold.sources.records import Records
from ledgerfold.sources.tables import OwnershipLost, Tables


@pytest.fixture
def log(spark, tmp_path):
    return ParquetLog(spark, f"file://{tmp_path}/log")


def filled(log, shard=1, epoch=1, n=3):
    log.fence(shard, epoch)
    rows = [(shard, i, f"p{i}") for i in range(1, n + 1)]
    log.append_batch({shard: epoch}, log.spark.createDataFrame(rows, "shard long, seqno long, payload string"), 0)
    return log


def read(log, shard=1, start=1, limit=100):
    return [(r["seqno"], r["payload"]) for r in log.read_from(shard, start, limit).collect()]


def test_appends_come_back_in_order(log):
    log.fence(1, 1)
    for i, p in enumerate("abc", 1):
        log.append(1, 1, i, p)
    assert read(log) == [(1, "a"), (2, "b"), (3, "c")]


def test_gap_is_refused(log):
    filled(log)
    with pytest.raises(Gap):
        log.append(1, 1, 5, "x")
    assert len(read(log)) == 3 and log.next_seqno(1) == 4


def test_duplicate_seqno_is_already_written(log):
    filled(log)
    with pytest.raises(AlreadyWritten):
        log.append(1, 1, 2, "x")
    assert read(log, 1, 2, 1) == [(2, "p2")]


def test_read_from_any_position(log):
    filled(log)
    assert [read(log, 1, start, 2) for start in (-5, 2, 3, 4)] == [[(1, "p1"), (2, "p2")], [(2, "p2"), (3, "p3")], [(3, "p3")], []]
    assert log.entry_at(1, 2) == "p2"
    with pytest.raises(KeyError):
        log.entry_at(1, 9)


def test_arguments_that_the_contract_refuses(log):
    filled(log)
    for wrong in (lambda: log.append(1, 1, 0, "x"), lambda: log.append(1, 1, 4, None), lambda: log.read_from(1, 1, 0), lambda: log.read_from(1, 1, -3)):
        with pytest.raises(BadRequest):
            wrong()
    log.append(1, 1, 4, "")
    assert log.entry_at(1, 4) == ""


def test_a_job_that_fails_changes_nothing(log):
    filled(log)
    bad = log.spark.range(4, 6).select(F.lit(1).cast("long").alias("shard"), F.col("id").alias("seqno"), F.when(F.col("id") < 9, F.raise_error(F.lit("lost"))).alias("payload"))
    with pytest.raises(Exception, match="lost"):
        log.append_batch({1: 1}, bad, 1)
    assert len(read(log)) == 3 and log.next_seqno(1) == 4


def test_trim_removes_up_to_and_nothing_else(log):
    filled(log)
    assert log.trim(1, 2) and not log.trim(1, 2) and not log.trim(1, 0)
    assert read(log) == [(3, "p3")] and log.next_seqno(1) == 4


def test_entries_that_were_read_stay_as_they_were(log):
    filled(log)
    before = log.entries(1)
    log.append(1, 1, 4, "later")
    assert before.count() == 3 and log.entries(1).count() == 4


def test_trim_of_a_log_with_nothing_in_it(log):
    assert not log.trim(1, 5)
    log.fence(1, 1)
    assert not log.trim(1, 5)
    log.append(1, 1, 1, "a")
    assert read(log) == [(1, "a")]


def test_append_below_a_trim_is_refused(log):
    filled(log)
    log.trim(1, 3)
    with pytest.raises((AlreadyWritten, Gap)):
        log.append(1, 1, 2, "again")
    log.append(1, 1, 4, "next")
    assert read(log) == [(4, "next")]


def test_shards_are_independent(log):
    filled(log, 1, 1)
    filled(log, 2, 7, 1)
    log.fence(1, 3)
    log.append(2, 7, 2, "x")
    with pytest.raises(Fenced):
        log.append(1, 1, 4, "x")
    assert log.shards() == [1, 2] and log.next_seqno(9) == 1 and log.entries().count() == 5


def test_append_needs_a_fence_at_its_epoch(log):
    with pytest.raises(Fenced, match="not fenced"):
        log.append(1, 1, 1, "a")
    log.fence(1, 2)
    for epoch in (1, 3):
        with pytest.raises(Fenced):
            log.append(1, epoch, 1, "a")


def test_zero_epoch_is_refused(log):
    for wrong in (lambda: log.fence(1, 0), lambda: log.append(1, 0, 1, "a")):
        with pytest.raises(BadRequest, match="zero epoch"):
            wrong()


def test_fence_cuts_off_lower_epochs(log):
    filled(log, 1, 2)
    ParquetLog(log.spark, log.folder).fence(1, 5)
    with pytest.raises(Fenced):
        log.append(1, 2, 4, "zombie")
    assert log.owner(1) == 5 and len(read(log)) == 3


def test_fenced_outranks_the_other_refusals(log):
    filled(log, 1, 2)
    log.fence(1, 5)
    for seqno in (2, 9):
        with pytest.raises(Fenced):
            log.append(1, 2, seqno, "x")


def test_fence_at_the_same_epoch_does_nothing(log):
    filled(log, 1, 2)
    at = log._of(1).last()
    log.fence(1, 2)
    assert log._of(1).last() == at and len(read(log)) == 3
    log.append(1, 2, 4, "x")


def test_fence_at_a_lower_epoch_is_refused(log):
    filled(log, 1, 4)
    with pytest.raises(Fenced):
        log.fence(1, 3)
    assert log.owner(1) == 4


def test_epoch_grows_without_changing_owner(log):
    filled(log, 1, 1)
    log.fence(1, 2)
    log.append(1, 2, 4, "x")
    assert [r["epoch"] for r in log.entries(1).orderBy("seqno").collect()] == [1, 1, 1, 2]


def test_a_page_ends_at_its_limit_and_not_at_a_byte_budget(log):
    log.fence(1, 1)
    rows = log.spark.range(1, 25).select(F.lit(1).cast("long").alias("shard"), F.col("id").alias("seqno"), F.repeat(F.lit("x"), 256 << 10).alias("payload"))
    log.append_batch({1: 1}, rows, 0)
    assert [len(p) for _, p in read(log, 1, 1, 24)] == [256 << 10] * 24


def test_trims_run_beside_appends(log):
    filled(log)
    other = ParquetLog(log.spark, log.folder)
    assert other.next_seqno(1) == 4
    log.append(1, 1, 4, "a")
    assert other.trim(1, 2)
    log.append(1, 1, 5, "b")
    assert read(other) == [(3, "p3"), (4, "a"), (5, "b")]


def test_two_writers_contend_for_one_shard(log):
    filled(log)
    said = {}

    def write(name):
        try:
            ParquetLog(log.spark, log.folder).append(1, 1, 4, name)
            said[name] = "written"
        except AlreadyWritten:
            said[name] = "taken"

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, s in said.items() if s == "written"]
    assert sorted(said.values()) == ["taken", "written"] and log.entry_at(1, 4) == won[0] and log.entries(1).count() == 4


def test_batches_are_taken_once_and_whole(log):
    filled(log, 1, 1)
    log.fence(2, 4)
    new = log.spark.createDataFrame([(1, 4, "a"), (2, 1, "b"), (2, 2, "c")], "shard long, seqno long, payload string")
    assert log.append_batch({1: 1, 2: 4}, new, 1) == [1, 2]
    assert log.append_batch({1: 1, 2: 4}, new, 1) == []
    for rows, refusal in (([(1, 5, "x"), (1, 7, "y")], Gap), ([(1, 5, "x"), (1, 5, "y")], AlreadyWritten), ([(1, 5, None)], BadRequest), ([(2, 3, "x"), (1, 9, "y")], Gap)):
        with pytest.raises(refusal):
            log.append_batch({1: 1, 2: 4}, log.spark.createDataFrame(rows, "shard long, seqno long, payload string"), 2)
    assert log.entries().count() == 6 and log.next_seqno(2) == 3


def test_an_append_reads_one_record_however_long_the_log(log, monkeypatch):
    log.fence(1, 1)
    for i in range(1, 6):
        log.append(1, 1, i, "x")
    seen = []
    monkeypatch.setattr(Records, "read", lambda self, n, read=Records.read: seen.append(n) or read(self, n))
    monkeypatch.setattr(Records, "numbers", lambda self: pytest.fail("an append lists the records"))
    log.append(1, 1, 6, "y")
    assert set(seen) == {6}


def test_a_compacted_log_reads_as_before(log):
    filled(log, 1, 1)
    log.fence(1, 2)
    log.append(1, 2, 4, "a")
    log.trim(1, 1)
    before = log.entries(1).orderBy("seqno").collect()
    log.compact(1)
    log.append(1, 2, 5, "b")
    fresh = ParquetLog(log.spark, log.folder)
    assert fresh.entries(1).orderBy("seqno").collect()[:-1] == before and fresh.owner(1) == 2 and len(fresh._of(1).numbers()) == 2


def test_pages_cover_the_log_and_must_get_on(log):
    filled(log, 1, 1, 5)
    assert [[r["seqno"] for r in page] for page in log.pages(1, 2, 2)] == [[2, 3], [4, 5]]
    stuck = [{"seqno": 1}, {"seqno": 1}]
    with pytest.raises(RuntimeError):
        list(log.pages(1, 2, 2, lambda *_: stuck))


def test_acknowledged_appends_are_read_back(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "shard long, seqno long, payload string")
    held, acked = rows((1, 1, "a"), (1, 2, "z"), (1, 4, "d")), rows((1, 1, "a"), (1, 2, "b"), (1, 3, "c"))
    assert acknowledged(held, acked).collect()[0][1:] == (1, 1, 1, 0)


def test_pressure_and_close(log):
    filled(log)
    assert (log.pressure(0, 0), log.pressure(1 << 62, 0), log.pressure(1 << 62, 1 << 62)) == (0, 1, 2)
    log.close()
    assert log.next_seqno(1) == 4 and log.owner(1) == 1


# ---- tables ------------------------------------------------------------------------------


def test_readers_see_one_version(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables.fence(1)
    assert tables.read("a") is None
    tables.commit(1, {"a": spark.range(3), "b": spark.range(1)}, {"1": 7}, 0)
    before = tables.read("a")
    tables.commit(1, {"a": spark.range(5)}, {"2": 4}, 1)
    assert before.count() == 3 and tables.read("a").count() == 5 and tables.read("b").count() == 1
    assert tables.manifest()["applied"] == {"1": 7, "2": 4}
    assert not tables.commit(1, {"a": spark.range(9)}, {}, 1), "a batch that is committed stays as it is"


def test_a_commit_replaces_the_buckets_it_touches(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables.fence(1)
    of = lambda *rows: spark.createDataFrame(list(rows), "id long, bucket int")
    tables.commit(1, {"a": (of((1, 0), (2, 1), (3, 2)), [0, 1, 2])}, {}, 0)
    first = tables.manifest()["tables"]["a"]
    tables.commit(1, {"a": (of((20, 1)), [1, 2])}, {}, 1)
    second = tables.manifest()["tables"]["a"]
    assert sorted(r["id"] for r in tables.read("a").collect()) == [1, 20] and second["0"] == first["0"] and "2" not in second
    assert [r["id"] for r in tables.read("a", [1]).collect()] == [20]


def test_tables_are_owned_shard_by_shard(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables.fence(2)
    tables.fence(2)
    tables.fence(5, shard=1)
    for wrong in (lambda: tables.fence(1), lambda: tables.fence(4, shard=1), lambda: tables.fence(3)):
        with pytest.raises(OwnershipLost):
            wrong()
    with pytest.raises(OwnershipLost):
        tables.commit(2, {"a": spark.range(1)}, {"1": 3, "2": 3}, 0)
    assert tables.commit(5, {"a": spark.range(1)}, {"1": 3}, 0) and tables.commit(2, {"a": spark.range(1)}, {"2": 3}, 1)


def test_two_commits_of_one_epoch_cannot_both_pass(spark, tmp_path):
    tables, other = (Tables(spark, f"file://{tmp_path}/t") for _ in range(2))
    tables.fence(1)
    held = other.manifest()
    tables.commit(1, {"a": spark.range(3)}, {"1": 3}, 0)
    with pytest.raises(OwnershipLost, match="moved"):
        other.commit(1, {"a": spark.range(9)}, {"1": 9}, 0, held)
    assert tables.read("a").count() == 3
