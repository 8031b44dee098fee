"""The exact fold: what each arriving kind does to what the window holds, and whole corpora."""

from itertools import islice

import pytest

from ledgerfold.sources.generator import Knobs, Mutation, corpus, missing, stream
from ledgerfold.streaming.accumulator import MUST_NOT_EXIST, NONE, InvalidStream, Refused, Window, exact_requests, folded


def window(*mutations):
    w = Window()
    for i, m in enumerate(mutations, 1):
        w.add(Mutation(i, workflow=1, **m))
    return w


CREATE = {"kind": "create", "run": 1, "version": 1, "upserts": {1: 10}}
UPDATE = {"kind": "update", "run": 1, "version": 5, "upserts": {2: 20}}
GROW = UPDATE | {"new_run": 2}
SET = {"kind": "set", "run": 1, "version": 6, "upserts": {3: 30}}
RESOLVE = {"kind": "conflict_resolve", "run": 1, "version": 6, "upserts": {4: 40}}
OTHER = {"kind": "conflict_resolve", "run": 7, "version": 3, "current_run": 1, "current_version": 5}
DELETE = {"kind": "delete", "run": 1}
HOLDS = {"nothing": [], "delta": [UPDATE], "continued": [GROW], "resolved": [OTHER], "snapshot": [SET], "created": [CREATE], "tombstone": [DELETE]}
OUTCOMES = {
    "create": (CREATE, ["ok", InvalidStream, InvalidStream, InvalidStream, InvalidStream, InvalidStream, "ok"]),
    "update": (UPDATE, ["ok", "ok", "ok", "ok", "ok", "ok", InvalidStream]),
    "grow": (UPDATE | {"new_run": 3}, ["ok", "ok", InvalidStream, Refused, Refused, Refused, InvalidStream]),
    "set": (SET, ["ok", "ok", Refused, Refused, "ok", "ok", InvalidStream]),
    "resolve": (RESOLVE, ["ok", "ok", Refused, Refused, "ok", "ok", InvalidStream]),
    "delete": (DELETE, ["ok", "ok", Refused, Refused, "ok", "ok", "ok"]),
}


@pytest.mark.parametrize("arrives", OUTCOMES)
@pytest.mark.parametrize("holds", HOLDS)
def test_shapes(holds, arrives):
    w = window(*HOLDS[holds])
    before = w.drain()
    mutation, outcomes = OUTCOMES[arrives]
    outcome = outcomes[list(HOLDS).index(holds)]
    arriving = Mutation(99, workflow=1, **mutation)
    if outcome == "ok":
        w.add(arriving)
        assert w.last == 99
    else:
        with pytest.raises(outcome):
            w.add(arriving)
        assert w.drain() == before, "a mutation that isn't taken changes nothing"


def test_a_run_that_the_window_holds_live_is_no_new_run():
    live = [{"kind": "create", "run": 2, "version": 1}, UPDATE]
    w = window(*live)
    before = w.drain()
    with pytest.raises(InvalidStream, match="holds live"):
        w.add(Mutation(9, workflow=1, **(UPDATE | {"version": 6, "new_run": 2})))
    assert w.drain() == before
    window({"kind": "create", "run": 2, "version": 1}, {"kind": "delete", "run": 2}, UPDATE | {"new_run": 2})


def test_what_is_not_legal_is_told_before_what_needs_a_new_window():
    w = window(CREATE, {"kind": "delete_current", "run": 4})
    with pytest.raises(InvalidStream):
        w.add(Mutation(9, workflow=1, on_current=True, **CREATE))
    with pytest.raises(Refused):
        w.add(Mutation(9, workflow=1, on_current=True, **UPDATE))


def test_head_and_items():
    w = window(UPDATE, UPDATE | {"version": 6, "deletes": (2,), "upserts": {9: 1}}, SET | {"version": 7})
    ((_, _, _, kind, shape, base, version, *_, ups, dels),) = w.drain()
    assert (kind, shape, base, version, ups, dels) == ("set", "snapshot", 4, 7, 1, 0)


def test_a_create_behind_a_tombstone_stands_on_the_windows_head():
    rows = window(UPDATE, DELETE, CREATE).drain()
    assert [(r[4], r[5]) for r in rows] == [("tombstone", 4), ("snapshot", NONE)]
    assert [r[8] for r in rows] == [1, 0]


def test_taint():
    w = window({"kind": "delete_current", "run": 4})
    assert [r[4] for r in w.drain()] == ["guard"]
    with pytest.raises(Refused):
        w.add(Mutation(9, "update", 1, 4, 2, on_current=True))
    w.add(Mutation(9, "update", 1, 4, 2))
    own = window(CREATE, {"kind": "delete_current", "run": 1})
    assert own.current[1] is None and len(own.requests) == 1
    assert window(CREATE, {"kind": "delete_current", "run": 8}).current[1] == 1


def test_ranges_take_earlier_tasks_and_merge_with_the_last_only():
    w = Window()
    for i, m in enumerate([dict(tasks=(1, 2)), dict(lo=1, hi=3), dict(tasks=(2,)), dict(lo=8, hi=9), dict(lo=2, hi=8), dict(lo=20, hi=21)], 1):
        w.add(Mutation(i, "add_tasks" if "tasks" in m else "range_complete", 1, **m))
    assert w.tasks == [] and w.ranges == [(1, 3), (2, 9), (20, 21)]


def rows_after(drains):
    """Run rows that a sink has after applying requests in order."""
    runs = {}
    for rows in drains:
        for _, workflow, run, _, shape, _, version, *_ in rows:
            if shape == "tombstone":
                runs.pop((workflow, run), None)
            elif shape != "guard":
                runs[workflow, run] = version
    return runs


@pytest.mark.parametrize("seed", range(5))
def test_folding_a_corpus_changes_nothing(seed):
    mutations = list(islice(stream(seed), 3000))
    assert not missing(mutations)
    arms = {size: list(folded(iter(mutations), size)) for size in (1, 64, 256)}
    final = {size: rows_after(w.drain() for _, _, w in arm) for size, arm in arms.items()}
    assert final[1] == final[64] == final[256]
    assert sum(len(w.requests) for _, _, w in arms[256]) < sum(len(w.requests) for _, _, w in arms[1])
    assert any(cause == "refusal" for _, cause, _ in arms[256])


def test_a_corpus_on_spark(spark):
    found = exact_requests(corpus(spark, 7, 500, shards=3), 64).toPandas()
    for shard in (1, 2, 3):
        own = found[found.shard == shard]
        here = [(n, cause, *row) for n, cause, w in folded(islice(stream(7000 + shard), 500), 64) for row in w.drain()]
        assert sorted(own.drop(columns="shard").itertuples(index=False, name=None)) == sorted(here)


def test_a_corpus_of_a_hundred_thousand_collapses():
    """The acceptance run: windows of 1024, 32 hot workflows, seed 20260730."""
    ins = outs = tombstones = refusals = n = 0
    for _, cause, w in folded(islice(stream(20260730), 100_000), 1024):
        rows = w.drain()
        ins, outs, n = ins + w.mutations, outs + len(w.requests), n + 1
        tombstones += sum(r[4] == "tombstone" for r in rows)
        refusals += cause == "refusal"
    assert ins == 100_000 and ins / outs > 1.5 and tombstones and refusals


def test_windows_save_transactions():
    """6,000 mutations, 32 hot workflows: a window of 256 against one of 1."""
    arms = {size: list(folded(islice(stream(20260916), 6000), size)) for size in (1, 256)}
    assert len(arms[1]) == 6000 and len(arms[1]) > 4 * len(arms[256])
    final = [rows_after(w.drain() for _, _, w in arm) for arm in arms.values()]
    assert final[0] == final[1]


def test_control_without_reuse():
    """Workflows that are never met again leave nothing to fold."""
    mutations = list(islice(stream(3, Knobs(workflows=10**6, reuse=0, add_tasks=0, range_complete=0)), 300))
    assert {m.kind for m in mutations} == {"create"}
    assert sum(len(w.requests) for _, _, w in folded(iter(mutations))) == 300
    assert all(b == MUST_NOT_EXIST for _, _, w in folded(iter(mutations)) for b in w.heads.values())
