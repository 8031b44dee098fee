"""Seeded streams of legal mutations of all kinds, for tests and acceptance runs."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

KINDS = ("create", "update", "set", "conflict_resolve", "delete", "delete_current", "add_tasks", "range_complete")


@dataclass(frozen=True)
class Knobs:
    """workflows: pool of hot workflows; reuse: how often a step stays with one that has a
    live run; key_reuse: how often a write takes a key in use; the rest are rates of steps."""

    workflows: int = 32
    reuse: float = 0.8
    key_reuse: float = 0.5
    upserts: int = 2
    delete_key: float = 0.3
    tasks: float = 1.5
    snapshot: float = 0.1
    continue_as_new: float = 0.1
    resolve: float = 0.05
    tombstone: float = 0.1
    add_tasks: float = 0.1
    range_complete: float = 0.05


@dataclass
class Mutation:
    seqno: int
    kind: str
    workflow: int
    run: int = 0
    version: int = 0
    new_run: int | None = None
    current_run: int | None = None
    current_version: int = 0
    on_current: bool = False
    upserts: dict[int, int] | None = None
    deletes: tuple[int, ...] = ()
    tasks: tuple[int, ...] = ()
    lo: int = 0
    hi: int = 0


def stream(seed: int, knobs: Knobs = Knobs()) -> Iterator[Mutation]:
    """Mutations 1, 2, ... of one shard; each is legal after those before it."""
    rng = random.Random(seed)
    live: dict[int, tuple[int, int]] = {}  # the running run of a workflow, and its version
    closed: dict[int, tuple[int, int]] = {}  # runs that were continued as new, not deleted yet
    n_runs: dict[int, int] = {}
    keys: dict[tuple[int, int], list[int]] = {}
    seqno = task = 0

    def tasks() -> tuple[int, ...]:
        nonlocal task
        n = sum(rng.random() < knobs.tasks / 3 for _ in range(3))
        task += n
        return tuple(range(task - n + 1, task + 1))

    def writes(workflow: int, run: int, fresh: bool = False) -> dict:
        own = keys.setdefault((workflow, run), [])
        if fresh:
            own.clear()
        ups = {}
        for _ in range(rng.randint(0, knobs.upserts)):
            key = rng.choice(own) if own and rng.random() < knobs.key_reuse else len(own) + rng.randint(0, 3)
            ups[key] = rng.randint(0, 999)
            if key not in own:
                own.append(key)
        gone = tuple(k for k in own if k not in ups and rng.random() < knobs.delete_key / max(1, len(own))) if not fresh else ()
        return {"upserts": ups, "deletes": gone, "tasks": tasks()}

    while True:
        seqno += 1
        roll = rng.random()
        idle = [w for w in range(knobs.workflows) if w not in live]
        if roll < knobs.add_tasks:
            yield Mutation(seqno, "add_tasks", rng.randrange(knobs.workflows), tasks=tasks())
            continue
        if roll < knobs.add_tasks + knobs.range_complete:
            lo = max(1, task - rng.randint(0, 20))
            yield Mutation(seqno, "range_complete", -1, lo=lo, hi=task + rng.randint(0, 3))
            continue
        if not live or idle and rng.random() >= knobs.reuse:
            workflow = rng.choice(idle)
            run = n_runs[workflow] = n_runs.get(workflow, -1) + 1
            live[workflow] = run, 1
            yield Mutation(seqno, "create", workflow, run, 1, on_current=True, **writes(workflow, run, True))
            continue
        workflow = rng.choice(sorted(live))
        run, version = live[workflow]
        version += 1
        roll = rng.random()
        if roll < knobs.tombstone:
            if rng.random() < 0.5 and workflow in closed:
                old, _ = closed.pop(workflow)
                yield Mutation(seqno, "delete", workflow, old)
            elif rng.random() < 0.3:
                yield Mutation(seqno, "delete_current", workflow, run)
                del live[workflow]
            else:
                yield Mutation(seqno, "delete", workflow, run)
                del live[workflow]
            continue
        live[workflow] = run, version
        if roll < knobs.tombstone + knobs.snapshot:
            yield Mutation(seqno, "set", workflow, run, version, **writes(workflow, run, True))
        elif roll < knobs.tombstone + knobs.snapshot + knobs.continue_as_new:
            new = n_runs[workflow] = n_runs[workflow] + 1
            closed[workflow] = run, version
            live[workflow] = new, 1
            yield Mutation(seqno, "update", workflow, run, version, new_run=new, on_current=True, **writes(workflow, run))
        elif roll < knobs.tombstone + knobs.snapshot + knobs.continue_as_new + knobs.resolve and workflow in closed:
            old, old_version = closed[workflow]
            closed[workflow] = run, version
            live[workflow] = old, old_version + 1
            yield Mutation(
                seqno, "conflict_resolve", workflow, old, old_version + 1, current_run=run, current_version=version, on_current=True, **writes(workflow, old, True)
            )
        else:
            yield Mutation(seqno, "update", workflow, run, version, on_current=True, **writes(workflow, run))


def missing(mutations: list[Mutation]) -> list[str]:
    """What a stream doesn't exercise: a test over it would be vacuous there."""
    seen = {m.kind for m in mutations}
    facts = {
        **{k: k in seen for k in KINDS},
        "continued as new": any(m.new_run is not None for m in mutations),
        "deleted keys": any(m.deletes for m in mutations),
        "tasks": any(m.tasks for m in mutations),
    }
    return [name for name, held in facts.items() if not held]


def corpus(spark: SparkSession, seed: int, n: int, shards: int = 4, knobs: Knobs = Knobs()) -> DataFrame:
    """shard, seqno, record (JSON) of n mutations of each shard, made where they are used."""

    def make(frames):
        import pandas as pd

        for frame in frames:
            for shard in frame["shard"]:
                source = islice(stream(seed * 1000 + int(shard), knobs), n)
                while rows := list(islice(source, 5000)):
                    yield pd.DataFrame({"shard": shard, "seqno": [m.seqno for m in rows], "record": [json.dumps(asdict(m)) for m in rows]})

    return spark.range(1, shards + 1, 1, shards).toDF("shard").mapInPandas(make, "shard long, seqno long, record string")


def parse(record: str) -> Mutation:
    fields = json.loads(record)
    ups = fields["upserts"]
    fields["upserts"] = None if ups is None else {int(k): v for k, v in ups.items()}
    return Mutation(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
