"""The exact fold: mutations of all kinds, one at a time, into requests.

What a mutation does depends on what the window holds of its run, several runs may share
a request, and some mutations can't join a window at all: then it is drained first. So a
shard's mutations pass in order through one task, which remembers the window only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.generator import Mutation, parse

#: Assertions: the version a run must be at, or one of these.
MUST_NOT_EXIST, NONE = -1, -2


class Refused(Exception):
    """Legal, but only in a new window."""


class InvalidStream(Exception):
    """Not legal after what came before."""


@dataclass
class Part:
    """What a window does to one run: delta, snapshot or tombstone."""

    run: int
    shape: str
    version: int = 0
    upserts: dict[int, int] = field(default_factory=dict)
    deletes: set[int] = field(default_factory=set)

    def write(self, m: Mutation) -> None:
        """The mutation's changes over those held; a key is written or deleted, not both."""
        for key in m.deletes:
            self.upserts.pop(key, None)
            if self.shape == "delta":
                self.deletes.add(key)
        for key, value in (m.upserts or {}).items():
            self.upserts[key] = value
            self.deletes.discard(key)
        self.version = m.version

    def reset(self, m: Mutation) -> None:
        self.shape, self.upserts, self.deletes = "snapshot", {}, set()
        self.write(m)


@dataclass
class Request:
    """One write of a drain: the parts of one workflow that must land together."""

    kind: str
    workflow: int
    tail: int
    parts: list[Part]


@dataclass
class Window:
    """An accumulator of one shard."""

    held: dict[tuple[int, int], tuple[Request, Part]] = field(default_factory=dict)
    requests: list[Request] = field(default_factory=list)
    heads: dict[tuple[int, int], int] = field(default_factory=dict)
    current: dict[int, int | None] = field(default_factory=dict)
    tainted: set[int] = field(default_factory=set)
    tasks: list[int] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)
    last: int = 0
    mutations: int = 0

    def add(self, m: Mutation) -> None:
        """Folds a mutation; raises before anything is changed."""
        if m.seqno <= self.last:
            raise InvalidStream(f"seqno {m.seqno} after {self.last}")
        getattr(self, m.kind)(m)
        self.tasks += m.tasks
        self.last, self.mutations = m.seqno, self.mutations + 1

    def _open(self, m: Mutation, *parts: Part) -> Request:
        request = Request(m.kind, m.workflow, m.seqno, list(parts))
        self.requests.append(request)
        for p in parts:
            self.held[m.workflow, p.run] = request, p
        return request

    def _admit(self, m: Mutation) -> None:
        """What is legal may still need a new window: asked after whether it is legal."""
        if m.on_current and m.workflow in self.tainted:
            raise Refused("it asserts a current row that the window deletes unasserted")

    def _assert(self, workflow: int, run: int, base: int) -> None:
        """The first toucher of a run fixes what the window asserts of it."""
        self.heads.setdefault((workflow, run), base)

    def _find(self, m: Mutation, run: int) -> tuple[Request | None, Part | None]:
        request, part = self.held.get((m.workflow, run), (None, None))
        if part is not None and part.shape == "tombstone" and m.kind not in ("create", "delete"):
            raise InvalidStream(f"{m.kind} of run {run} after its tombstone")
        return request, part

    def _lives(self, workflow: int, run: int) -> bool:
        _, part = self.held.get((workflow, run), (None, None))
        return part is not None and part.shape != "tombstone"

    def create(self, m: Mutation) -> None:
        _, part = self._find(m, m.run)
        if part is not None and part.shape != "tombstone":
            raise InvalidStream(f"run {m.run} exists")
        self._admit(m)
        self._assert(m.workflow, m.run, MUST_NOT_EXIST)
        new = Part(m.run, "snapshot")
        new.write(m)
        self._open(m, new)
        self.current[m.workflow] = m.run

    def update(self, m: Mutation) -> None:
        request, part = self._find(m, m.run)
        grows = m.new_run is not None
        if grows and self._lives(m.workflow, m.new_run):
            raise InvalidStream(f"continued as new into run {m.new_run}, which the window holds live")
        if part is not None and grows:
            if part.shape == "snapshot" or request.kind == "conflict_resolve":
                raise Refused("a second run can't join this request")
            if len(request.parts) > 1:
                raise InvalidStream("continued as new twice")
        self._admit(m)
        self._assert(m.workflow, m.run, m.version - 1)
        if part is None:
            part = Part(m.run, "delta")
            request = self._open(m, part)
        part.write(m)
        request.tail = m.seqno
        if grows:
            new = Part(m.new_run, "snapshot", 1)
            request.parts.append(new)
            self.held[m.workflow, m.new_run] = request, new
            self._assert(m.workflow, m.new_run, MUST_NOT_EXIST)
        if m.on_current:
            self.current[m.workflow] = m.new_run if grows else m.run

    def _replace(self, m: Mutation, multi: bool) -> tuple[Request | None, Part | None]:
        """Makes way for a whole state of a run: what of the window it supersedes."""
        request, part = self._find(m, m.run)
        if part is None:
            return None, None
        if part.shape == "delta":
            if len(request.parts) > 1 or request.kind == "conflict_resolve":
                raise Refused("a state over one of several runs of a request")
        elif multi:
            raise Refused("several parts over a state")
        return request, part

    def set(self, m: Mutation) -> None:
        request, part = self._replace(m, False)
        self._admit(m)
        self._assert(m.workflow, m.run, m.version - 1)
        if part is None:
            part = Part(m.run, "snapshot")
            request = self._open(m, part)
        elif part.shape == "delta":
            request.kind = "set"
        part.reset(m)
        request.tail = m.seqno

    def conflict_resolve(self, m: Mutation) -> None:
        multi = m.current_run is not None or m.new_run is not None
        if m.new_run is not None and self._lives(m.workflow, m.new_run):
            raise InvalidStream(f"continued as new into run {m.new_run}, which the window holds live")
        request, part = self._replace(m, multi)
        other_request, other = self._find(m, m.current_run) if m.current_run is not None else (None, None)
        if other is not None and (other.shape != "delta" or len(other_request.parts) > 1):
            raise Refused("the current run's change can't be merged")
        self._admit(m)
        self._assert(m.workflow, m.run, m.version - 1)
        if part is not None and not multi:
            part.reset(m)
            request.tail = m.seqno
        else:
            reset = Part(m.run, "snapshot")
            reset.reset(m)
            if request is not None:
                self.requests.remove(request)
            parts = [reset]
            if m.current_run is not None:
                self._assert(m.workflow, m.current_run, m.current_version - 1)
                if other_request is not None:
                    self.requests.remove(other_request)
                other = other or Part(m.current_run, "delta")
                other.version = m.current_version
                parts.append(other)
            if m.new_run is not None:
                self._assert(m.workflow, m.new_run, MUST_NOT_EXIST)
                parts.append(Part(m.new_run, "snapshot", 1))
            self._open(m, *parts)
        self.current[m.workflow] = m.new_run if m.new_run is not None else m.run

    def delete(self, m: Mutation) -> None:
        request, part = self._find(m, m.run)
        if part is not None and part.shape == "tombstone":
            return
        if part is not None and len(request.parts) > 1:
            raise Refused("it deletes one of several runs of a request")
        self._admit(m)
        self._assert(m.workflow, m.run, NONE)
        if part is not None:
            self.requests.remove(request)
        self._open(m, Part(m.run, "tombstone"))

    def delete_current(self, m: Mutation) -> None:
        if m.workflow in self.current:
            if self.current[m.workflow] == m.run:
                self.current[m.workflow] = None  # the window's own write goes
        else:
            self._open(m)  # the store deletes the row if it names the run
        self.tainted.add(m.workflow)

    def add_tasks(self, m: Mutation) -> None:
        pass  # tasks are collected for every kind

    def range_complete(self, m: Mutation) -> None:
        """Drops the window's tasks that came before; merges with the last range if joined."""
        self.tasks = [t for t in self.tasks if not m.lo <= t < m.hi]
        if self.ranges and m.lo <= self.ranges[-1][1] and self.ranges[-1][0] <= m.hi:
            lo, hi = self.ranges.pop()
            self.ranges.append((min(lo, m.lo), max(hi, m.hi)))
        else:
            self.ranges.append((m.lo, m.hi))

    def drain(self) -> list[tuple]:
        """(ord, workflow, run, kind, shape, base, version, tail, first_of_workflow, upserts,
        deletes) of each part of each request, in the order of last mutations."""
        out, met, asserted = [], set(), set()
        for n, r in enumerate(sorted(self.requests, key=lambda r: r.tail)):
            for p in r.parts or [Part(-1, "guard")]:
                base = self.heads.get((r.workflow, p.run), NONE) if (r.workflow, p.run) not in asserted else NONE
                asserted.add((r.workflow, p.run))
                out.append((n, r.workflow, p.run, r.kind, p.shape, base, p.version, r.tail, int(r.workflow not in met), len(p.upserts), len(p.deletes)))
            met.add(r.workflow)
        return out


COLUMNS = "ord workflow run kind shape base version tail first_of_workflow upserts deletes".split()


def folded(mutations: Iterator[Mutation], size: int = 256) -> Iterator[tuple[int, str, Window]]:
    """Window number, why it was drained, and the window. A mutation that is refused is
    folded again, once, into the empty window after the drain."""
    n, window = 0, Window()
    for m in mutations:
        try:
            window.add(m)
        except Refused:
            yield n, "refusal", window
            n, window = n + 1, Window(last=window.last)
            window.add(m)
        if window.mutations >= size:
            yield n, "mutations", window
            n, window = n + 1, Window(last=window.last)
    if window.mutations:
        yield n, "explicit", window


def exact_requests(corpus: DataFrame, size: int = 256) -> DataFrame:
    """shard, win, cause and the parts of all requests of a corpus (shard, seqno, record)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shards():
            for frame in frames:
                yield from zip(frame["shard"], frame["record"])

        rows = shards()
        ahead = next(rows, None)
        while ahead is not None:
            shard = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    yield parse(ahead[1])
                    ahead = next(rows, None)

            for n, cause, window in folded(own(), size):
                out = pd.DataFrame(window.drain(), columns=COLUMNS)
                out.insert(0, "cause", cause)
                out.insert(0, "win", n)
                out.insert(0, "shard", shard)
                yield out

    ordered = corpus.repartition("shard").sortWithinPartitions("shard", "seqno")
    return ordered.mapInPandas(run, "shard long, win long, cause string, ord long, workflow long, run long, kind string, shape string, base long, version long, tail long, first_of_workflow long, upserts long, deletes long")
