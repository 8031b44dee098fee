"""The exact cycle: windows that close by count, bytes or age, as entries come.

Where a window ends depends on what is in it, so a shard's entries pass in order through
one task. Entries stream through it in batches, and no more than the window at hand is
remembered; shards spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of the triggers and of trims.
MUTATIONS, BYTES, AGE_S, TRIM_DRAINS = 256, 256 << 10, 5.0, 16


def exact_windows(
    entries: DataFrame, mutations: int = MUTATIONS, size: int = BYTES, age_s: float = AGE_S, trim_drains: int = TRIM_DRAINS
) -> DataFrame:
    """shard, win, first, last, mutations, bytes, workflows, cause, trims of each window.

    A window closes with the mutation that reaches a bound (count is named before bytes),
    before an entry that comes `age_s` or more after its first, and, by refusal, before a
    snapshot of a run that it has already deleted keys of and reset (which one change can't
    hold). trims: whether this drain is one of every trim_drains.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _Cycle(mutations, size, age_s, trim_drains).run(frames)

    ordered = (
        entries.select("shard", "seqno", "workflow", "run", "kind", "size", F.unix_micros("ts").alias("at_us"))
        .repartition("shard")
        .sortWithinPartitions("shard", "seqno")
    )
    return ordered.mapInPandas(run, ", ".join(f"{c} {'string' if c == 'cause' else 'long'}" for c in COLUMNS))


COLUMNS = ["shard", "win", "first", "last", "mutations", "bytes", "workflows", "cause", "trims"]


class _Cycle:
    """The window at hand of one shard after another."""

    def __init__(self, mutations: int, size: int, age_s: float, trim_drains: int):
        self.mutations, self.size, self.age_us, self.trim_drains = mutations, size, age_s * 1e6, trim_drains
        self.shard, self.win = None, 0
        self._empty()

    def _empty(self) -> None:
        self.first = self.last = self.at_us = None
        self.n = self.bytes = 0
        self.workflows: set[int] = set()
        self.reset: set[tuple[int, int]] = set()

    def _close(self, cause: str) -> tuple:
        self.win += 1
        trims = int(self.win % self.trim_drains == 0)
        row = (self.shard, self.win - 1, self.first, self.last, self.n, self.bytes, len(self.workflows), cause, trims)
        self._empty()
        return row

    def add(self, e) -> list[tuple]:
        out = []
        if e.shard != self.shard:
            if self.n:
                out.append(self._close("explicit"))
            self.shard, self.win = e.shard, 0
        if self.n and e.at_us - self.at_us >= self.age_us:
            out.append(self._close("age"))
        elif e.kind == "snapshot" and (e.workflow, e.run) in self.reset:
            out.append(self._close("refusal"))
        if not self.n:
            self.first, self.at_us = e.seqno, e.at_us
        self.last, self.n, self.bytes = e.seqno, self.n + 1, self.bytes + e.size
        self.workflows.add(e.workflow)
        if e.kind == "snapshot":
            self.reset.add((e.workflow, e.run))
        if self.n >= self.mutations:
            out.append(self._close("mutations"))
        elif self.bytes >= self.size:
            out.append(self._close("bytes"))
        return out

    def run(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for e in frame.itertuples(index=False) for r in self.add(e)], columns=COLUMNS)
        if self.n:
            yield pd.DataFrame([self._close("explicit")], columns=COLUMNS)
