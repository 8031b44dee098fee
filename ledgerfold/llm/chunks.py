"""Keyed arrays dealt by key: rows of many entries each, so that shuffles move bytes, not rows.

A chunk holds arrays packed into one binary and belongs to a part, a range of the 64-bit
keys. Jobs deal chunks by part, and in a part by kind and block, and read them as a
stream: a task holds the tables of one part at a time, whatever the number of parts. An
entry costs the size of its arrays; where parts outnumber the keys of a chunk it costs a
row, as in any shuffle by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BATCH, written

CHUNK = "part long, kind int, block long, data binary"
#: Kinds of chunks, in the order in which a part reads them: a table's keys and values,
#: what belongs to them, questions, answers, sums.
HELD, MORE, ASK, ANSWER, SUMS = range(5)
_TYPES = [np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i8", "f8")]
#: Types from here on are ascending 64-bit keys, as differences of so many bytes less this.
_STEPS = 10


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary. Ascending keys, as those of tables and questions are, take as
    many bytes each as their largest difference does."""
    head, parts = [len(arrays)], []
    for a in arrays:
        kind = _TYPES.index(a.dtype)
        if a.dtype == np.uint64 and len(a) > 1 and (a[1:] >= a[:-1]).all():
            steps = np.diff(a)
            width = max(1, (int(steps.max()).bit_length() + 7) // 8)
            if width < 8:
                kind = _STEPS + width
                parts += [a[:1].tobytes(), steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
        if kind < _STEPS:
            parts.append(np.ascontiguousarray(a).tobytes())
        head += [kind, len(a)]
    return b"".join([np.array(head, np.int64).tobytes(), *parts])


def unpack(data: pa.Buffer) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        if kind < _STEPS:
            out.append(np.frombuffer(data, _TYPES[kind], size, at))
            at += size * _TYPES[kind].itemsize
            continue
        width = kind - _STEPS
        steps = np.zeros((size, 8), np.uint8)
        steps[0] = np.frombuffer(data, np.uint8, 8, at)
        steps[1:, :width] = np.frombuffer(data, np.uint8, (size - 1) * width, at + 8).reshape(-1, width)
        out.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64))
        at += 8 + (size - 1) * width
    return out


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The part of each stretch of sorted keys: parts are equal ranges of the keys."""
    of = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(keys) else np.zeros(0, int)
    for a, b in zip(at, np.r_[at[1:], len(keys)]):
        yield int(of[a]), slice(int(a), int(b))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def places_of(keys: np.ndarray) -> np.ndarray:
    """Where each of the keys is among the distinct ones in order."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]) if len(keys) else 0
    return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, them in that order, and where in it each distinct one begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, ranked, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, int)


def tallied(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows by their keys, the first array, and how often each comes; other arrays are equal
    where the keys are."""
    order, ranked, at = _grouped(rows[0])
    return [ranked[at], *(x[order[at]] for x in rows[1:]), np.diff(np.r_[at, len(order)])]


def summed(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows by their keys, the first array; the last is added up, the others are equal."""
    order, ranked, at = _grouped(rows[0])
    return [ranked[at], *(x[order[at]] for x in rows[1:-1]), np.add.reduceat(rows[-1][order], at) if len(at) else rows[-1]]


def stacked(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*pieces)]


class Table:
    """Values by key, from pieces of (keys, values...) without a key in common."""

    def __init__(self, pieces: list[list[np.ndarray]]):
        self.columns = stacked(pieces) if pieces else [np.zeros(0, np.uint64)]
        if len(pieces) > 1:
            order = np.argsort(self.columns[0])
            self.columns = [x[order] for x in self.columns]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and where."""
        held = self.columns[0]
        at = np.searchsorted(held, keys)
        at[at == len(held)] = 0
        return (held[at] == keys if len(held) else np.zeros(len(keys), bool)), at

    def get(self, keys: np.ndarray, column: int, missing) -> np.ndarray:
        there, at = self.find(keys)
        out = np.full(len(keys), missing)
        if there.any():
            out[there] = self.columns[column][at[there]]
        return out


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, bytes) else 8 for x in row)
        if size > BATCH // 2:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def made(df: DataFrame, rows: Callable, schema: str = CHUNK) -> DataFrame:
    """rows(batch) of every Arrow batch of df, as a table."""
    kinds = arrow(schema)
    return df.mapInArrow(lambda found: batches((row for batch in found for row in rows(batch)), kinds), schema)


def dealt(chunks: DataFrame, work: Callable, schema: str = CHUNK) -> DataFrame:
    """work(part, chunks) of every part, as a table: its chunks as (kind, block, arrays,
    further columns) in order of kind and block."""
    kinds = arrow(schema)

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in found:
            heads = (batch.column(i).to_numpy() for i in range(3))
            for i, (part, kind, block) in enumerate(zip(*heads)):
                data = batch.column(3)[i]
                yield part, kind, block, unpack(data.as_buffer()) if data.is_valid else None, [c[i] for c in batch.columns[4:]]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_parts = groupby(read(found), key=lambda row: row[0])
        return batches((row for part, rows in of_parts for row in work(int(part), (r[1:] for r in rows))), kinds)

    return chunks.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(run, schema)


def cut_by_kind(chunks: DataFrame, what: str) -> DataFrame:
    """Chunks written to the shared folder, a folder for each kind, and read again."""
    spark = chunks.sparkSession
    path = written(chunks, what, "kind")
    return spark.read.schema("part long, block long, data binary, kind int").parquet(path).select("part", "kind", "block", "data")


def of_kind(chunks: DataFrame, *kinds: int) -> DataFrame:
    return chunks.filter(F.col("kind").isin(*kinds))
