"""Words of many texts at once, as arrays: their places, their hashes, tables of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of 8 bytes, as Spark's xxhash64 has it for a long."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )
    h = (seed + p5 + np.uint64(8)) ^ (_rotl(x * p2, 31) * p1)
    h = _rotl(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


_made: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2 ** 64, and of its inverse."""
    if n not in _made:
        base = 0x9E3779B97F4A7C15
        x, y = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        x[0] = y[0] = 1
        _made.clear()
        _made[n] = np.multiply.accumulate(x), np.multiply.accumulate(y)
    return _made[n]


class Spans:
    """Hashes of stretches of some bytes, from sums of prefixes."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _powers(1 << max(20, len(data).bit_length()))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return hash_long(value, (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """All words of some texts: the bytes of the texts in a row (A-Z lower-cased), where each
    word starts and ends, its hash, the number of words of each text (null: none), and the
    hashes of other stretches."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    spans: Spans


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    data = LOWER[data] if lower else data
    bounds = bounds - bounds[0]
    word = ~SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[bounds] = True
    before = np.r_[False, word][:-1] & ~breaks[:-1]
    after = np.r_[word, False][1:] & ~breaks[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    spans = Spans(data)
    return Words(data, starts, ends, spans.hashes(starts, ends), np.diff(np.searchsorted(starts, bounds)), spans)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some `size` bytes of `text`, one text at least."""
    sizes = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing; key 0 marks a free slot."""
    size = len(keys) * 10 // 7 + 1
    slots, held = np.zeros(size, np.uint64), np.zeros(size, values.dtype)
    place(slots, held, keys, values)
    return slots, held


def place(slots: np.ndarray, held: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    at = _slot(keys, len(slots))
    while len(keys):
        free = slots[at] == 0
        slots[at[free]] = keys[free]  # of those that meet in a slot, one stays
        won = slots[at] == keys
        held[at[won]] = values[won]
        keys, values, at = keys[~won], values[~won], (at[~won] + 1) % len(slots)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    slots, held = table
    out = np.full(len(keys), missing, held.dtype)
    at, who = _slot(keys, len(slots)), np.arange(len(keys))
    while len(who):
        found = slots[at]
        hit = found == keys[who]
        out[who[hit]] = held[at[hit]]
        on = ~hit & (found != 0)
        who, at = who[on], (at[on] + 1) % len(slots)
    return out


class Numbers:
    """Numbers 0, 1, ... of keys (not 0), in the order of their coming."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self._slots, self._held = np.zeros(1024, np.uint64), np.zeros(1024, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return look_up((self._slots, self._held), keys, -1)

    def add(self, keys: np.ndarray) -> None:
        """Keys that aren't there yet, each once."""
        values = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.keys = np.concatenate([self.keys, keys])
        if len(self.keys) * 10 > len(self._slots) * 7:
            size = 2 * len(self._slots) + 2 * len(keys)
            self._slots, self._held = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            keys, values = self.keys, np.arange(len(self.keys), dtype=np.int32)
        place(self._slots, self._held, keys, values)
