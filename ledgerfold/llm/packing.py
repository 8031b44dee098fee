"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of at most the longest length. Pieces are dealt to groups by a
seeded hash, and each group is packed by itself: longest pieces first, each into the open
bin that it fills best. When none fits, a bin is opened, of the permitted size that costs
least for each word that it is expected to hold: with the pieces still to come that fill it
best. So one packing mixes the sizes. Every bin is at last downsized to the cheapest size
that holds its contents. A group is also packed with one preferred opening size throughout,
for each of them, and the packing of least total cost stands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, seeded_key, word_count


@dataclass(frozen=True)
class Lengths:
    """sizes: permitted lengths, ascending; costs: of a sequence of each, in any unit (by
    default its length); group: pieces packed together, at most; seed: of the dealing."""

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    costs: tuple[float, ...] | None = None
    group: int = 8192
    seed: int = 5

    def cost(self, at: int) -> float:
        return self.costs[at] if self.costs else float(self.sizes[at])


def best_fit(sizes: list[int], opening: Callable[[int], int]) -> tuple[list[int], list[list[int]]]:
    """Bin of each piece, and the pieces of each bin. sizes: descending; opening(i): the
    capacity of the bin that piece i opens. Of equally full bins the oldest is taken."""
    rest: list[tuple[int, int]] = []  # room and bin, ascending
    of, bins = [], []
    for i, size in enumerate(sizes):
        at = bisect_left(rest, (size, -1))
        if at < len(rest):
            room, b = rest.pop(at)
        else:
            room, b = opening(i), len(bins)
            bins.append([])
        of.append(b)
        bins[b].append(i)
        if room > size:
            insort(rest, (room - size, b))
    return of, bins


def expected_fill(sizes: list[int], i: int, capacity: int) -> int:
    """What a bin of that capacity holds when piece i opens it and the longest pieces behind
    it that fit go in. sizes: descending."""
    room, at, n = capacity - sizes[i], i + 1, len(sizes)
    while room and at < n:
        at = bisect_left(sizes, -room, at, key=lambda size: -size)  # the first that is no longer than the room
        if at == n or not sizes[at]:
            break
        room -= sizes[at]
        at += 1
    return capacity - room


def pack(sizes: np.ndarray, lengths: Lengths = Lengths()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, capacity of the bin and place in it, of pieces of descending size."""
    permitted = np.array(lengths.sizes)
    cost = np.array([lengths.cost(i) for i in range(len(permitted))])
    cheapest = [int(permitted[i:][np.argmin(cost[i:])]) for i in range(len(permitted))]
    cost_of = {c: float(cost[i]) for i, c in enumerate(lengths.sizes)}
    fitting = lambda n: cheapest[bisect_left(lengths.sizes, n)]
    pieces = sizes.tolist()

    def least_cost(i: int) -> int:
        """The size of the least cost a word, as its contents are expected; the smaller of equals."""
        best = None
        for capacity in lengths.sizes[bisect_left(lengths.sizes, pieces[i]) :]:
            fill = expected_fill(pieces, i, capacity)
            price = cost_of[fitting(fill)] / fill
            if best is None or price < best[0]:
                best = price, capacity
        return best[1]

    def preferring(at: int) -> Callable[[int], int]:
        return lambda i: lengths.sizes[max(at, bisect_left(lengths.sizes, pieces[i]))]

    best = None
    for opening in (least_cost, *map(preferring, range(len(permitted)))):
        of, bins = best_fit(pieces, opening)
        fitted = [fitting(sum(pieces[i] for i in b)) for b in bins]
        total = sum(cost_of[c] for c in fitted)
        if best is None or total < best[0]:
            best = total, of, bins, fitted
    _, of, bins, fitted = best
    place = np.zeros(len(pieces), np.int64)
    for b in bins:
        place[b] = np.r_[0, np.cumsum(sizes[b])[:-1]]
    of = np.array(of, np.int64)
    return of, np.array(fitted, np.int64)[of] if len(of) else of, place


def pieces(docs: DataFrame, lengths: Lengths = Lengths()) -> DataFrame:
    """doc_id, text_hash, n_words, piece, size of every piece."""
    longest = lengths.sizes[-1]
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count().alias("n_words"))
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(n_words - 1) div {longest}"), F.lit(0)))
    return counted.withColumn("piece", F.explode(numbers)).withColumn(
        "size", F.least(F.col("n_words") - F.col("piece") * longest, F.lit(longest)).cast("long")
    )


def packed(docs: DataFrame, lengths: Lengths = Lengths()) -> DataFrame:
    """doc_id, text_hash, piece, size, bin, capacity, place of every piece.

    docs: doc_id, text; other columns are ignored. A null or empty text has one piece of
    size 0, which is in no bin (nulls). A text longer than the longest length has several
    pieces, and no word is left out. Repeated rows are packed as often as they come. A
    group that has more than lengths.group pieces (as of rows all alike) is packed in
    several goes. An empty table gives an empty result.
    """
    every = cut(pieces(docs, lengths), "pieces")
    groups = max(1, -(-2 * every.count() // lengths.group))
    key = seeded_key(lengths.seed, F.col("doc_id"), F.col("text_hash"), F.col("piece"))
    dealt = every.withColumn("group", F.pmod(key, F.lit(groups)))
    order = ["group", F.col("size").desc(), "doc_id", "text_hash", "piece"]
    ordered = dealt.repartition("group").sortWithinPartitions(*order)

    def done(rows: pd.DataFrame, go: int) -> pd.DataFrame:
        real = rows["size"].to_numpy() > 0
        bins, capacity, place = pack(rows["size"].to_numpy()[real], lengths)
        out = rows[["doc_id", "text_hash", "piece", "size"]].copy()
        for name, value in (("bin", [f"{rows['group'].iat[0]}-{go}-{b}" for b in bins]), ("capacity", capacity), ("place", place)):
            full = pd.Series([None] * len(rows), dtype=object if name == "bin" else "Int64")
            full[real] = value
            out[name] = full.to_numpy(dtype=object)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, go = None, 0
        for frame in frames:
            for group, rows in frame.groupby("group", sort=False):
                if held is not None and held["group"].iat[0] != group:
                    yield done(held, go)
                    held, go = None, 0
                held = rows if held is None else pd.concat([held, rows])
                while len(held) > lengths.group:
                    yield done(held.iloc[: lengths.group].reset_index(drop=True), go)
                    held, go = held.iloc[lengths.group :], go + 1
                held = held.reset_index(drop=True)
                if not len(held):
                    held = None
        if held is not None:
            yield done(held, go)

    kind = dict(docs.dtypes)["doc_id"]
    return ordered.mapInPandas(
        run, f"doc_id {kind}, text_hash long, piece long, size long, bin string, capacity long, place long"
    )
