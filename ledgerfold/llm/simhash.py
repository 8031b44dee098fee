"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. A router, a vantage-point tree over
a bounded sample of them, splits the space by Hamming distance to vantage points into
shards. Every fingerprint lives in one shard; those within the radius of a boundary also
visit the shards beyond it, one way only, so each close pair meets exactly where the
outer one lives. In a shard a local vantage-point tree, pruned by the triangle bound,
finds all pairs; what leaves it is a spanning set of links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_name
from .graph import components

SHINGLE, RADIUS = 3, 2
#: Fingerprints a shard should hold, and what makes one be dealt out in blocks. Shards are
#: large, as a local tree's cost hardly grows with them, while each level of the router makes
#: fingerprints visit more shards; but tables that have too few of them for all cores, at
#: CORE_SHARDS each, get more, down to LEAST_ROWS.
SHARD_ROWS, BLOCK_ROWS, LEAST_ROWS, CORE_SHARDS = 1 << 14, 1 << 16, 2000, 4
#: Sampled fingerprints for each shard of the router, and at most.
SAMPLE_PER_SHARD, SAMPLE_MOST = 16, 1 << 20
#: The least part of a node's fingerprints on either side.
LEAST_PART = 0.02
#: Shingles hashed at once, and fingerprints a leaf of a local tree compares directly.
CHUNK, LEAF = 1 << 18, 64

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text (as an unsigned number); that of no words is 0."""
    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if n > 0 else [tuple(words)]
    hashes, counts, n = map(_hash, map(b" ".join, grams)), np.zeros(64, np.int64), max(n, 1)
    for done in range(0, n, CHUNK):
        part = np.fromiter(hashes, np.uint64, min(CHUNK, n - done))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (as a signed 64-bit number) of every whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(of, f"doc_id {kind}, text_hash long, fp long")


def _apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


#: A router's node: vantage point, radius, inner and outer child; a child is a node's
#: index, or -1 minus a shard.
Node = tuple[np.uint64, int, int, int]


def build_router(sample: np.ndarray, shards: int) -> list[Node]:
    """A vantage-point tree whose leaves are the shards 0, 1, ...; node 0 is the root,
    and no nodes mean a single shard.

    A radius is put where the fewest fingerprints inside reach beyond it, for each bit that
    the split tells: in a gap where there is one, else off the middle, where distances
    crowd. Shards go to the sides in proportion.
    """
    nodes: list[Node] = []
    made = 0
    todo = [(np.sort(sample), shards, None)]
    while todo:
        points, n, parent = todo.pop()
        at = None
        if n > 1 and len(points) > 1:
            vantage = points[len(points) // 2]
            d = _apart(points, vantage).astype(int)
            if (radius := _radius(d, n)) is not None:
                inner = d <= radius
                at = len(nodes)
                nodes.append((vantage, radius, 0, 0))
                mine = min(max(1, round(n * inner.mean())), n - 1)
                todo += [(points[~inner], n - mine, (at, 3)), (points[inner], mine, (at, 2))]
        if at is None:
            made += 1
            at = -made
        if parent is not None:
            node = list(nodes[parent[0]])
            node[parent[1]] = at
            nodes[parent[0]] = tuple(node)
    return nodes


def _radius(d: np.ndarray, shards: int) -> int | None:
    """The best radius for these distances; None if they can't be split."""
    counts = np.bincount(d, minlength=65)
    inside = np.cumsum(counts)[:64] / len(d)
    least = max(LEAST_PART, 1 / shards)
    near = (counts[:64] + np.r_[0, counts[:63]]) / len(d)  # within RADIUS of the boundary, inside
    for bound in (least, 0.0):
        fit = np.flatnonzero((inside >= bound) & (inside <= 1 - bound) & (inside > 0) & (inside < 1))
        if len(fit):
            p = inside[fit]
            told = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
            return int(fit[np.argmin((near[fit] + 1e-9) / told)])
    return None


def route(nodes: list[Node], fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a fingerprint, shard, and whether it lives there (else it visits)."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(fps)), True)]
    while todo:
        at, who, home = todo.pop()
        if not len(who):
            continue
        if at < 0:
            out.append((who, np.full(len(who), -1 - at), np.full(len(who), home)))
            continue
        vantage, radius, inner, outer = nodes[at]
        d = _apart(fps[who], vantage).astype(int)
        if home:  # only those inside visit beyond: the outer one of a pair never has to
            todo += [(inner, who[d <= radius], True), (outer, who[d > radius], True)]
            todo.append((outer, who[(d <= radius) & (d + reach > radius)], False))
        else:
            todo += [(inner, who[d - reach <= radius], False), (outer, who[d + reach > radius], False)]
    who, shard, home = (np.concatenate(x) for x in zip(*out))
    return who, shard, home


def near_pairs(homes: np.ndarray, asking: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (i, j) of all pairs with asking[i] and homes[j] at most `reach` bits apart,
    by a vantage-point tree over homes."""
    todo = [(np.arange(len(homes)), np.arange(len(asking)))]
    while todo:
        own, who = todo.pop()
        if not len(own) or not len(who):
            continue
        radius = d = None
        if len(own) > LEAF:
            vantage = homes[own[len(own) // 2]]
            d = _apart(homes[own], vantage).astype(int)
            radius = int(np.median(d))
        if radius is None or (d <= radius).all():
            rows = max(1, (1 << 22) // len(own))
            for at in range(0, len(who), rows):
                i, j = np.nonzero(_apart(asking[who[at : at + rows], None], homes[own][None, :]) <= reach)
                if len(i):
                    yield who[at + i], own[j]
            continue
        q = _apart(asking[who], vantage).astype(int)
        todo.append((own[d <= radius], who[q - reach <= radius]))
        todo.append((own[d > radius], who[q + reach > radius]))


def spanning_links(homes: np.ndarray, visits: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the close pairs of homes with homes or visits do."""
    everyone = np.concatenate([homes, visits])
    label, made = np.arange(len(everyone)), []
    for i, j in near_pairs(homes, everyone, reach):
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for a, b in zip(starts, [*starts[1:], len(i)]):
            found, first = np.unique(label[j[a:b]], return_index=True)
            for old, k in zip(found, first):
                new = label[i[a]]
                if old != new:
                    made.append((i[a], j[a + k]))
                    label[label == old] = new
    ends = np.array(made, int).reshape(-1, 2)
    return everyone[ends[:, 0]], everyone[ends[:, 1]]


def links(fps: DataFrame, reach: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that span, exactly, the components
    of all pairs at most `reach` bits apart."""
    spark = fps.sparkSession
    n = fps.count()
    busy = min(-(-n // LEAST_ROWS), CORE_SHARDS * spark.sparkContext.defaultParallelism)
    shards = max(1, min(max(-(-n // SHARD_ROWS), busy), SAMPLE_MOST // SAMPLE_PER_SHARD))
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(min(n, shards * SAMPLE_PER_SHARD)).toPandas()
    nodes = spark.sparkContext.broadcast(build_router(sample["fp"].to_numpy(np.int64).view(np.uint64), shards))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            if len(fp):
                who, shard, home = route(nodes.value, fp.view(np.uint64), reach)
                yield pd.DataFrame({"fp": fp[who], "shard": shard, "home": home})

    routed = cut(fps.select("fp").mapInPandas(deal, "fp long, shard long, home boolean"), "routed")
    nodes.destroy()
    # a dense shard is dealt out in blocks of homes by blocks of askers: each pair of blocks is a cell
    counts = routed.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("askers"))
    blocks = counts.select(
        F.col("shard").alias("of"),
        F.ceil(F.col("homes") / BLOCK_ROWS).cast("int").alias("hb"),
        F.ceil(F.col("askers") / BLOCK_ROWS).cast("int").alias("ab"),
    )
    one = lambda part, of: F.pmod(F.xxhash64("fp", F.lit(part)), F.greatest(of, F.lit(1))).cast("int")
    dealt = routed.join(blocks, F.col("shard") == F.col("of"))
    every = lambda of: F.sequence(F.lit(0), of - 1)
    as_home = dealt.filter("home").select("shard", one("h", F.col("hb")).alias("h"), F.explode(every(F.col("ab"))).alias("a"), "fp", F.lit(0).alias("role"))
    as_asker = dealt.filter("hb > 0").select("shard", F.explode(every(F.col("hb"))).alias("h"), one("a", F.col("ab")).alias("a"), "fp", F.lit(1).alias("role"))

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = spanning_links(fp[rows["role"].to_numpy() == 0], fp[rows["role"].to_numpy() == 1], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return as_home.union(as_asker).groupBy("shard", "h", "a").applyInPandas(cell, "a long, b long")


def _rooted(fps: DataFrame, reach: int) -> DataFrame:
    """fp, its least doc_id and the root of its component, of every fingerprint."""
    unique = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    rooted = components(links(unique, reach))
    joined = unique.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return cut(joined, "simhash-roots")


def classes(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row.

    docs: doc_id, text; other columns are ignored. Null and empty texts have fingerprint
    0 and link like any other; repeated rows are rows of one class; a null doc_id is
    never the smallest unless there is no other; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, shingle).drop("text_hash"), "simhash")
    joined = _rooted(fps, reach)
    smallest = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    of = cut(joined.join(smallest, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """One row of docs for each class: that with the smallest doc_id (null last), then the
    smallest hash of its text; of rows that repeat both, one."""
    fps = cut(fingerprints(docs, shingle), "simhash")
    # rows of one doc_id and text are of one class, so the two tell which rows stay
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    first = fps.join(_rooted(fps, reach).select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("first"))
    d, h = fresh_name(docs, "_keep"), fresh_name(docs, "_hash")
    keep = cut(first.select(F.col("first.doc_id").alias(d), F.col("first.text_hash").alias(h)), "simhash-kept")
    met = docs.withColumn(h, F.xxhash64("text")).join(keep.withColumnRenamed(h, f"{h}_kept"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(f"{h}_kept")))
    return met.dropDuplicates(["doc_id", h]).select(*(f"`{c}`" for c in docs.columns))
