"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments, each with a table from values to codes. A code
within m * r + a bits of a query is within r bits of it in one of the first a + 1
segments, or within r - 1 in another. So segments are searched in turn with growing
radius, every code found is verified, and a query is done when k verified distances are
within the distance covered so far; what it has then is exact.

Distinct codes and distinct queries are dealt to cells, a block of queries by a shard of
codes, each of bounded size; a cell gives each query its nearest codes there, and the
nearest of all cells are the result. Copies of a code stay one code with its smallest
ids, so a code that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries and codes of a cell; pairs verified at once; parts of a code's copies.
QUERY_BLOCK, CODE_SHARD, PAIRS, SALTS = 4000, 50_000, 1 << 21, 64


def sign_code(vector: Column) -> Column:
    """The signs of a vector's at most 64 entries as bits (1: above 0; NaN counts so). A wider
    vector is refused: its first entries alone would not find its nearest."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    wide = F.raise_error(F.concat(F.lit("vector of more than 64 entries: "), F.size(vector).cast("string")))
    held = F.when(F.size(vector) > 64, wide.cast("array<double>")).otherwise(vector.cast("array<double>"))
    return F.aggregate(F.transform(held, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def nearest(codes: np.ndarray, weight: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of all codes that may be among a query's k nearest rows:
    those no farther than its k-th row. weight: rows of each code."""
    m = int(np.clip(round(64 / max(1.0, np.log2(max(len(codes), 2)))), 4, 16))
    edges = np.linspace(0, 64, m + 1).astype(int)
    segment = lambda x, s: ((x >> np.uint64(edges[s])) & np.uint64((1 << int(edges[s + 1] - edges[s])) - 1)).astype(np.int64)
    tables = []
    for s in range(m):
        value = segment(codes, s)
        order = np.argsort(value, kind="stable")
        tables.append((order, np.searchsorted(value[order], np.arange((1 << int(edges[s + 1] - edges[s])) + 1))))
    rows = np.zeros((len(asked), 65), np.int64)  # of each query at each distance
    active, out = np.arange(len(asked)), []
    need = min(k, int(weight.sum()))
    for covered in range(65 + 16 * m):
        r, a = divmod(covered, m)
        width = int(edges[a + 1] - edges[a])
        order, at = tables[a]
        if r <= width:
            masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)
            step = max(1, PAIRS // max(1, len(masks)))
            for lo in range(0, len(active), step):
                who = active[lo : lo + step]
                probe = (segment(asked[who], a)[:, None] ^ masks[None, :]).ravel()
                size = at[probe + 1] - at[probe]
                hit = np.flatnonzero(size)
                for part in np.array_split(hit, max(1, int(size.sum()) // PAIRS)):
                    n = size[part]
                    q = np.repeat(who[part // len(masks)], n)
                    c = order[np.repeat(at[probe[part]], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
                    apart = asked[q] ^ codes[c]
                    fresh = np.ones(len(q), bool)  # not found by an earlier step
                    for s in range(m):
                        if s != a:
                            fresh &= np.bitwise_count(segment(apart, s)) > (r if s < a else r - 1)
                    q, c, d = q[fresh], c[fresh], np.bitwise_count(apart[fresh]).astype(int)
                    np.add.at(rows, (q, d), weight[c])
                    out.append((q, c, d))
        known = np.cumsum(rows[active, : min(covered, 64) + 1], 1)[:, -1]
        active = active[known < need]
        if not len(active):
            break
    if not out:
        return (np.zeros(0, np.int64),) * 3
    q, c, d = (np.concatenate(x) for x in zip(*out))
    limit = (np.cumsum(rows, 1) >= need).argmax(1)
    keep = d <= limit[q]
    return q[keep], c[keep], d[keep]


def search(rows: DataFrame, asking: Column, k: int = 10) -> DataFrame:
    """query_id, rank (1 to k), neighbor_id, distance: the k nearest other rows of every row
    that `asking` holds for; ties by smaller id.

    rows: id, code (a long); rows without id or code are neither found nor ask. Repeated
    rows count once; an id with several codes asks with each and is never its own
    neighbour. With fewer than k other rows there are fewer neighbours. An empty table, or
    no query, gives an empty result.
    """
    known = cut(rows.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct(), "codes")
    # the k + 1 smallest ids of each code, by parts of its rows and then altogether
    by_id = Window.partitionBy("code", "salt").orderBy("id")
    salted = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(by_id))
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")
    index = cut(salted.filter(F.col("nth") <= k + 1).groupBy("code").agg(ids), "code-index")
    asked = cut(known.filter(asking).select(F.col("id").alias("query_id"), F.col("code").alias("query")), "asking")
    queries = cut(asked.select("query").distinct(), "queries")
    shards, blocks = max(1, -(-index.count() // CODE_SHARD)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    as_code = index.select(every(blocks).alias("block"), one("code", shards).alias("shard"), "code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"))
    as_query = queries.select(one("query", blocks).alias("block"), every(shards).alias("shard"), F.col("query").alias("code"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("least"))

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows["n"].to_numpy() > 0
        code = rows["code"].to_numpy().view(np.uint64)
        codes, asked, weight = code[held], code[~held], rows["n"].to_numpy()[held].astype(np.int64)
        q, c, d = nearest(codes, weight, asked, k + 1)
        least = rows["least"].to_numpy()[held].astype(np.int64)
        order = np.lexsort((least[c], d, q))
        q, c, d = q[order], c[order], d[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) <= k  # a code behind k + 1 others can't matter
        return pd.DataFrame({"query": asked[q[first]].view(np.int64), "code": codes[c[first]].view(np.int64), "distance": d[first]})

    near = as_code.union(as_query).groupBy("block", "shard").applyInPandas(cell, "query long, code long, distance int")
    near = cut(near, "near-codes").join(index, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    best = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    top = cut(near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1), "near-rows")
    other = asked.join(top, "query").filter("neighbor_id <> query_id")
    own = Window.partitionBy("query_id", "query").orderBy("nth")
    return (
        other.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
    )
