"""LM scoring by a probabilistic suffix tree over words.

Symbols are lower-cased words and an end mark; words not seen in training are one more
symbol. Contexts are the last 1 to DEPTH words (begin marks stand before a text). The
tree grows from the root: a context becomes a node if its suffix is one, it is frequent
enough, and its next-symbol distribution diverges from its suffix's by more than a
threshold (summed log-likelihood gain for each distinct next symbol). Distributions are
smoothed: symbols that are seen more than once in a context have a
discounted frequency, all others share the rest as the suffix's distribution has them,
down to the root's, which adds one to each count. A text is scored from the longest suffix of
each position's history that is a node.

Everything is counted over the whole training corpus, level by level. A window (a context
and a symbol after it) is known by a 64-bit hash; windows, nodes, questions for them and
answers are packed into chunks that are dealt by ranges of the hash (chunks.py), so no
worker ever holds more than the entries of one range. A node's total is the count of its
words as a window, so one table of windows with their counts, and the nodes' factors, are
the whole model. To score, texts are put into blocks that are written down; each block asks
for its distinct windows, once each, and what comes back meets the block again. That takes
the same few passes whatever the size of vocabulary and tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import (
    ANSWER, ASK, CHUNK, HELD, MORE, SUMS, Table, arrow, batches, by_part, cut_by_kind, dealt, distinct, made, narrow, of_kind, pack, places_of, stacked,
    summed, tallied, unpack,
)
from .common import bit_map, cut, drop_cut, in_map, lean, small_batches, text_of
from .words import slices, words_of

#: Words of the longest context; the least gain in nats for each symbol that a node gives
#: its own probability; the discount of each count.
DEPTH, LEAST_GAIN, DISCOUNT = 3, 1.0, 0.75
#: Least occurrences of a context, whatever the size of the corpus; symbols of one need two.
LEAST_COUNT, LEAST_SYMBOL = 8, 2
#: Bytes of training text for each part of the windows; windows that a task adds up before it
#: passes them on; bytes of text hashed at once, and of a block's texts.
PART_BYTES, HELD_ROWS, BATCH_BYTES, BLOCK_BYTES = 8 << 20, 600_000, 1 << 20, 2 << 20
#: Texts are scored in so many rounds (fewer if one would have less than some bytes), so that
#: questions and answers of all texts are never on disk at once.
ROUNDS, ROUND_BYTES = 4, 4 << 20
#: Symbols that are no words, as hashes.
BEGIN, END = np.uint64(0x0B), np.uint64(0x0E)


def held_out() -> Column:
    """Whether a document is not learned from: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- symbols and contexts -----------------------------------------------------------


def turned(context: np.ndarray, by: int = 23) -> np.ndarray:
    return (context << np.uint64(by)) | (context >> np.uint64(64 - by))


def extend(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a context and a symbol after it: as the symbols' hashes are uniform, the
    context's turned by 23 bits and the symbol's, added without carry; the root's is 0. So
    any two of context, symbol and window give the third."""
    return turned(context) ^ symbol


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts in a row, each text's after DEPTH begin marks and before an end
    mark; the places of predicted symbols (not begin marks); and their number per text."""
    found = words_of(texts)
    words, counts = np.where(found.hashes <= END, found.hashes + np.uint64(99), found.hashes), found.counts
    firsts = np.cumsum(counts + DEPTH + 1) - counts - 1
    out = np.full(int((counts + DEPTH + 1).sum()), BEGIN)
    out[np.arange(len(words)) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)] = words
    out[firsts + counts] = END
    places = np.arange(int((counts + 1).sum())) + np.repeat(firsts - (np.cumsum(counts + 1) - counts - 1), counts + 1)
    return out, places, counts + 1


def contexts(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """For d from 0 to depth: at each place the hash of the d symbols that end there."""
    out = [np.zeros(len(symbols), np.uint64)]
    for _ in range(depth):
        out.append(extend(np.r_[np.uint64(0), out[-1][:-1]] if len(out) > 1 else out[0], symbols))
    return out


def before_texts() -> list[np.ndarray]:
    """The contexts of 1 to DEPTH begin marks."""
    return [x[-1:] for x in contexts(np.full(DEPTH, BEGIN), DEPTH)[1:]]


# ---- counting ----------------------------------------------------------------------


def windows(train: DataFrame, d: int, parts: int, ctx_map=None, suffix_map=None) -> DataFrame:
    """Chunks of the windows of d words and a symbol whose contexts (and their suffixes)
    the maps hold, added up within a task: HELD has keys and counts, MORE the contexts and,
    for d > 1, the windows without their first word."""

    def out(rows: list[np.ndarray]) -> Iterator[tuple]:
        for part, at in by_part(rows[0], parts):
            yield part, HELD, 0, pack(rows[0][at], narrow(rows[-1][at]), *(x[at] for x in rows[1:-1]))

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in found:
            for piece in slices(batch, BATCH_BYTES):
                symbols, places, _ = laid_out(piece.column("text"))
                ends = contexts(symbols, d + 1)
                rows = [ends[d + 1][places], *([ends[d][places - 1]] if d else []), *([ends[d][places]] if d > 1 else [])]
                if d:
                    keep = in_map(ctx_map.value, rows[1])
                    if suffix_map is not None:
                        keep &= in_map(suffix_map.value, ends[d - 1][places - 1])
                    rows = [x[keep] for x in rows]
                held.append(rows)
                size += len(rows[0])
                if size > HELD_ROWS:
                    yield from out(tallied(stacked(held)))
                    held, size = [], 0
        if held:
            yield from out(tallied(stacked(held)))

    def total(part: int, chunks) -> Iterator[tuple]:
        held, size = [], 0
        for _, _, (key, n, *rows), _ in chunks:
            held.append([key, *rows, n.astype(np.int64)])
            size += len(n)
            if size > 2 * HELD_ROWS:
                held = [summed(stacked(held))]
                size = len(held[0][0])
        key, *more, n = summed(stacked(held))
        if d:
            often = n >= LEAST_SYMBOL
            key, more, n = key[often], [x[often] for x in more], n[often]
        if len(key):
            yield part, HELD, part, pack(key, narrow(n))
        if len(key) and d:
            yield part, MORE, part, pack(*more)
            low = distinct(more[1] if d > 1 else turned(more[0]) ^ key)
            for target, at in by_part(low, parts):
                yield target, ASK, part, pack(low[at])

    kinds = arrow(CHUNK)
    return dealt(train.mapInArrow(lambda found: batches(count(found), kinds), CHUNK), total)


def begins(spark: SparkSession, d: int, n_texts: int, parts: int) -> DataFrame:
    """The context of d begin marks, as a window that comes once a text."""
    key = before_texts()[d - 1]
    part, _ = next(by_part(key, parts))
    return spark.createDataFrame([(part, HELD, -1, pack(key, np.array([n_texts], np.int64)))], CHUNK)


def keys_from(chunks: DataFrame, least: int | None = None) -> DataFrame:
    """The keys of HELD chunks, with at least so many occurrences, as rows."""
    kinds = arrow("key long")

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for data in batch.column("data"):
                key, n, *_ = unpack(data.as_buffer())
                key = key if least is None else key[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], schema=kinds)

    return chunks.select("data").mapInArrow(rows, "key long")


# ---- the tree ------------------------------------------------------------------------


def told(part: int, chunks) -> Iterator[tuple]:
    """The value of each key that is asked for, 0 where there is none."""
    pieces, table = [], None
    for kind, block, arrays, _ in chunks:
        if kind == HELD:
            pieces.append([arrays[0], arrays[1].astype(np.int64)])
            continue
        table = table or Table(pieces)
        yield block, ANSWER, part, pack(narrow(table.get(arrays[0], 1, 0)))


def diverging(level: DataFrame, d: int, lower: DataFrame, totals: DataFrame, nodes: DataFrame | None, root: int, parts: int) -> DataFrame:
    """The nodes of level d as chunks of keys, totals and factors (the share that is left
    for symbols without a probability of their own, over that which the suffix gives these).

    lower: the windows one word shorter; totals: those and the begin marks; nodes: those of
    level d - 1; root: what a count plus one is divided by in the root."""

    def judged(ctx, total, below_total, seen, kinds, gain, lower_sum) -> Iterator[tuple]:
        """gain: sum of n * log((n - DISCOUNT) / the suffix's count for the symbol)."""
        mass = (seen - DISCOUNT * kinds) / total
        left = (1 - mass) / np.maximum(1 - lower_sum / below_total, 1e-9)
        gain = gain + seen * np.log(below_total / total) + (total - seen) * np.log(left)
        kept = gain >= LEAST_GAIN * kinds
        if kept.any():
            part = next(by_part(ctx[:1], parts))[0]
            yield part, HELD, part, pack(ctx[kept], total[kept].astype(np.int64), left[kept])

    def sums(part: int, chunks) -> Iterator[tuple]:
        """Of each context, what its windows in a part add to the sums."""
        of = {HELD: [], MORE: [], ANSWER: []}
        for kind, _, arrays, _ in chunks:
            of[kind].append(arrays)
        if not of[HELD]:
            return
        (key, n), more = of[HELD][0], of[MORE][0]
        ctx, symbol = more[0], turned(more[0]) ^ key
        low = more[1] if d > 1 else symbol
        below = np.concatenate([x[0] for x in of[ANSWER]]).astype(np.int64)[places_of(low)]
        there = below > 0
        key, n, ctx, symbol, low, below = (x[there] for x in (key, n.astype(np.int64), ctx, symbol, low, below))
        ctx, first, at = np.unique(ctx, return_index=True, return_inverse=True)
        counted = below - DISCOUNT if d > 1 else below + 1.0
        seen, kinds = np.bincount(at, n), np.bincount(at).astype(np.float64)
        rows = [ctx, turned(low ^ symbol, 41)[first], seen, kinds, np.bincount(at, n * np.log((n - DISCOUNT) / counted)), np.bincount(at, counted)]
        for target, some in by_part(ctx, parts):
            yield target, SUMS, part, pack(*(x[some] for x in rows))

    def together(part: int, chunks) -> Iterator[tuple]:
        """The sums of frequent contexts; those of level 1 are judged at once."""
        pieces, rows = [], []
        for kind, _, arrays, _ in chunks:
            pieces.append([arrays[0], arrays[1].astype(np.int64)]) if kind == HELD else rows.append(arrays)
        if not rows:
            return
        ctx, suffix, *values = stacked(rows)
        ctx, first, at = np.unique(ctx, return_index=True, return_inverse=True)
        suffix, values = suffix[first], [np.bincount(at, x) for x in values]
        total = Table(pieces).get(ctx, 1, 0).astype(np.float64)
        often = total >= LEAST_COUNT
        ctx, suffix, total, *values = (x[often] for x in (ctx, suffix, total, *values))
        if not len(ctx):
            return
        if d == 1:
            yield from judged(ctx, total, float(root), *values)
            return
        yield part, MORE, part, pack(ctx, suffix, total, *values)
        asked = distinct(suffix)
        for target, some in by_part(asked, parts):
            yield target, ASK, part, pack(asked[some])

    def last(part: int, chunks) -> Iterator[tuple]:
        rows, answers = None, []
        for kind, _, arrays, _ in chunks:
            if kind == MORE:
                rows = arrays
            else:
                answers.append(arrays[0])
        if rows is None:
            return
        ctx, suffix, total, *values = rows
        below_total = np.concatenate(answers).astype(np.float64)[places_of(suffix)]
        node = below_total > 0
        if node.any():
            yield from judged(*(x[node] for x in (ctx, total, below_total, *values)))

    below = dealt(of_kind(lower, HELD).union(of_kind(level, ASK)), told)
    parted = dealt(of_kind(level, HELD, MORE).union(below), sums)
    met = dealt(totals.union(parted), together)
    if d == 1:
        return cut(met, "nodes-1")
    met = cut_by_kind(met, f"contexts-{d}")
    answers = dealt(nodes.union(of_kind(met, ASK)), told)
    found = cut(dealt(of_kind(met, MORE).union(answers), last), f"nodes-{d}")
    drop_cut(met)
    return found


class Tree:
    """levels: chunks of the windows of 0 to DEPTH words and a symbol; marks: the contexts
    of begin marks; nodes: chunks of keys, totals and factors, by length; kinds and total:
    distinct symbols and all."""

    def __init__(self, levels: list[DataFrame], marks: list[DataFrame], nodes: list[DataFrame], total: int, kinds: int, parts: int):
        self.levels, self.marks, self.nodes, self.total, self.kinds, self.parts = levels, marks, nodes, total, kinds, parts

    def windows(self) -> DataFrame:
        out = of_kind(self.levels[0], HELD)
        for more in [*(of_kind(x, HELD) for x in self.levels[1:]), *self.marks]:
            out = out.union(more)
        return out

    def factors(self) -> DataFrame:
        out = self.nodes[0]
        for more in self.nodes[1:]:
            out = out.union(more)
        return out


def grow(train: DataFrame, n_texts: int, n_bytes: int) -> Tree:
    """The tree of the rows (text); n_texts and n_bytes: how many there are."""
    spark = train.sparkSession
    parts = max(1, -(-n_bytes // PART_BYTES))
    share = lambda keys: spark.sparkContext.broadcast(bit_map(keys))

    def counted(d: int, *maps) -> DataFrame:
        return cut_by_kind(windows(train, d, parts, *maps), f"windows-{d}")

    levels, nodes, suffix_map = [counted(0)], [], None
    sums = made(of_kind(levels[0], HELD), _sizes, "n long, kinds long")
    total, kinds = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    marks = [begins(spark, d, n_texts, parts) for d in range(1, DEPTH + 1)]
    for d in range(1, DEPTH + 1):
        totals = of_kind(levels[-1], HELD).union(marks[d - 1])
        ctx_map = share(keys_from(totals, LEAST_COUNT))
        levels.append(counted(d, ctx_map, suffix_map))
        ctx_map.destroy()
        nodes.append(diverging(levels[d], d, levels[d - 1], totals, nodes[-1] if nodes else None, total + kinds + 1, parts))
        # a node's suffix is one; shorter windows than the last are also counted to find frequent contexts
        suffix_map = share(keys_from(nodes[-1])) if d == DEPTH - 1 else None
    return Tree(levels, marks, nodes, total, kinds, parts)


def _sizes(batch: pa.RecordBatch) -> Iterator[tuple]:
    for data in batch.column("data"):
        n = unpack(data.as_buffer())[1]
        yield int(n.sum()), len(n)


# ---- scoring -----------------------------------------------------------------------


def blocks(docs: DataFrame) -> DataFrame:
    """part (the block's number), ids and texts: rows (doc_id, text) in blocks of some
    BLOCK_BYTES, or one longer text."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"part long, ids array<{kind}>, texts array<string>"
    kinds = arrow(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks()) for c in ("doc_id", "text")]
            return pa.RecordBatch.from_arrays([pa.array([at]), *(x.cast(t) for x, t in zip(lists, kinds.types[1:]))], schema=kinds)

        for batch in found:
            for piece in slices(batch, BATCH_BYTES):
                if held and size + piece.nbytes > BLOCK_BYTES:
                    yield block()
                    at, held, size = at + 1, [], 0
                held.append(piece)
                size += piece.nbytes
        if held:
            yield block()

    return cut(docs.select("doc_id", "text").mapInArrow(run, schema), "blocks")


def wanted(texts: pa.Array, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The number of symbols of each text; their places among the symbols and begin marks;
    at which of the places the context of each length may be a node; and the hashes that
    matter: of all symbols and begin marks (also the contexts of length 1), of longer
    contexts, and for each length of the windows."""
    symbols, places, counts = laid_out(texts)
    ends = contexts(symbols, DEPTH + 1)
    may, keys = [], [symbols]
    for d in range(1, DEPTH + 1):
        ctx = ends[d][places - 1]
        may.append(np.flatnonzero(in_map(nodes, ctx)))
        keys += [*([ctx[may[-1]]] if d > 1 else []), ends[d + 1][places[may[-1]]]]
    return counts, places, may, keys


def _scored(docs: DataFrame, tree: Tree, node_map) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row (doc_id, text)."""
    parts, total, kinds = tree.parts, tree.total, tree.kinds
    missing = -np.log10(total + kinds + 1)
    at_rest = blocks(docs)

    def asks(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, texts in zip(batch.column("part").to_pylist(), batch.column("texts")):
            keys = distinct(np.concatenate(wanted(texts.values, node_map.value)[-1]))
            for target, at in by_part(keys, parts):
                yield target, ASK, part, pack(keys[at])

    def answer(part: int, chunks) -> Iterator[tuple]:
        pieces, factors, tables = [], [], None
        for kind, block, arrays, _ in chunks:
            if kind == HELD:
                pieces.append([arrays[0], arrays[1].astype(np.int64)])
            elif kind == MORE:
                factors.append([arrays[0], arrays[2]])
            else:
                tables = tables or (Table(pieces), Table(factors))
                keys = arrays[0]
                node, at = tables[1].find(keys)
                left = tables[1].columns[1][at[node]] if node.any() else np.zeros(0)
                yield block, ANSWER, part, pack(narrow(tables[0].get(keys, 1, 0)), np.flatnonzero(node).astype(np.uint32), left)

    def score(part: int, chunks) -> Iterator[tuple]:
        texts, counts_of, left_of = None, [], []
        for kind, _, arrays, more in chunks:
            if kind == HELD:
                ids, texts = more[0].as_py(), more[1].values
            else:
                n, node, left = arrays
                counts_of.append(n.astype(np.int64))
                left_of.append(np.full(len(n), np.nan))
                left_of[-1][node] = left
        counts, places, may, keys = wanted(texts, node_map.value)
        n_of, left_of = np.concatenate(counts_of), np.concatenate(left_of)
        found = np.split(places_of(np.concatenate(keys)), np.cumsum([len(x) for x in keys])[:-1])
        c = n_of[found[0][places]]
        base = np.log10(c + 1.0) + missing
        # the longest node first: its window has the probability; without one, its factor
        # goes on to the next shorter node, at last to the root
        logs, opened = base.copy(), np.ones(len(base), bool)
        for d in range(DEPTH, 0, -1):
            who, window = may[d - 1], found[2 * d - 1]
            ctx = found[2 * d - 2] if d > 1 else found[0][places[who] - 1]
            left = left_of[ctx]
            node = opened[who] & ~np.isnan(left)
            who, ctx, left, n = who[node], ctx[node], left[node], n_of[window[node]]
            hit = n > 0
            logs[who[hit]] += np.log10((n[hit] - DISCOUNT) / n_of[ctx[hit]]) - base[who[hit]]
            opened[who[hit]] = False
            logs[who[~hit]] += np.log10(left[~hit])
        at = np.cumsum(counts) - counts
        sums = [counts, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)]
        yield from zip(ids, *(x.tolist() for x in sums))

    empty = F.lit(None).cast("binary").alias("data")
    kind = dict(docs.dtypes)["doc_id"]
    model = tree.windows().union(tree.factors().withColumn("kind", F.lit(MORE)))
    told_ = dealt(model.union(made(at_rest, asks)), answer)
    no_text = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{kind}>"), ("texts", "array<string>"))]
    both = at_rest.select("part", F.lit(HELD).alias("kind"), F.lit(0).cast("long").alias("block"), empty, "ids", "texts").union(told_.select("*", *no_text))
    found = cut(dealt(both, score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"), "scores")
    drop_cut(at_rest)
    return found


def scores(docs: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    docs: doc_id, text; other columns are ignored. A null text is empty: one token, its
    end. A null doc_id is learned from. Repeated rows are counted and scored as often as
    they come. An empty table gives an empty result. A text is hashed in one piece: a
    worker needs some 150 bytes for each of a text's words.
    """
    spark: SparkSession = docs.sparkSession
    with small_batches(spark), lean(spark):
        texts = docs.select("doc_id", text_of().alias("text"))
        train, learned = texts.filter(~held_out()), ~held_out()
        size = F.octet_length("text").cast("long")
        sums = [F.count_if(learned), F.sum(F.when(learned, size)), F.sum(size)]
        n_texts, n_bytes, all_bytes = texts.agg(*(F.coalesce(c, F.lit(0)) for c in sums)).first()
        tree = grow(train.select("text"), n_texts, n_bytes)
        node_map = spark.sparkContext.broadcast(bit_map(keys_from(tree.factors())))
        rounds = max(1, min(ROUNDS, -(-all_bytes // round_bytes)))
        found = None
        for i in range(rounds):
            part = _scored(texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i), tree, node_map)
            found = part if found is None else found.union(part)
        node_map.destroy()
        for table in (*tree.levels, *tree.nodes):
            drop_cut(table)
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
