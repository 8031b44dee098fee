"""Fuzzy line deduplication by MinHash.

Every line gets a one-permutation MinHash signature of its character shingles, cut into
bands. Equal lines are one class from the start; distinct lines that share a band are
candidates. In each band's bucket all lines are compared with its first line; then the
lines that are not in that one's component yet are compared with all of the bucket, in
blocks that yield spanning links only. So no similar pair of a bucket goes unlinked, and
a bucket of copies gives a star and not all pairs. Exact Jaccard similarity verifies each candidate, and a distributed union-find keeps the
first line of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, cut, drop_cut, fresh_name, in_map, let, small_batches
from .graph import components

#: Characters of a shingle; the least similarity.
SHINGLE, SIMILARITY = 8, 0.8
#: 12 bands of 5 find a pair of similarity 0.8 with probability 0.991, of 0.9 with 0.99999.
BANDS, ROWS = 12, 5
#: Lines of a bucket that meet in a cell, at most about.
BLOCK = 4000
#: Shingle sets that a task keeps.
KNOWN_SETS = 8000
#: Lines that a task remembers to have met.
MET_LINES = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k codes from each place of an array on."""
    h, size, base = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while size < k:  # from stretches of `size` codes to such of twice as many, or of k
        step = min(size, k - size)
        h = h[: len(h) - step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        size += step
    return _mix(h)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def signatures(lines: list[str], k: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """len(lines) x bins minima of 32 bits. A line shorter than k is one shingle. An empty
    bin takes its value from the next filled one, mixed with the distance to it."""
    padded = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    sizes = np.array([len(x) for x in padded])
    hashes = _shingle_hashes(_codes("".join(padded)), k)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lines)), sizes)[: len(hashes)]
    inside = np.arange(len(hashes)) + k <= ends[owner]
    hashes, owner = hashes[inside], owner[inside]
    where = owner * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(lines) * bins, 1 << 32, np.int64)
    np.minimum.at(out, where, (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    out = out.reshape(len(lines), bins)
    empty = out == 1 << 32
    # the next filled bin, around the end
    twice = np.concatenate([empty, empty], 1)
    place = np.where(twice, 2 * bins, np.arange(2 * bins))
    place = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :bins]
    steps = place - np.arange(bins)
    filled = np.take_along_axis(out, place % bins, 1)
    return np.where(steps > 0, (filled + steps * 0x9E3779B1) & 0xFFFFFFFF, filled)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of a signature, the band's number included."""
    out = np.empty((len(sig), sig.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


def _sets_of(lines: list[str], k: int) -> list[np.ndarray]:
    """The shingles (hashes) of each line, sorted."""
    if not lines:
        return []
    padded = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    hashes, out, at = _shingle_hashes(_codes("".join(padded)), k), [], 0
    for x in padded:
        own = np.sort(hashes[at : at + len(x) - k + 1])
        out.append(own[np.r_[True, own[1:] != own[:-1]]])
        at += len(x)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def split_lines(text: str | None) -> list[str]:
    """The lines of a text, without their ends (\\n); an empty text has none."""
    return text.split("\n") if text else []


def _ids(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lines], np.uint64).view(np.int64)


def line_table(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """id (a 64-bit hash of the line), doc_id, text_hash, line_no of every line that isn't
    blank, and its bands the first time (or more often) that a task meets it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # arrays that fit the processor's cache
                part = batch.slice(at, 32)
                rows, numbers, lines = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for number, line in enumerate(split_lines(text)):
                        if line.strip():
                            rows.append(row)
                            numbers.append(number)
                            lines.append(line)
                if not lines:
                    continue
                ids, fresh = _ids(lines), []
                for n, i in enumerate(ids.tolist()):
                    if i not in met:
                        met.add(i)
                        fresh.append(n)
                if len(met) > MET_LINES:
                    met.clear()
                sizes = np.zeros(len(lines) + 1, np.int32)
                sizes[np.array(fresh, int) + 1] = BANDS
                found = bands(signatures([lines[n] for n in fresh], k)).ravel() if fresh else np.zeros(0, np.int64)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        part.column("doc_id").take(take),
                        part.column("text_hash").take(take),
                        pa.array(numbers, pa.int32()),
                        pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), pa.array(found)),
                    ],
                    ["id", "doc_id", "text_hash", "line_no", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        of, f"id long, doc_id {kind}, text_hash long, line_no int, bands array<long>"
    )


#: Orders the lines of a band's bucket by one of four ways, which the band's lowest bits
#: name, so that a group of lines that meet in many buckets has several heads.
TURNS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], np.int64)


def _crowded(members: DataFrame) -> DataFrame:
    """band, head (its bucket's first line), id of the lines in buckets of several lines.

    Buckets are dealt to tasks by band and pass through them in order; a task remembers no
    more than the head of the bucket at hand, however large that is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band0 = head0 = key0 = None  # the bucket and line at the end of the last batch
        told = False
        for batch in batches:
            band, key = (batch.column(c).to_numpy() for c in ("band", "key"))
            if len(band):  # copies of a line stand together
                again = np.r_[(band[0] == band0) & (key[0] == key0), (band[1:] == band[:-1]) & (key[1:] == key[:-1])].astype(bool)
                key0 = key[-1]
                band, key = band[~again], key[~again]
            if not len(band):
                continue
            ids = key ^ TURNS[band & 3]
            starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            sizes = np.diff(np.r_[starts, len(band)])
            heads = ids[starts].copy()
            goes_on = band0 is not None and band[0] == band0
            if goes_on:
                heads[0] = head0
            keep = np.repeat(sizes > 1, sizes)
            if goes_on:
                keep[: sizes[0]] = True
            out = [band[keep], np.repeat(heads, sizes)[keep], ids[keep]]
            if goes_on and not told:  # the head itself was alone at the end of its batch
                out = [np.r_[x, y] for x, y in zip(([band0], [head0], [head0]), out)]
            told = sizes[-1] > 1 or (len(sizes) == 1 and goes_on)
            band0, head0 = band[-1], heads[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["band", "head", "id"])

    ordered = members.repartition("band").sortWithinPartitions("band", "key")
    return cut(ordered.mapInArrow(scan, "band long, head long, id long"), "crowded")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of the given ids. A bit map of fixed size, broadcast, lets the tasks that
    read the documents pass over most other lines."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.col("id").alias("key"))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [line for text in batch.column("text").to_pylist() for line in split_lines(text)]
            own = _ids(lines)
            at = np.flatnonzero(in_map(bits.value, own.view(np.uint64)))
            own, first = np.unique(own[at], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([lines[i] for i in at[first]], pa.string())], ["id", "line"])

    found = docs.select("text").mapInArrow(find, "id long, line string").groupBy("id").agg(F.first("line").alias("line"))
    texts = cut(found.join(ids, "id", "left_semi"), "line-texts")
    bits.destroy()
    return texts


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b: line ids) whose lines are similar."""
    a, b = (texts.select(F.col("id").alias(x), F.col("line").alias(f"{x}_line")) for x in "ab")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                xs, ys = part.column("a_line").to_pylist(), part.column("b_line").to_pylist()
                lines = list({*xs, *ys})
                sets = dict(zip(lines, _sets_of(lines, k)))
                keep = [jaccard(sets[x], sets[y]) >= similarity for x, y in zip(xs, ys)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(b, "b").join(a, "a").select("a", "b", "a_line", "b_line")
    return cut(met.mapInArrow(similar, "a long, b long"), "similar")


def spanning_pairs(sets: list[np.ndarray], groups: np.ndarray, asking: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar lines (sets of shingles) that connect what the similar pairs of an
    asking line with any line of another group do; groups: what is connected already."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    codes = flag = None
    label, made = groups.copy(), []
    for i in np.flatnonzero(asking):
        open_ = np.flatnonzero(label != label[i])
        if len(open_) <= 16:
            near = [j for j in open_ if jaccard(sets[i], sets[j]) >= similarity]
        else:
            if codes is None:
                kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
                flag = np.zeros(len(kinds), np.int64)
            mine = codes[starts[i] : starts[i] + sizes[i]]
            flag[mine] = 1
            common = np.add.reduceat(flag[codes], starts)
            flag[mine] = 0
            near = np.flatnonzero(common >= similarity * (sizes + sizes[i] - common))
        for j in near:
            if label[j] != label[i]:
                made.append((i, j))
                label[label == label[j]] = label[i]
    return made


def _across(labelled: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) between lines of a bucket that are in different components, so far.

    Lines outside the component of their bucket's head ask all lines of the bucket. A
    large bucket is dealt out in cells: a block of its asking lines by a block of all.
    """
    stray = F.col("comp") != F.col("head_comp")
    mixed = labelled.groupBy("band").agg(F.count_if(stray).alias("strays"), F.count(F.lit(1)).alias("n"))
    mixed = cut(
        mixed.filter("strays > 0").select(
            "band", F.ceil(F.col("strays") / BLOCK).cast("int").alias("sb"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mb")
        ),
        "mixed-bands",
    )
    dealt = labelled.join(mixed, "band").withColumn("stray", stray)
    every = lambda n: F.sequence(F.lit(0), n - 1)
    one = lambda part, n: F.pmod(F.xxhash64("id", F.lit(part)), n).cast("int")
    asks = dealt.filter("stray").select("band", one("s", F.col("sb")).alias("s"), F.explode(every(F.col("mb"))).alias("m"), "id", "comp", F.lit(True).alias("asks"))
    hears = dealt.select("band", F.explode(every(F.col("sb"))).alias("s"), one("m", F.col("mb")).alias("m"), "id", "comp", F.lit(False).alias("asks"))
    rows = cut(asks.union(hears).join(texts, "id"), "cells")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def links(table: pa.Table) -> Iterator[tuple[int, int]]:
            """Of whole cells, which stand together; an asking line comes before its copy."""
            learned = 0
            names = ("band", "s", "m", "id", "comp", "asks")
            band, s, m, ids, comp, asks = (table.column(c).to_numpy() for c in names)
            lines = table.column("line").to_pylist()
            new = np.r_[True, (band[1:] != band[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1])]
            keep = np.r_[True, ids[1:] != ids[:-1]] | new
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], len(band)]):
                if a >= learned:  # the sets of the next cells' lines together
                    learned = min(len(band), max(b, a + 2000))
                    fresh = {i: lines[x] for x, i in enumerate(ids[a:learned].tolist(), a) if i not in known}
                    if len(known) + len(fresh) > KNOWN_SETS:
                        known.clear()
                        fresh = {i: lines[x] for x, i in enumerate(ids[a:learned].tolist(), a)}
                    known.update(zip(fresh, _sets_of(list(fresh.values()), k)))
                if b > learned:
                    late = {i: lines[x] for x, i in enumerate(ids[a:b].tolist(), a) if i not in known}
                    known.update(zip(late, _sets_of(list(late.values()), k)))
                at = a + np.flatnonzero(keep[a:b])
                sets = [known[i] for i in ids[at].tolist()]
                yield from ((ids[at[i]], ids[at[j]]) for i, j in spanning_pairs(sets, comp[at], asks[at], similarity))

        def whole_cells() -> Iterator[pa.Table]:
            """The rows, each cell's together."""
            held = None
            for batch in batches:
                held = pa.concat_tables([x for x in (held, pa.Table.from_batches([batch])) if x is not None])
                key = [held.column(c).to_numpy() for c in ("band", "s", "m")]
                last = np.ones(len(held), bool)
                for c in key:
                    last &= c == c[-1]
                end = len(held) - int(last[::-1].cumprod().sum()) if len(held) else 0
                if end:
                    yield held.slice(0, end)
                    held = held.slice(end)
            if held is not None and len(held):
                yield held

        for table in whole_cells():
            found = np.array(list(links(table)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    order = ["band", "s", "m", "id"]
    ordered = rows.repartition("band", "s", "m").sortWithinPartitions(*order, F.col("asks").desc())
    return cut(ordered.mapInArrow(cells, "a long, b long"), "similar")


def drop_lists(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, dropped: the sorted numbers of the lines to drop."""
    with small_batches(docs.sparkSession):
        return _drop_lists(docs, similarity, k)


def _drop_lists(docs: DataFrame, similarity: float, k: int) -> DataFrame:
    place = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("line_no"))
    full = cut(line_table(docs, k), "lines-bands")
    lines = full.drop("bands")
    turn = F.element_at(F.array(*(F.lit(int(t)) for t in TURNS)), (F.col("band").bitwiseAND(3) + 1).cast("int"))
    members = full.select("id", F.explode("bands").alias("band")).select("band", F.col("id").bitwiseXOR(turn).alias("key"))
    crowded = _crowded(members)
    star = crowded.filter("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    star = cut(star, "candidates")
    texts = _texts(docs, crowded.select("id").distinct())
    linked = _verified(star, texts, k, similarity)
    rooted = cut(components(linked), "line-components")
    of = lambda c, name: rooted.select(F.col("node").alias(c), F.col("root").alias(name))
    labelled = cut(
        crowded.join(of("id", "r"), "id", "left")
        .join(of("head", "hr"), "head", "left")
        .select("band", "id", F.coalesce("r", "id").alias("comp"), F.coalesce("hr", "head").alias("head_comp")),
        "labelled",
    )
    more = _across(labelled, texts, k, similarity)
    if not more.isEmpty():
        rooted = cut(components(linked.union(more)), "line-components")
    # of lines that come more than once, or are like others, all but the first go
    repeated = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    concerned = repeated.union(rooted.select("node")).distinct().join(rooted, F.col("id") == F.col("node"), "left")
    concerned = cut(concerned.select("id", F.coalesce("root", "id").alias("component")), "concerned")
    named = cut(lines.join(concerned, "id").select("component", "doc_id", "text_hash", "line_no"), "named-lines")
    first = cut(named.groupBy("component").agg(F.min(place).alias("first")), "first-lines")
    gone = named.join(first, "component").filter(~place.eqNullSafe(F.col("first")))
    lists = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    lists = cut(lists, "dropped-lines")
    drop_cut(full)
    return lists


def deduplicate(docs: DataFrame, kept: str = "kept", dropped: str = "dropped", **kinds) -> DataFrame:
    """docs with two more columns, named by the arguments: the text without its dropped
    lines, and the numbers of those (null: none).

    A component of similar lines keeps the line that comes first by doc_id (null first),
    the hash of its text, and line number. Lines are told apart by 64-bit hashes. Blank
    lines always stay. Null and empty texts have no lines and stay as they are. Rows that repeat both doc_id and text count as one document and all keep
    its lines. An empty table gives an empty result. docs: doc_id, text and any other
    columns.
    """
    d, h = fresh_name(docs, "_d"), fresh_name(docs, "_h")
    lists = drop_lists(docs.select("doc_id", "text"), **kinds).toDF(d, h, dropped)
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h))

    def stay(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    rest = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), stay))
    return docs.join(lists, same, "left").withColumn(kept, rest).drop(d, h)


def cleaned(docs: DataFrame, **kinds) -> DataFrame:
    """docs with texts (and n_chars, where there is one) after deduplication; documents of
    which no line, or only blank ones, are left go."""
    kept, dropped = fresh_name(docs, "_kept"), fresh_name(docs, "_dropped")
    found = deduplicate(docs, kept, dropped, **kinds).filter(F.col(dropped).isNull() | F.col(kept).rlike(r"(?U)[^\s\x1c-\x1f]"))
    n_chars = F.coalesce(F.length(kept), F.lit(0)).cast("long")
    fresh = {"text": F.col(kept), "n_chars": F.when(F.col(dropped).isNull(), F.col("n_chars")).otherwise(n_chars) if "n_chars" in docs.columns else None}
    return found.select(*(fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns))
