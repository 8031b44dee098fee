"""Token-id files with a minimal perfect hash index.

Documents are dealt to shards by ascending doc_id and encoded there. A shard is a pair
of files: `ids-N.bin`, the raw ids of its documents one after another (unsigned, little
endian, as narrow as the vocabulary allows), and `ids-N.idx`: the offset of each
document's first id, and a minimal perfect hash from doc_id to its documents. The hash
is a cascade of bit arrays: a key that falls alone on a bit of a level is placed there,
the rest go on to the next level, and a key's slot is the number of bits set before its
own. Each slot keeps a fingerprint of its key, so that foreign keys are told apart.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import pyarrow.fs  # noqa: F401  pa.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, text_of
from .words import Numbers, slices, words_of

MAGIC = b"MPHIDS01"
#: Bits for each key that is left, on a level of the hash; levels at most, after which
#: the few keys left are listed.
GAMMA, LEVELS = 2, 32
#: Ids of encoded words that a worker keeps, bytes of text encoded together, and documents
#: a shard should hold.
CACHE_IDS, BATCH_BYTES, SHARD_DOCS = 20_000_000, 1 << 21, 10_000
#: Shards at most: the driver and each reading task hold a row for each.
MOST_SHARDS = 1 << 16
END_ID = 2


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integers (the finalizer of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels (bit arrays as booleans) and the keys left after the last of them."""
    left, levels = keys, []
    while len(left) and len(levels) < LEVELS:
        at = _mix(left, len(levels)) % np.uint64(GAMMA * len(left))
        alone = np.bincount(at.astype(np.int64), minlength=GAMMA * len(left)) == 1
        levels.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    return levels, np.sort(left)


def slots(levels: list[np.ndarray], ranks: list[np.ndarray], left: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key; of a foreign key any slot, or -1."""
    out, todo, base = np.full(len(keys), -1), np.arange(len(keys)), 0
    for n, (bits, rank) in enumerate(zip(levels, ranks)):
        at = (_mix(keys[todo], n) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = base + rank[at[hit]]
        todo, base = todo[~hit], base + int(bits.sum())
    if len(left) and len(todo):
        at = np.searchsorted(left, keys[todo])
        hit = left[np.minimum(at, len(left) - 1)] == keys[todo]
        out[todo[hit]] = base + at[hit]
    return out


def write_index(keys: np.ndarray, void: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """keys: doc_ids in file order, equal ones together; void: which are null (first);
    starts: the offset in ids of each document, and the end."""
    known = keys[~void]
    unique, first, count = np.unique(known, return_index=True, return_counts=True)
    levels, left = build_hash(unique)
    at = slots(levels, [np.cumsum(b) - b for b in levels], left, unique)
    places = np.zeros((len(unique), 3), np.int64)
    places[at] = np.stack([first + int(void.sum()), count, _mix(unique, 101).view(np.int64) & 0xFFFFFFFF], 1)
    out = io.BytesIO()
    out.write(MAGIC)
    head = [width, len(keys), int(void.sum()), len(unique), len(levels), len(left), *map(len, levels)]
    for part in (np.array([len(head), *head], "<i8"), starts.astype("<i8"), places.astype("<i8"), left.astype("<i8")):
        out.write(part.tobytes())
    for bits in levels:
        out.write(np.packbits(bits).tobytes())
    return out.getvalue()


class Index:
    """The index of a shard, read back."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        at = 8

        def longs(n: int) -> np.ndarray:
            nonlocal at
            at += 8 * n
            return np.frombuffer(data, "<i8", n, at - 8 * n)

        head = longs(int(longs(1)[0]))
        self.width, n, self.n_void, n_keys, n_levels, n_left = map(int, head[:6])
        self.starts = longs(n + 1)
        self.places = longs(3 * n_keys).reshape(-1, 3)
        self.left, self.levels = longs(n_left), []
        for size in map(int, head[6 : 6 + n_levels]):
            self.levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        self.ranks = [np.cumsum(b) - b for b in self.levels]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 of them if it's foreign."""
        at = slots(self.levels, self.ranks, self.left, keys)
        if not len(self.places):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        found = self.places[at]
        own = (at >= 0) & (found[:, 2] == (_mix(keys, 101).view(np.int64) & 0xFFFFFFFF))
        return np.where(own, found[:, 0], 0), np.where(own, found[:, 1], 0)


#: Stands between words that are encoded together; a word that has it is encoded alone.
BETWEEN = "|"


class Encoder:
    """Ids of texts, for tokenizers to which white space (0x20, 0x09-0x0D) always ends a
    token and leaves none: a text's ids are those of its words in turn. Each word is
    encoded once a process, and known by a 64-bit hash.

    caseless: the tokenizer lower-cases texts, so words are lower-cased before. apart: no
    token has letters and, after them, a comma or stop. Texts with `<|`, where one of the
    tokenizer's special tokens may begin, are encoded as they are.
    """

    def __init__(self, path: str, dtype: str, caseless: bool, apart: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.caseless, self.apart = caseless, apart
        self.between = self.ids_of(BETWEEN)
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.size = Numbers(), np.zeros(0, np.int64)
        self.first, self.ids, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, self.dtype), 0

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first = np.concatenate([self.first, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)
        self.numbers.add(keys)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        alone = np.array([BETWEEN.encode() in w or len(self.between) > 1 for w in words], bool)
        together, ids, sizes = np.flatnonzero(~alone), [], []
        for at in range(0, len(together), 256):
            part = together[at : at + 256]
            found = self.ids_of(f" {BETWEEN} ".join(words[i].decode() for i in part))
            own = found != self.between[0]
            stops = np.flatnonzero(~own)
            ids.append(found[own])
            sizes.append(np.diff(np.r_[-1, stops, len(found)]) - 1)
        for i in np.flatnonzero(alone):
            ids.append(self.ids_of(words[i].decode()))
            sizes.append([len(ids[-1])])
        if ids:
            order = np.concatenate([together, np.flatnonzero(alone)])
            self._keep(keys[order], np.concatenate(ids), np.concatenate(sizes))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words (numbers) in a row, and how many each has."""
        sizes = self.size[at]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(self.first[at], sizes) + inner], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if self.used > CACHE_IDS:
            self._clear()
        w = words_of(texts, lower=self.caseless)
        keys, first, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(self.numbers.find(keys) < 0)
        starts, ends = w.starts[first[fresh]], w.ends[first[fresh]]
        ended = np.zeros(len(fresh), bool)
        if self.apart and len(fresh):  # a word and a comma or stop
            before = w.data[np.maximum(ends - 2, 0)]
            ended = np.isin(w.data[ends - 1], SIGNS) & (ends - starts > 1) & ((before >= 97) & (before <= 122))
        stems = w.spans.hashes(starts[ended], ends[ended] - 1)
        new, at = np.unique(np.concatenate([keys[fresh[~ended]], stems]), return_index=True)
        lo = np.concatenate([starts[~ended], starts[ended]])[at]
        hi = np.concatenate([ends[~ended], ends[ended] - 1])[at]
        unknown = self.numbers.find(new) < 0
        data = w.data.tobytes()
        self._learn(new[unknown], [data[a:b] for a, b in zip(lo[unknown].tolist(), hi[unknown].tolist())])
        if ended.any():
            ids, sizes = self._gather(self.numbers.find(stems))
            sign = np.array([self.ids_of(chr(c))[0] for c in SIGNS], self.dtype)[np.searchsorted(SIGNS, w.data[ends[ended] - 1])]
            self._keep(keys[fresh[ended]], np.insert(ids, np.cumsum(sizes), sign), sizes + 1)
        ids, sizes = self._gather(self.numbers.find(keys)[word])
        at = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(w.counts)]]
        counts = np.diff(at)
        odd = np.flatnonzero(pa.compute.match_substring(texts.cast(pa.large_string()), "<|").fill_null(False).to_numpy(zero_copy_only=False))
        if len(odd):
            parts = np.split(ids, at[1:-1])
            for i in odd:
                parts[i] = self.ids_of(texts[int(i)].as_py())
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


SIGNS = np.array([44, 46], np.uint8)  # comma, stop
_encoders: dict[tuple, Encoder] = {}


def _encoder(*of) -> Encoder:
    if of not in _encoders:
        _encoders[of] = Encoder(*of)
    return _encoders[of]


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    vocabulary: int,
    end_id: int = END_ID,
    caseless: bool = False,
    apart: bool = False,
) -> DataFrame:
    """Writes the files of docs into `folder`, which all executors must share, and
    returns the manifest, a row for each shard (at most MOST_SHARDS): shard, file, n_docs,
    n_ids, n_void (documents of null doc_id), first and last (doc_id), start (ids of all
    shards before).

    docs: doc_id (an integer), text; other columns are ignored. A null text is empty and
    gives the end id alone; documents with equal doc_id stand together, by text; a null
    doc_id goes first and is found by none. An empty table gives no files. Each attempt of a
    task writes files of its own name and never renames or replaces one; the manifest,
    written last, names those of the attempts that count, so lost executors and repeated
    tasks do no harm on any store.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    shards = max(1, min(-(-docs.select("doc_id").count() // SHARD_DOCS), MOST_SHARDS))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, keys, void, sizes = _encoder(tokenizer_path, dtype, caseless, apart), [], [], [np.zeros(1, np.int64)]
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex[:12]}"
        fs, own = pa.fs.FileSystem.from_uri(f"{folder}/{name}")
        out = None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{own}.bin")
            for part in slices(batch, BATCH_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                sizes.append(counts + 1)
                out.write(np.insert(ids, np.cumsum(counts), end_id).tobytes())
            keys.append(batch.column("doc_id").fill_null(0).to_numpy())
            void.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        starts = np.cumsum(np.concatenate(sizes))
        with fs.open_output_stream(f"{own}.idx") as index:
            index.write(write_index(np.concatenate(keys), np.concatenate(void), starts, np.dtype(dtype).itemsize))
        known, none = np.concatenate(keys), np.concatenate(void)
        known, n_void = known[~none], int(none.sum())
        first, last = (int(known[0]), int(known[-1])) if len(known) else (1, 0)
        row = {"shard": shard, "file": name, "n_docs": len(starts) - 1, "n_ids": int(starts[-1]), "n_void": n_void, "first": first, "last": last}
        yield pa.RecordBatch.from_pylist([row])

    _make_folder(spark, folder)
    columns = "shard long, file string, n_docs long, n_ids long, n_void long, first long, last long"
    with small_batches(spark):
        done = cut(ordered.mapInArrow(write_shard, columns), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _open(folder: str, file: str) -> tuple[Index, pa.NativeFile]:
    fs, at = pa.fs.FileSystem.from_uri(f"{folder}/{file}")
    with fs.open_input_stream(f"{at}.idx") as f:
        index = Index(f.read())
    return index, fs.open_input_file(f"{at}.bin")


def look_up(folder: str, file: str, doc_ids: list[int]) -> list[list[np.ndarray]]:
    """For each key the ids of its documents in a shard's file, end id included; none if foreign."""
    index, payload = _open(folder, file)
    with payload:
        first, count = index.find(np.array(doc_ids, np.int64))
        read = lambda k: np.frombuffer(payload.read_at(int(index.starts[k + 1] - index.starts[k]) * index.width, int(index.starts[k]) * index.width), f"<u{index.width}")
        return [[read(k) for k in range(a, a + n)] for a, n in zip(first, count)]


def shards_of(first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which key (by place) goes to which shard (by place): those whose range has it. Shards
    are in order of their keys, and only one key's documents lie in several."""
    lo, hi = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def read(doc_ids: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents of the given keys, read back
    from the files: each key goes to the shards whose range has it (from the manifest, a
    row for each shard, of which there are at most MOST_SHARDS) and through their index to
    its ids. A key that is in no index gives no row, one of several documents a row for
    each, a null key the null ones."""
    held = manifest.orderBy("shard").toPandas()
    some = held[held["first"] <= held["last"]]
    first, last, places = some["first"].to_numpy(), some["last"].to_numpy(), some.index.to_numpy()
    voids = held.index[held["n_void"] > 0].to_numpy()
    files, starts = held["file"].tolist(), held["start"].to_numpy()

    def to_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["doc_id"].astype("Int64")
            known = keys.dropna().to_numpy(np.int64)
            which, at = shards_of(first, last, known)
            yield pd.DataFrame({"doc_id": pd.array(known[which], "Int64"), "at": places[at]})
            if len(known) < len(keys):
                yield pd.DataFrame({"doc_id": pd.array([pd.NA] * len(voids), "Int64"), "at": voids})

    def read_shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, asked in frame.groupby("at"):
                index, payload = _open(folder, files[k])
                with payload:
                    yield _records(index, payload, asked["doc_id"].astype("Int64"), int(starts[k]))

    keys = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    routed = keys.mapInPandas(to_shards, "doc_id long, at long")
    return (
        routed.repartition(max(1, len(held)), "at")
        .sortWithinPartitions("at", "doc_id")
        .mapInPandas(read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _records(index: Index, payload: pa.NativeFile, keys: pd.Series, base: int) -> pd.DataFrame:
    real = keys.dropna().to_numpy(np.int64)
    first, count = index.find(real)
    which = np.repeat(np.arange(len(real)), count)
    docs = np.repeat(first, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    if len(real) < len(keys):
        docs = np.concatenate([np.arange(index.n_void), docs])
    starts, crc, at = index.starts, [], 0
    while at < len(docs):  # documents in a row, some 8 million ids of them at a time
        end = at + 1
        while end < len(docs) and docs[end] == docs[end - 1] + 1 and starts[docs[end] + 1] - starts[docs[at]] <= 1 << 23:
            end += 1
        lo, hi = int(starts[docs[at]]), int(starts[docs[end - 1] + 1])
        ids = np.frombuffer(payload.read_at((hi - lo) * index.width, lo * index.width), f"<u{index.width}")
        crc += [zlib.crc32(ids[starts[k] - lo : starts[k + 1] - lo].astype("<u4")) for k in docs[at:end]]
        at = end
    voids = [pd.NA] * (len(docs) - len(which))
    return pd.DataFrame(
        {
            "doc_id": pd.array([*voids, *real[which]], "Int64"),
            "start": base + starts[docs],
            "n_tokens": starts[docs + 1] - starts[docs],
            "ids_crc32": np.array(crc, np.int64),
        }
    )
