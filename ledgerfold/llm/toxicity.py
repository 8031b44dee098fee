"""Toxicity scores by a bidirectional GRU with attention pooling over words and characters.

A word enters the network as a learned word vector (words known from training), the mean
of learned vectors of its character n-grams, and how much the word and its n-grams speak
for either label in training. A text is cut into overlapping windows; its score is the
calibrated score of its most toxic window, so long texts hide nothing.

Training takes a bounded sample of labelled rows to one task and is done in numpy; the
model has a fixed size and is broadcast. All windows of all texts are scored, by arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import gru
from .common import fresh_name, seeded_key, text_of
from .words import Spans, Words, hash_table, look_up, slices, words_of

#: Labelled rows of each label that training takes at most, and bytes of text of them
#: altogether, both filled in seeded order.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 12_000_000
#: Words of a window and from one window's start to the next's.
WINDOW, STRIDE = 48, 32
HIDDEN, ATTENTION, WORD_DIM, GRAM_DIM = 8, 8, 6, 6
#: Words and n-grams of the model at most, and texts of training that must have them.
MOST_WORDS, MOST_GRAMS, LEAST_TEXTS = 1 << 15, 1 << 16, 3
GRAMS = (4, 5)
FOLDS, STEPS, BATCH, SEED = 3, 300, 128, 3
#: Part of the words whose learned vectors a training step leaves out.
DROPPED = 0.5
#: Weight decay: few labels must not teach the network their texts by heart.
DECAY = {"W": 3.0, "U": 12.0, "word_vectors": 3.0, "gram_vectors": 3.0}
#: Windows that pass the network together, and bytes of text prepared at once.
AT_ONCE, BATCH_BYTES = 2048, 1 << 21
THRESHOLD = 0.3

#: Bytes that are stripped from a word's ends: ASCII but letters and digits.
EDGE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
MARK = np.uint8(1)


def held_out() -> Column:
    """Whether labels of a row are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---- words and n-grams -------------------------------------------------------------


class Tokens:
    """The distinct words of some texts, and each text's words as numbers of those."""

    def __init__(self, texts: pa.Array):
        w: Words = words_of(texts)
        starts, ends = w.starts.copy(), w.ends.copy()
        for _ in range(3):
            inner = ends - starts > 1
            starts += inner & EDGE[w.data[starts]] if len(starts) else 0
            inner = ends - starts > 1
            ends -= inner & EDGE[w.data[ends - 1]] if len(ends) else 0
        hashes = Spans(w.data).hashes(starts, ends)
        self.hashes, first, self.words = np.unique(hashes, return_index=True, return_inverse=True)
        self.counts = w.counts
        self._data, self._starts, self._sizes = w.data, starts[first], (ends - starts)[first]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the distinct words between marks, and whose they are."""
        sizes = self._sizes + 2
        base = np.cumsum(sizes) - sizes
        data = np.full(int(sizes.sum()), MARK)
        inner = np.arange(int(self._sizes.sum())) - np.repeat(np.cumsum(self._sizes) - self._sizes, self._sizes)
        data[np.repeat(base + 1, self._sizes) + inner] = self._data[np.repeat(self._starts, self._sizes) + inner]
        spans, hashes, owners = Spans(data), [], []
        for n in GRAMS:
            count = np.maximum(sizes - n + 1, 0)
            owner = np.repeat(np.arange(len(sizes)), count)
            at = np.repeat(base, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            hashes.append(spans.hashes(at, at + n))
            owners.append(owner)
        return np.concatenate(hashes), np.concatenate(owners)


class Lexicon:
    """Hash tables from words and n-grams to their numbers in the model."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.n_words, self.n_grams = len(words), len(grams)
        self.words = hash_table(words, np.arange(len(words), dtype=np.int32))
        self.grams = hash_table(grams, np.arange(len(grams), dtype=np.int32))

    def of(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each distinct word or -1; numbers of known n-grams and whose they are."""
        hashes, owner = tokens.grams()
        found = look_up(self.grams, hashes, -1)
        return look_up(self.words, tokens.hashes, -1), found[found >= 0], owner[found >= 0]


def inputs_of(model: dict, found: tuple[np.ndarray, np.ndarray, np.ndarray], leaning: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The network's input for each distinct word."""
    word, gram, owner = found
    for_word, for_gram = leaning or (model["word_leaning"], model["gram_leaning"])
    n = len(word)
    out = np.zeros((n, WORD_DIM + GRAM_DIM + 4), np.float32)
    known = word >= 0
    out[known, :WORD_DIM] = model["word_vectors"][word[known]]
    count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None].astype(np.float32)
    sums = np.zeros((n, GRAM_DIM), np.float32)
    for k in range(GRAM_DIM):
        sums[:, k] = np.bincount(owner, model["gram_vectors"][gram, k], n)
    out[:, WORD_DIM : WORD_DIM + GRAM_DIM] = sums / count
    most = np.zeros(n, np.float32)
    np.maximum.at(most, owner, for_gram[gram])
    out[known, -4] = for_word[word[known]]
    out[:, -3] = most
    out[:, -2] = np.bincount(owner, for_gram[gram], n) / count[:, 0]
    out[:, -1] = known
    return out


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among all words), words and text of every window; a text has one at least."""
    each = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    base = np.cumsum(counts) - counts
    return base[text] + nth * STRIDE, np.clip(counts[text] - nth * STRIDE, 0, WINDOW), text


def _steps(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(max(1, int(size.max(initial=0))))[:, None]
    mask = t < size[None, :]
    at = words[np.where(mask, start[None, :] + t, 0)] if len(words) else np.zeros(mask.shape, np.int64)
    return np.where(mask, at, 0), mask


def window_logits(model: dict, inputs: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    inputs = inputs if len(inputs) else np.zeros((1, inputs.shape[1]), np.float32)
    for at in range(0, len(start), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        steps, mask = _steps(words, start[part], size[part])
        out[part] = gru.forward(model["net"], inputs, steps, mask)
    return out


# ---- training ----------------------------------------------------------------------


def _leaning(presence: tuple[np.ndarray, np.ndarray], label: np.ndarray, use: np.ndarray, n: int) -> np.ndarray:
    """Log odds of each item from (item, text) pairs of the texts in use, moved towards 0 by
    their standard error, and scaled."""
    item, text = presence
    keep = use[text]
    toxic = np.bincount(item[keep], label[text[keep]], n)
    clean = np.bincount(item[keep], 1 - label[text[keep]], n)
    n_toxic, n_clean = (label * use).sum(), ((1 - label) * use).sum()
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    unsure = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return (np.sign(odds) * np.maximum(np.abs(odds) - unsure, 0) / 4).astype(np.float32)


def train(texts: list[str], label: np.ndarray, share_toxic: float) -> dict:
    """A model from some texts and their labels; share_toxic: of all labelled rows."""
    rng = np.random.default_rng(SEED)
    tokens = Tokens(pa.array(texts, pa.large_string()))
    text_of_word = np.repeat(np.arange(len(texts)), tokens.counts)

    def presence(items: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(items.astype(np.int64) * len(texts) + of)
        return pairs // len(texts), pairs % len(texts)

    def choose(hashes: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
        """The items that are in most texts (n), whatever their labels, and in enough."""
        order = np.lexsort((hashes, -n))
        return hashes[order[: min(most, int((n >= LEAST_TEXTS).sum()))]]

    in_text = presence(tokens.words, text_of_word)
    words = choose(tokens.hashes, np.bincount(in_text[0], minlength=len(tokens.hashes)), MOST_WORDS)
    hashes, owner = tokens.grams()
    kinds, gram = np.unique(hashes, return_inverse=True)

    def grams_in_texts(gram: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(n-gram, text), each once, some texts at a time."""
        order = np.argsort(owner, kind="stable")
        gram, at = gram[order], np.searchsorted(owner[order], np.arange(len(tokens.hashes) + 1))
        by_text = np.argsort(in_text[1], kind="stable")
        for part in np.array_split(by_text, max(1, len(by_text) // 20_000)):
            word, text = in_text[0][part], in_text[1][part]
            size = at[word + 1] - at[word]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            pairs = np.unique(gram[np.repeat(at[word], size) + inner].astype(np.int64) * len(texts) + np.repeat(text, size))
            yield (pairs // len(texts)).astype(np.int32), (pairs % len(texts)).astype(np.int32)

    n_texts = np.zeros(len(kinds), np.int64)
    for found_grams, _ in grams_in_texts(gram, owner):
        n_texts += np.bincount(found_grams, minlength=len(kinds))
    grams = choose(kinds, n_texts, MOST_GRAMS)
    lexicon = Lexicon(words, grams)
    found = lexicon.of(tokens)
    word, known_gram, gram_owner = found
    known = word[tokens.words] >= 0
    seen_words = presence(word[tokens.words][known], text_of_word[known])
    seen_grams = tuple(map(np.concatenate, zip(*grams_in_texts(known_gram, gram_owner)))) if len(in_text[0]) else (np.zeros(0, int),) * 2

    def leanings(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (
            _leaning(seen_words, label, use, lexicon.n_words),
            _leaning(seen_grams, label, use, lexicon.n_grams),
        )

    everyone = leanings(np.ones(len(texts), bool))
    model = {
        "lexicon": (lexicon.words, lexicon.grams),
        "word_leaning": everyone[0],
        "gram_leaning": everyone[1],
        "word_vectors": 0.1 * rng.standard_normal((lexicon.n_words, WORD_DIM)).astype(np.float32),
        "gram_vectors": 0.1 * rng.standard_normal((lexicon.n_grams, GRAM_DIM)).astype(np.float32),
        "net": gru.new_params(WORD_DIM + GRAM_DIM + 4, HIDDEN, ATTENTION, rng),
    }
    # what training sees of a text leans on the labels of other folds only
    fold = rng.permutation(len(texts)) % FOLDS
    by_fold = [leanings(fold != f) for f in range(FOLDS)]
    start, n_words, of = windows_of(tokens.counts)
    strength = np.zeros(len(start))
    for f in range(FOLDS):
        lean = inputs_of(model, found, by_fold[f])
        per_word = np.maximum(lean[:, -4], lean[:, -3])
        mine = np.flatnonzero(fold[of] == f)
        for a in range(0, len(mine), AT_ONCE):
            part = mine[a : a + AT_ONCE]
            steps, mask = _steps(tokens.words, start[part], n_words[part])
            strength[part] = np.where(mask, per_word[steps], -np.inf).max(0)
    order = np.lexsort((rng.random(len(of)), -strength, of))
    nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    likely = order[(nth < 1) | ((nth < 3) & (label[of[order]] == 0))]  # clean texts: their most suspicious windows, too
    spare = order[(nth >= 3) & (label[of[order]] == 0)]
    chosen = np.concatenate([likely, rng.permutation(spare)[: len(likely) // 2]])
    adam, target = gru.Adam(0.01, DECAY), label[of[chosen]]
    net_names = list(model["net"])
    groups = [[np.flatnonzero((fold[of[chosen]] == f) & (target == k)) for k in (0, 1)] for f in range(FOLDS)]
    groups = [g for g in groups if len(g[0]) and len(g[1])]
    for step in range(STEPS if groups else 0):
        adam.rate = 0.01 * (1 - step / STEPS)
        mine = np.concatenate([rng.choice(g, BATCH // 2) for g in groups[step % len(groups)]])
        f = int(fold[of[chosen[mine[0]]]])
        steps, mask = _steps(tokens.words, start[chosen[mine]], n_words[chosen[mine]])
        kinds_here, steps = np.unique(steps, return_inverse=True)
        steps = steps.reshape(mask.shape)
        pick = np.isin(gram_owner, kinds_here)
        here = word[kinds_here], known_gram[pick], np.searchsorted(kinds_here, gram_owner[pick])
        inputs, kept = inputs_of(model, here, by_fold[f]), {}
        left = (rng.random((len(inputs), 1)) >= DROPPED) / (1 - DROPPED)
        inputs[:, : WORD_DIM + GRAM_DIM] *= left
        logit = gru.forward(model["net"], inputs, steps, mask, kept)
        error = (1 / (1 + np.exp(-logit)) - target[mine]).astype(np.float32) / len(mine)
        grad, d_in = gru.backward(model["net"], inputs, steps, mask, kept, error)
        d_in[:, : WORD_DIM + GRAM_DIM] *= left
        count = np.maximum(np.bincount(here[2], minlength=len(kinds_here)), 1)[:, None]
        grad["word_vectors"], grad["gram_vectors"] = np.zeros_like(model["word_vectors"]), np.zeros_like(model["gram_vectors"])
        has = here[0] >= 0
        np.add.at(grad["word_vectors"], here[0][has], d_in[has, :WORD_DIM])
        np.add.at(grad["gram_vectors"], here[1], (d_in[:, WORD_DIM : WORD_DIM + GRAM_DIM] / count)[here[2]])
        params = {k: model["net"][k] for k in net_names} | {k: model[k] for k in ("word_vectors", "gram_vectors")}
        adam.step(params, grad)
    # calibration of a text's highest logit, with the rows weighted to the true share
    best = np.full(len(texts), -np.inf)
    for f in range(FOLDS):
        logits = window_logits(model, inputs_of(model, found, by_fold[f]), tokens.words, start, n_words)
        mine = fold[of] == f
        np.maximum.at(best, of[mine], logits[mine])
    weight = np.where(label == 1, share_toxic / max(label.mean(), 1e-9), (1 - share_toxic) / max(1 - label.mean(), 1e-9))
    x, at = np.stack([best, np.ones(len(best))], 1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, x @ w) - label * (x @ w))).sum() + (w[0] - 1) ** 2)

    for _ in range(50):  # Newton's method, with steps that lower the loss
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weight * (p - label)) + [2 * (at[0] - 1), 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2, 1e-6])
        move = np.linalg.solve(curve, slope)
        while loss(at - move) > loss(at) and np.abs(move).max() > 1e-9:
            move = move / 2
        at = at - move
    return model | {"slope": max(float(at[0]), 0.05), "offset": float(at[1])}


def text_scores(model: dict, texts: pa.Array) -> np.ndarray:
    tokens = Tokens(texts)
    lexicon = Lexicon.__new__(Lexicon)
    lexicon.words, lexicon.grams = model["lexicon"]
    start, size, of = windows_of(tokens.counts)
    logits = window_logits(model, inputs_of(model, lexicon.of(tokens)), tokens.words, start, size)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, of, logits)
    return 1 / (1 + np.exp(-(model["slope"] * best + model["offset"])))


# ---- on tables ---------------------------------------------------------------------


def within(size: np.ndarray, label: np.ndarray, turn: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places, ascending, of the rows that fit in `most` bytes (SAMPLE_BYTES): of each label
    the first by turn. A label may fill half of them and what the other leaves; a text that
    is longer than that by itself is passed over."""
    most, out = SAMPLE_BYTES if most is None else most, []
    for k in (0, 1):
        mine = np.flatnonzero(label == k)
        mine = mine[np.argsort(turn[mine], kind="stable")]
        part = max(most // 2, most - int(size[label != k].sum()))
        mine = mine[size[mine] <= part]
        out.append(mine[np.cumsum(size[mine]) <= part])
    return np.sort(np.concatenate(out))


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled rows that are not held out; none without both labels.

    labels: doc_id, toxic; a doc_id labelled more than once is toxic if one label says so;
    nulls are no labels. The sample: of each label the first SAMPLE_ROWS by seeded order,
    as far as their texts fit in the label's part of SAMPLE_BYTES (see `within`).
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return None
    keyed = known.withColumn("turn", seeded_key(SEED, F.col("doc_id")))
    first = lambda k: keyed.filter(F.col("toxic") == k).orderBy("turn", "doc_id").limit(SAMPLE_ROWS)
    chosen = first(1).union(first(0)).toPandas()
    sample = spark.createDataFrame(chosen) if len(chosen) else keyed
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("turn").alias("turn"), F.min("text").alias("text"))
    share = n_toxic / n

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        rows = pa.concat_tables(tables).sort_by("doc_id")
        size = pa.compute.binary_length(rows.column("text")).to_numpy()
        rows = rows.take(within(size, rows.column("toxic").to_numpy(), rows.column("turn").to_numpy()))
        label = rows.column("toxic").to_numpy().astype(float)
        if 0 < label.sum() < len(label):
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(train(rows.column("text").to_pylist(), label, share))]})

    # one task trains, on an executor: the sample is bounded, and the driver stays small
    found = rows.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, as they are, whose score is below the threshold."""
    into = fresh_name(docs, "score")
    return scores(docs, labels, into).filter(F.col(into) < threshold).drop(into)


def scores(docs: DataFrame, labels: DataFrame, into: str = "score") -> DataFrame:
    """The rows of docs (all columns) with, as column `into`, a score from 0 to 1, higher:
    likelier toxic.

    docs: doc_id, text and others. A null or empty text is one window without words.
    Repeated rows are scored alike. Without rows of both labels to learn from every
    score is 0. An empty table gives an empty result.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                found = pa.array(text_scores(shared.value, part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, into])

    schema = StructType([*docs.schema.fields]).add(into, DoubleType())
    return docs.mapInArrow(score, schema)
