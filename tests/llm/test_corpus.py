"""The corpus operators against brute force, on the small tables and on awkward ones."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerfold.llm import chunks, gru, hamming, lines, mixing, order_minhash, packing, queries, sharding, simhash, suffix_tree, tokenfile, toxicity, words
from ledgerfold.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, kept string, `row` string, start long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def table(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, clashing names."""
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(200))
    texts = [None, "", " \t ", "one", "two words", long, "a b c d e f g h", "a b c d e f g h", "Ünï cödé 文字 ok", "x" * 30_000]
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", None, None, 7, 0.5, "k", "r", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[6], rows[6], (None, "no id", "s1", "en", 5, 7, 0.5, "k", "r", 1), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- pieces --------------------------------------------------------------------------


def test_windows_contexts_and_symbols_give_each_other():
    rng = np.random.default_rng(5)
    ctx, symbol = (rng.integers(0, 2**64, 50, np.uint64) for _ in range(2))
    window = suffix_tree.extend(ctx, symbol)
    assert (window ^ suffix_tree.turned(ctx) == symbol).all() and (suffix_tree.turned(window ^ symbol, 41) == ctx).all()


def test_chunks_come_back_by_part(spark):
    rng = np.random.default_rng(6)
    keys = np.sort(rng.integers(0, 2**64, 500, np.uint64))
    pieces = [(part, chunks.HELD, i, chunks.pack(keys[at], chunks.narrow(np.arange(500)[at]))) for i in (1, 2) for part, at in chunks.by_part(keys, 7)]

    def work(part, found):
        for kind, block, (mine, n), _ in found:
            yield part, int(block), int(len(mine)), int(n.astype(np.int64).sum()), bool((np.diff(mine.astype(float)) >= 0).all())

    found = chunks.dealt(spark.createDataFrame(pieces, chunks.CHUNK), work, "part long, block long, n long, total long, ascends boolean").toPandas()
    assert len(found) == 14 and found.n.sum() == 1000 and found.total.sum() == 500 * 499 and found.ascends.all()
    assert found.part.nunique() == 7 and (chunks.places_of(keys[::-1]) == np.arange(500)[::-1]).all()
    table = chunks.Table([[keys[1::2], np.arange(250)], [keys[::2], np.arange(250)]])
    assert (table.get(keys, 1, -1) == np.arange(500) // 2).all() and (table.get(keys + np.uint64(1), 1, -1) == -1).all()


def test_words_of():
    texts = ["The  cat,\tÜber", "", None, "a", " x\n"]
    found = words.words_of(pa.array(texts))
    assert found.counts.tolist() == [3, 0, 0, 1, 1]
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)] == ["the", "cat,", "Über", "a", "x"]
    again = words.words_of(pa.array(["zz the", "x"]))
    assert again.hashes[1] == found.hashes[0] and again.hashes[2] == found.hashes[4]


def test_numbers_and_tables():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64))
    numbers = words.Numbers()
    for part in np.array_split(keys, 7):
        numbers.add(part)
    assert (numbers.find(keys) == np.arange(len(keys))).all() and numbers.find(np.array([18, 17], np.uint64)).tolist() == [-1, -1]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *((100 + i, 101 + i) for i in range(60)), *((500, 501 + i) for i in range(40))]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found[3] == 1 and found[9] == 8 and 5 not in found and found[160] == 100 and found[540] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: suffix tree ------------------------------------------------------------------


def test_suffix_tree_scores(spark, sf, table):
    found = queries.op1_suffix_tree(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    tokens = [[*WORD.findall(lowered(t)), "\n"] for t in table.text]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in table.doc_id]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        base = sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        assert (found.held_out[i], found.n_tokens[i], found.n_known[i], found.train_tokens[i]) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(found.base_score[i] - base) < 1e-6 * abs(base)
    assert found.score[found.held_out].sum() > found.base_score[found.held_out].sum()


class BruteTree:
    """The tree by its definition, with words as strings and counts in dictionaries."""

    def __init__(self, texts, depth=suffix_tree.DEPTH, least=8):
        self.depth, counts = depth, Counter()
        for t in texts:
            line = self.line(t)
            counts.update(line[i - d : i + 1] for i in range(depth, len(line)) for d in range(depth + 1))
            counts.update({("^",) * d: 1 for d in range(1, depth + 1)})
        self.counts = counts
        words = {k[0]: n for k, n in counts.items() if len(k) == 1 and k != ("^",)}
        self.total, self.kinds, self.words, self.left = sum(words.values()), len(words), words, {(): 1.0}
        for d in range(1, depth + 1):
            after = defaultdict(dict)
            for k, n in counts.items():
                if len(k) == d + 1 and n >= 2 and k[-1] != "^":
                    after[k[:-1]][k[-1]] = n
            for ctx, follow in after.items():
                if counts[ctx] >= least and ctx[1:] in self.left:
                    own = {s: (n - 0.75) / counts[ctx] for s, n in follow.items()}
                    below = {s: self.own(ctx[1:], s) for s in follow}
                    left = (1 - sum(own.values())) / max(1 - sum(below.values()), 1e-9)
                    gain = sum(n * np.log(own[s] / below[s]) for s, n in follow.items())
                    if gain + (counts[ctx] - sum(follow.values())) * np.log(left) >= len(follow):
                        self.left[ctx] = left

    def line(self, text):
        return (*["^"] * self.depth, *WORD.findall(lowered(text)), "$")

    def own(self, ctx, s):
        return (self.counts[(*ctx, s)] - 0.75) / self.counts[ctx] if ctx else (self.words.get(s, 0) + 1) / (self.total + self.kinds + 1)

    def prob(self, history, s):
        ctx = next(history[i:] for i in range(len(history) + 1) if history[i:] in self.left)
        factor = 1.0
        while ctx and self.counts[(*ctx, s)] < 2:
            factor, ctx = factor * self.left[ctx], ctx[1:]
        return factor * self.own(ctx, s)

    def score(self, text):
        line = self.line(text)
        return sum(np.log10(self.prob(line[i - self.depth : i], line[i])) for i in range(self.depth, len(line)))


def test_suffix_tree_scores_as_by_definition(spark, docs, table):
    texts = table.head(60)
    brute = BruteTree([t for i, t in zip(texts.doc_id, texts.text) if zlib.crc32(str(i).encode()) % 7 != 2])
    assert {len(x) for x in brute.left} == {0, 1, 2, 3}
    found = suffix_tree.scores(docs.filter(F.col("doc_id").isin(texts.doc_id.tolist()))).toPandas().set_index("doc_id")
    for i, t in zip(texts.doc_id, texts.text):
        assert abs(found.score[i] - brute.score(t)) < 1e-6 * abs(brute.score(t))
    # after a context, the probabilities of all known symbols and the unknown one add up to 1
    for ctx in list(brute.left)[:40]:
        assert abs(sum(brute.prob(ctx, s) for s in [*brute.words, "no such word"]) - 1) < 1e-6


def test_suffix_tree_in_parts_and_awkward(spark, awkward, empty, docs, monkeypatch):
    some = docs.select("doc_id", "text").union(docs.filter("doc_id < 9").select("doc_id", "text"))
    whole = suffix_tree.scores(some).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    for name, value in {"PART_BYTES": 20_000, "HELD_ROWS": 2_000, "BATCH_BYTES": 9_000, "BLOCK_BYTES": 30_000, "ROUNDS": 2}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    parts = suffix_tree.scores(some, 1000).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    assert np.allclose(whole[["n_known", "base_score", "score"]], parts[["n_known", "base_score", "score"]], rtol=1e-12)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "64MB", "67108864")
    found = suffix_tree.scores(awkward).toPandas()
    assert len(found) == awkward.count() and found.score.notna().all() and (found.n_tokens >= 1).all()
    assert suffix_tree.scores(empty).count() == 0


def test_suffix_tree_learns_rare_contexts_of_large_corpora(spark):
    """A context that comes 8 times is a node, and its symbol has a probability, at any size."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 50}" for j in range(40)) for i in range(2000)] + ["rare word"] * 10 + ["scarce word"]
    found = suffix_tree.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert found.held_out[2000:2010].sum() <= 2
    assert (found.score[2000:2010] > -5).all() and found.score[2010] < -7


def test_suffix_tree_grows_contexts_of_three_words(spark):
    """What follows x y depends on the word before, though a x and b x say no more than x."""
    texts = ["a x y p", "b x y q", "z y r"] * 30
    rows = spark.createDataFrame(list(enumerate([*texts, "a x y q"])), "doc_id long, text string")
    found = suffix_tree.scores(rows).toPandas().set_index("doc_id")
    assert found.score[90] < found.score[0] - 1


# ---- 2: Order MinHash ----------------------------------------------------------------


def test_order_minhash(spark, sf, table):
    found = queries.op2_order_minhash(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = table.text.tolist()
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert found.edited_sha256[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    by_text = defaultdict(set)
    for t, f in zip(texts, found.fingerprint):
        by_text[t].add(f)
    assert all(len(x) == 1 for x in by_text.values())
    assert found.near_edited.between(0, 1).all() and found.near_edited.mean() > found.near_next.mean() + 0.05


def slow_signature(text, k=order_minhash.K):
    """By the definition: tuples of the next two k-mers around each seed's circle, in text order."""
    bits = order_minhash.HASH_BITS

    def chained(parts):
        h = 42
        for part in parts:
            h = xxhash.xxh64_intdigest(part, h)
        return h

    w = [x.encode() for x in WORD.findall(text)]
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w]
    upper = lambda h: h >> (64 - bits)
    met, numbered = Counter(), []
    for place, g in enumerate(grams, 1):
        h = upper(chained(g))
        n, met[h] = met[h], met[h] + 1
        numbered.append((upper(chained([h.to_bytes(8, "little"), n.to_bytes(4, "little")])) if n else h, place))
    out = []
    for seed in range(order_minhash.SEEDS):
        own = sorted((upper(chained([h.to_bytes(8, "little"), seed.to_bytes(4, "little")])), p) if seed else (h, p) for h, p in numbered)
        for point in order_minhash.points_of(seed):
            first = sum(h < point >> order_minhash.PLACE_BITS for h, _ in own)
            mine = sorted((own[(first + i) % len(own)] for i in range(order_minhash.PER_POINT)), key=lambda x: x[1])
            out.append(chained([h.to_bytes(8, "little") for h, _ in mine]))
    return out


def test_order_minhash_is_as_defined(spark, table):
    texts = [*table.text[:30], "", "one", "a b", "a b c", "a b c a b c a b c", "x y z " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in order_minhash.fingerprints(df).collect():
        assert [x % 2**64 for x in r["signature"]] == slow_signature(texts[r["doc_id"]])


def test_order_minhash_tells_the_order_of_short_texts(spark):
    """Texts of few k-mers, with the same k-mers in another order, are less alike than equal ones."""
    a, b = "p q r s t u v w x y z", "p q r s t u | v w x y z"
    rows = [(0, f"{a} | {b}"), (1, f"{b} | {a}"), (2, f"{a} | {b} | end")]
    sig = {r["doc_id"]: r["signature"] for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = lambda x, y: np.mean([p == q for p, q in zip(sig[x], sig[y])])
    assert alike(0, 2) > alike(0, 1) and all(len(set(x)) > 8 for x in sig.values())


def test_order_minhash_minds_order_and_repeats(spark):
    rng = np.random.default_rng(2)
    w = [f"w{i}" for i in rng.permutation(400)]
    moved = w[200:] + w[:200]
    near = w[:100] + ["new"] + w[101:]
    rows = [(0, " ".join(w)), (1, " ".join(near)), (2, " ".join(moved)), (3, " ".join(sorted(w))), (4, "a b c " * 50), (5, "a b c " * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sig = {r["doc_id"]: r["signature"] for r in order_minhash.fingerprints(df).collect()}
    alike = lambda a, b: np.mean([x == y for x, y in zip(sig[a], sig[b])])
    assert alike(0, 1) > 0.7 and alike(0, 1) > alike(0, 2) > alike(0, 3)
    assert sig[4] != sig[5]


def test_order_minhash_awkward(awkward, empty):
    found = order_minhash.with_next(awkward).collect()
    assert len(found) == awkward.count() and all(r["next_text"] is not None for r in found)
    assert order_minhash.with_next(empty).count() == 0
    many = order_minhash.with_next(awkward, per_range=2).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["next_text"])
    assert sorted(map(key, many)) == sorted(map(key, found))


# ---- 3: toxicity ---------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in gru.new_params(5, 3, 4, rng).items()}
    inputs, at = rng.standard_normal((6, 5)), rng.integers(0, 6, (7, 4))
    mask = np.arange(7)[:, None] < np.array([7, 3, 1, 5])
    kept = {}
    out = gru.forward(p, inputs, at, mask, kept)
    grad, d_inputs = gru.backward(p, inputs, at, mask, kept, np.ones(4))
    for name, x, g in [*((k, p[k], grad[k]) for k in p), ("inputs", inputs, d_inputs)]:
        i = tuple(rng.integers(0, n) for n in x.shape)
        old = x[i]
        x[i] = old + 1e-3
        up = gru.forward(p, inputs, at, mask).sum()
        x[i] = old - 1e-3
        down = gru.forward(p, inputs, at, mask).sum()
        x[i] = old
        assert abs((up - down) / 2e-3 - g[i]) < 1e-3 * max(1, abs(g[i])), name
    assert out.shape == (4,)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", "toxic")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.scores(some, labels).filter(toxicity.held_out()).join(labels, "doc_id").select("score", "toxic").toPandas()
    assert found.score.between(0, 1).all()
    caught = (found.score >= 0.3) & (found.toxic == 1)
    wrong = (found.score >= 0.3) & (found.toxic == 0)
    assert caught.sum() > 0.7 * (found.toxic == 1).sum() and wrong.sum() < 0.03 * (found.toxic == 0).sum()


def test_the_network_adds_to_its_log_odds():
    """Held-out texts are told apart better by the network than by any one of the label
    statistics among its inputs, whether a window's highest or its mean."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{sf}/{t}.parquet", columns=["doc_id", c]).to_pandas() for t, c in (("documents", "text"), ("labels", "toxic")))
    rows = docs.merge(labels, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    learn, test = rows[~held], rows[held]
    clean = learn[learn.toxic == 0].sample(1000, random_state=1).index
    sample = learn[(learn.toxic == 1) | learn.index.isin(clean)]
    model = toxicity.train(sample.text.tolist(), sample.toxic.to_numpy().astype(float), learn.toxic.mean())
    texts, toxic = pa.array(test.text.tolist(), pa.large_string()), test.toxic.to_numpy() == 1

    def area(x):
        ranks = np.argsort(np.argsort(x))
        return (ranks[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum())

    scores = toxicity.text_scores(model, texts)
    tokens, lexicon = toxicity.Tokens(texts), toxicity.Lexicon.__new__(toxicity.Lexicon)
    lexicon.words, lexicon.grams = model["lexicon"]
    inputs, (start, size, of) = toxicity.inputs_of(model, lexicon.of(tokens)), toxicity.windows_of(tokens.counts)
    best = 0.0
    for column in range(-4, 0):
        for pool in (np.max, np.mean):
            pooled = np.full(len(texts), -9.0)
            for s, n, o in zip(start, size, of):
                if n:
                    pooled[o] = max(pooled[o], pool(inputs[tokens.words[s : s + n], column]))
            best = max(best, area(pooled))
    assert area(scores) > best + 0.005
    assert (scores[toxic] >= toxicity.THRESHOLD).mean() > 0.9 and (scores[~toxic] >= toxicity.THRESHOLD).mean() < 0.03


def test_training_bytes_are_filled_in_seeded_order():
    """Long texts are learned from as short ones are."""
    size, label, turn = np.array([9, 1, 9, 1, 9, 1, 90, 2]), np.array([1, 1, 1, 1, 0, 0, 0, 0]), np.array([0, 3, 1, 2, 0, 1, 2, 3])
    assert toxicity.within(size, label, turn, 1000).tolist() == list(range(8))
    assert toxicity.within(size, label, turn, 38).tolist() == [0, 2, 3, 4, 5, 7]


def test_a_long_text_hides_nothing():
    start, size, of = toxicity.windows_of(np.array([0, 10, 48, 49, 500]))
    for text, n in enumerate([0, 10, 48, 49, 500]):
        base = [0, 0, 10, 58, 107][text]
        own = of == text
        seen = set().union(*(range(a - base, a - base + s) for a, s in zip(start[own], size[own])))
        assert seen == set(range(n)) and own.any()


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    found = toxicity.scores(awkward, labels, "tox").toPandas()
    assert len(found) == awkward.count() and found.tox.between(0, 1).all()
    assert toxicity.accepted(awkward, labels).columns == awkward.columns
    assert toxicity.scores(empty, labels, "tox").count() == 0
    assert toxicity.scores(awkward, labels.limit(0), "tox").agg({"tox": "max"}).first()[0] == 0


# ---- 4: mixing -----------------------------------------------------------------------


def test_mixing_targets_and_texts(spark, docs, table):
    found = mixing.place_words(docs).withColumn("taken", mixing.taken()).toPandas()
    for _, own in found.groupby("source"):
        assert abs(own.taken.sum() - own.target.iat[0]) <= 2 * mixing.Mix().block_words
    assert (found.taken <= 2 * found["size"]).all()
    texts = mixing.mixed_texts(docs).toPandas()
    words = texts.groupby("doc_id").text.apply(lambda t: sum(len(WORD.findall(x)) for x in t))
    assert words.to_dict() == {d: t for d, t in zip(found.doc_id, found.taken) if t}


def test_quotas_are_sainte_lagues(spark):
    sizes = spark.createDataFrame([("a", 70_000), ("b", 20_000), ("c", 9_000), (None, 1_000)], "source string, size long")
    mix = mixing.Mix(n_shards=7)
    targets = mixing.targets(sizes, mix).orderBy("place")
    goal = [r["target"] for r in targets.collect()]
    until = defaultdict(dict)
    for r in mixing.quotas(targets, mix).collect():
        until[r["shard"]][r["place"]] = r["until"]
    house = round(sum(goal) / mix.block_words)
    for shard in range(7):
        seats, won = house * (shard + 1) // 7, [0] * 4
        for _ in range(seats):
            won[max(range(4), key=lambda s: (goal[s] / (2 * won[s] + 1), -s))] += 1
        assert [until[shard][p] for p in range(4)] == won


def test_blocks_go_to_the_shards_that_their_quotas_name(docs):
    mix = mixing.Mix(n_shards=5)
    placed = mixing.place_words(docs, mix).withColumn("taken", mixing.taken()).toPandas()
    found = mixing.place_blocks(docs, mix).toPandas()
    found["words"] = found["to"] - found["from"]
    assert (found.words > 0).all() and (found.words <= mix.block_words).all()
    assert found.groupby("doc_id").words.sum().to_dict() == {d: t for d, t in zip(placed.doc_id, placed.taken) if t}
    for source, own in placed.groupby("source"):
        ends, mine = own.shard_ends.iat[0], found[found.source == source]
        starts = [0, *ends[:-1]]
        for shard, (a, b) in enumerate(zip(starts, ends)):
            assert sorted(set(mine[mine.shard == shard].nth)) == list(range(a, b))
        whole = mine.groupby("nth").words.sum()
        assert (whole[whole.index != whole.index.max()] <= mix.block_words).all()


def test_mixing_awkward(awkward, empty):
    assert mixing.place_blocks(empty).count() == 0 and mixing.place_blocks(awkward).filter("`from` >= `to`").isEmpty()
    found = mixing.place_words(awkward).withColumn("taken", mixing.taken()).toPandas()
    assert len(found) == awkward.count() and (found.taken <= 2 * found["size"]).all()
    out = mixing.mixed_texts(awkward)
    assert out.columns == awkward.columns and out.count() > 0
    assert mixing.mixed_texts(empty).count() == 0 and mixing.place_words(empty).count() == 0


# ---- 5: packing ----------------------------------------------------------------------


def test_packing_keeps_all_words(docs, table):
    found = packing.packed(docs).toPandas()
    sizes = {d: len(WORD.findall(t)) for d, t in zip(table.doc_id, table.text)}
    assert found.groupby("doc_id")["size"].sum().to_dict() == sizes
    bins = found.dropna(subset=["bin"]).sort_values(["bin", "place"])
    assert (bins.groupby("bin")["size"].cumsum() - bins["size"] == bins.place).all()
    total = bins.groupby("bin").agg(size=("size", "sum"), capacity=("capacity", "first"))
    assert (total["size"] <= total.capacity).all()
    lengths = packing.Lengths().sizes
    assert all(c == min(x for x in lengths if x >= s) for s, c in zip(total["size"], total.capacity))


def test_packing_is_no_worse_than_one_size():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 4096, 500))[::-1]
    of, capacity, _ = packing.pack(sizes)
    cost = sum(dict(zip(of.tolist(), capacity.tolist())).values())
    _, bins = packing.best_fit(sizes.tolist(), lambda n: 4096)
    assert cost <= 4096 * len(bins)


def least_total(sizes, lengths):
    """The least cost of any packing, by trying them all."""
    cost = lambda n: min(lengths.cost(i) for i, c in enumerate(lengths.sizes) if c >= n)
    best = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(map(cost, bins)))
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= lengths.sizes[-1]:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("costs", [None, (5.0, 7.0, 12.0), (3.0, 11.0, 13.0), (9.0, 10.0, 30.0)])
def test_packing_is_near_the_best_of_all_packings(costs):
    rng, found, best = np.random.default_rng(12), 0.0, 0.0
    lengths = packing.Lengths(sizes=(4, 8, 16), costs=costs)
    for _ in range(40):
        sizes = np.sort(rng.integers(1, 17, rng.integers(1, 8)))[::-1]
        of, capacity, _ = packing.pack(sizes, lengths)
        per_bin = dict(zip(of.tolist(), capacity.tolist()))
        mine, least = sum(lengths.cost(lengths.sizes.index(c)) for c in per_bin.values()), least_total(sizes.tolist(), lengths)
        assert least - 1e-9 <= mine <= 1.5 * least
        found, best = found + mine, best + least
    assert found <= 1.06 * best


def test_bins_open_at_their_least_expected_cost():
    """One packing mixes sizes: a long piece opens a long bin that later pieces fill, while
    a piece that nothing would fill up opens a short one."""
    assert packing.expected_fill([9, 6, 5, 2, 1], 0, 16) == 16 and packing.expected_fill([9, 9, 9], 0, 16) == 9
    lengths = packing.Lengths(sizes=(4, 10, 16))
    _, capacity, _ = packing.pack(np.array([10, 10, 10, 9, 7, 4]), lengths)
    assert sorted(set(capacity.tolist())) == [4, 10, 16] and capacity[:3].tolist() == [10, 10, 10]


def test_packing_awkward(awkward, empty):
    lengths = packing.Lengths(sizes=(4, 16), group=8)
    found = packing.packed(awkward, lengths).toPandas()
    assert found.loc[found["size"] == 0, "bin"].isna().all() and found.loc[found["size"] > 0, "bin"].notna().all()
    words = [len(WORD.findall(r["text"] or "")) for r in awkward.select("text").collect()]
    assert found["size"].sum() == sum(words)
    per_bin = found.dropna(subset=["bin"]).groupby("bin").agg(s=("size", "sum"), c=("capacity", "first"))
    assert (per_bin.s <= per_bin.c).all()
    assert packing.packed(empty).count() == 0


# ---- 6: SimHash ----------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORD.findall(lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(table):
    for t in [*table.text[:40], None, "", " ", "One", "a b", "Äb ÄB äb x"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_links_are_exact(spark, n, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_ROWS", 300)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 300)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(n)
    centers = rng.integers(0, 2**63, max(1, n // 30)).astype(np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, n)).astype(np.uint64), axis=0)
    fps = np.unique(rng.choice(centers, n) ^ flips)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    label = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1:
            label[label == label[j]] = label[i]
    groups = defaultdict(set)
    for x, g in zip(fps.view(np.int64).tolist(), label):
        groups[g].add(x)
    mine = defaultdict(set)
    for node, root in found.items():
        mine[root].add(node)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_shards_that_a_fingerprint_visits():
    """Random fingerprints are the worst case of a router: no gaps. Each four times as many
    shards take about 1.7 times as many visits; shards are large for that reason."""
    rng = np.random.default_rng(6)
    fps, copies = rng.integers(0, 2**64, 20_000, np.uint64), []
    for shards in (25, 100, 400):
        nodes = simhash.build_router(rng.integers(0, 2**64, 16 * shards, np.uint64), shards)
        who, shard, home = simhash.route(nodes, fps, simhash.RADIUS)
        assert sorted(who[home]) == list(range(len(fps))) and shard.max() < shards
        copies.append(len(who) / len(fps))
    assert copies[0] < 3 and copies[1] < 1.8 * copies[0] and copies[2] < 1.8 * copies[1]
    # where distances leave gaps, nothing reaches across
    centers = rng.integers(0, 2**64, 5, np.uint64)
    grouped = np.repeat(centers, 3000) ^ (np.uint64(1) << rng.integers(0, 64, 15_000).astype(np.uint64))
    nodes = simhash.build_router(grouped[::40], 4)
    who, _, _ = simhash.route(nodes, grouped, simhash.RADIUS)
    assert len(nodes) == 3 and len(who) < 1.05 * len(grouped)


def test_simhash_awkward(awkward, empty):
    found = simhash.classes(awkward).toPandas()
    assert len(found) == awkward.count()
    blank = found[found.fp == 0]
    assert blank.component_id.nunique() == 1 and blank.component_id.iat[0] == 0
    one = simhash.one_of_each(awkward)
    assert one.columns == awkward.columns and one.filter("doc_id = 6").count() == 1 and one.filter("doc_id = 7").count() == 0
    assert simhash.classes(empty).count() == 0


def test_one_row_of_each_class_stays(spark, awkward):
    """Also of classes whose rows share a doc_id, or have none."""
    component = lambda rows: {r["component_id"] for r in simhash.classes(rows).collect()}
    numbered = awkward.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    texts = [r["text"] for r in simhash.one_of_each(awkward).collect()]
    fps = {r["doc_id"]: r["component_id"] for r in simhash.classes(numbered).collect()}
    of = {r["text"]: fps[r["doc_id"]] for r in numbered.collect()}
    assert sorted(of[t] for t in texts) == sorted(component(numbered)) and "no id" in texts
    rows = [(None, "one two three four"), (None, "five six seven eight"), (None, "a b c d"), (3, "a b c d"), (3, "e f g h"), (4, "e f g h")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {*rows[:2], rows[3], rows[4]} and len(kept) == 4


# ---- 7: sharding ---------------------------------------------------------------------


def test_shards_have_the_mixture(docs, table):
    found = sharding.interleave(docs, n_shards=7).toPandas()
    sizes = found.groupby("shard").slot.agg(["count", "min", "max"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] == sizes["count"] - 1).all() and (sizes["min"] == 0).all()
    share = table.source.value_counts() / len(table)
    for _, own in found.groupby("shard"):
        for source, n in own.source.value_counts().items():
            assert abs(n - share[source] * len(own)) <= 2


def test_sharding_awkward(awkward, empty):
    found = sharding.interleave(awkward).toPandas()
    assert len(found) == awkward.count() and sorted(found.text_crc32)[0] == 0 and (found["size"] >= 16).all()
    assert sharding.interleave(empty).count() == 0


# ---- 8: lines ------------------------------------------------------------------------


def slow_drops(rows, k=8, similarity=0.8, least=5):
    spots = defaultdict(list)
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n") if text else []):
            if len(line.encode().split()) >= least:
                spots[line].append((i, n))
    all_lines = list(spots)
    sets = [{p[i : i + k] for i in range(len(p) - k + 1)} for p in (x.ljust(k, "\0") for x in all_lines)]
    label = list(range(len(all_lines)))
    for i in range(len(all_lines)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old = label[j]
                label = [label[i] if x == old else x for x in label]
    groups = defaultdict(list)
    for i, line in enumerate(all_lines):
        groups[label[i]] += spots[line]
    return {x for g in groups.values() for x in g if x != min(g)}


def test_fuzzy_lines(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    base = [" ".join(word() for _ in range(rng.integers(4, 60))) for _ in range(60)]
    rows = []
    for i in range(120):
        text = []
        for line in rng.choice(base, 3):
            w = line.split()
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = word()
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], n) for r in lines.deduplicate(df).collect() for n in r["dropped"] or []}
    want = slow_drops(rows)
    assert len(found ^ want) <= 0.02 * len(want) + 1
    assert all(r["kept"] == "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in found) for r in lines.deduplicate(df).collect())


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Variants of one line that are like some but not all others, met in small cells."""
    monkeypatch.setattr(lines, "BLOCK", 7)
    rng = np.random.default_rng(5)
    w = [f"word{i}" for i in range(40)]
    variants = [" ".join(f"other{rng.integers(99)}" if rng.random() < 0.04 else x for x in w) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(variants)]
    found = {(r["doc_id"], n) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect() for n in r["dropped"] or []}
    assert found == slow_drops(rows)


def test_lines_awkward(awkward, empty):
    out = lines.cleaned(awkward)
    assert out.columns == awkward.columns
    found = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (0, None) in found and (1, "") in found and (6, "a b c d e f g h") in found and not any(d == 7 for d, _ in found)
    assert lines.cleaned(empty).count() == 0


def test_short_lines_are_compared(spark):
    """Exact copies of lines of few words, or without spaces, and similar ones of the latter go."""
    chinese = "這是一行沒有空格的文字而且它相當長所以可以用字元片段來比較看看結果如何".ljust(80, "甲")
    rows = [(0, "Les.\nAll rights reserved.\n\none"), (1, f"Les.\n\n{chinese}\nLes."), (2, f"All rights reserved.\n{chinese}乙"), (3, "Les.\n\n \u3000")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], n) for r in lines.deduplicate(df).collect() for n in r["dropped"] or []}
    assert found == slow_drops(rows, least=1) == {(1, 0), (1, 3), (2, 0), (2, 1), (3, 0)}
    assert {r["doc_id"]: r["text"] for r in lines.cleaned(df).collect()} == {0: rows[0][1], 1: f"\n{chinese}"}


@pytest.mark.parametrize("words", [(5, 10), (20, 40)])
def test_bands_find_similar_lines(words):
    """Recall of the code's own bands, at the least similarity, where it is lowest."""
    rng, found, n = np.random.default_rng(words[0]), 0, 0
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(3000)]
    while n < 400:
        line = list(rng.choice(vocabulary, rng.integers(*words)))
        other = list(line)
        for _ in range(rng.integers(1, 3)):
            at = rng.integers(len(other))
            other[at] = other[at][:-1] if rng.random() < 0.5 else str(rng.choice(vocabulary))
        a, b = " ".join(line), " ".join(other)
        if 0.8 <= lines.jaccard(*lines._sets_of([a, b], lines.SHINGLE)) < 0.84:
            both = lines.bands(lines.signatures([a, b]))
            n, found = n + 1, found + bool((both[0] == both[1]).any())
    assert found / n > 0.97


# ---- 9: token files ------------------------------------------------------------------


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(9).integers(-(2**62), 2**62, 5000))
    levels, left = tokenfile.build_hash(keys)
    at = tokenfile.slots(levels, [np.cumsum(b) - b for b in levels], left, keys)
    assert sorted(at) == list(range(len(keys)))
    index = tokenfile.Index(tokenfile.write_index(keys, np.zeros(len(keys), bool), np.arange(len(keys) + 1), 2))
    first, count = index.find(keys)
    assert (first == np.arange(len(keys))).all() and (count == 1).all()
    assert index.find(keys + 1)[1][~np.isin(keys + 1, keys)].sum() <= 1


def test_round_trip(spark, sf, table):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    found = queries.op9_token_index(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    tokenizer, start = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    for i, text in enumerate(table.text):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (found.start[i], found.n_tokens[i], found.ids_crc32[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_whole_texts_encode_as_the_library_does():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow.parquet as pq

    encoder = tokenfile.Encoder(public.path("word_bpe_49k.json"), "<u2", True, True)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, counts = encoder.encode(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
    want = [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]


def test_keys_go_to_the_shards_that_may_have_them():
    first, last = np.array([-5, 3, 3, 3, 9]), np.array([2, 3, 3, 8, 9])
    keys = np.array([-6, -5, 2, 3, 5, 9, 10])
    which, at = tokenfile.shards_of(first, last, keys)
    assert list(zip(keys[which], at)) == [(-5, 0), (2, 0), (3, 1), (3, 2), (3, 3), (5, 3), (9, 4)]


def test_a_token_file_that_is_written_again_replaces_none(spark, docs, tmp_path):
    """Files of an attempt that doesn't count stay beside those that the manifest names."""
    import os

    public = pytest.importorskip("public_tokenizers")
    path, folder = public.path("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    first = tokenfile.write(docs, folder, path, 49_408).collect()
    before = {f: os.stat(f"{tmp_path}/ids/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/ids")}
    manifest = tokenfile.write(docs, folder, path, 49_408)
    assert {f: os.stat(f"{tmp_path}/ids/{f}").st_mtime_ns for f in before} == before
    assert not {r["file"] for r in first} & {r["file"] for r in manifest.collect()}
    assert tokenfile.read(docs, folder, manifest).count() == docs.count()


def test_odd_texts_encode_as_the_library_does():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    encoder = tokenfile.Encoder(path, "<u2", True, True)
    texts = ["", None, "It's  DON'T, stop... a|b | c,d ,, .", "İstanbul ΣΑΣ ß", "x<|endoftext|>y", "é ́a b\x1cc\x85d", "123.45, 文字。", "a.\tb,\nC."]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]


def test_token_files_awkward(spark, awkward, empty, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokenfile, "SHARD_DOCS", 4)
    path, folder = public.path("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    manifest = tokenfile.write(awkward, folder, path, 49_408)
    found = tokenfile.read(awkward, folder, manifest).toPandas()
    assert len(found) == awkward.count() and sorted(found.start)[0] == 0
    ordered = found.sort_values("start")
    assert (ordered.start.shift(-1).dropna() == (ordered.start + ordered.n_tokens).iloc[:-1]).all()
    assert found.doc_id.isna().sum() == 2 and (found.doc_id == 6).sum() == 3
    strangers = spark.createDataFrame([(10**9,), (-4,)], "doc_id long")
    assert tokenfile.read(strangers, folder, manifest).count() == 0
    none = f"file://{tmp_path}/none"
    assert tokenfile.read(empty, none, tokenfile.write(empty, none, path, 49_408)).count() == 0


# ---- 10: Hamming search --------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 400, 5000])
def test_nearest_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(hamming, "CODE_SHARD", 900)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 60)
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 2**63, n).astype(np.int64)
    codes[rng.random(n) < 0.33] = codes[0]
    near = rng.random(n) < 0.3
    codes[near] = codes[0] ^ (1 << rng.integers(0, 63, near.sum()))
    rows = spark.createDataFrame([(int(i), int(c)) for i, c in enumerate(codes)], "id long, code long")
    found = defaultdict(list)
    for r in hamming.search(rows, F.col("id") % 20 == 0, 4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["distance"], r["neighbor_id"]))
    for q in range(0, n, 20):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64))
        assert found[q] == sorted((int(d[i]), i) for i in range(n) if i != q)[:4]


def test_search_awkward(spark):
    rows = spark.createDataFrame([(0, 5), (0, 5), (20, None), (None, 3), (40, 5), (3, 4)], "id long, code long")
    found = hamming.search(rows, F.col("id") % 20 == 0, 3).collect()
    assert {(r["query_id"], r["neighbor_id"], r["distance"]) for r in found} == {(0, 40, 0), (0, 3, 1), (40, 0, 0), (40, 3, 1)}
    assert hamming.search(rows.limit(0), F.col("id") % 20 == 0).count() == 0


def test_wide_vectors_are_refused(spark):
    code = lambda n: spark.createDataFrame([([1.0, -1.0] * (n // 2),), (None,)], "v array<float>").select(hamming.sign_code(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in code(64)] == [0x5555555555555555, None]
    with pytest.raises(Exception, match="more than 64 entries"):
        code(66)
