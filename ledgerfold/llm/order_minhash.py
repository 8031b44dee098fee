"""Document fingerprints by Order MinHash.

A text's k-mers (k consecutive words) are numbered by occurrence, so that repeats count, and
hashed by SEEDS seeds. Each seed's hashes form a circle on which POINTS fixed points lie; a
point's order, of distance from it onwards around the circle, is a permutation of the k-mers,
so seeds and points give SEEDS x POINTS permutations. Of each, the `per_point` minimal
occurrence-numbered k-mers are selected, put back into text order, and hashed as a tuple.
Tuples agree only if both texts have the same minimal k-mers in the same order, so the share
of agreeing ones falls with edit distance, moves of passages included. A text of fewer
k-mers than per_point has them all in each tuple.

Arrays of longs hold hash and place together, so sorting them is primitive, a text costs
n log n for each seed, and minima are found by halving; built-in functions only, and nothing
of a text leaves its row.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, let, text_of

K, SEEDS, POINTS, PER_POINT = 3, 4, 8, 2
#: Bits of a k-mer's place in a text (67 million words) and of its hash.
PLACE_BITS = 26
HASH_BITS = 63 - PLACE_BITS
PLACE_MASK = (1 << PLACE_BITS) - 1


def _hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE_MASK).cast("long"))


def _packed(h: Column, place: Column) -> Column:
    """The upper bits of a 64-bit hash over the place."""
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _halved(s: Column, lo: Column, hi: Column, below) -> Column:
    """The first place from lo on and before hi where below(element) doesn't hold."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        right = (at["lo"] < at["hi"]) & below(F.get(s, mid))
        return F.struct(
            F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi")
        )

    steps = F.sequence(F.lit(1), (F.floor(F.log2(hi - lo + 1.0)) + 1).cast("int"))
    return F.aggregate(steps, F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda at: at["lo"])


def points_of(seed: int, points: int = POINTS) -> list[int]:
    """The points of a seed, as hashes over no place: one in each of equal stretches."""
    rng = random.Random(seed)
    width = (1 << HASH_BITS) // points
    return [(p * width + rng.randrange(width)) << PLACE_BITS for p in range(points)]


def signature(text: Column, k: int = K, seeds: int = SEEDS, points: int = POINTS, per_point: int = PER_POINT) -> Column:
    """seeds x points 64-bit hashes of a text, none of them null.

    A text of fewer than k words has one k-mer, the whole word sequence; an empty text
    has that of no words, so all empty texts have one signature. A text of more words than
    places can be told apart (67 million) is an error.
    """

    def kmers(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.size(w) - k + 1),
            lambda i: _packed(F.xxhash64(*(F.element_at(w, i + j) for j in range(k))), i),
        )
        whole = F.array(_packed(F.xxhash64(w), F.lit(1)))
        long_ = F.raise_error(F.lit(f"a text has more than {PLACE_MASK} words")).cast("array<long>")
        return F.sort_array(F.when(F.size(w) > PLACE_MASK, long_).when(F.size(w) >= k, grams).otherwise(whole))

    def occurrence(s: Column, x: Column, t: Column) -> Column:
        """How many of the sorted s before place t (from 0) have x's hash."""
        same = lambda back: _hash_of(F.get(s, t - back)) == _hash_of(x)
        lowest = F.shiftleft(_hash_of(x), PLACE_BITS)
        first = _halved(s, F.lit(0), t, lambda y: y < lowest)
        return F.when((t < 1) | ~same(1), 0).when((t < 2) | ~same(2), 1).otherwise(t - first)

    def numbered(s: Column) -> Column:
        one = lambda x, t: let(occurrence(s, x, t), lambda n: F.when(n == 0, x).otherwise(_packed(F.xxhash64(_hash_of(x), n), _place_of(x))))
        return F.transform(s, one)

    def reseeded(s: Column, seed: int) -> Column:
        return F.sort_array(s if seed == 0 else F.transform(s, lambda x: _packed(F.xxhash64(_hash_of(x), F.lit(seed)), _place_of(x))))

    def tuple_at(s: Column, point: Column) -> Column:
        """The minimal k-mers from a point on, around the circle, in text order, as one hash."""

        def of(first: Column) -> Column:
            mine = [F.get(s, (first + i) % F.size(s)) for i in range(per_point)]
            turned = F.transform(F.array(*mine), lambda x: F.shiftleft(_place_of(x), HASH_BITS).bitwiseOR(_hash_of(x)))
            return F.xxhash64(F.transform(F.sort_array(turned), lambda y: y.bitwiseAND(F.lit((1 << HASH_BITS) - 1).cast("long"))))

        return let(_halved(s, F.lit(0), F.size(s), lambda y: y < point), of)

    def tuples(s: Column, seed: int) -> Column:
        at = F.array(*(F.lit(p).cast("long") for p in points_of(seed, points)))
        return F.transform(at, lambda p: tuple_at(s, p))

    words = F.filter(F.split(text, GAP), lambda w: w != "")
    of_seed = lambda n, seed: let(reseeded(n, seed), lambda s: tuples(s, seed))
    all_of = lambda n: F.concat(*(of_seed(n, seed) for seed in range(seeds)))
    return let(words, lambda w: let(kmers(w), lambda s: let(numbered(s), all_of)))


def as_string(sig: Column) -> Column:
    """8 hexadecimal digits for each tuple."""
    digits = lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0")
    return F.array_join(F.transform(sig, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of tuples that agree."""
    short = lambda x: F.shiftrightunsigned(x, 32)
    agree = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: short(p["a"]) == short(p["b"])))
    return agree / F.size(a)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signature of every whole text (null: empty)."""
    return docs.select("doc_id", signature(text_of()).alias("signature"))


#: Ranges of doc_ids at most: their bounds are a literal of the plan.
MOST_RANGES = 1 << 16


def _rank(sorted_longs: Column, n: int, x: Column) -> Column:
    """How many of n ascending longs are at most x."""
    return _halved(sorted_longs, F.lit(0), F.lit(n), lambda y: y <= x)


def _literal(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_next(docs: DataFrame, per_range: int = 2000) -> DataFrame:
    """doc_id, text, sig, next_text, next_sig: each row with the one after it by doc_id
    (ties: by text; a null doc_id goes first), the last with the first.

    doc_id: an integer. Rows are dealt to doc_id ranges of about per_range rows. The first
    rows of each range are also put at the end of the range before, so that rows meet only
    within ranges and each text is shuffled once. The ranges' bounds, a doc_id for each, are
    the only thing that reaches the driver, and at most MOST_RANGES of them. A null text is
    empty. Of an empty table the result is empty; a single row is next to itself.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(n // per_range, MOST_RANGES))
    cuts = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    # 0 for null, then the ranges between the bounds
    in_range = F.when(F.col("doc_id").isNull(), 0).otherwise(
        1 + (_rank(_literal(bounds, "bigint"), len(bounds), F.col("doc_id")) if bounds else F.lit(0))
    )
    heads = {r["r"]: r["head"] for r in ids.groupBy(in_range.alias("r")).agg(F.min("doc_id").alias("head")).collect()}
    places = sorted(heads)
    before = dict(zip(places, [*places[-1:], *places[:-1]]))
    every = range(len(bounds) + 2)
    head, back = _literal([heads.get(r) for r in every], "bigint"), _literal([before.get(r) for r in every], "int")
    first = F.col("doc_id").eqNullSafe(F.get(head, F.col("_range")))
    to = F.when(first, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")), F.struct(F.get(back, F.col("_range")).alias("r"), F.lit(True).alias("ghost"))))
    rows = (
        docs.select("doc_id", text_of().alias("text"))
        .withColumns({"_range": in_range, "sig": signature(F.col("text"))})
        .withColumn("_to", F.explode(to.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost"))))))
        .select("doc_id", "text", "sig", F.col("_to.r").alias("_range"), F.col("_to.ghost").alias("_ghost"))
    )
    ahead = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.withColumns({"next_text": F.lead("text").over(ahead), "next_sig": F.lead("sig").over(ahead)})
        .filter(~F.col("_ghost"))
        .select("doc_id", "text", "sig", "next_text", "next_sig")
    )


def edited(text: Column, after: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of after."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))
