"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of equal-token blocks. Seats (blocks) go to sources by the highest
quotients target / (2k - 1). Seats for the first 1, 2, ... shards are apportioned in
turn; as the method never takes a seat back when the house grows, the differences are
the integer quotas of each shard. Each source's documents are shuffled by a seeded key
and its words cut into blocks; from a seeded first block on, the quotas take blocks in
turn, around the end, so that a block repeats only when all have been taken.

Built-in functions only. Words are placed in their source's stream by bucketed prefix
sums, blocks are never listed one by one, and apportionment looks only at the few seats
around the house size, so its tables have a few rows per source and shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, KEY_BITS, cut, let, running_offsets, seeded_key, text_of, word_count

SOURCE_BITS = 10


@dataclass(frozen=True)
class Mix:
    """share: words of the mix as a part of all words. repeat: targets stop at this many
    times their source. weights: dealt to the sources in code-point order, null last."""

    share: float = 1.5
    repeat: int = 2
    weights: tuple[int, ...] = (3, 1, 2)
    block_words: int = 64
    n_shards: int = 32
    seed: int = 4


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target, place from rows of (source, size).

    A source is full when its cap is no more than its share of what sources with
    lower cap per weight leave; one window over the sources, in that order, finds all.
    """
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("place") % len(mix.weights) + 1).cast("int"))
    src = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", mix.repeat * F.col("source_size"))
    )
    level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = mix.share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    full = F.col("cap") * F.sum("weight").over(rest) <= left * F.col("weight")
    held = (
        src.withColumn("full", full)
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
        .withColumn("held", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("all", F.sum("source_size").over(everything))
    )
    reshared = (mix.share * F.col("all") - F.col("held")) * F.col("weight") / F.col("open")
    return held.select(
        "source", "source_size", "place", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(reshared).alias("target")
    )


def quotas(targets: DataFrame, mix: Mix) -> DataFrame:
    """source, place, shard, until: the blocks of a source in this and earlier shards."""
    everything = Window.partitionBy()
    house = (
        targets.filter("target > 0")
        .withColumn("part", F.col("target") / F.sum("target").over(everything))
        .withColumn("blocks", F.round(F.sum("target").over(everything) / mix.block_words).cast("long"))
        .withColumn("n", F.count(F.lit(1)).over(everything))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(mix.n_shards - 1))))
        .withColumn("seats", F.expr(f"blocks * (shard + 1) div {mix.n_shards}"))
    )

    def seats_before(key: Column) -> Column:
        return F.floor(F.greatest(key, F.lit(0.0)) * F.col("part") + 0.5).cast("long")

    margin = F.col("n") / 2 + 1.0
    house = house.withColumn("sure", seats_before(F.col("seats") - margin)).withColumn(
        "most", seats_before(F.col("seats") + margin)
    )
    by_quotient = Window.partitionBy("shard").orderBy("key", "place")
    contested = (
        house.withColumn("k", F.explode(F.expr("CASE WHEN most > sure THEN sequence(sure + 1, most) END")))
        .withColumn("key", (F.col("k") - 0.5) / F.col("part"))
        .withColumn("nth", F.row_number().over(by_quotient))
        .select("shard", "place", "nth")
    )
    open_seats = house.groupBy("shard").agg((F.max("seats") - F.sum("sure")).alias("open"))
    won = contested.join(open_seats, "shard").filter("nth <= open").groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won"))
    return house.join(won, ["shard", "place"], "left").select(
        "source", "place", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("until")
    )


def apportion(sizes: DataFrame, mix: Mix) -> DataFrame:
    """A row per source: place, source, source_size, target, n_blocks, first (a seeded
    block), quota and shard_ends (blocks taken until the end of each shard)."""
    src = cut(targets(sizes, mix), "mix-targets")
    ends = (
        quotas(src, mix)
        .groupBy("place")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "until"))), lambda x: x["until"]).alias("ends"))
    )
    n_blocks = F.expr(f"(source_size + {mix.block_words - 1}) div {mix.block_words}")
    most = mix.repeat * F.col("n_blocks")
    return (
        src.join(ends, "place", "left")
        .withColumn("n_blocks", n_blocks)
        .withColumn("shard_ends", F.transform(F.coalesce("ends", F.array(F.lit(0).cast("long"))), lambda x: F.least(x, most)))
        .withColumn("quota", F.element_at("shard_ends", -1))
        .withColumn("first", F.when(F.col("n_blocks") > 0, F.pmod(seeded_key(mix.seed, F.col("place")), F.col("n_blocks"))))
        .select("place", "source", "source_size", "target", "n_blocks", "first", "quota", "shard_ends")
    )


def place_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs with size, source_size, target, start (its first word's place in its source's
    shuffled stream), rounds (times that all of it is taken), and head and tail: word
    ranges [from, to) of it taken once more.

    docs: doc_id, text, source; other columns are left out. A null or empty text has size 0 and gives nothing to the mix; a null source is a source of its
    own; repeated rows are rows of their own; an empty table gives an empty result.
    """
    key = seeded_key(mix.seed, F.col("doc_id"), F.md5(text_of().cast("binary")))
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key")), "mix-sizes")
    return place_sized(sized, sized, mix)


def place_sized(sized: DataFrame, streams: DataFrame, mix: Mix) -> DataFrame:
    """As place_words, with sizes and keys already in `sized`; `streams` has all of its
    rows for the statistics."""
    per_source = cut(apportion(streams, mix), "mix-sources").withColumnRenamed("source", "_source")
    placed = running_offsets(
        sized,
        ["source"],
        F.shiftright("_key", KEY_BITS - SOURCE_BITS),
        [F.col("_key"), F.col("doc_id")],
        "size",
        "start",
    ).join(per_source, F.col("source").eqNullSafe(F.col("_source")))

    def shared(a: Column, b: Column) -> Column:
        """The words of the document in [a, b) of its stream, as a range within it."""
        lo, hi = F.greatest(a, F.col("start")), F.least(b, F.col("start") + F.col("size"))
        return F.struct(
            F.when(hi > lo, lo - F.col("start")).otherwise(0).alias("from"),
            F.when(hi > lo, hi - F.col("start")).otherwise(0).alias("to"),
        )

    some = F.col("n_blocks") > 0
    rounds = F.when(some, F.expr("quota div n_blocks")).otherwise(0)
    until = F.col("first") + F.when(some, F.expr("quota % n_blocks")).otherwise(0)
    b = mix.block_words
    return placed.withColumns(
        {
            "rounds": rounds.cast("int"),
            "tail": shared(F.col("first") * b, F.least(until, F.col("n_blocks")) * b),
            "head": shared(F.lit(0).cast("long"), F.greatest(until - F.col("n_blocks"), F.lit(0)) * b),
        }
    ).drop("_key", "_source")


def taken() -> Column:
    """The words that the mix takes of a document of place_words, repeats counted."""
    once = F.col("tail.to") - F.col("tail.from") + F.col("head.to") - F.col("head.from")
    return (F.col("rounds") * F.col("size") + once).cast("long")


def place_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Which block, of which shard, each taken word goes to: doc_id, source, shard, nth (of
    the source's blocks, in the order in which the quotas take them), block (of the source's
    stream) and the document's words [from, to) in it; a row for each block of a document and
    each time that it is taken. docs, nulls and repeated rows: as for place_words."""
    b, some = mix.block_words, place_words(docs, mix).filter("size > 0 AND quota > 0")
    of_block = some.withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    turns = F.transform(F.sequence(F.lit(0), F.col("rounds")), lambda r: F.pmod(F.col("block") - F.col("first"), F.col("n_blocks")) + r * F.col("n_blocks"))
    taken_ = of_block.withColumn("nth", F.explode(F.filter(turns, lambda k: k < F.col("quota"))))
    return taken_.select(
        "doc_id",
        "source",
        F.size(F.filter("shard_ends", lambda end: end <= F.col("nth"))).alias("shard"),
        "nth",
        "block",
        F.greatest(F.col("block") * b - F.col("start"), F.lit(0)).alias("from"),
        F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")).alias("to"),
    )


def mixed_texts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix: the columns of docs, a row for each round that takes all or part of a
    document. A whole document keeps its text as it is; a part is the document's taken
    words, joined by spaces, with n_chars set anew where there is such a column. Documents
    without words aren't in the mix. Other columns, however named, come along."""
    key = seeded_key(mix.seed, F.col("doc_id"), F.md5(text_of().cast("binary")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sized = docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key"), row)
    streams = cut(sized.drop("row"), "mix-sizes")
    once = F.col("tail.to") - F.col("tail.from") + F.col("head.to") - F.col("head.from")
    whole = F.col("rounds") + (once == F.col("size")).cast("int")
    part = ((once > 0) & (once < F.col("size"))).cast("int")
    copies = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), part))
    taken_rows = place_sized(sized, streams, mix).filter("size > 0").withColumn("part", F.explode(copies))

    def piece(words: Column) -> Column:
        span = lambda p: F.slice(words, F.col(f"{p}.from").cast("int") + 1, (F.col(f"{p}.to") - F.col(f"{p}.from")).cast("int"))
        return F.array_join(F.concat(span("head"), span("tail")), " ")

    cut_text = let(F.filter(F.split("row.text", GAP), lambda w: w != ""), piece)
    out = taken_rows.withColumn("new", F.when(F.col("part"), cut_text).otherwise(F.col("row.text")))
    n_chars = F.when(F.col("part"), F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    fresh = {"text": F.col("new"), "n_chars": n_chars}
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
