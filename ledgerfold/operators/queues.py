"""Task queues: ranges that delete, sweeps of a window, interval unions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import before
from ..sources.views import cuts, long, ranges, tasks


def covers(category: Column, task_id: Column, fire_time: Column, lo_id: Column, hi_id: Column, lo_time: Column, hi_time: Column) -> Column:
    """Whether a range covers a task: immediate categories (1) by id alone, scheduled ones
    by fire time alone, in microseconds."""
    by_id = (task_id >= lo_id) & (task_id < hi_id)
    stored = F.date_trunc("microsecond", fire_time)
    by_time = (stored >= F.date_trunc("microsecond", lo_time)) & (stored < F.date_trunc("microsecond", hi_time))
    return F.when(category == 1, by_id).otherwise(by_time)


#: Buckets of the axis of a category (ids, microseconds) are 2 ** bits wide; so many of
#: them make one of the next level, up to the last level.
ID_BITS, TIME_BITS, STEP_BITS, LEVELS = 7, 26, 10, 5


def _unit(category: Column, at: Column) -> Column:
    return F.when(category == 1, F.shiftright(at, ID_BITS)).otherwise(F.shiftright(at, TIME_BITS))


def levels_of(ranges: DataFrame) -> int:
    """How many levels of buckets the widest range takes, LEVELS at most."""
    c = F.col
    width = _unit(c("category"), c("hi") - 1) - _unit(c("category"), c("lo")) + 1
    widest = ranges.filter("hi > lo").agg(F.max(width)).first()[0] or 1
    return min(LEVELS, 1 + (widest.bit_length() - 1) // STEP_BITS)


def spread(ranges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Ranges, once for each bucket that they reach into, of levels as high as they are
    wide: a range has a few buckets a level, however wide it is. Empty ranges have none."""
    df = ranges.filter("hi > lo").withColumns({"_a": _unit(F.col("category"), F.col("lo")), "_b": _unit(F.col("category"), F.col("hi") - 1) + 1})
    if levels == 1:
        return df.select(*ranges.columns, F.lit(0).alias("level"), F.explode(F.sequence("_a", F.col("_b") - 1)).alias("bucket"))
    names = []
    for level in range(levels):
        a, b = F.col("_a"), F.col("_b")
        up, down = F.shiftright(a + (1 << STEP_BITS) - 1, STEP_BITS), F.shiftright(b, STEP_BITS)
        higher = (up < down) if level < levels - 1 else F.lit(False)
        none = F.array().cast("array<long>")
        several = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(none)  # noqa: E731, B023
        low = several(a, F.when(higher, F.shiftleft(up, STEP_BITS)).otherwise(b))
        high = F.when(higher, several(F.shiftleft(down, STEP_BITS), b)).otherwise(none)
        level_ = F.lit(level)
        found = F.transform(F.concat(low, high), lambda x: F.struct(level_.alias("level"), x.alias("bucket")))  # noqa: B023
        df = df.withColumns({f"_{level}": found, "_up": F.when(higher, up).otherwise(0), "_down": F.when(higher, down).otherwise(0)})
        df = df.drop("_a", "_b").withColumnsRenamed({"_up": "_a", "_down": "_b"})
        names.append(f"_{level}")
    return df.withColumn("_at", F.explode(F.concat(*names))).select(*ranges.columns, "_at.level", "_at.bucket")


def without(tasks: DataFrame, ranges: DataFrame, own: list[str], after: str | None = None, levels: int | None = None) -> DataFrame:
    """The tasks that no range of their category covers; own: columns in which a range is
    like its tasks; after: a column in which it is higher. An anti join for each level that
    ranges may have (see levels_of), with equal buckets, so that a task meets only the ranges
    around it."""
    levels = levels or levels_of(ranges)
    pieces = spread(ranges, levels)
    for level in range(levels):
        t, r = tasks.alias("t"), pieces.filter(F.col("level") == level).alias("r")
        bucket = F.shiftright(_unit(F.col("t.category"), F.col("t.at")), STEP_BITS * level)
        hit = (bucket == F.col("r.bucket")) & (F.col("t.at") >= F.col("r.lo")) & (F.col("t.at") < F.col("r.hi"))
        for c in ("category", *own):
            hit &= F.col(f"t.{c}") == F.col(f"r.{c}")
        if after:
            hit &= F.col(f"t.{after}") < F.col(f"r.{after}")
        tasks = t.join(r, hit, "left_anti")
    return tasks


def swept(entries: DataFrame) -> DataFrame:
    """Tasks that no range folded after them in their window deletes."""
    return without(tasks(entries), ranges(entries), ["shard", "win"], "seqno")


def sweep_counts(entries: DataFrame) -> DataFrame:
    keys = ["shard", "win", "category"]
    every = tasks(entries).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kept = swept(entries).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    written = F.coalesce("kept", long(0))
    return every.join(kept, keys, "left").select(*keys, written.alias("written"), (F.col("n") - written).alias("dropped"))


def islands(entries: DataFrame) -> DataFrame:
    """Each shard's ranges of a category merged where they join or overlap; gaps stay. How
    far the ranges before reach, and how many gaps they leave, are bucketed totals."""
    group, order = ["shard", "category"], [F.col(c) for c in ("lo", "hi", "seqno")]
    bucket = F.shiftright(_unit(F.col("category"), F.col("lo")), STEP_BITS)
    reached = before(ranges(entries), group, bucket, order, maxima={"reach": F.col("hi")})
    opens = reached.withColumn("opens", long(F.coalesce(F.col("lo") > F.col("reach"), F.lit(True))))
    numbered = before(opens, group, bucket, order, {"island": F.col("opens")}).withColumn("island", F.col("island") + F.col("opens"))
    return numbered.groupBy(*group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("ranges"))


def base_tasks(entries: DataFrame, levels: int | None = None) -> DataFrame:
    """Tasks at rest at the applied position: written up to it, and deleted by no range
    after them up to it."""
    at = F.broadcast(cuts(entries).select("shard", "applied"))
    done = lambda df: df.join(at, "shard").filter("seqno <= applied").drop("applied")
    return without(done(tasks(entries)), done(ranges(entries)), ["shard"], "seqno", levels)


def tail_tasks(entries: DataFrame, overlap: int = 0, levels: int | None = None) -> DataFrame:
    """Tasks of the tail, in order of which ranges sweep them; with `overlap`, as many
    entries below the applied position are held by both sides."""
    at = F.broadcast(cuts(entries).select("shard", "applied"))
    held = tasks(entries).join(at, "shard").filter(F.col("seqno") > F.col("applied") - overlap).drop("applied")
    return without(held, tail_ranges(entries), ["shard"], "seqno", levels)


def tail_ranges(entries: DataFrame) -> DataFrame:
    return ranges(entries).join(F.broadcast(cuts(entries).select("shard", "applied")), "shard").filter("seqno > applied").drop("applied")


def hidden(entries: DataFrame) -> DataFrame:
    """How many tasks at rest each category shows and undrained ranges hide."""
    levels = levels_of(ranges(entries))
    base, kept = base_tasks(entries, levels), visible_base(entries, levels)
    keys = ["shard", "category"]
    every = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("at_rest"))
    seen = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("shown"))
    shown = F.coalesce("shown", long(0))
    return every.join(seen, keys, "left").select(*keys, "at_rest", shown.alias("shown"), (F.col("at_rest") - shown).alias("hidden"))


def visible_base(entries: DataFrame, levels: int | None = None) -> DataFrame:
    return without(base_tasks(entries, levels), tail_ranges(entries), ["shard"], None, levels)


#: Entries below the applied position that the window still holds.
OVERLAP = 10


def merged(entries: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Tasks of both sides, each key once: what is at rest wins, ties are counted."""
    key = ["shard", "category", "fire_time", "at", "task_id"]
    levels = levels_of(ranges(entries))
    both = (
        visible_base(entries, levels)
        .select(*key, "workflow", "slot", long(0).alias("side"))
        .unionByName(tail_tasks(entries, overlap, levels).select(*key, "workflow", "slot", long(1).alias("side")))
    )
    of_key = Window.partitionBy(*key)
    return (
        both.withColumns({"nth": F.row_number().over(of_key.orderBy("side")), "copies": F.count(F.lit(1)).over(of_key)})
        .filter("nth = 1")
        .drop("nth")
    )


def page(entries: DataFrame, batch: int = 50) -> DataFrame:
    """The first page of each category's queue, by fire time and id."""
    order = Window.partitionBy("shard", "category").orderBy(F.col("fire_time").asc_nulls_first(), "task_id")
    return (
        merged(entries)
        .withColumn("ord", long(F.row_number().over(order)))
        .filter(F.col("ord") <= max(batch, 1))
        .select("shard", "category", "ord", long(F.unix_micros("fire_time")).alias("fire_us"), "task_id", "workflow", "side")
    )


def next_page(entries: DataFrame, after: int, after_us: int, batch: int = 50) -> DataFrame:
    """The page of each queue above a key: immediate tasks above an id, scheduled ones above
    a fire time and id. Keyset pagination, so pages join without gaps."""
    order = Window.partitionBy("shard", "category").orderBy(F.col("fire_time").asc_nulls_first(), "task_id")
    above = F.when(F.col("category") == 1, F.col("task_id") > after).otherwise(
        (F.col("at") > after_us) | ((F.col("at") == after_us) & (F.col("task_id") > after))
    )
    return (
        merged(entries)
        .filter(above)
        .withColumn("ord", long(F.row_number().over(order)))
        .filter(F.col("ord") <= max(batch, 1))
        .select("shard", "category", "ord", "task_id", long(F.unix_micros("fire_time")).alias("fire_us"), "side")
    )


def base_pages(entries: DataFrame, size: int = 20) -> DataFrame:
    """Pages as a store may answer, right and wrong: the base's tasks of a category, `size` a
    page, with faults planted by the page's number. shard, category, page, ord, key, lo, hi,
    asked, token."""
    order = Window.partitionBy("shard", "category").orderBy("at", "task_id")
    rows = base_tasks(entries).withColumn("n", long(F.row_number().over(order)) - 1)
    page, ord_ = F.floor(F.col("n") / size).cast("long"), F.col("n") % size
    fault = page % 6
    return rows.select(
        "shard",
        "category",
        page.alias("page"),
        F.when(fault == 1, size - 1 - ord_).otherwise(ord_).alias("ord"),  # descends
        (F.col("at") + F.when((fault == 2) & (ord_ == 3), -(1 << 60)).otherwise(0)).alias("key"),  # below the range
        long(-(1 << 50)).alias("lo"),
        long(1 << 60).alias("hi"),
        F.when(fault == 3, long(size // 2)).otherwise(long(size)).alias("asked"),  # more than was asked for
        long(fault != 5).alias("token"),
    )


def page_audit(pages: DataFrame) -> DataFrame:
    """What is wrong with a store's pages, by shard, category and page (none is left out):
    rows outside of the range, rows that don't ascend from the one before, in the page or
    the pages before, rows beyond those asked for, and a token beside an empty page."""
    in_page = Window.partitionBy("shard", "category", "page").orderBy("ord")
    up_to = Window.partitionBy("shard", "category").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        pages.withColumn("earlier", F.lag("key").over(in_page))
        .groupBy("shard", "category", "page")
        .agg(
            F.count("key").alias("n"),
            F.count_if((F.col("key") < F.col("lo")) | (F.col("key") >= F.col("hi"))).alias("outside"),
            F.count_if(F.col("key") <= F.col("earlier")).alias("descends"),
            F.min("key").alias("lowest"),
            F.max("key").alias("highest"),
            F.max("asked").alias("asked"),
            F.max("token").alias("token"),
        )
    )
    passed = long(F.coalesce(F.col("lowest") <= F.max("highest").over(up_to), F.lit(False)))
    return found.withColumn("passed", passed).select(
        "shard",
        "category",
        "page",
        "n",
        "outside",
        "descends",
        "passed",
        long(F.col("n") > F.col("asked")).alias("too_large"),
        long((F.col("n") == 0) & (F.col("token") == 1)).alias("empty_beside_token"),
    )


def collisions(entries: DataFrame) -> DataFrame:
    """Statistics of reading the whole queue: rows of the base, those of them that ranges
    hide, tasks of the window, keys of both sides, keys that both hold, and where the
    merged ones come from."""
    keys = ["shard", "category"]
    n = F.count(F.lit(1))
    met = merged(entries).groupBy(*keys).agg(
        n.alias("keys"),
        F.count_if(F.col("copies") > 1).alias("collisions"),
        F.count_if(F.col("side") == 0).alias("from_base"),
        F.count_if(F.col("side") == 1).alias("from_window"),
    )
    levels = levels_of(ranges(entries))
    base = base_tasks(entries, levels).groupBy(*keys).agg(n.alias("base_rows"))
    window = tail_tasks(entries, OVERLAP, levels).groupBy(*keys).agg(n.alias("window_touched"))
    none = lambda c: F.coalesce(c, long(0)).alias(c)
    columns = ("base_rows", "window_touched", "keys", "collisions", "from_base", "from_window")
    joined = base.join(window, keys, "full_outer").join(met, keys, "full_outer").select(*keys, *map(none, columns))
    return joined.withColumn("base_discarded", F.col("base_rows") - F.col("from_base"))


def scheduled_cover(timers: DataFrame, lo: str, hi: str) -> DataFrame:
    """Timers (task_id, fire_time) that a scheduled range covers, whatever their ids."""
    null = F.lit(None).cast("long")
    inside = covers(long(2), F.col("task_id"), F.col("fire_time"), null, null, F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))
    return timers.filter(inside).select("task_id", long(F.unix_micros("fire_time")).alias("fire_us"))


def history_page(nodes: DataFrame, reverse: bool = False, batch: int = 3, held_from: int = 3, metadata_only: bool = False) -> DataFrame:
    """The first page of each tree's history from two sides: nodes at rest (below held_from
    + 1) and nodes of the tail (from held_from on). Nodes ascend and their transactions
    descend; reversed, the other way round. A node on both sides is that at rest."""
    both = nodes.filter(F.col("node") <= held_from).withColumn("side", long(0)).unionByName(nodes.filter(F.col("node") >= held_from).withColumn("side", long(1)))
    key = ["tree", "node", "txn"]
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("side", "events"))).filter("nth = 1")
    order = (F.col("node").desc(), F.col("txn").asc()) if reverse else (F.col("node").asc(), F.col("txn").desc())
    of_tree = Window.partitionBy("tree").orderBy(*order)
    paged = once.withColumn("ord", long(F.row_number().over(of_tree))).filter(F.col("ord") <= max(batch, 1))
    columns = ["tree", "ord", "node", "txn", "side"]
    return paged.select(*columns) if metadata_only else paged.select(*columns, long(F.length("events")).alias("chars"))


def upsert_nodes(at_rest: DataFrame, new: DataFrame) -> DataFrame:
    """History nodes after an idempotent upsert: per key the latest write stands."""
    key = ["tree", "node", "txn"]
    both = at_rest.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("turn").desc(), "events")
    return both.withColumn("nth", F.row_number().over(last)).filter("nth = 1").select(*key, "events", long(F.col("turn")).alias("turn"))
