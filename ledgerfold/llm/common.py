"""Pieces that several corpus operators share: reading tables, cutting lineage in
the cluster's shared folder, seeded order keys and distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A word: a run of characters other than space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that clashing extra columns never matter."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots as __) while it lasts."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def lean(spark: SparkSession):
    """While it lasts, jobs delete their shuffle files when they end: what they made is
    written by then."""
    return setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


#: Bytes of a small Arrow batch between Spark and Python.
BATCH = 4 << 20


def small_batches(spark: SparkSession):
    """While it lasts, Arrow batches of some BATCH bytes: where rows are long, Spark's own
    limit, a count of rows first, lets batches grow large on both sides."""
    return setting(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH))


def written(df: DataFrame, what: str, *by: str) -> str:
    """The folder, in the shared one, to which df was written (with a folder for each value of `by`)."""
    path = new_folder(df.sparkSession, what)
    with lean(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written to a table in the shared folder and read again: later jobs neither
    recompute it nor lose it with an executor, and the optimizer knows its size."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, what))


def drop_cut(df: DataFrame) -> None:
    """Deletes the folder behind a table that `cut` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` names it, also in lambdas
    (where the optimizer would put the expression itself)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, after as many underscores as it takes not to be a column of df."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of a seeded order key.
KEY_BITS = 60


def seeded_key(seed: int, *parts: Column) -> Column:
    """A uniform key of KEY_BITS bits from a seed and some columns (null: empty)."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_offsets(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, into: str
) -> DataFrame:
    """Adds the exclusive running sum of `value` in each group, by `order`.

    `bucket` must not decrease along `order` and has a fixed number of values. Rows
    meet only within a (group, bucket); sums of whole buckets are added up in a table
    of at most groups x buckets rows. So no task gets a whole group, however hot.
    Nulls in a group column form a group of their own.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *(F.col(g).alias(f"_of_{g}") for g in group),
        F.col("_bucket").alias("_of_bucket"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"),
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_bucket") == F.col("_of_bucket")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        local.join(base, same)
        .withColumn(into, (F.col("_base") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_base", "_of_bucket", *(f"_of_{g}" for g in group))
    )


#: Bits of a bit map.
MAP_BITS = 26


def bit_map(keys: DataFrame) -> np.ndarray:
    """A bit map of MAP_BITS bits of the longs `key`: at most 2 ** (MAP_BITS - 6) rows
    come to the driver, whatever the number of keys."""
    bit = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long"))
    one = F.expr(f"shiftleft(1L, cast(key & 63 as int))")
    rows = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
