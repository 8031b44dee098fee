"""Running totals along long sequences, without a task for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes, by the optimizer's estimate, of tables that need no buckets.
SMALL = 64 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer knows that a table, or what it is made of, is small."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def before(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """df with a column for each sum and maximum of the rows of its group that come before
    the row by `order`, that row excluded: 0 and null where there are none.

    `bucket` must not decrease along `order`. Rows meet only within a bucket of their group;
    the totals of whole buckets, a row for each, are added up in a window of their own and
    joined. So the largest task is that of a bucket, or of a group's buckets, and never that
    of a group's rows; a small table takes one window. A null in a group column is a group.
    """
    sums, maxima = sums or {}, maxima or {}
    inputs = {f"_in_{name}": value for name, value in (sums | maxima).items()}

    def over(window) -> dict[str, Column]:
        out = {name: F.coalesce(F.sum(f"_in_{name}").over(window), F.lit(0)) for name in sums}
        return out | {name: F.max(f"_in_{name}").over(window) for name in maxima}

    if is_small(df):
        whole = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(inputs).withColumns(over(whole)).drop(*inputs)
    rows = df.withColumn("_bucket", bucket).withColumns(inputs)
    totals = rows.groupBy(*group, "_bucket").agg(
        *(F.sum(f"_in_{name}").alias(f"_in_{name}") for name in sums), *(F.max(f"_in_{name}").alias(f"_in_{name}") for name in maxima)
    )
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    base = totals.select(
        *(F.col(g).alias(f"_of_{g}") for g in group), F.col("_bucket").alias("_of_bucket"), *(c.alias(f"_base_{name}") for name, c in over(ahead).items())
    )
    same = F.col("_bucket").eqNullSafe(F.col("_of_bucket"))
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    met = rows.withColumns({f"_own_{name}": c for name, c in over(within).items()}).join(base, same)
    found = {name: F.col(f"_base_{name}") + F.col(f"_own_{name}") for name in sums}
    found |= {name: F.greatest(f"_base_{name}", f"_own_{name}") for name in maxima}
    return met.select(*df.columns, *(c.alias(name) for name, c in found.items()))
