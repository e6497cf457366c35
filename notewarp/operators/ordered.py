"""Runs and running sums over ordered rows of a key, without one task per key.

A key may hold a third of all rows, so its rows are windowed in buckets of the order column, and only one summary row per bucket is
windowed per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_total(df: DataFrame, key: str, bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `amount` over the key's rows up to and including each row. Buckets ascend with the order."""
    inside = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = df.groupBy(key, bucket).agg(F.sum(amount).alias("__sum"))
    before = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return df.withColumn("__inside", F.sum(amount).over(inside)).join(sums, [key, bucket]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def with_previous(df: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """`df` with `name`: `value` of the key's row before, null at the first."""
    inside = W.partitionBy(key, bucket).orderBy(*order)
    ends = df.groupBy(key, bucket).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__end"))
    ends = ends.select(key, bucket, F.lag("__end").over(W.partitionBy(key).orderBy(bucket)).alias("__end"))
    own = F.lag(F.struct(value)).over(inside)
    return df.withColumn("__own", own).join(ends, [key, bucket]).withColumn(name, F.coalesce("__own", "__end")[value]).drop("__own", "__end")


def numbered_runs(df: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str = "run") -> DataFrame:
    """`df` with `name`: 1 for the key's first longest run of one `value`, 2 for the next and so on. `value` must not be null."""
    marked = with_previous(df, key, bucket, order, value, "__previous")
    starts = F.when(F.col("__previous").eqNullSafe(F.col(value)), 0).otherwise(1)
    return running_total(marked, key, bucket, order, starts, name).drop("__previous")
