"""Ranks and running sums of groups of any size.

A window over one group is one task.  Here each group is cut into buckets that follow its order, the buckets' totals (a
small table) give each bucket its offset, and only a bucket is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_SPAN = 2**63
BUCKETS = 4096
LETTERS = 3


def hash_bucket(order: Column, buckets: int) -> Column:
    """Bucket of a 64-bit order value; buckets follow the order of the values."""
    width = 2**64 // buckets
    return F.least(F.lit(buckets - 1), F.floor((order.cast("decimal(20,0)") + F.lit(str(LONG_SPAN)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("int"))


def _prefixed(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_bucket``: of a string order the ``LETTERS`` characters after what all its values begin with.

    The least and the greatest value share a prefix that all others have too; one row tells its length.
    """
    low, high = F.min(order).alias("_low"), F.max(order).alias("_high")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_low"), F.length("_high"))))
    differs = F.filter(places, lambda k: F.substring("_low", k, F.lit(1)) != F.substring("_high", k, F.lit(1)))
    first = F.coalesce(F.get(differs, F.lit(0)), F.least(F.length("_low"), F.length("_high")) + 1, F.lit(1)).alias("_from")
    one = df.agg(low, high).select(first)
    return df.crossJoin(F.broadcast(one)).withColumn("_bucket", F.substring(F.col(order), F.col("_from"), F.lit(LETTERS))).drop("_from")


def running(df: DataFrame, keys: list[str], order: str, tie: list[str], value: Column, out: str, buckets: int = BUCKETS, total: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``keys`` that come before a row.

    Order: the column ``order``, then ``tie``.  A bigint order is taken for a hash, spread over all 64 bits; of a string
    the first characters that tell rows apart make the buckets.  For another kind of order give ``bucket``, an
    expression that never falls as ``order`` grows.  ``total`` names a column for the group's whole sum.  Null values
    count 0; null keys form a group, null orders come first; an empty frame stays empty.
    """
    if bucket is None and isinstance(df.schema[order].dataType, T.StringType):
        parts = _prefixed(df, order)
    else:
        parts = df.withColumn("_bucket", hash_bucket(F.col(order), buckets) if bucket is None else bucket)
    parts = parts.withColumn("_value", F.coalesce(value, F.lit(0)).cast("bigint"))
    sums = parts.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
    )
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    done = summed.join(offsets, on).withColumn(out, F.col("_offset") + F.col("_within"))
    if total:
        done = done.withColumn(total, F.col("_total"))
    return done.drop("_bucket", "_value", "_b", "_offset", "_within", "_total", *[f"_k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: str, tie: list[str], out: str, buckets: int = BUCKETS, bucket: Column | None = None) -> DataFrame:
    """0-based rank of each row among the rows of the same ``keys``; see ``running``."""
    return running(df, keys, order, tie, F.lit(1), out, buckets, bucket=bucket)
