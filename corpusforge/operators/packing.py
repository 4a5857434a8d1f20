"""Sequences: clipping, packing in order, padding, length buckets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.plans.ranks import ranked

IGNORED = -100


def clipped(ids: Column, most: int, begin: int, end: int) -> Column:
    """Begin mark, at most ``most - 2`` of the ids, end mark."""
    return F.concat(F.array(F.lit(begin)), F.slice(ids, 1, most - 2), F.array(F.lit(end)))


def padded(ids: Column, length: Column, fill: int) -> Column:
    """The ids filled up to ``length``."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(ids))))


def padded_rows(df: DataFrame, ids: str, length: int, pad: int) -> DataFrame:
    """``df`` with ``input_ids``, ``labels`` (pads ignored) and ``attention_mask`` of one fixed length."""
    n = F.lit(length)
    return df.withColumns({"input_ids": padded(F.col(ids), n, pad), "labels": padded(F.col(ids), n, IGNORED), "attention_mask": padded(F.transform(ids, lambda x: F.lit(1)), n, 0)})


def next_fit(df: DataFrame, by: list[str], order: str, size: str, capacity: int, out: str = "bin") -> DataFrame:
    """The group's columns, order and size with each row's bin: rows in order go into the open bin, or open the next where they don't fit.

    The bins of a group depend on all rows before, so a group is folded in one task, on its order and sizes only; give
    ``by`` as many groups as there should be tasks.  A row larger than the capacity gets a bin of its own.  Null sizes
    count 0.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        at, used, bins = 0, 0, []
        for n in rows[size].fillna(0).astype("int64").tolist():
            if used and used + n > capacity:
                at, used = at + 1, 0
            used += n
            bins.append(at)
        rows[out] = bins
        return rows

    thin = df.select(*by, order, size)
    return thin.groupBy(*by).applyInPandas(fold, T.StructType([*thin.schema.fields, T.StructField(out, T.LongType())]))


def packed_bins(rows: DataFrame, by: list[str], bin: str, order: str, ids: str, length: int, pad: int) -> DataFrame:
    """One padded row per bin, its rows' ids in order."""
    joined = rows.groupBy(*by, bin).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(ids).alias("_ids")))), lambda x: x["_ids"])).alias("ids"))
    return padded_rows(joined, "ids", length, pad).drop("ids")


def padding(df: DataFrame, by: list[str], bin: str, size: str, capacity: int) -> DataFrame:
    """Bins, tokens, padding and its share per group, and tokens that bear loss (all but each bin's first)."""
    bins = df.groupBy(*by, bin).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_used"))
    return bins.groupBy(*by).agg(
        F.count("*").alias("bins"),
        F.sum("_used").alias("tokens"),
        F.sum(F.greatest(F.lit(0), capacity - F.col("_used"))).alias("padding"),
        F.sum(F.greatest(F.lit(0), F.col("_used") - 1)).alias("loss_tokens"),
    ).withColumn("padding_fraction", F.col("padding") / (F.col("tokens") + F.col("padding")))


def length_buckets(df: DataFrame, position: str, length: str, batch: int, batches_per_bucket: int = 32) -> DataFrame:
    """``df`` with ``bucket`` (runs of positions), ``place`` (overall, by length inside a bucket) and ``batch``."""
    bucket = F.floor(F.col(position) / (batch * batches_per_bucket))
    inside = Window.partitionBy("bucket").orderBy(length, position)
    placed = df.withColumn("bucket", bucket).withColumn("place", F.col("bucket") * batch * batches_per_bucket + F.row_number().over(inside) - 1)
    return placed.withColumn("batch", F.floor(F.col("place") / batch))


def batch_padding(df: DataFrame, batch: str, length: str) -> DataFrame:
    """Rows, greatest length and padding of each batch that is padded to its longest row."""
    return df.groupBy(batch).agg(F.count("*").alias("rows"), F.max(length).alias("width"), (F.max(length) * F.count("*") - F.sum(length)).alias("padding"))


def collated(df: DataFrame, batch: str, order: str, ids: str, labels: str, pad: int) -> DataFrame:
    """One row per batch, its rows in order padded to the longest: ``batch, input_ids, labels, attention_mask`` (arrays of arrays).

    A batch is as large as its maker made it (``micro_batches``, ``length_buckets``); pads are ignored by labels and mask.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(ids).alias("_i"), F.col(labels).alias("_l"))))
    held = df.groupBy(batch).agg(rows.alias("_rows")).withColumn("_width", F.array_max(F.transform("_rows", lambda r: F.size(r["_i"]))))
    fill = lambda of, value: F.transform("_rows", lambda r: padded(of(r), F.col("_width"), value))
    ones = lambda r: F.transform(r["_i"], lambda _: F.lit(1))
    return held.select(batch, fill(lambda r: r["_i"], pad).alias("input_ids"), fill(lambda r: r["_l"], IGNORED).alias("labels"), fill(ones, 0).alias("attention_mask"))


def masked_rows(supervised: DataFrame, replay: DataFrame, id: str, ids: str, labels: str) -> DataFrame:
    """Unpadded training rows: supervised ones with their labels, replayed ones with their ids as labels; ``replayed`` tells which."""
    parts = ((supervised, labels, False), (replay, ids, True))
    rows = [df.select(F.col(id).alias(id), F.col(ids).alias("input_ids"), F.col(of).alias("labels"), F.lit(again).alias("replayed")) for df, of, again in parts]
    return rows[0].unionByName(rows[1])


def micro_batches(df: DataFrame, id: str, size: int) -> DataFrame:
    """``df`` with ``batch`` and ``slot``: consecutive rows in the order of ``id``; the last batch may be short."""
    placed = ranked(df, [], id, [], "_at")
    return placed.withColumn("batch", F.floor(F.col("_at") / size)).withColumn("slot", F.col("_at") % size).drop("_at")


def loss_tokens(labels: Column) -> Column:
    """Labels after the first that aren't ignored."""
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED))


def learning_rates(spark: SparkSession, steps: int, warmup: int, peak: float, least: float) -> DataFrame:
    """``step, rate``: linear warm-up to the peak, then a cosine down to the least rate."""
    s = F.col("step")
    share = F.least(F.lit(1.0), (s - warmup) / max(1, steps - warmup))
    return spark.range(steps).select(F.col("id").alias("step")).withColumn("rate", F.when(s < warmup, peak * (s + 1) / max(1, warmup)).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(F.lit(3.141592653589793) * share))))
