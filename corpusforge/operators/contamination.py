"""Checks of a corpus against its evaluation sets and its own splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import shape, shingles
from corpusforge.plans.stage import staged


def split_violations(df: DataFrame, key: Column, split: str, order: list[str]) -> DataFrame:
    """Rows whose split isn't that of the first row of their key: ``df`` with ``key`` and ``first_split``.

    The first split comes from an aggregate that is joined back, so a key may hold any share of the rows (the join's
    skewed partitions are split at run time).  Null splits are values of their own; null keys are left out.
    """
    keyed = df.withColumn("key", key).filter("key is not null")
    firsts = keyed.groupBy(F.col("key").alias("_key")).agg(F.min_by(F.struct(F.col(split).alias("s")), F.struct(*order)).alias("_first"), F.countDistinct(F.coalesce(F.col(split), F.lit("\0"))).alias("_n")).filter("_n > 1")
    met = keyed.join(firsts, F.col("key") == F.col("_key"))
    return met.withColumn("first_split", F.col("_first.s")).filter(~F.col(split).eqNullSafe(F.col("first_split"))).drop("_key", "_first", "_n")


def near_pairs(eval_rows: DataFrame, eval_id: str, eval_text: str, train: DataFrame, train_id: str, train_text: str, size: int, threshold: float) -> DataFrame:
    """Evaluation and training rows whose word shingles have a Jaccard index of ``threshold`` or more.

    Columns ``eval_id, train_id, jaccard``.  A pair needs a share of ``threshold`` of the evaluation row's shingles in
    the training row, so one of its ``n - ceil(threshold n) + 1`` rarest shingles at least: only these, the rarest by
    the training rows that hold them, look for candidates, and boilerplate that many rows share looks for none.
    Training shingles that no evaluation row has are dropped before any pairing.  Candidates are settled by their sets.
    Null texts match nothing; a threshold of 0 or less is refused.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0, please")

    def sets(df: DataFrame, id: str, text: str, tag: str) -> DataFrame:
        hashes = F.transform(shingles(F.col(text), size), lambda x: F.xxhash64(x))
        return df.filter(F.col(text).isNotNull()).select(F.col(id).alias(f"{tag}_id"), hashes.alias(f"{tag}_set")).distinct()

    left, right = staged(sets(eval_rows, eval_id, eval_text, "eval")), staged(sets(train, train_id, train_text, "train"))
    own = left.select("eval_id", F.size("eval_set").alias("n"), "eval_set", F.explode("eval_set").alias("s"))
    asked = own.select(F.col("s").alias("_s")).distinct()
    hits = staged(right.select("train_id", F.explode("train_set").alias("s")).join(asked, F.col("s") == F.col("_s"), "left_semi"))
    counts = hits.groupBy(F.col("s").alias("_s")).agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("eval_id", "eval_set").orderBy("often", "s")
    prefix = own.join(counts, F.col("s") == F.col("_s"), "left").withColumn("_at", F.row_number().over(rarest))
    prefix = prefix.filter((F.col("_at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("often").isNotNull())
    pairs = prefix.select("eval_id", "s").join(hits, "s").select("eval_id", "train_id").distinct()
    met = pairs.join(left, "eval_id").join(right, "train_id").withColumn("_both", F.size(F.array_intersect("eval_set", "train_set")))
    scored = met.withColumn("jaccard", F.col("_both") / (F.size("eval_set") + F.size("train_set") - F.col("_both")))
    return scored.filter(F.col("jaccard") >= threshold).select("eval_id", "train_id", "jaccard")


def shape_pairs(eval_rows: DataFrame, eval_id: str, eval_text: str, train: DataFrame, train_text: str, order: str) -> DataFrame:
    """Evaluation rows whose shape a training text has, with the first such text: ``eval_id, train_text``; null texts have none.

    Training texts are first met with the evaluation shapes (a small side goes out whole), so only hits are shuffled.
    """
    own = eval_rows.select(F.col(eval_id).alias("eval_id"), shape(F.col(eval_text)).alias("_own")).filter("_own is not null")
    shaped = train.select(F.col(train_text).alias("_text"), F.col(order).alias("_order"), shape(F.col(train_text)).alias("_shape"))
    met = shaped.join(own.select(F.col("_own").alias("_any")).distinct(), F.col("_shape") == F.col("_any"), "left_semi")
    firsts = met.groupBy("_shape").agg(F.min_by("_text", "_order").alias("train_text"))
    return own.join(firsts, F.col("_own") == F.col("_shape")).select("eval_id", "train_text")


def shared_values(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values that both frames have in a column: ``field, value``."""
    stack = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").dropna().distinct()
    return stack(left).intersect(stack(right))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: its number of violations and whether it is clean."""
    rows = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("clean"))
        rows = row if rows is None else rows.unionByName(row)
    return rows
