"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.plans.digests import ordered_digest

DOCUMENT_VALUES = 1_000_000


def totals(df: DataFrame, text: str, tokens: str, context: int = 1024) -> DataFrame:
    """One row: examples, tokens, bytes, mean, median and greatest length, share beyond the context.  Null tokens count 0; zeros for no rows."""
    n = F.coalesce(F.col(tokens), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.count("*").alias("examples"),
        F.coalesce(F.sum(n), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("bytes"),
        zero(F.avg(n)).alias("mean_tokens"),
        zero(F.median(n)).alias("median_tokens"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_tokens"),
        zero(F.avg((n > context).cast("double"))).alias("beyond_context"),
    )


def floor_percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """The value at 0-based place ``min(n - 1, floor(n p))`` of the sorted values, for each share: ``p, value``.

    Works on the histogram of values, so only distinct values are sorted.  Nulls count 0.
    """
    counts = df.groupBy(*by, F.coalesce(F.col(value), F.lit(0)).alias("value")).agg(F.count("*").alias("_n"))
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = counts.withColumn("_end", F.sum("_n").over(window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(window))
    wanted = placed.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares])))
    at = F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.col("p")))
    return wanted.filter((at < F.col("_end")) & (at >= F.col("_end") - F.col("_n"))).select(*by, "p", "value")


def distributions(df: DataFrame, dimensions: dict[str, Column], tokens: str) -> DataFrame:
    """Counts and tokens per value of each dimension in one pass: ``dimension, value, examples, tokens``; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in dimensions.items()])
    long = df.select(F.coalesce(F.col(tokens), F.lit(0)).alias("_n"), F.explode(pairs).alias("x")).select("_n", "x.*").filter("value is not null")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("examples"), F.sum("_n").alias("tokens"))


def top_values(df: DataFrame, value: Column, first: str, limit: int) -> DataFrame:
    """The most frequent values, ties by the least ``first``: ``value, n``.  A top-k keeps ``limit`` rows per task."""
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", "value").limit(limit).select("value", "n")


def weighted_means(df: DataFrame, value: str, weight: str, by: str) -> DataFrame:
    """Mean of ``value`` weighted by ``weight``, per ``by`` and overall (null there): ``by, mean, weight``; null mean without weight."""
    w, v = F.col(weight), F.col(value)
    return df.rollup(by).agg(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("mean"), F.sum(w).alias("weight"))


def set_digest(df: DataFrame, id: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """SHA-256 of the sorted ids, one per line, per group: ``digest, n``; the identity of a set of records.

    Streamed in order (``plans.digests``); null ids are left out.
    """
    return ordered_digest(df, by, F.col(id), F.col(id))


def document(df: DataFrame, context: int, counters: dict[str, int], shape: Column, top: int = 20) -> dict:
    """The statistics of a corpus as one document of 20 keys; every number is aggregated by Spark.

    ``df``: records with ``example_id, prompt, split, category, difficulty, tool_required, synthetic, generator_id, family_id,
    tool_name, expected_behavior, token_count``.  Null values of a dimension are left out, as are empty tool names;
    an empty corpus has zeros and empty maps.  At most ``DOCUMENT_VALUES`` values in all dimensions.
    """
    rows = df.withColumn("_tokens", F.coalesce("token_count", F.lit(0)))
    dimensions = {
        "split_composition": F.col("split"),
        "category_distribution": F.col("category"),
        "difficulty_distribution": F.col("difficulty"),
        "tool_required_distribution": F.when(F.coalesce("tool_required", F.lit(False)), "tool_required").otherwise("no_tool"),
        "synthetic_vs_external": F.when(F.coalesce("synthetic", F.lit(False)), "synthetic").otherwise("external"),
        "generator_family_distribution": F.concat_ws("/", F.coalesce("generator_id", F.lit("")), F.coalesce("family_id", F.lit(""))),
        "tool_name_distribution": F.when(F.col("tool_name") != "", F.col("tool_name")),
        "expected_behavior_distribution": F.col("expected_behavior"),
    }
    found = distributions(rows, dimensions, "_tokens").orderBy("dimension", "value").limit(DOCUMENT_VALUES + 1).collect()
    if len(found) > DOCUMENT_VALUES:
        raise ValueError(f"more than {DOCUMENT_VALUES} values of dimensions")
    counts: dict[str, dict[str, int]] = {d: {} for d in dimensions}
    tokens: dict[str, dict[str, int]] = {d: {} for d in dimensions}
    for r in found:
        counts[r["dimension"]][r["value"]], tokens[r["dimension"]][r["value"]] = r["examples"], r["tokens"]
    whole = totals(rows, "prompt", "_tokens", context).first()
    percentiles = {f"p{round(100 * r['p'])}": r["value"] for r in floor_percentiles(rows, "_tokens", [0.5, 0.9, 0.99]).collect()}
    shaped = rows.select("example_id", shape.alias("_shape")).filter("_shape is not null")
    templates = shaped.agg(F.countDistinct("_shape").alias("n")).first()["n"]
    common = {r["value"]: r["n"] for r in top_values(shaped, F.col("_shape"), "example_id", top).collect()}
    split, families = counts.pop("split_composition"), "generator_family_distribution"
    return counts | {
        "total_examples": whole["examples"],
        "total_tokens": whole["tokens"],
        "total_bytes": whole["bytes"],
        "split_composition": {s: {"examples": n, "tokens": tokens["split_composition"][s]} for s, n in split.items()},
        "tokens_by_generator_family": tokens[families],
        "structural_template_count": templates,
        "top_structural_template_counts": common,
        "average_tokens_per_example": whole["mean_tokens"],
        "median_tokens_per_example": whole["median_tokens"],
        "token_length_percentiles": percentiles or {"p50": 0, "p90": 0, "p99": 0},
        "max_example_tokens": whole["max_tokens"],
        "fraction_exceeding_context": whole["beyond_context"],
        "build_counters": counters,
    }


def log_drift(left: DataFrame, right: DataFrame, step: str, value: str, most: float | None = None) -> DataFrame:
    """Two logs aligned by step, the greatest value of a step counting: steps in both, in one only, and the greatest difference.

    With ``most`` also ``resumed``: whether they have steps in common and never differ by more.
    """
    last = lambda df, name: df.groupBy(F.col(step).alias(f"_s{name}")).agg(F.max(value).alias(f"_v{name}"))
    met = last(left, "a").join(last(right, "b"), F.col("_sa") == F.col("_sb"), "full_outer")
    both = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    counted = met.agg(F.count_if(both).alias("common_steps"), F.count_if(~both).alias("single_steps"), F.max(F.abs(F.col("_va") - F.col("_vb"))).alias("greatest_difference"))
    if most is None:
        return counted
    return counted.withColumn("resumed", (F.col("common_steps") > 0) & (F.col("greatest_difference") <= most))
