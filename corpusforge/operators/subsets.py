"""Selected subsets, their manifests and their identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.calculator import canonical
from corpusforge.plans.digests import ordered_digest
from corpusforge.sources.files import read_json


def subset_manifest(df: DataFrame, id: str, split: str, tokens: str, counted: list[str], distinct: list[str] = [], flag: str | None = None) -> DataFrame:  # noqa: B006
    """One row per split: records, tokens, the ids' digest, a map of counts for each column of ``counted``, numbers of distinct values, and how many have ``flag``.

    The digest is of the sorted ids, one per line, streamed in order; everything else is aggregated before the shuffle.
    """
    digests = ordered_digest(df, [split], F.col(id), F.col(id)).select(F.col(split).alias("_d"), F.col("digest").alias("ids_sha256"))
    base = df.groupBy(split).agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct],
        *([F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias(f"with_{flag}")] if flag else []),
    )
    base = base.join(digests, base[split].eqNullSafe(F.col("_d")), "left").drop("_d")
    for c in counted:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(split).alias("_s"), c).count().groupBy("_s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c), F.col("count"))))).alias(f"{c}_counts"))
        base = base.join(counts, base[split].eqNullSafe(F.col("_s")), "left").drop("_s")
    return base


@F.pandas_udf(T.StringType())
def _represented(ids: pd.Series, inputs: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([canonical({"example_id": i, "input_ids": [int(x) for x in a], "labels": [int(x) for x in b]}) for i, a, b in zip(ids, inputs, labels)])


def representation_digest(df: DataFrame, id: str, input_ids: str, labels: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """SHA-256 of the canonical JSON list of ``example_id, input_ids, labels`` in the order of ids: ``by, representation_sha256, n``.

    The records' JSON is made where they are; the hash of a group streams over them.  Replay records have their ids as
    labels.  No records give the hash of an empty list (without ``by``).
    """
    item = _represented(F.col(id), F.col(input_ids), F.col(labels))
    return ordered_digest(df, by, F.col(id), item, "[", ",", "]").withColumnRenamed("digest", "representation_sha256")


def union_identity(manifest: DataFrame, split: str, digests: list[str]) -> DataFrame:
    """One hash for a few splits: of their sorted ``split:digest:digest`` lines; a missing digest is ``none``."""
    line = F.concat_ws(":", F.col(split), *[F.coalesce(F.col(d), F.lit("none")) for d in digests])
    return manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("identity"))


def union_of_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of frames of equal columns with ``source``, the part's name; missing columns are null."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def manifest_count(manifest: DataFrame, split: str) -> int:
    """Rows of a split by its manifest alone; an error if there are none."""
    n = manifest.filter(F.col("split") == split).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not n:
        raise ValueError(f"no rows of {split} in the manifest")
    return n


def shares_add_up(shares: dict[str, float], within: float = 1e-6) -> dict[str, float]:
    """The shares of a configuration, refused unless they are non-negative and add up to 1."""
    if any(s < 0 for s in shares.values()) or abs(sum(shares.values()) - 1) > within:
        raise ValueError(f"shares don't add up to 1: {shares}")
    return shares


def load_config(spark: SparkSession, path: str, required: list[str], shares: list[str]) -> dict:
    """A JSON configuration, refused if a key is missing or a group of shares doesn't add up to 1."""
    config = read_json(spark, path)
    missing = [k for k in [*required, *shares] if config.get(k) is None]
    if missing:
        raise ValueError(f"missing in {path}: {missing}")
    for k in shares:
        shares_add_up(config[k])
    return config


def table_rules(
    df: DataFrame,
    required: list[str],
    unique: str,
    allowed: dict[str, list[str]] = {},  # noqa: B006
    booleans: list[str] = [],  # noqa: B006
    needed: dict[str, tuple[str, str]] = {},  # noqa: B006
) -> DataFrame:
    """Rows of a small manifest that break its rules: ``row, rule`` of ``missing_x, unknown_x, type_x, repeated``.

    ``booleans`` must be true or false; ``needed`` gives for a column the other column and value that make it required.
    """
    n = df.groupBy(F.col(unique).alias("_u")).count()
    met = df.join(n, F.col(unique) == F.col("_u"), "left")
    blank = lambda c: ~F.coalesce(F.col(c).cast("string").rlike(r"\S"), F.lit(False))
    rules = [
        *[F.when(blank(c), F.lit(f"missing_{c}")) for c in required],
        *[F.when(~blank(c) & ~F.col(c).isin(v), F.lit(f"unknown_{c}")) for c, v in allowed.items()],
        *[F.when(~F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "false"), F.lit(False)), F.lit(f"type_{c}")) for c in booleans],
        *[F.when((F.col(other) == value) & blank(c), F.lit(f"missing_{c}")) for c, (other, value) in needed.items()],
        F.when(F.col("count") > 1, F.lit("repeated")),
    ]
    return met.select(F.col(unique).alias("row"), F.explode(F.array_compact(F.array(*rules))).alias("rule")).distinct()
