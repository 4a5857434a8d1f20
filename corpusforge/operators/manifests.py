"""Manifests against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.ids import package_name


def cross_check(declared: DataFrame, name: str, scope: str, licensed: DataFrame, licensed_name: str, licensed_scope: str) -> DataFrame:
    """Declared packages against licensed ones by normal name: ``package, outcome`` of ``ok, missing, wrong_scope, stale``."""
    left = declared.select(package_name(F.col(name)).alias("_d"), F.col(scope).alias("_ds")).distinct()
    right = licensed.select(package_name(F.col(licensed_name)).alias("_l"), F.col(licensed_scope).alias("_ls")).distinct()
    met = left.join(right, F.col("_d") == F.col("_l"), "full_outer")
    outcome = F.when(F.col("_l").isNull(), "missing").when(F.col("_d").isNull(), "stale").when(~F.col("_ds").eqNullSafe(F.col("_ls")), "wrong_scope").otherwise("ok")
    return met.select(F.coalesce("_d", "_l").alias("package"), outcome.alias("outcome"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file, bytes, sha256`` of the files below a path, hashed where they are read; an empty or missing folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    hashed = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if hashed.isEmpty():
        raise FileNotFoundError(f"no files in {path}")
    return hashed


def verify_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows (``file, bytes, sha256``) against files: ``file, outcome`` of ``ok, missing, unmanifested, size, hash, repeated``."""
    rows = manifest.groupBy("file").agg(F.count("*").alias("_n"), F.min("bytes").alias("_bytes"), F.min("sha256").alias("_sha"))
    there = found.select(F.col("file").alias("_file"), F.col("bytes").alias("_have"), F.col("sha256").alias("_is"))
    met = rows.join(there, F.col("file") == F.col("_file"), "full_outer")
    outcome = F.when(F.col("file").isNull(), "unmanifested").when(F.col("_n") > 1, "repeated").when(F.col("_file").isNull(), "missing").when(F.col("_bytes") != F.col("_have"), "size").when(F.col("_sha") != F.col("_is"), "hash").otherwise("ok")
    return met.select(F.coalesce("file", "_file").alias("file"), outcome.alias("outcome"))


def identity(manifest: DataFrame) -> str:
    """SHA-256 of the files' hashes in the order of split and index, one per line."""
    import hashlib

    rows = manifest.orderBy("split", "shard_index").select("sha256").collect()  # one row a shard file
    return hashlib.sha256("\n".join(r["sha256"] for r in rows).encode()).hexdigest()


def declared_dependencies(toml: str) -> dict[str, list[str]]:
    """Names a project's TOML text declares, in their normal form: ``runtime`` and ``dev`` (all optional groups), sorted."""
    import re
    import tomllib

    project = tomllib.loads(toml).get("project", {})
    name = lambda x: re.sub("[-_.]+", "-", re.match(r"[A-Za-z0-9._-]+", x.strip()).group()).lower()
    groups = project.get("optional-dependencies", {})
    return {"runtime": sorted({name(x) for x in project.get("dependencies", [])}), "dev": sorted({name(x) for of in groups.values() for x in of})}


def artifact_outcomes(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded artifacts (``file, sha256``) against files: ``file, outcome`` of ``ok, missing, hash``; files nobody recorded don't count."""
    there = found.groupBy(F.col("file").alias("_f")).agg(F.min("sha256").alias("_is"))
    met = manifest.join(there, F.col("file") == F.col("_f"), "left")
    return met.select("file", F.when(F.col("_f").isNull(), "missing").when(F.lower("sha256") != F.col("_is"), "hash").otherwise("ok").alias("outcome"))
