"""JSON-lines shards of records: strict reads, exact shards out, and their manifest."""

from __future__ import annotations

import json
import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.operators.manifests import files, identity, verify_files
from corpusforge.plans.ranks import ranked
from corpusforge.plans.stage import staged
from corpusforge.schema import CASE_SCHEMA, EXAMPLE_SCHEMA, case_rules, violations
from corpusforge.sources.files import exists, read_json, remove, rename, write_json


def read_shards(spark: SparkSession, path: str, schema: T.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """Records of all shards below a path; a broken line fails the read, a missing or empty folder too."""
    found = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    if not found.inputFiles():
        raise FileNotFoundError(f"no shards in {path}")
    return found


def read_manifested(spark: SparkSession, path: str, manifest: DataFrame, split: str, schema: T.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """Records of one split's shards, after all files agree with the manifest; a row of another split fails."""
    wrong = [r.asDict() for r in verify_files(manifest, files(spark, path, "*.jsonl")).filter("outcome != 'ok'").limit(20).collect()]
    if wrong:
        raise ValueError(f"shards disagree with the manifest: {wrong}")
    names = [r["file"] for r in manifest.filter(F.col("split") == split).orderBy("shard_index").select("file").collect()]
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path}/{n}" for n in names])
    return rows.withColumn("split", F.when(F.col("split") == split, F.col("split")).otherwise(F.raise_error(F.lit("a row of another split"))))


@F.pandas_udf(T.StringType())
def _sorted_line(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False))


def write_shards(df: DataFrame, path: str, name: str, split: str, id: str, rows_per_shard: int = 50_000) -> DataFrame:
    """Write exactly ``rows_per_shard`` rows a file (the last one fewer), sorted by id, for each split; the manifest is returned.

    Row places come from bucketed ranks; each file is one task of Spark's own writer, so a lost task leaves nothing
    behind, and gets its name at the end.  Manifest: ``split, shard_index, file, rows, bytes, sha256``.  Rows with a null
    split go to the split ``none``.
    """
    spark = df.sparkSession
    columns = df.columns
    placed = ranked(df.withColumn("_split", F.coalesce(F.col(split), F.lit("none"))), ["_split"], id, [], "_at")
    line = _sorted_line(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("value")
    lined = placed.select("_split", F.floor(F.col("_at") / rows_per_shard).cast("int").alias("_shard"), "_at", line)
    ordered = lined.repartition("_split", "_shard").sortWithinPartitions("_split", "_shard", "_at").select("_split", "_shard", "value")
    draft = f"{path}/_{name}.draft"
    ordered.write.mode("overwrite").partitionBy("_split", "_shard").text(draft)
    written = spark.read.format("text").load(draft)
    told = written.groupBy(F.col("_split").cast("string").alias("split"), F.col("_shard").cast("int").alias("shard_index")).agg(F.count("*").alias("rows"), F.min(F.col("_metadata.file_path")).alias("_path"), F.countDistinct("_metadata.file_path").alias("_files"))
    shards = [r.asDict() for r in told.collect()] if df.take(1) else []  # one row a shard file
    for r in shards:
        if r["_files"] != 1:
            raise OSError(f"shard {r['shard_index']} of {r['split']} has {r['_files']} files")
        r["file"] = f"{name}.{r['split']}.{r['shard_index']:05d}.jsonl"
        rename(spark, r["_path"], f"{path}/{r['file']}")
    remove(spark, draft)
    made = spark.createDataFrame([(r["split"], r["shard_index"], r["file"], r["rows"]) for r in shards], "split string, shard_index int, file string, rows bigint")
    return made.join(files(spark, path, f"{name}.*.jsonl"), "file").select("split", "shard_index", "file", "rows", "bytes", "sha256") if shards else made.selectExpr("*", "0L AS bytes", "'' AS sha256")


def write_manifest(manifest: DataFrame, path: str) -> str:
    """Write the manifest's JSON beside the shards and return the identity of the data set."""
    rows = [r.asDict() for r in manifest.orderBy("split", "shard_index").collect()]  # one row a shard file
    told = identity(manifest)
    write_json(manifest.sparkSession, path, {"identity": told, "shards": rows})
    return told


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A manifest's rows and the identity recorded in it."""
    told = read_json(spark, path)
    rows = [(r["split"], r["shard_index"], r["file"], r["rows"], r["bytes"], r["sha256"]) for r in told["shards"]]
    return spark.createDataFrame(rows, "split string, shard_index int, file string, rows bigint, bytes bigint, sha256 string"), told["identity"]


def verify_parent(spark: SparkSession, folder: str, manifest_path: str) -> tuple[DataFrame, str]:
    """The manifest and identity of a data set, refused unless every split's files and the identity agree with what is there."""
    manifest, told = read_manifest(spark, manifest_path)
    wrong = [r.asDict() for r in verify_files(manifest, files(spark, folder, "*.jsonl")).filter("outcome != 'ok'").limit(20).collect()]
    if wrong or identity(manifest) != told:
        raise ValueError(f"shards disagree with the manifest: {wrong or 'identity'}")
    return manifest, told


def checked_suite(cases: DataFrame) -> DataFrame:
    """The cases of a suite, refused if one breaks a rule or an id comes twice."""
    cases = staged(cases)
    broken = violations(cases, case_rules()).filter("size(violations) > 0").select("id", "violations").limit(20).collect()
    twice = cases.groupBy("id").count().filter("count > 1").select("id").limit(20).collect()
    if broken or twice:
        raise ValueError(f"broken cases {[tuple(r) for r in broken]}, repeated ids {[r['id'] for r in twice]}")
    return cases


def union_of_suites(spark: SparkSession, paths: dict[str, str], schema: T.StructType = CASE_SCHEMA) -> tuple[DataFrame, list[str]]:
    """The cases of all suites that are there, with ``suite``, and the names of those that are missing; none at all is an error."""
    there = {name: path for name, path in paths.items() if exists(spark, path)}
    missing = sorted(set(paths) - set(there))
    for name in missing:
        warnings.warn(f"suite {name} is missing: {paths[name]}", stacklevel=2)
    if not there:
        raise FileNotFoundError(f"no suite of {sorted(paths)}")
    parts = [read_suite(spark, path, schema).withColumn("suite", F.lit(name)) for name, path in there.items()]
    return reduce(DataFrame.unionByName, parts), missing


def write_suite(cases: DataFrame, path: str, most: int = 100_000) -> int:
    """Write an evaluation suite, a JSON object with a list ``cases`` in the order of ids; suites of more than ``most`` cases are refused."""
    rows = cases.orderBy("id").select(F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"}).alias("case")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cases")
    write_json(cases.sparkSession, path, {"cases": [json.loads(r["case"]) for r in rows]})
    return len(rows)


def read_suite(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cases of an evaluation suite: a JSON object with a list ``cases``."""
    return spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(schema))])).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("cases"))


def write_lines(df: DataFrame, text: str, path: str) -> None:
    """One text per line: line breaks become spaces, blank texts are dropped."""
    line = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    df.select(line.alias("value")).filter(F.length("value") > 0).write.text(path)

