"""Intermediate tables in the folder that all executors share.

``staged`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back, so lineage is cut and
nothing is lost with an executor.  Loops free the tables of earlier rounds; the others go when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master, else an error."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
    return _own[context.applicationId]


def _filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df``, computed once and read from a written table; an empty frame stays empty and keeps its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusforge-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    files, jpath = _filesystem(spark, path)
    files.deleteOnExit(jpath)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``staged`` with aggregates over all its rows, gathered while the table is written instead of by another job.

    The aggregates of an empty frame are those of no rows.
    """
    seen = Observation()
    table = staged(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return table, seen.get


def free(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            files, jpath = _filesystem(table.sparkSession, path)
            files.delete(jpath, True)
