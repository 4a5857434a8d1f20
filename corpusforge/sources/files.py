"""Small texts in the cluster's file system, by the driver."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a text, folders included; a file that is there is replaced."""
    files, jpath = _at(spark, path)
    out = files.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a file; a missing one is an error."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"]).decode()


def exists(spark: SparkSession, path: str) -> bool:
    files, jpath = _at(spark, path)
    return files.exists(jpath)


def rename(spark: SparkSession, source: str, target: str) -> None:
    files, jsource = _at(spark, source)
    jtarget = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.delete(jtarget, False)
    if not files.rename(jsource, jtarget):
        raise OSError(f"can't move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    files, jpath = _at(spark, path)
    files.delete(jpath, True)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """A JSON document with sorted keys, two spaces of indent and a line feed at its end."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))
