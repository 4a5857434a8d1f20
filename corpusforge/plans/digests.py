"""SHA-256 over all rows of a group in order, streamed: a group may be larger than a task's memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_digest(df: DataFrame, by: list[str], order: Column, text: Column, begin: str = "", between: str = "\n", end: str = "") -> DataFrame:
    """``by, digest, n``: SHA-256 of each group's non-null texts in order, joined by ``between``, after ``begin`` and before ``end``.

    A hash is a fold over its input, so a group is one task; rows come to it by Spark's external sort and leave as they
    are hashed, nothing is gathered.  Ties of the order are settled by the text.  Without ``by`` there is one row, also
    for no rows at all; null keys form a group.
    """
    keys = [f"_k{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], order.alias("_order"), text.alias("_text")).filter("_text is not null")
    placed = (rows.repartition(*keys) if by else rows.repartition(1)).sortWithinPartitions(*keys, "_order", "_text").select(*keys, "_text")
    schema = T.StructType([*placed.schema.fields[:-1], T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, count, done = None, None, 0, []

        def close() -> None:
            hasher.update(end.encode())
            done.append((*now, hasher.hexdigest(), count))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, text_ in zip(*columns):
                if hasher is None or key != now:
                    if hasher is not None:
                        close()
                    now, hasher, count = key, hashlib.sha256(begin.encode()), 0
                if count:
                    hasher.update(between.encode())
                hasher.update(text_.encode())
                count += 1
        if hasher is not None:
            close()
        yield pa.record_batch([pa.array([r[k] for r in done], f.type) for k, f in enumerate(_arrow(schema))], names=schema.names)

    found = placed.mapInArrow(fold, schema)
    if not by:
        empty = hashlib.sha256((begin + end).encode()).hexdigest()
        return found.groupBy().agg(F.coalesce(F.max("digest"), F.lit(empty)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return found.withColumnsRenamed(dict(zip(keys, by)))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
