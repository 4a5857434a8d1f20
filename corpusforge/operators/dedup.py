"""Exact and shape duplicates, and reserved content."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.ids import PART
from corpusforge.functions.text import shape


def python_repr(answer_json: Column, kind: Column) -> Column:
    """An answer as its type writes it, so that ``"12"`` and ``12`` differ: strings quoted, truth values and null by name."""
    bare = F.get_json_object(F.concat(F.lit('{"v":'), answer_json, F.lit("}")), "$.v")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("\\\\")), "\n", r"\\n"), "\t", r"\\t"), "\r", r"\\r")
    quoted = F.when(bare.contains("'") & ~bare.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(answer_json.isNull() | (answer_json == "null"), "None").when(answer_json == "true", "True").when(answer_json == "false", "False").when((kind == "str") | answer_json.startswith('"'), quoted).otherwise(answer_json)


def exact_key(prompt: Column, answer: Column) -> Column:
    """Hash of a prompt with its answer's ``python_repr``; a null prompt counts as empty."""
    return F.sha2(F.concat(F.coalesce(prompt, F.lit("")), F.lit(PART), answer), 256)


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; a null key is a key.

    An aggregate, not a window: copies are dropped before the shuffle, so one key may hold any share of the rows.
    Rows that tie in the whole order are told apart by their other columns' values.
    """
    columns = df.columns
    whole = F.struct(*[F.col(c) for c in columns])
    rest = [F.to_json(F.struct(*[F.col(c) for c in columns if c not in order]))] if set(columns) - set(order) else []
    best = df.withColumn("_key", key).groupBy("_key").agg(F.min_by(whole, F.struct(*[F.col(c) for c in order], *rest)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in columns])


def capped(df: DataFrame, keys: list[Column], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group; null keys form groups.  Each task drops what exceeds the cap before the shuffle."""
    names = [f"_key{k}" for k in range(len(keys))]
    ranked = df.withColumns(dict(zip(names, keys))).withColumn("_rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= cap).drop("_rank", *names)


def shape_capped(df: DataFrame, family: Column, text: Column, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each text shape within a family (for caps of 1 and more)."""
    return capped(df, [family, shape(text)], order, cap)


def without_reserved(df: DataFrame, key: Column, reserved: DataFrame, reserved_key: Column) -> DataFrame:
    """``df`` without rows whose key is reserved; rows with a null key stay."""
    taken = reserved.select(reserved_key.alias("_reserved")).distinct()
    return df.withColumn("_key", key).join(taken, F.col("_key") == F.col("_reserved"), "left_anti").drop("_key")


def shape_fold(df: DataFrame, family: Column, text: Column, order: str, size: int, threshold: float, window: int = 200) -> DataFrame:
    """The zero-cap form of ``shape_capped``: ``df`` without rows that are like one of the last ``window`` kept rows of their family.

    A row is dropped if its shape was kept before or its shape's word shingles have a Jaccard index of ``threshold`` or
    more with a kept one.  What is kept depends on what was kept before, so a family is folded in one task, on order
    and shapes only; null texts have an empty shape.
    """
    import pandas as pd
    from pyspark.sql import types as T

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        recent: deque[set[str]] = deque(maxlen=window)
        known, kept = set(), []
        rows = rows.sort_values("order", kind="stable")
        for s in rows["shape"]:
            parts = s.split()
            own = {" ".join(parts[k : k + size]) for k in range(max(1, len(parts) - size + 1))}
            ok = s not in known and all(len(own & x) < threshold * len(own | x) for x in recent)
            kept.append(ok)
            if ok:
                known.add(s)
                recent.append(own)
        return rows.loc[kept, ["order"]]

    thin = df.select(family.alias("family"), F.col(order).alias("order"), F.coalesce(shape(text), F.lit("")).alias("shape"))
    stay = thin.groupBy("family").applyInPandas(fold, T.StructType([thin.schema["order"]])).select(F.col("order").alias("_order"))
    return df.join(stay, F.col(order) == F.col("_order"), "left_semi")
