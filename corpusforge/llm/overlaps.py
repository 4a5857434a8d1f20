"""Records that also occur in another split: problem 2.

The evaluation records' gram hashes are partitioned by hash and the training records' are scanned against them: of an
evaluation record held to the share t in a training record, one gram of its prefix (``wordsets``) is among the training
record's grams.  Training grams that no evaluation record asks for are dropped where they are read.  Signatures are
compared in tiles; for each hit pair the containment of the evaluation record in the training record is computed from
the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.tiles import Alike, Bound, Within, compared, whole_groups
from corpusforge.llm.wordsets import alike as alike_sql
from corpusforge.llm.wordsets import gram_counts, gram_sets, keys_from_arrow, keys_to_arrow, measured, one_of_each, prefix_buckets
from corpusforge.plans.stage import staged

HOT = 2048
COLUMNS = ["key", "n", "sig0", "sig1"]


def _sets(df: DataFrame, id: str, text: str, held_out: Column, share: Fraction, size: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all records that take part, and one for each set and side."""
    rows = df.select(F.col(id).alias("id"), held_out.alias("held_out"), F.col(text).alias("text")).filter("id is not null and held_out is not null")
    counts = gram_counts(rows, "text", size)
    wanted = prefix_buckets(rows.filter("held_out"), "text", share, size, counts)
    sets = staged(gram_sets(rows, "text", share, size, counts=counts, scanned="held_out", wanted=wanted))
    return sets, staged(one_of_each(sets, "held_out"))


def cells(unique: DataFrame) -> DataFrame:
    """``cell, place`` (1 evaluation, 2 training) and the set's columns; both sides of a hot gram are salted.

    A gram that few records can hold makes one cell.  Of the others both sides are counted; cells are pairs of an
    evaluation and a training salt, so a cell has at most some ``2 * HOT`` rows.
    """
    place = F.when(F.col("held_out"), 1).otherwise(2).cast("tinyint").alias("place")
    rare = unique.select(F.explode(F.slice("grams", F.lit(1), F.col("r"))).alias("cell"), place, *COLUMNS)
    rest = F.slice("grams", F.col("r") + 1, F.col("p") - F.col("r"))
    common = unique.filter("p > r").select(F.explode(rest).alias("gram"), place, *COLUMNS)
    both = common.groupBy(F.col("gram").alias("_g")).agg(F.count_if(F.col("place") == 1).alias("_e"), F.count_if(F.col("place") == 2).alias("_t"))
    met = common.join(both.filter("_e > 0 and _t > 0"), F.col("gram") == F.col("_g"))
    here, there = (F.ceil(F.when(F.col("place") == a, F.col("_e")).otherwise(F.col("_t")) / HOT).cast("int") for a in (1, 2))
    salted = met.withColumns({"own": F.pmod(F.xxhash64(F.lit("salt"), "key"), here).cast("int"), "other": F.explode(F.sequence(F.lit(0), there - 1))})
    ends = [F.when(F.col("place") == k, F.col("own")).otherwise(F.col("other")) for k in (1, 2)]
    return rare.unionByName(salted.select(F.xxhash64("gram", *ends).alias("cell"), "place", *COLUMNS))


def candidates(of: DataFrame, bound: Bound, nearest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of evaluation and training keys whose signatures allow the bound.

    With ``nearest`` only one for each evaluation record of a cell, the one with most bits in common; ``more`` tells
    whether there were others.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            cell, place, n, s0, s1 = (table.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            key = keys_from_arrow(table.column(2))
            sig = np.stack([s0, s1], axis=1).view(np.uint64)
            x, y, _ = compared(cell, place, n, sig, bound, None)
            more = np.zeros(len(x), bool)
            if nearest and len(x):
                order = np.lexsort((np.bitwise_count(sig[x] & ~sig[y]).sum(axis=1), x))
                x, y = x[order], y[order]
                heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                more = np.diff(np.concatenate([heads, [len(x)]])) > 1
                x, y = x[heads], y[heads]
            for k in range(0, len(x), 500_000):
                a, b = key[x[k : k + 500_000]], key[y[k : k + 500_000]]
                yield pa.record_batch([keys_to_arrow(*a.T), keys_to_arrow(*b.T), pa.array(more[k : k + 500_000])], names=["a", "b", "more"])

    sorted_cells = of.select("cell", "place", "key", "n", "sig0", "sig1").repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(compare, "a binary, b binary, more boolean")


def _contained(share: Fraction) -> str:
    return f"n_both > 0 and n_both * {share.denominator}L >= n_a * {share.numerator}L"


def split_overlaps(df: DataFrame, id: str, text: str, held_out: Column, share: Fraction = Fraction(4, 5), size: int = 5, likeness: Fraction | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of an evaluation and a training text that holds ``share`` of its grams, as classes of equal gram sets, and the classes' members.

    ``held_out`` is true for evaluation records, false for training records and null for rows that take no part.
    First frame: ``key_eval, key_train, containment`` (share of the evaluation record's grams that the training
    record holds, however long that is) and ``likeness`` (grams in both by grams in either); equal sets pair with
    themselves.  With ``likeness``, at least ``share``, only pairs that are at least as alike: they are among those
    found by containment, and the tiles drop the others.  Second frame: ``key, id, held_out``, repeated rows once.
    Null ids are left out, texts without words hold nothing and are held nowhere, an empty table gives empty frames.
    """
    sets, unique = _sets(df, id, text, held_out, share, size)
    pairs = staged(candidates(cells(unique), _bound(share, likeness)).select("a", "b").distinct())
    found = measured(pairs, sets, "text", size).filter(_met(share, likeness))
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    alike = found.select(F.col("a").alias("key_eval"), F.col("b").alias("key_train"), (F.col("n_both") / F.col("n_a")).alias("containment"), (F.col("n_both") / either).alias("likeness"))
    return alike, sets.filter("key is not null").select("key", "id", "held_out").distinct()


def _bound(share: Fraction, likeness: Fraction | None) -> Bound:
    if likeness is not None and likeness < share:
        raise ValueError("a likeness below the share isn't implied by containment")
    return Within(share) if likeness is None else Alike(likeness)


def _met(share: Fraction, likeness: Fraction | None) -> str:
    return _contained(share) if likeness is None else alike_sql(likeness)


def overlap_pairs(df: DataFrame, id: str, text: str, held_out: Column, share: Fraction = Fraction(4, 5), size: int = 5, likeness: Fraction | None = None) -> DataFrame:
    """``split_overlaps`` as pairs of records: ``id_eval, id_train, containment, likeness``, each pair once."""
    alike, members = split_overlaps(df, id, text, held_out, share, size, likeness)
    alike = staged(alike)
    ends = [members.filter(cond).select(F.col("key").alias(f"key_{x}"), F.col("id").alias(f"id_{x}")) for cond, x in (("held_out", "eval"), ("not held_out", "train"))]
    return alike.join(ends[0], "key_eval").join(ends[1], "key_train").select("id_eval", "id_train", "containment", "likeness")


def _hit(of: DataFrame, sets: DataFrame, size: int, share: Fraction, likeness: Fraction | None) -> DataFrame:
    """Keys of evaluation records that have a hit: first by their nearest candidate of each cell, then, where that fails, by all others."""
    bound, met = _bound(share, likeness), _met(share, likeness)
    near = staged(candidates(of, bound, nearest=True).groupBy("a", "b").agg(F.max("more").alias("more")))
    hit = staged(measured(near.select("a", "b"), sets, "text", size).filter(met).select("a").distinct())
    unsure = near.filter("more").join(hit, "a", "left_anti").select(F.col("a").alias("_open")).distinct()
    again = of.join(unsure, (F.col("place") == 1) & (F.col("key") == F.col("_open")), "left").filter("place = 2 or _open is not null").drop("_open")
    rest = candidates(again, bound).select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    late = measured(staged(rest), sets, "text", size).filter(met).select("a").distinct()
    return hit.unionByName(late).withColumnRenamed("a", "key")


def overlapping_records(df: DataFrame, id: str, text: str, held_out: Column, share: Fraction = Fraction(4, 5), size: int = 5, likeness: Fraction = Fraction(4, 5)) -> DataFrame:
    """The evaluation records of which some training record holds the share: ``id`` and ``alike``, whether one is also as alike as asked.

    As ``split_overlaps``, but one hit decides about a record, so near copies on both sides don't give all their pairs.
    """
    sets, unique = _sets(df, id, text, held_out, share, size)
    of = cells(unique)
    held = _hit(of, sets, size, share, None)
    same = _hit(of, sets, size, share, likeness).withColumn("alike", F.lit(True))
    members = sets.filter("held_out").select("key", "id").join(held, "key", "left_semi").join(same, "key", "left")
    return members.groupBy("id").agg(F.coalesce(F.max("alike"), F.lit(False)).alias("alike"))
