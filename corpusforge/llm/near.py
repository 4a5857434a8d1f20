"""Near-duplicate records: problem 3.

Records that share a prefix gram (``wordsets``) form a block.  A block is compared exactly, tile against tile, by
numpy exclusive-or and bit counts of the signatures, skipping tiles whose population counts differ beyond the radius
(``tiles``).  Blocks of more than ``CELL`` rows are cut before that:

* by the second and third gram their rows have in common, where that leaves less to compare - unequal sets of
  likeness t share at least t/(1-t) grams;
* what is still larger by salts, so that a cell never has more than some ``2 * CELL`` rows.  First rows of one salt
  meet.  Where most of a block is one group by then, as with copies with small edits, its other rows meet the group
  and each other; else all salts meet.  Rows of a group needn't meet again, so blocks of near copies stay linear.

What the signatures can't tell is settled by the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.components import components
from corpusforge.llm.tiles import Alike, bit_count, compared, whole_groups
from corpusforge.llm.wordsets import alike, gram_hashes, gram_sets, keys_from_arrow, keys_to_arrow, measured, one_of_each
from corpusforge.plans.stage import free, staged

CELL = 4096
LEVELS = 3
COLUMNS = ["key", "n", "sig0", "sig1"]


def _cell(*parts: Column | str) -> Column:
    return F.xxhash64(*parts).alias("cell")


def _place(place: Column | int) -> Column:
    return (F.lit(place) if isinstance(place, int) else place).cast("tinyint").alias("place")


def _salt(salts: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), "key"), salts).cast("int")


def _upto(n: Column) -> Column:
    """0 to n - 1; nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def blocks(unique: DataFrame, likeness: Fraction) -> tuple[DataFrame, DataFrame | None]:
    """The cells of blocks of at most ``CELL`` rows (``cell, place`` and the set's columns), and the rows of larger ones.

    The second frame has ``block`` and its number of rows ``m``; it is None if there are none.
    """
    deepest = LEVELS if likeness == 1 else min(LEVELS, int(likeness / (1 - likeness)))
    cells = unique.select(F.explode(F.slice("grams", F.lit(1), F.col("r"))).alias("cell"), _place(0), *COLUMNS)
    common = F.slice("grams", F.col("r") + 1, F.col("p") - F.col("r"))
    wide = unique.filter("p > r").select(*COLUMNS, "grams", "p", "r", F.posexplode(common).alias("at", "block")).withColumn("at", F.col("at") + F.col("r"))
    wide = wide.drop("r")
    left = None
    for level in range(1, deepest + 1):
        large = staged(wide.groupBy(F.col("block").alias("_b")).agg(F.count("*").alias("m")).filter(F.col("m") > CELL))
        small = wide.join(large, F.col("block") == F.col("_b"), "left_anti")
        cells = cells.unionByName(small.select(F.col("block").alias("cell"), _place(0), *COLUMNS))
        if large.isEmpty():
            break
        hot = wide.join(large, F.col("block") == F.col("_b")).drop("_b")
        if level < deepest:
            hot = staged(hot)
            begin, end = F.col("at") + 1, F.least(F.col("p") + level - 1, F.size("grams") - 1)
            further = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
            finer = hot.withColumnRenamed("block", "parent").withColumn("at", F.explode(further)).withColumn("block", F.xxhash64("parent", F.get("grams", F.col("at"))))
            parts = finer.groupBy("parent", "m", "block").agg(F.count("*").cast("double").alias("c"))
            worth = staged(parts.groupBy(F.col("parent").alias("_p")).agg((2 * F.sum(F.col("c") * F.col("c")) < F.pow(F.first("m"), F.lit(2))).alias("cut")))
            wide = finer.join(worth.filter("cut"), F.col("parent") == F.col("_p")).drop("_p", "parent", "m", "cut")
            hot = hot.join(worth.filter("not cut"), F.col("block") == F.col("_p"))
        rows = hot.select("block", "m", *COLUMNS)
        left = rows if left is None else left.unionByName(rows)
    if left is None:
        return cells, None
    left = staged(left)
    return cells, None if left.isEmpty() else left


def own_cells(large: DataFrame) -> DataFrame:
    """A cell for each salt of a large block: ``cell, place`` (0) and the set's columns."""
    return large.select(_cell("block", _salt(F.ceil(F.col("m") / CELL))), _place(0), *COLUMNS)


def cross_cells(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The cells for pairs of different salts of large blocks: ``cell, place`` (1 or 2 for a side, else 0) and the set's columns.

    Where the largest group so far (``roots``: ``node, root``) has at least half of a block, salts of the group meet
    salts of the other rows, and these meet each other.  Else all pairs of different salts of the block meet.
    """
    met = large.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    groups = met.groupBy("block", "root").agg(F.count("*").alias("c"))
    leads = groups.groupBy(F.col("block").alias("_b")).agg(F.max_by("root", F.struct("c", "root")).alias("_lead"), F.max("c").alias("_n"))
    met = met.join(leads, F.col("block") == F.col("_b")).drop("_b").withColumn("led", 2 * F.col("_n") >= F.col("m"))
    met = met.withColumn("mine", F.when(F.col("led"), F.col("root") == F.col("_lead")).otherwise(F.lit(False)))
    lead, rest = F.ceil(F.col("_n") / CELL), F.ceil((F.col("m") - F.col("_n")) / CELL)
    led = met.filter("led")
    here = led.filter("mine").withColumn("i", _salt(lead)).withColumn("j", F.explode(_upto(rest)))
    come = led.filter("not mine").withColumn("j", _salt(rest)).withColumn("i", F.explode(_upto(lead)))
    pairs = [side.select(_cell("block", F.lit("lead"), "i", "j"), _place(k), *COLUMNS) for k, side in ((1, here), (2, come))]
    among = met.filter("not mine").withColumn("salts", F.when(F.col("led"), rest).otherwise(F.ceil(F.col("m") / CELL)))
    among = among.withColumn("i", _salt("salts")).withColumn("j", F.explode(_upto(F.col("salts")))).filter("led or i != j")
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return pairs[0].unionByName(pairs[1]).unionByName(among.select(_cell("block", F.lit("rest"), F.least("i", "j"), F.greatest("i", "j")), _place(side), *COLUMNS))


def cell_pairs(cells: DataFrame, likeness: Fraction) -> DataFrame:
    """Candidate pairs ``a, b`` of keys with a null ``cell``, once each; of a dense cell, with many times more pairs than rows, its rows instead: ``cell, place`` and the key in ``a``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            cell, place, n, s0, s1 = (table.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
            key = keys_from_arrow(table.column(2))
            x, y, dense = compared(cell, place, n, np.stack([s0, s1], axis=1).view(np.uint64), Alike(likeness))
            a, b = key[x], key[y]
            swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
            a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            once = np.flatnonzero((a != b).any(axis=1))
            once = once[np.unique(np.concatenate([a[once], b[once]], axis=1), axis=0, return_index=True)[1]] if len(once) else once
            a = np.concatenate([a[once], key[dense]])
            b = np.concatenate([b[once], key[dense]])
            pair = np.arange(len(a)) < len(once)
            cell_, place_ = (np.concatenate([np.zeros(len(once), v.dtype), v[dense]]) for v in (cell, place))
            columns = [keys_to_arrow(*a.T), keys_to_arrow(*b.T, pair), pa.array(cell_, mask=pair), pa.array(place_, mask=pair)]
            yield pa.record_batch(columns, names=["a", "b", "cell", "place"])

    sorted_cells = cells.select("cell", "place", "key", "n", "sig0", "sig1").repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(compare, "a binary, b binary, cell bigint, place tinyint")


def dense_links(rows: DataFrame, unique: DataFrame, sets: DataFrame, text: str, likeness: Fraction, size: int) -> DataFrame:
    """Links ``a, b`` that join the same sets as all links inside dense cells, fewer than a cell has rows.

    A row is measured, by the grams of its text, against rows of its cell that it isn't joined with yet, so a cell of
    copies with small edits costs about one measurement a row and none of its quadratic number of pairs leaves the task.
    """
    asked = rows.select(F.col("a").alias("key")).distinct()
    texts = sets.filter("first").select("key", F.col(text).alias("_text")).join(asked, "key", "left_semi").groupBy("key").agg(F.min("_text").alias("_text"))
    met = rows.select("cell", "place", F.col("a").alias("key")).join(unique.select(*COLUMNS), "key").join(texts, "key")
    bound = Alike(likeness)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            cells = table.column(0).to_numpy()
            found = []
            keys = keys_from_arrow(table.column(2))
            for s in np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])).tolist():
                part = table.slice(s, int(np.searchsorted(cells, cells[s], side="right")) - s)
                place, n, s0, s1 = (part.column(k).to_numpy() for k in (1, 3, 4, 5))
                place, n = place.astype(np.int64), n.astype(np.int64)
                hashes, sizes = gram_hashes(part.column(6).to_pylist(), size)
                ends = np.cumsum(sizes)
                grams = [np.sort(hashes[e - m : e]) for e, m in zip(ends.tolist(), sizes.tolist())]
                sig = np.stack([s0, s1], axis=1).view(np.uint64)
                ones = bit_count(sig)
                group = np.arange(len(n))
                order = np.argsort(ones, kind="stable")
                for at, x in enumerate(order.tolist()):
                    rest = order[at + 1 :]
                    rest = rest[(group[rest] != group[x]) & ((place[x] + place[rest]) % 3 == 0)]
                    rest = rest[bound.rough(ones[x], ones[rest], n[x], n[rest])]
                    rest = rest[bound.fine(sig[x], sig[rest], n[x], n[rest])]
                    for y in rest.tolist():
                        if group[x] != group[y]:
                            both = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
                            if both * likeness.denominator >= (len(grams[x]) + len(grams[y]) - both) * likeness.numerator:
                                group[group == group[y]] = group[x]
                                found.append((s + x, s + y))
            a, b = (keys[[p[k] for p in found]] if found else keys[:0] for k in (0, 1))
            yield pa.record_batch([keys_to_arrow(*a.T), keys_to_arrow(*b.T)], names=["a", "b"])

    sorted_rows = met.select("cell", "place", *COLUMNS, "_text").repartition("cell").sortWithinPartitions("cell")
    return sorted_rows.mapInArrow(link, "a binary, b binary")


def _links(cells: DataFrame, unique: DataFrame, sets: DataFrame, likeness: Fraction, size: int) -> DataFrame:
    """Pairs ``a, b`` of keys whose texts are alike, of dense cells only as many as it takes."""
    found = staged(cell_pairs(cells, likeness))
    links = measured(found.filter("cell is null").select("a", "b").distinct(), sets, "text", size).filter(alike(likeness)).select("a", "b")
    dense = found.filter("cell is not null")
    linked = staged(links if dense.isEmpty() else links.unionByName(dense_links(dense, unique, sets, "text", likeness, size)))
    free(found)
    return linked


def near_groups(df: DataFrame, id: str, text: str, likeness: Fraction = Fraction(4, 5), size: int = 5) -> DataFrame:
    """Groups of records whose gram sets are alike, directly or through others: a row per record that has company.

    ``df`` may hold other columns and repeated ids; rows of one id are one record if their texts agree.  Columns:
    ``first_id`` (the group's smallest id), ``member_id`` (every other id of it).  Null ids are left out, texts
    without words (null, empty, blank) are like nothing, an empty table gives no rows.  ``size`` words make a gram;
    the likeness of two sets is the number of grams in both by that in either.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("id is not null")
    sets = staged(gram_sets(rows, "text", likeness, size, deeper=LEVELS - 1))
    unique = staged(one_of_each(sets))
    cells, large = blocks(unique, likeness)
    links = _links(cells if large is None else cells.unionByName(own_cells(large)), unique, sets, likeness, size)
    if large is not None:
        links = links.unionByName(_links(cross_cells(large, components(links, "a", "b")), unique, sets, likeness, size))
    roots = components(links, "a", "b")
    members = sets.filter("key is not null").select("key", "id").distinct()
    own = members.join(roots, F.col("key") == F.col("node"), "left").select("id", F.coalesce("root", "key").alias("root"))
    lead = own.groupBy("root").agg(F.min("id").alias("first_id"), F.max("id").alias("_last")).filter("first_id < _last").select(F.col("root").alias("_root"), "first_id")
    return own.join(lead, F.col("root") == F.col("_root")).filter("id != first_id").select("first_id", F.col("id").alias("member_id")).distinct()
