"""Splits that keep related records together: problem 4.

Values of the linking columns are the nodes of a graph, records its edges (distinct pairs, pre-aggregated); its
components come from hooking and shortcutting over parent tables.  Which component sizes fill which split is chosen
on the histogram of sizes - N records have at most sqrt(2N) different sizes - by subset-sum bitsets over true sizes.
Bitsets reach ``REACH`` records; what a split wants beyond that is filled before with its largest components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.components import components
from corpusforge.plans.ranks import ranked
from corpusforge.plans.stage import staged

REACH = 1 << 22
SPLITS = 1000


def related(df: DataFrame, links: list[str]) -> DataFrame:
    """``df`` with ``root``, equal for rows that share a non-null value of a column of ``links``, directly or through others.

    Rows that have none of the values keep a null ``root``.  Values of different columns never meet.
    """
    tagged = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in enumerate(links)]
    lead = F.coalesce(*tagged)
    pairs = None
    for t in tagged:
        some = df.select(lead.alias("u"), t.alias("v")).dropna().distinct()
        pairs = some if pairs is None else pairs.unionByName(some)
    roots = components(pairs, "u", "v").select(F.col("node").alias("_node"), "root")
    return df.withColumn("_lead", lead).join(roots, F.col("_lead") == F.col("_node"), "left").drop("_lead", "_node")


def choose(histogram: dict[int, int], targets: dict[str, float]) -> dict[str, dict[int, int]]:
    """How many components of each size go to each split so that the totals come close to the targets' shares.

    Smaller splits choose first, the largest takes the rest.  A split takes components, largest first, as long as it
    wants more than ``REACH`` records after them, or one that is larger than ``REACH`` and fits.  The rest comes from
    the reachable sums over the sizes left: of these the closest.  Up to ``REACH`` records this is the best choice
    there is for the split, beyond it the last ``REACH`` are.
    """
    left = dict(histogram)
    total = sum(s * n for s, n in left.items())
    order = sorted(targets, key=lambda s: (targets[s], s))
    chosen: dict[str, dict[int, int]] = {}
    for split in order[:-1]:
        want = targets[split] * total
        picked: dict[int, int] = {}
        for size in sorted(left, reverse=True):
            room = want if size > REACH else want - REACH
            if take := min(left[size], max(0, int(room // size))):
                picked[size] = take
                left[size] -= take
                want -= take * size
        for size, take in _closest(left, want).items():
            picked[size] = picked.get(size, 0) + take
            left[size] -= take
        chosen[split] = picked
        left = {s: n for s, n in left.items() if n}
    chosen[order[-1]] = left
    return chosen


def _closest(left: dict[int, int], want: float) -> dict[int, int]:
    """The sizes whose sum is closest to ``want``, a tie below it.

    Multiplicities are split into powers of two.  Each sum remembers the step that first reached it, so its sizes are
    found by walking back; four bytes a sum, whatever the number of steps.
    """
    goal = max(0, round(want))
    if goal > 2 * REACH:  # every component left is larger than that, or it would have been taken
        least = min((s for s, n in left.items() if n), default=0)
        return {least: 1} if least and least - want < want else {}
    most = 2 * goal + 1  # a sum beyond is farther than 0
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    step_of = np.full(most + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []
    for size in sorted(left, reverse=True):
        count, step = min(left[size], most // size), 1
        while count > 0 and not reach[goal]:
            take = min(step, count)
            weight = size * take
            if weight <= most:
                new = np.flatnonzero(reach[: most + 1 - weight] & ~reach[weight:]) + weight
                reach[new] = True
                step_of[new] = len(steps)
                steps.append((size, take))
            count, step = count - take, step * 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - want))])
    picked: dict[int, int] = {}
    while at:
        size, take = steps[step_of[at]]
        picked[size] = picked.get(size, 0) + take
        at -= size * take
    return picked


def shares_of(plan: DataFrame, split: str, share: str) -> dict[str, float]:
    """The shares of a small table of splits: at most ``SPLITS`` rows, each split once, shares not negative and 1 in all; an empty one has none."""
    rows = plan.select(split, share).limit(SPLITS + 1).collect()
    shares = {r[0]: r[1] for r in rows}
    if len(rows) > SPLITS or len(shares) < len(rows) or None in shares or None in shares.values():
        raise ValueError(f"splits are repeated, null or more than {SPLITS}")
    if rows and (min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-6):
        raise ValueError(f"shares don't add up to 1: {shares}")
    return shares


def grouped_split(df: DataFrame, id: str, links: list[str], shares: dict[str, float], out: str = "new_split") -> DataFrame:
    """A row per record: its id, the linking columns and ``out``, its split.

    Records that share a value of ``links``, directly or through others, get the same split, and the splits' shares of
    all records come as close to ``shares`` as whole components allow.  Rows of one id are one record; if their
    values differ, the id itself holds them together.  Null ids are left out; a record without any link value stands
    alone; an empty table or empty ``shares`` gives no rows.
    """
    names = [f"link{k}" for k in range(len(links))]
    rows = staged(df.select(F.col(id).alias("id"), *[F.col(c).alias(n) for c, n in zip(links, names)]).filter("id is not null").distinct())
    back = [F.col("id").alias(id), *[F.col(n).alias(c) for c, n in zip(links, names)]]
    if not shares:
        return rows.limit(0).select(*back, F.lit(None).cast("string").alias(out))
    twice = rows.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_id"))
    keyed = rows.join(twice, F.col("id") == F.col("_id"), "left").withColumnRenamed("_id", "twice")
    placed = staged(related(staged(keyed), [*names, "twice"]).drop("twice"))
    component = F.coalesce("root", F.concat(F.lit("id:"), F.col("id")))
    sizes = staged(placed.select("id", component.alias("component")).distinct().groupBy("component").count().select("component", F.col("count").alias("size"), F.xxhash64("component").alias("_order")))
    histogram = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most sqrt(2N) rows
    plan = []
    begin: dict[int, int] = {}
    for split, picked in choose(histogram, shares).items():
        for size, n in picked.items():
            plan.append((size, split, begin.get(size, 0), begin.get(size, 0) + n))
            begin[size] = begin.get(size, 0) + n
    ranges = df.sparkSession.createDataFrame(plan, "_size bigint, split string, _from bigint, _to bigint")
    numbered = ranked(sizes, ["size"], "_order", ["component"], "_rank")
    split_of = numbered.join(F.broadcast(ranges), (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(F.col("component").alias("_component"), "split")
    return placed.join(split_of, component == F.col("_component")).select(*back, F.col("split").alias(out))


def torn(df: DataFrame, links: list[str], split: str) -> DataFrame:
    """Values of the first column of ``links`` whose related rows lie in two or more splits; null splits don't count.

    Repeated rows count once, rows without any link value don't; an empty table gives no rows.
    """
    names = [f"link{k}" for k in range(len(links))]
    combos = staged(df.select(*[F.col(c).alias(n) for c, n in zip(links, names)], F.col(split).alias("split")).distinct())
    placed = staged(related(combos, names).filter("root is not null"))
    apart = placed.groupBy("root").agg(F.min("split").alias("_low"), F.max("split").alias("_high")).filter("_low < _high").select(F.col("root").alias("_root"))
    families = placed.filter("link0 is not null").select("link0", "root").distinct()
    return families.join(apart, F.col("root") == F.col("_root"), "left_semi").select(F.col("link0").alias(links[0])).distinct()
