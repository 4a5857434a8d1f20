"""Filling containers of fixed capacity: problem 6, by optimal length buckets and token-budget batches.

Dynamic programming over the global histogram of lengths (at most one entry per length up to the capacity) puts the
bucket bounds where padding every length up to its bound costs least.  Batches then take, bucket by bucket from the
longest, as many items as their token budget holds; what is left of the budget goes to items of shorter buckets.  As
this needs only the buckets' counts, the driver plans it as runs of equal batches, and each item finds its container
from its rank in its bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.plans.ranks import ranked, running
from corpusforge.plans.stage import staged

BUCKETS = 96
SPECS = 1000
LENGTHS = 4_000_000


def _next_bound(best: np.ndarray, n: np.ndarray, s: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of each prefix of lengths with one bucket more than ``best`` has, and where its last bucket begins.

    A longer prefix's last bucket never has to begin earlier, so prefixes are solved by halves, a level at a time: the
    middle of each span looks only between the starts of its solved neighbours, some m steps a level.
    """
    m = len(top)
    grown, back = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    solved = np.array([0, m + 1])
    starts = np.array([0, m])  # of the two ends: least and greatest
    while True:
        mid = (solved[:-1] + solved[1:]) // 2
        new = mid > solved[:-1]
        if not new.any():
            return grown, back
        at, low = mid[new], starts[:-1][new]
        high = np.minimum(starts[1:][new], at - 1)
        width = high - low + 1
        first = np.concatenate([[0], np.cumsum(width)[:-1]])
        j = np.repeat(at, width)
        i = np.arange(width.sum()) - np.repeat(first - low, width)
        cost = best[i] + top[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
        grown[at] = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == np.repeat(grown[at], width))
        back[at] = i[hit[np.searchsorted(hit, first)]]
        order = np.argsort(np.concatenate([solved, at]), kind="stable")
        solved, starts = np.concatenate([solved, at])[order], np.concatenate([starts, back[at]])[order]


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; the last bound is the greatest length."""
    if len(lengths) <= buckets:
        return lengths.tolist()
    n = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    m, top = len(lengths), lengths.astype(float)
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    back = np.zeros((buckets, m + 1), np.int32)
    for k in range(buckets):
        best, back[k] = _next_bound(best, n, s, top)
    bounds, at = [], m
    for k in reversed(range(buckets)):
        if at <= 0:
            break
        bounds.append(int(lengths[at - 1]))
        at = int(back[k, at])
    return sorted(set(bounds))


def batches(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of equal batches, as ``bucket, first rank, end rank, items per batch, first container``; and their number.

    Each batch takes from the longest bucket with items left as many as its budget holds, then from the next.
    """
    left, taken = list(counts), [0] * len(counts)
    plan, containers = [], 0
    while any(left):
        budget, batch = capacity, []
        for k in reversed(range(len(bounds))):
            if take := min(left[k], budget // bounds[k]):
                batch.append((k, take))
                budget -= take * bounds[k]
        times = min(left[k] // take for k, take in batch)
        for k, take in batch:
            plan.append((k, taken[k], taken[k] + times * take, take, containers))
            left[k] -= times * take
            taken[k] += times * take
        containers += times
    return plan, containers


def packed(df: DataFrame, id: str, tokens: Column, limits: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The container of each item: ``spec_id, id, part, container, tokens, bound, oversize``.

    ``limits``: ``spec_id, max_tokens``, of which null or non-positive capacities are left out.  An item is whole
    unless it exceeds the capacity; then it is ``oversize``, its full parts fill containers of their own and the rest
    is an item as any other.  Items without tokens (null, blank) take no room and come out in container 0.  Repeated
    rows are items of their own, null ids too; an empty table or no limits give no rows.  More than ``SPECS``
    capacities, or than ``LENGTHS`` lengths in all of them, are refused.
    """
    spark = df.sparkSession
    told = limits.select("spec_id", "max_tokens").filter("max_tokens > 0").distinct().limit(SPECS + 1).collect()
    specs = [(r["spec_id"], r["max_tokens"]) for r in told]
    if len(specs) > SPECS:
        raise ValueError(f"more than {SPECS} capacities")
    sizes = staged(df.select(F.col(id).alias("id"), tokens.cast("bigint").alias("all_tokens")))
    caps = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("cap")) for s, c in specs])
    caps = caps if specs else F.from_json(F.lit("[]"), "array<struct<spec_id:string,cap:bigint>>")
    full = F.when(F.col("all_tokens") > F.col("cap"), F.floor(F.col("all_tokens") / F.col("cap"))).otherwise(F.lit(0))
    each = sizes.select("id", "all_tokens", F.inline(caps)).withColumn("full", full)
    each = each.withColumn("rest", F.col("all_tokens") - F.col("full") * F.col("cap"))
    histogram: dict[str, dict[int, int]] = {}
    cells = each.filter("rest > 0").groupBy("spec_id", "rest").count().limit(LENGTHS + 1).collect()  # at most max_tokens rows a spec
    if len(cells) > LENGTHS:
        raise ValueError(f"more than {LENGTHS} lengths in all capacities")
    for r in cells:
        histogram.setdefault(r["spec_id"], {})[r["rest"]] = r["count"]
    bound_rows, plan_rows, made = [], [], {s: 0 for s, _ in specs}
    for s, cap in specs:
        of = histogram.get(s, {})
        lengths = np.array(sorted(of), np.int64)
        if not len(lengths):
            continue
        counts = np.array([of[x] for x in lengths.tolist()], np.int64)
        bounds = bucket_bounds(lengths, counts, buckets)
        place = np.searchsorted(np.array(bounds), lengths)
        plan, made[s] = batches(bounds, np.bincount(place, counts, len(bounds)).astype(np.int64).tolist(), cap)
        plan_rows += [(s, bounds[k], a, b, n, c) for k, a, b, n, c in plan]
        bound_rows += [(s, x, bounds[k]) for x, k in zip(lengths.tolist(), place.tolist())]
    bounds_of = spark.createDataFrame(bound_rows, "_spec string, _rest bigint, bound bigint")
    plans = spark.createDataFrame(plan_rows, "_s string, _b bigint, _from bigint, _to bigint, _per bigint, _first bigint")
    order = F.xxhash64("id", "all_tokens")
    own = (F.col("spec_id") == F.col("_spec")) & (F.col("rest") == F.col("_rest"))
    items = each.filter("rest > 0").join(F.broadcast(bounds_of), own).withColumn("_order", order)
    numbered = ranked(items, ["spec_id", "bound"], "_order", ["id"], "_rank")
    run = (F.col("spec_id") == F.col("_s")) & (F.col("bound") == F.col("_b"))
    met = numbered.join(F.broadcast(plans), run & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    container = (F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_per"))).alias("container")
    part, oversize = F.col("full").cast("int").alias("part"), (F.col("full") > 0).alias("oversize")
    whole = met.select("spec_id", "id", part, container, F.col("rest").alias("tokens"), "bound", oversize)
    starts = F.create_map(*[F.lit(x) for s, n in made.items() for x in (s, n)]) if made else F.create_map(F.lit(""), F.lit(0))
    over = running(each.filter("full > 0").withColumn("_order", order), ["spec_id"], "_order", ["id"], F.col("full"), "_before")
    parts = over.select("spec_id", "id", "cap", "_before", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part"))
    place = (starts[F.col("spec_id")] + F.col("_before") + F.col("part")).alias("container")
    cap = [F.col("cap").alias(c) for c in ("tokens", "bound")]
    filled = parts.select("spec_id", "id", "part", place, *cap, F.lit(True).alias("oversize"))
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("container", "tokens", "bound")]
    empty = each.filter("all_tokens = 0").select("spec_id", "id", F.lit(0).alias("part"), *zeros, F.lit(False).alias("oversize"))
    return whole.unionByName(filled).unionByName(empty)
