"""Mixing sources to target weights: problem 7, by Pfair scheduling.

Each source contributes blocks of tokens.  Block k of a source with weight w is released at slot floor(k/w) and due
at ceil((k+1)/w); the earliest deadline first gives slots to released blocks, so at any slot a source deviates from
its weight by less than one block.  Blocks are as large as it takes for all mixtures together to have some ``SLOTS``
slots, and one more for each of at most ``TARGETS`` sources of a mixture, so the schedule is bounded whatever the size
of the sources; records find their slot from their source's running sum.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.plans.ranks import running
from corpusforge.plans.stage import staged

SLOTS = 262_144
BLOCK_TOKENS = 1024
TARGETS = 20_000


def pfair(blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks, all slots of their total being used."""
    total = sum(blocks.values())
    weights = {s: Fraction(n, total) for s, n in blocks.items() if n}
    releases = [(0, s, 0) for s in weights]
    heapq.heapify(releases)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    for slot in range(total):
        while releases and releases[0][0] <= slot:
            _, s, k = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(k + 1) * weights[s].denominator // weights[s].numerator), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < blocks[s]:
            heapq.heappush(releases, ((k + 1) * weights[s].denominator // weights[s].numerator, s, k + 1))
    return slots


def _planned(totals: dict[str, int], mixture: list) -> list[dict]:
    rows = []
    for r in mixture:
        quota, have = r["target_share"] * r["total_tokens"], totals.get(r["source"], 0)
        rows.append(r.asDict() | {"quota": quota, "available": have, "usable": have * r["max_repeats"], "take": min(quota, have * r["max_repeats"])})
    return rows


def mixed(df: DataFrame, id: str, source: Column, tokens: Column, mixture: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen records in their order, and what each source gets.

    ``mixture``: ``mix_id, source, target_share, max_repeats, total_tokens``; rows with a null in one of them are
    left out.  First frame: ``mix_id, slot, start, source, id, repeat, tokens`` - order by slot, then start; a record
    comes in whole where at least half of it lies before its source's target, and records longer than that target come
    after all others of the source, so that none of them takes the place of those that fit.  Second: ``mix_id, source,
    target_share, target_tokens, available_tokens, usable_tokens`` (all allowed repeats), ``chosen_tokens, short,
    actual_share``; a source is short where all its allowed repeats were chosen and don't reach its target.
    Records of no known source, of none (null) or without tokens are not chosen; repeated rows are records of their
    own.  A source without records has 0 tokens.  An empty mixture gives no rows.
    """
    spark = df.sparkSession
    wanted = mixture.dropna(subset=["mix_id", "source", "target_share", "max_repeats", "total_tokens"]).limit(TARGETS + 1).collect()
    if len(wanted) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    names = sorted({r["source"] for r in wanted})
    read = df.select(F.col(id).alias("id"), source.alias("source"), tokens.cast("bigint").alias("tokens"))
    records = staged(read.filter(F.col("source").isin(names) & (F.col("tokens") > 0)))
    sums = records.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest")).collect()  # at most the mixture's sources
    longest = {r["source"]: r["longest"] for r in sums}
    rows = _planned({r["source"]: r["n"] for r in sums}, wanted)
    schedule, takes, ways = [], [], {}  # a way is an order of a source's records; all targets that none exceeds share one
    mixes = sorted({r["mix_id"] for r in rows})
    limit = max(1, SLOTS // max(1, len(mixes)))
    for mix in mixes:
        own = [r for r in rows if r["mix_id"] == mix]
        block = max(BLOCK_TOKENS, -(-int(sum(r["take"] for r in own)) // limit))
        slots = pfair({r["source"]: -(-int(r["take"] + 0.999999) // block) for r in own})
        schedule += [(mix, s, k, slot) for s, of in slots.items() for k, slot in enumerate(of)]
        for r in own:
            if r["take"] > 0:
                way = ways.setdefault((r["source"], float(r["take"]) if longest[r["source"]] > r["take"] else None), len(ways))
                takes.append((mix, way, float(r["take"]), r["available"], block))
    take = spark.createDataFrame(takes, "mix_id string, _of int, _take double, _available bigint, _block bigint")
    way = spark.createDataFrame([(k, s, most) for (s, most), k in ways.items()], "_way int, _source string, _most double")
    late = F.coalesce(F.col("tokens") > F.col("_most"), F.lit(False)).alias("_late")
    met = records.join(F.broadcast(way), F.col("source") == F.col("_source"))
    laid = met.select("id", "source", "tokens", "_way", late, F.xxhash64("id", "tokens").alias("_order"))
    early = laid.filter("not _late").groupBy(F.col("_way").alias("_w")).agg(F.sum("tokens").alias("_early"))
    summed = running(laid, ["_way", "_late"], "_order", ["id"], F.col("tokens"), "_before").join(F.broadcast(early), F.col("_way") == F.col("_w"), "left")
    summed = summed.withColumn("_before", F.col("_before") + F.when(F.col("_late"), F.coalesce("_early", F.lit(0))).otherwise(0))
    passes = F.sequence(F.lit(0), F.ceil(F.col("_take") / F.col("_available")).cast("int") - 1)
    columns = ["mix_id", "source", "id", "tokens", "_take", "_block", "_before", "_available"]
    used = summed.join(F.broadcast(take), F.col("_way") == F.col("_of")).select(*columns, F.explode(passes).alias("repeat"))
    used = used.withColumn("start", F.col("_before") + F.col("repeat") * F.col("_available"))
    used = used.filter(F.col("start") + F.col("tokens") / 2 <= F.col("_take")).withColumn("_k", F.floor(F.col("start") / F.col("_block")))
    slots_of = spark.createDataFrame(schedule, "_mix string, _s string, _at bigint, slot bigint")
    own = (F.col("mix_id") == F.col("_mix")) & (F.col("source") == F.col("_s"))
    slotted = used.join(F.broadcast(slots_of), own & (F.col("_k") == F.col("_at")))
    chosen = slotted.select("mix_id", "slot", "start", "source", "id", "repeat", "tokens")
    told = [(r["mix_id"], r["source"], float(r["target_share"]), float(r["quota"]), r["available"], r["usable"]) for r in rows]
    kinds = "mix_id string, source string, target_share double, target_tokens double, available_tokens bigint, usable_tokens bigint"
    report = spark.createDataFrame(told, kinds)
    got = chosen.groupBy(F.col("mix_id").alias("_mix"), F.col("source").alias("_s")).agg(F.sum("tokens").alias("_got"))
    shares = report.join(got, own, "left").withColumn("chosen_tokens", F.coalesce("_got", F.lit(0))).drop("_mix", "_s", "_got")
    all_chosen = F.col("chosen_tokens") == F.col("usable_tokens")
    shares = shares.withColumn("short", all_chosen & (F.col("usable_tokens") < F.col("target_tokens")))
    whole = F.sum("chosen_tokens").over(Window.partitionBy("mix_id"))
    return chosen, shares.withColumn("actual_share", F.try_divide("chosen_tokens", whole))
