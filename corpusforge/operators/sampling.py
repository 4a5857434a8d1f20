"""Targets, strides, quotas and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.ids import digest
from corpusforge.plans.ranks import ranked, running


def proportional_targets(df: DataFrame, by: str, tokens: str, target_tokens: int, floor: int) -> DataFrame:
    """Records to take per group for ``target_tokens`` in all: ``by, available, target``.

    Share of the tokens over the group's mean length, rounded half to even, at least ``min(floor, available)`` and at
    most what there is.  Null groups are left out, null tokens count 0; a group without tokens gets the floor.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("available"), F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("_tokens"))
    # share * target / mean = (t / T) * target / (t / n)
    share = F.col("_tokens") / F.sum("_tokens").over(Window.partitionBy(F.lit(0)))
    wanted = F.coalesce(F.bround(F.try_divide(share * target_tokens, F.col("_tokens") / F.col("available")), 0), F.lit(0))
    return counts.withColumn("target", F.greatest(F.least(F.lit(floor), "available"), F.least(wanted, "available")).cast("bigint")).drop("_tokens")


def flattened_targets(df: DataFrame, by: str, total: int, weights: dict[str, float]) -> DataFrame:
    """Records per group by fixed weights, rounded half to even, at most what there is: ``by, available, target``."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(by)]
    counts = df.filter(F.col(by).isin(list(weights))).groupBy(by).agg(F.count("*").alias("available"))
    return counts.withColumn("target", F.least(F.bround(weight * total, 0), "available").cast("bigint"))


def stride(n: int, target: int, seed: int) -> tuple[int, int]:
    """Step and offset that pick ``target`` of ``n`` rows evenly."""
    if not 0 < target <= n:
        raise ValueError(f"can't take {target} of {n} rows")
    step = max(1, n // target)
    return step, seed % step


def stride_sample(df: DataFrame, id: str, targets: DataFrame, by: str, seed: int) -> DataFrame:
    """``target`` evenly spaced rows of each group in the order of ``id``; groups without a target give none.

    ``targets``: ``by, available, target``, one row per group (small).  The rows' places come from bucketed ranks, so a
    group may be any part of the data.  A group with fewer rows than its ``available`` says comes out short; ``missed``
    tells, and ``selection`` refuses.
    """
    wanted = targets.filter("target > 0").select(F.col(by).alias("_by"), "available", "target")
    placed = ranked(df, [by], id, [], "_at").join(wanted, F.col(by) == F.col("_by"))
    step = F.greatest(F.lit(1), F.floor(F.col("available") / F.col("target")))
    hit = (F.col("_at") - F.lit(seed) % step)
    return placed.filter((hit >= 0) & (hit % step == 0) & (F.floor(hit / step) < F.col("target"))).drop("_by", "available", "target", "_at")


def missed(selected: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """Groups with fewer selected rows than their target: ``by, target, selected``."""
    got = selected.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    met = targets.join(got, F.col(by) == F.col("_by"), "left").select(by, "target", F.coalesce("_n", F.lit(0)).alias("selected"))
    return met.filter("selected < target")


def _reserved(df: DataFrame, id: str, by: str, targets: DataFrame, seed: int, factor: float, extra: int) -> DataFrame:
    """A stride sample with reserve, at most all there is, with ``_target``."""
    reserve = targets.withColumn("_target", F.col("target")).withColumn("target", F.least("available", F.floor(F.col("target") * factor).cast("bigint") + extra))
    wanted = reserve.select(F.col(by).alias("_by"), "_target").filter("_target > 0")
    return stride_sample(df, id, reserve, by, seed).join(wanted, F.col(by) == F.col("_by")).drop("_by")


def gated_sample(df: DataFrame, id: str, by: str, targets: DataFrame, fits: Column, seed: int, factor: float = 1.15, extra: int = 5) -> DataFrame:
    """A stride sample with reserve (``factor`` times the target and ``extra``), of which rows that don't fit are dropped and the first ``target`` kept."""
    kept = _reserved(df, id, by, targets, seed, factor, extra).filter(F.coalesce(fits, F.lit(False)))
    return ranked(kept, [by], id, [], "_at").filter("_at < _target").drop("_target", "_at")


def passed_over(df: DataFrame, id: str, by: str, targets: DataFrame, fits: Column, seed: int, factor: float = 1.15, extra: int = 5) -> DataFrame:
    """``by, n``: rows that ``gated_sample`` meets before it has its target and drops as they don't fit."""
    ok = F.coalesce(fits, F.lit(False))
    met = running(_reserved(df, id, by, targets, seed, factor, extra), [by], id, [], ok.cast("int"), "_kept")
    return met.filter(~ok & (F.col("_kept") < F.col("_target"))).groupBy(by).agg(F.count("*").alias("n"))


def quota_prefix(df: DataFrame, by: str, order: str, tokens: Column, quota: int) -> DataFrame:
    """Rows of each group, in order, while the tokens before them are below the quota."""
    return running(df, [by], order, [], tokens, "_before").filter(F.col("_before") < quota).drop("_before")


def shuffled(df: DataFrame, id: Column, seed: int, epoch: int, out: str = "position") -> DataFrame:
    """``df`` with each row's position in the epoch's order: by a hash of seed, epoch and id."""
    keyed = df.withColumn("_hash", digest(F.lit(str(seed)), F.lit(str(epoch)), id))
    return ranked(keyed, [], "_hash", [], out).drop("_hash")


def round_robin(df: DataFrame, order: str, slots: list[str], out: str) -> DataFrame:
    """``df`` with the slots dealt in turn, in order."""
    dealt = ranked(df, [], order, [], "_at")
    return dealt.withColumn(out, F.element_at(F.array(*[F.lit(s) for s in slots]), (F.col("_at") % len(slots) + 1).cast("int"))).drop("_at")


def augmented(df: DataFrame, id: str, text: str, allowed: Column, frames: list[str], variants: int) -> DataFrame:
    """``df`` with ``variants`` reframed copies of each allowed row, told apart by ``variant`` (0 for the original).

    A copy's frame (a pattern with ``%s``) is chosen by a hash of id and variant, its id is a hash of both.
    """
    copies = df.withColumn("variant", F.explode(F.when(F.coalesce(allowed, F.lit(False)), F.sequence(F.lit(0), F.lit(variants))).otherwise(F.array(F.lit(0)))))
    key = F.concat_ws(":", F.col(id), F.col("variant").cast("string"))
    frame = F.element_at(F.array(*[F.lit(f) for f in frames]), (F.pmod(F.conv(F.substring(F.sha2(key, 256), 57, 8), 16, 10).cast("bigint"), F.lit(len(frames))) + 1).cast("int"))
    copy = F.col("variant") > 0
    return copies.withColumn(text, F.when(copy, F.replace(frame, F.lit("%s"), F.col(text))).otherwise(F.col(text))).withColumn(id, F.when(copy, F.substring(F.sha2(key, 256), 1, 24)).otherwise(F.col(id)))

