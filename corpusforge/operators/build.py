"""Building a corpus: the stages that only look at rows, and the fold whose limits look at what was accepted before."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.exact import verified
from corpusforge.functions.text import normalized
from corpusforge.operators.dedup import capped
from corpusforge.plans.stage import staged
from corpusforge.schema import example_rules, violations

REASONS = ["schema_invalid", "ground_truth_mismatch", "diversity_cap", "exact_duplicate", "near_duplicate", "exceeds_context", "accepted"]


def ground_truth(df: DataFrame) -> DataFrame:
    """``df`` with ``truth``: ``ok``, ``mismatch`` or ``error`` by the record's mode of verification.

    Deterministic records are computed, tool records need a trace, semantic ones hold; any other mode mismatches.
    """
    checked = df.withColumn("_exact", verified(F.col("verification.expression"), F.col("answer_json"), F.col("tolerance")))
    mode = F.col("verification.mode")
    traced = F.when(F.coalesce(F.size("tool_traces"), F.lit(0)) > 0, "ok").otherwise("mismatch")
    return checked.withColumn("truth", F.when(mode == "deterministic", F.col("_exact")).when(mode == "tool", traced).when(mode == "semantic", "ok").otherwise("mismatch")).drop("_exact")


def examined(df: DataFrame) -> DataFrame:
    """``df`` with its prompts normalized and ``reject``, the first reason that needs no other row, null for none.

    ``schema_invalid`` where nothing is left of the prompt or a rule is broken, then ``ground_truth_mismatch``.
    """
    checked = ground_truth(violations(df.withColumn("prompt", normalized(F.col("prompt"))), example_rules(), "_broken"))
    reject = F.when(F.size("_broken") > 0, "schema_invalid").when(F.col("truth") != "ok", "ground_truth_mismatch")
    return checked.withColumn("reject", reject).drop("_broken", "truth")


def accept(df: DataFrame, by: str, order: str, columns: dict[str, str], template_share: float, family_tokens: int | Column, quota: int | Column, shape_cap: int, context: int, grace: int = 30) -> DataFrame:
    """The build's decision on each candidate, in order: ``by, order, decision`` (one of ``REASONS``, or ``beyond_quota``).

    A template may hold ``template_share`` of its family once that has ``grace`` accepted rows; then exact keys and
    shapes (at most ``shape_cap`` per family) are checked, and both are remembered even for rows rejected later; then
    length, and the family's tokens.  All counts are of rows accepted so far, so a group is one sequential fold over
    thin rows - ids, counts and 16 bytes of each key's and shape's hash, no texts; ``by`` (a category) is what may run
    in parallel.  Families count within their group; exact keys hold across groups, which come in the order of ``by``
    (null first): all groups are folded as if they shared no key, then those again that have a key an earlier group
    remembered, until nothing changes - after n rounds the first n groups are settled, mostly all after two or three.
    ``columns`` names the frame's ``family, template, exact_key, shape, tokens, reject`` columns; ``reject`` is a
    reason found before (null for none).  Nulls are values of their own, null tokens count 0.  ``family_tokens`` and
    ``quota`` may be columns with one value in each group; null is no limit.  Optional columns ``reserved`` (boolean: the
    exact key is another set's) and ``seeded`` (how often the family's shape counts as met before) come from ``seeded``.
    """
    names = ["family", "template", "exact_key", "shape", "tokens", "reject", "reserved", "seeded"]
    given = {n: F.col(columns[n]) if n in columns else F.lit(0 if n == "seeded" else False) for n in names}
    given |= {n: F.substring(F.unhex(F.sha2(given[n].cast("string"), 256)), 1, 16) for n in ("exact_key", "shape")}
    given |= {n: (c if isinstance(c, Column) else F.lit(c)).cast("long") for n, c in (("family_tokens", family_tokens), ("quota", quota))}
    thin = staged(df.select(F.col(by).alias("by"), F.col(order).alias("order"), *[c.alias(n) for n, c in given.items()]))

    def fold(rows: pd.DataFrame, across: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        family_n, template_n, family_t, shapes = {}, {}, {}, {}
        seen, shared = set(across["exact_key"][across["taken"]]), set(across["exact_key"])
        most, family_most = (math.inf if pd.isna(rows[n].iloc[0]) else int(rows[n].iloc[0]) for n in ("quota", "family_tokens"))
        total, decisions, kept = 0, [], []
        for family, template, key, shape, tokens, reject, reserved, before in zip(*(rows[n] for n in names)):
            tokens = 0 if pd.isna(tokens) else int(tokens)
            kept.append(False)
            if total >= most:
                decisions.append("beyond_quota")
                continue
            if reject is not None and not pd.isna(reject):
                decisions.append(reject)
                continue
            n, t = family_n.get(family, 0), template_n.get((family, template), 0)
            if n >= grace and (t + 1) / (n + 1) > template_share:
                decisions.append("diversity_cap")
                continue
            if reserved or key in seen:
                decisions.append("exact_duplicate")
                continue
            seen.add(key)
            kept[-1] = key in shared
            if shapes.get((family, shape), before) >= shape_cap:
                decisions.append("near_duplicate")
                continue
            shapes[family, shape] = shapes.get((family, shape), before) + 1
            if tokens > context:
                decisions.append("exceeds_context")
                continue
            if family_t.get(family, 0) + tokens > family_most:
                decisions.append("diversity_cap")
                continue
            family_n[family], template_n[family, template], family_t[family] = n + 1, t + 1, family_t.get(family, 0) + tokens
            total += tokens
            decisions.append("accepted")
        remembered = [k if x else None for k, x in zip(rows["exact_key"], kept)]
        return pd.DataFrame({"by": rows["by"].astype(object), "order": rows["order"].astype(object), "decision": decisions, "exact_key": remembered, "kept": kept})

    schema = T.StructType([thin.schema["by"], thin.schema["order"], T.StructField("decision", T.StringType()), thin.schema["exact_key"], T.StructField("kept", T.BooleanType())])
    groups = thin.groupBy("exact_key").agg(F.collect_set(F.struct("by")).alias("groups")).filter(F.size("groups") > 1)
    across = staged(groups.select("exact_key", F.inline("groups"), F.lit(False).alias("taken")))
    part, known, done = thin, across, None
    while True:
        met = part.groupBy("by").cogroup(known.groupBy("by")).applyInPandas(fold, schema)
        done = staged(met) if done is None else done.join(again, F.col("by").eqNullSafe(F.col("_by")), "left_anti").unionByName(staged(met))
        firsts = done.filter("kept").groupBy(F.col("exact_key").alias("_key")).agg(F.min(F.struct("by")).alias("_first"))
        taken = F.coalesce(F.col("_first") < F.struct("by"), F.lit(False))
        across = staged(across.join(firsts, F.col("exact_key").eqNullSafe(F.col("_key")), "left").select("exact_key", "by", F.col("taken").alias("before"), taken.alias("taken")))
        again = across.filter("taken != before").select(F.col("by").alias("_by")).distinct()
        if again.isEmpty():
            return done.select("by", "order", "decision").withColumnsRenamed({"by": by, "order": order})
        part, known = (x.join(again, F.col("by").eqNullSafe(F.col("_by")), "left_semi") for x in (thin, across))


def seeded(df: DataFrame, family: str, exact_key: str, shape: str, reserved: DataFrame) -> DataFrame:
    """``df`` with ``reserved`` and ``seeded`` for ``accept``: evaluation records were there first.

    ``reserved``: their ``exact_key``, and ``family, shape`` pairs, each of which counts as one occurrence.  Nulls are
    values of their own.
    """
    keys = reserved.select(F.col("exact_key").alias("_k")).distinct().withColumn("reserved", F.lit(True))
    shapes = reserved.select(F.col("family").alias("_f"), F.col("shape").alias("_s")).distinct().withColumn("seeded", F.lit(1))
    met = df.join(keys, F.col(exact_key).eqNullSafe(F.col("_k")), "left").join(shapes, F.col(family).eqNullSafe(F.col("_f")) & F.col(shape).eqNullSafe(F.col("_s")), "left")
    return met.withColumns({"reserved": F.coalesce("reserved", F.lit(False)), "seeded": F.coalesce("seeded", F.lit(0))}).drop("_k", "_f", "_s")


def funnel(df: DataFrame, decision: str, by: list[str] = [], beyond: bool = False) -> DataFrame:  # noqa: B006
    """Rows per decision, a column for each reason and ``generated`` for all but those beyond a quota, which ``beyond`` counts in ``beyond_quota``."""
    counts = [F.count_if(F.col(decision) == r).alias(r if r == "accepted" else f"rejected_{r}") for r in REASONS]
    past = F.col(decision) == "beyond_quota"
    return df.groupBy(*by).agg(F.count_if(~past).alias("generated"), *counts, *([F.count_if(past).alias("beyond_quota")] if beyond else []))


def shortfalls(df: DataFrame, by: str, tokens: Column, targets: DataFrame, share: float = 0.9) -> DataFrame:
    """Groups with fewer tokens than ``share`` of their target: ``by, target_tokens, tokens``; a group without rows has 0."""
    have = df.groupBy(F.col(by).alias("_by")).agg(F.sum(F.coalesce(tokens, F.lit(0))).alias("_tokens"))
    met = targets.join(have, F.col(by) == F.col("_by"), "left").withColumn("tokens", F.coalesce("_tokens", F.lit(0)))
    return met.filter(F.col("tokens") < share * F.col("target_tokens")).select(by, "target_tokens", "tokens")


def build(df: DataFrame, family: Column, exact_key: Column, text: Column, shape: Column, tokens: Column, order: list[str], shape_cap: int, context: int) -> DataFrame:
    """The build without limits on shares: each row's decision by set operations alone, at any size.

    ``df`` with ``decision``: first row of an exact key, then the first ``shape_cap`` of a shape within a family, then
    the length; a null text is ``schema_invalid``.  Rows that agree in the whole order are decided alike.
    First rows and shapes within the cap are found by aggregates that drop the others before the shuffle, and rows meet
    them by their own place in the order, so a key or shape may hold any share of the rows.
    """
    thin = {"_key": exact_key, "_family": family, "_shape": F.xxhash64(shape), "_shape2": F.md5(shape), "_n": tokens, "_null": text.isNull(), "_o": F.struct(*order)}
    keyed = staged(df.withColumns(thin))
    firsts = keyed.filter("not _null").groupBy("_key").agg(F.min("_o").alias("_o")).select("_o")
    new = keyed.filter("not _null").join(firsts, "_o", "left_semi")
    within = capped(new.select("_o", "_family", "_shape", "_shape2").distinct(), [F.col("_family"), F.col("_shape"), F.col("_shape2")], ["_o"], shape_cap)
    known = firsts.select(F.col("_o").alias("_f"), F.lit(True).alias("_new")).join(within.select(F.col("_o").alias("_w"), F.lit(True).alias("_kept")), F.col("_f") == F.col("_w"), "left")
    met = keyed.join(known, F.col("_o") == F.col("_f"), "left")
    decision = F.when(F.col("_null"), "schema_invalid").when(F.col("_new").isNull(), "exact_duplicate").when(F.col("_kept").isNull(), "near_duplicate")
    decided = met.withColumn("decision", decision.when(F.coalesce("_n", F.lit(0)) > context, "exceeds_context").otherwise("accepted"))
    return decided.drop(*thin, "_f", "_new", "_w", "_kept")
