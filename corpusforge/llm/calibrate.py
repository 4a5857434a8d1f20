"""Samples that match target category proportions: problem 5.

Inclusion probabilities tilt the odds of a uniform draw exponentially in (1, tokens) so that each category meets its
token target and its number of examples.  The dual is solved by Newton's method; the categories' moments are summed
by Spark over the histogram of (category, tokens), the driver holds two numbers per target.  The sample itself is
drawn by the pivotal method: probabilities fight in pairs until one is 0 or 1, in parts of a category of at most some
``PART`` units first, then the parts' last open units in parts of their own, until one part is left.  Gaps are read off
the sample: a target is missed for good where all records of its category were drawn and don't reach it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusforge.plans.stage import staged

PART = 20_000
ROUNDS = 60
TARGETS = 100_000


def calibrated(histogram: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target the tilt ``eta, slope, mean, sd`` of the odds, what it should draw, and ``reason`` where it can't be met.

    ``histogram``: ``category, tokens, n``.  All records are taken where tokens or examples are short or just enough;
    where even the shortest ``floor_examples`` records exceed the tokens, the floor is kept and the tokens given up.
    A target that Newton's method hasn't met after ``ROUNDS`` rounds has the reason ``unconverged``.
    """
    cells = histogram.withColumnRenamed("category", "_category")
    joined = targets.join(cells, F.col("category") == F.col("_category"), "left")
    before = F.coalesce(F.sum("n").over(_smaller()), F.lit(0))
    base = joined.withColumn("_least", F.greatest(F.lit(0), F.least(F.col("n"), F.col("floor_examples") - before)) * F.col("tokens"))
    n, t = F.col("n"), F.col("tokens")
    sums = {"count": n, "total": n * t, "square": n * t * t, "least": F.col("_least")}
    found = base.groupBy("config_id", "category", "want_tokens", "floor_examples")
    found = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])
    rows = [r.asDict() for r in found.collect()]
    for r in rows:
        n, total, want, floor = r["count"], r["total"], r["want_tokens"], r["floor_examples"]
        r["mean"] = total / n if n else 0.0
        r["sd"] = math.sqrt(max(0.0, r["square"] / n - r["mean"] ** 2)) if n else 0.0
        r |= {"eta": 0.0, "slope": 0.0, "open": False, "reason": None, "examples": n, "tokens": float(total)}
        if n <= floor or total <= want:
            r |= {"eta": math.inf, "reason": "examples" if n < floor else "tokens" if total < want else "floor" if total > want else None}
            continue
        natural = want / r["mean"] if r["mean"] else 0
        r["examples"] = max(floor, math.ceil(natural))
        if r["least"] > want or r["sd"] == 0 or r["examples"] >= n or not natural:
            p = min(r["examples"] / n, 1.0)
            r |= {"tokens": p * total, "eta": math.log(p / (1 - p)) if 0 < p < 1 else math.inf if p else -math.inf, "reason": "floor" if r["least"] > want else None}
            continue
        p = r["examples"] / n
        r |= {"eta": math.log(p / (1 - p)), "open": True}
    spark = histogram.sparkSession
    for _ in range(ROUNDS):
        live = [r for r in rows if r["open"]]
        if not live:
            break
        tilts = [(k, r["category"], r["eta"], r["slope"], r["mean"], r["sd"]) for k, r in enumerate(live)]
        now = spark.createDataFrame(tilts, "target int, category string, eta double, slope double, mean double, sd double")
        z = (F.col("tokens") - F.col("mean")) / F.col("sd")
        p = 1 / (1 + F.exp(-(F.col("eta") + F.col("slope") * z)))
        w = F.col("n") * p * (1 - p)
        moments = {"m0": F.col("n") * p, "m1": F.col("n") * p * z, "h00": w, "h01": w * z, "h11": w * z * z}
        met = now.join(cells, F.col("category") == F.col("_category"))
        for s in met.groupBy("target").agg(*[F.sum(c).alias(name) for name, c in moments.items()]).collect():
            r = live[s["target"]]
            r["tokens"] = s["m1"] * r["sd"] + s["m0"] * r["mean"]
            aim = (r["want_tokens"] - r["examples"] * r["mean"]) / r["sd"]
            g0, g1 = r["examples"] - s["m0"], aim - s["m1"]
            if abs(g0) < 1e-7 and abs(g1) < 1e-5 * max(1.0, r["want_tokens"] / r["sd"]):
                r["open"] = False
                continue
            det = s["h00"] * s["h11"] - s["h01"] ** 2
            if det <= 1e-12 * s["h00"] * s["h11"]:
                d0, d1 = g0 / max(s["h00"], 1e-12), 0.0
            else:
                d0, d1 = (g0 * s["h11"] - g1 * s["h01"]) / det, (g1 * s["h00"] - g0 * s["h01"]) / det
            shrink = min(1.0, 2.0 / max(abs(d0), abs(d1), 1e-12))
            r["eta"], r["slope"] = r["eta"] + shrink * d0, r["slope"] + shrink * d1
    for r in rows:
        if r["open"]:
            r["reason"] = "unconverged"
    return rows


def _histogram(population: DataFrame) -> DataFrame:
    tokens = F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")
    return staged(population.filter("category is not null").groupBy("category", tokens).agg(F.count("*").alias("n")))


def _bounded(targets: DataFrame) -> DataFrame:
    targets = targets.select("config_id", "category", "want_tokens", F.col("floor_examples").cast("int").alias("floor_examples"))
    if targets.limit(TARGETS + 1).count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    return targets


def _smaller() -> WindowSpec:
    return Window.partitionBy("config_id", "category").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)


def pivotal(p: np.ndarray, seed: int) -> np.ndarray:
    """Pivotal sampling in the given order: 1 and 0 for decided units, at most one unit keeps a value between."""
    q = p.tolist()
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(q)).tolist()
    at = None
    for k, b in enumerate(q):
        if not 1e-9 < b < 1 - 1e-9:
            q[k] = float(b > 0.5)
            continue
        if at is None:
            at = k
            continue
        a, u = q[at], draws[k]
        if a + b < 1:
            if u * (a + b) < b:
                q[at], q[k], at = 0.0, a + b, k
            else:
                q[at], q[k] = a + b, 0.0
        elif u * (2 - a - b) < 1 - b:
            q[at], q[k], at = 1.0, a + b - 1, k
        else:
            q[at], q[k] = a + b - 1, 1.0
        if not 1e-9 < q[at] < 1 - 1e-9:
            q[at], at = float(q[at] > 0.5), None
    return np.array(q)


def _fight(last: bool, seed: int):
    def fight(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "order"], kind="stable")
        own = int(rows["order"].iloc[0]) if len(rows) else 0
        p = pivotal(rows["p"].to_numpy(), (own ^ seed) & (2**63 - 1))
        if last:
            draws = np.random.Generator(np.random.PCG64((own + seed) & (2**63 - 1))).random(len(p))
            p = np.where(p == 1, 1.0, np.where(p == 0, 0.0, (draws < p).astype(float)))
        return rows.assign(p=p)[p > 0]

    return fight


def _drawn(population: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, list[dict]]:
    spark = population.sparkSession
    population, targets = population.select("id", "category", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), _bounded(targets)
    rows = calibrated(_histogram(population), targets)
    tilt = spark.createDataFrame(
        [(r["config_id"], r["category"], float(max(-1e3, min(1e3, r["eta"]))), r["slope"], r["mean"], r["sd"] or 1.0, r["count"]) for r in rows],
        "config_id string, _category string, eta double, slope double, mean double, sd double, _n bigint",
    )
    tilt = F.broadcast(tilt)  # at most TARGETS rows
    odds = F.col("eta") + F.col("slope") * (F.col("tokens") - F.col("mean")) / F.col("sd")
    met = population.join(tilt, F.col("category") == F.col("_category"))
    # rounded, as sums in another order give tilts that differ in their last digits
    units = met.withColumn("probability", F.round(1 / (1 + F.exp(-odds)), 10)).withColumn("order", F.xxhash64(F.lit(seed), "config_id", "id"))
    units = units.withColumn("parts", F.ceil(F.col("_n") / PART)).withColumn("part", F.pmod("order", "parts"))
    units = units.select("config_id", "category", "id", "tokens", "probability", "order", "parts", "part", F.col("probability").alias("p"))
    open_ = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    decided = units.filter("p >= 1 - 1e-9")
    left = units.filter(open_)
    most = max((-(-r["count"] // PART) for r in rows), default=1)
    while True:
        last = most <= 1
        fought = left.groupBy("config_id", "category", "part").applyInPandas(_fight(last, seed), units.schema)
        if last:
            return decided.unionByName(fought).select("config_id", "category", "id", "tokens", "probability"), rows
        fought = staged(fought)
        decided, most = decided.unionByName(fought.filter("p = 1")), -(-most // PART)
        left = fought.filter(open_).withColumn("parts", F.ceil(F.col("parts") / PART)).withColumn("part", F.pmod(F.xxhash64("part"), "parts"))


def proportional_sample(population: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """The drawn records: ``config_id, category, id, tokens, probability``.

    ``population``: ``id, category, tokens``, one row per record; ``targets``: ``config_id, category, want_tokens,
    floor_examples``, at most ``TARGETS`` rows.  Null tokens count 0; null categories meet no target.
    A record may be drawn for several configs.  The draw depends on ids, tokens and ``seed`` only, not on the
    cluster.  An empty population or no targets give no rows.
    """
    return _drawn(population, targets, seed)[0]


def sample_report(population: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """What ``proportional_sample`` gives each target, a row per target, and what can't be met.

    ``config_id, category, want_tokens, floor_examples, available_tokens, available_examples, sampled_tokens,
    sampled_examples``, the calibration's ``reason`` (``tokens``, ``examples``, ``floor`` where the floor costs more
    tokens than wanted, ``unconverged``, or null), and ``short_tokens``, ``short_examples``: every record of the
    category was drawn and the tokens or the floor aren't reached.  A category without records has 0.
    """
    sample, rows = _drawn(population, targets, seed)
    told = [(r["config_id"], r["category"], float(r["want_tokens"]), r["floor_examples"], r["total"], r["count"], r["reason"]) for r in rows]
    report = population.sparkSession.createDataFrame(told, "config_id string, category string, want_tokens double, floor_examples int, available_tokens bigint, available_examples bigint, reason string")
    got = sample.groupBy(F.col("config_id").alias("_c"), F.col("category").alias("_k")).agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"))
    met = report.join(got, (F.col("config_id") == F.col("_c")) & (F.col("category") == F.col("_k")), "left").drop("_c", "_k")
    met = met.withColumn("sampled_tokens", F.coalesce("_t", F.lit(0))).withColumn("sampled_examples", F.coalesce("_n", F.lit(0))).drop("_t", "_n")
    whole = F.col("sampled_examples") == F.col("available_examples")
    return met.withColumn("short_tokens", whole & (F.col("sampled_tokens") < F.col("want_tokens"))).withColumn("short_examples", whole & (F.col("sampled_examples") < F.col("floor_examples")))
