import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm.calibrate import calibrated, pivotal, proportional_sample, sample_report
from corpusforge.llm import calibrate, splits
from corpusforge.llm.splits import choose, grouped_split, shares_of, torn

SHARES = {"train": 0.9, "validation": 0.05, "test": 0.05}


def table(spark, n, seed, hot=0.3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        family = "hot" if r.random() < hot else r.choice([None, *[f"f{x}" for x in range(n // 4)]])
        template = r.choice([None, None, f"t{r.randrange(n)}", f"t{r.randrange(n)}"])
        rows.append((f"e{k:05d}", family, template, r.choice(["train", "train", "test", None])))
    rows += [rows[0], rows[1], (None, "hot", "t0", "test"), ("alone", None, None, "test"), ("two", "f1", None, "train"), ("two", None, "t5", "train")]
    return rows, spark.createDataFrame(rows, "root string, component string, size string, split string")


def roots(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, f, t, _ in rows:
        for v in (("f", f), ("t", t)):
            if v[1] is not None:
                parent[root(v)] = root(("id", i))
    return root


def test_related_records_stay_together(spark):
    rows, df = table(spark, 800, 1)
    out = grouped_split(df, "root", ["component", "size"], SHARES, "split").collect()
    assert {r["root"] for r in out} == {r[0] for r in rows if r[0]}
    root = roots([r for r in rows if r[0]])
    splits = defaultdict(set)
    for r in out:
        splits[root(("id", r["root"]))].add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    sizes = {s: len({r["root"] for r in out if r["split"] == s}) for s in SHARES}
    total = sum(sizes.values())
    assert abs(sizes["test"] - 0.05 * total) <= 1 and abs(sizes["validation"] - 0.05 * total) <= 1


def test_split_does_not_depend_on_partitions(spark):
    _, df = table(spark, 200, 2)
    a, b = (set(map(tuple, grouped_split(df.repartition(k), "root", ["component", "size"], SHARES).collect())) for k in (1, 7))
    assert a == b


def test_no_rows_and_no_shares(spark):
    _, df = table(spark, 50, 3)
    assert grouped_split(df.limit(0), "root", ["component", "size"], SHARES).count() == 0
    assert grouped_split(df, "root", ["component", "size"], {}).count() == 0
    assert torn(df.limit(0), ["component", "size"], "split").count() == 0


def test_torn_equals_brute_force(spark):
    rows, df = table(spark, 400, 4, hot=0.02)
    rows = [(f"{k}", *r[1:]) for k, r in enumerate(rows)]
    root = roots(rows)
    splits = defaultdict(set)
    for i, f, t, s in rows:
        if s and (f or t):
            splits[root(("id", i))].add(s)
    want = {f for i, f, _, _ in rows if f and len(splits[root(("id", i))]) > 1}
    found = torn(df, ["component", "size"], "split")
    assert found.columns == ["component"] and {r[0] for r in found.collect()} == want


@pytest.mark.parametrize("seed", range(5))
def test_choice_is_as_close_as_any(seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(6)}
    items = [s for s, n in histogram.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums}
    picked = choose(histogram, {"a": 0.8, "b": 0.2})
    got = sum(s * n for s, n in picked["b"].items())
    assert abs(got - 0.2 * sum(items)) == min(abs(s - 0.2 * sum(items)) for s in sums)
    assert all(picked["a"].get(s, 0) + picked["b"].get(s, 0) == n for s, n in histogram.items())


def test_pivotal_keeps_probabilities():
    p = np.array([0.3, 0.9, 0.5, 0.2, 0.1, 1.0, 0.0, 0.7, 0.3])
    draws = np.array([pivotal(p, seed) for seed in range(6000)])
    assert np.allclose(draws.mean(axis=0), p, atol=0.03)
    assert np.allclose(draws.sum(axis=1), p.sum())
    assert ((draws > 1e-9) & (draws < 1 - 1e-9)).sum(axis=1).max() <= 1


def population(spark, n, seed):
    r = random.Random(seed)
    names = ["big"] * 6 + ["mid"] * 3 + ["small", None]
    rows = [(f"i{k:05d}", r.choice(names), r.randrange(5, 90), "x") for k in range(n)] + [("iz", "tiny", 40, "x"), ("iy", "tiny", None, "x")]
    return rows, spark.createDataFrame(rows, "id string, category string, tokens int, p string")


TARGETS = [("c1", "big", 30000.0, 50), ("c1", "mid", 5000.0, 50), ("c1", "small", 800.0, 60), ("c1", "tiny", 500.0, 3), ("c1", "none", 10.0, 1), ("c2", "big", 1000.0, 40), ("c2", "mid", 9e9, 5)]


def test_sample_meets_targets(spark):
    rows, df = population(spark, 4000, 5)
    targets = spark.createDataFrame([(*t, 0.5) for t in TARGETS], "config_id string, category string, want_tokens double, floor_examples int, eta double")
    out = proportional_sample(df, targets).collect()
    assert len({(r["config_id"], r["id"]) for r in out}) == len(out)
    got = defaultdict(lambda: [0, 0])
    for r in out:
        got[r["config_id"], r["category"]][0] += r["tokens"]
        got[r["config_id"], r["category"]][1] += 1
    assert abs(got["c1", "big"][0] / 30000 - 1) < 0.01 and abs(got["c1", "mid"][0] / 5000 - 1) < 0.03
    assert got["c1", "small"][1] in (60, 61) and abs(got["c1", "small"][0] / 800 - 1) < 0.25  # the floor tilts to short records
    assert got["c1", "tiny"] == [40, 2] and ("c1", "none") not in got
    assert got["c2", "big"][1] == 40 and got["c2", "mid"][1] == sum(1 for r in rows if r[1] == "mid")
    again = proportional_sample(df.repartition(5), targets).collect()
    assert set(map(tuple, again)) == set(map(tuple, out))
    gaps = {(r["config_id"], r["category"]): (r["short_tokens"], r["short_examples"]) for r in sample_report(df, targets).collect()}
    assert gaps["c1", "tiny"] == (True, True) and gaps["c1", "none"] == (True, True) and gaps["c2", "mid"] == (True, False) and gaps["c1", "big"] == (False, False)


@pytest.mark.parametrize("part", [100, 12])
def test_parts_of_large_categories(spark, monkeypatch, part):
    monkeypatch.setattr(calibrate, "PART", part)
    _, df = population(spark, 3000, 6)
    targets = spark.createDataFrame([("c", "big", 20000.0, 10)], "config_id string, category string, want_tokens double, floor_examples int")
    out = proportional_sample(df, targets)
    assert abs(out.agg(F.sum("tokens")).first()[0] / 20000 - 1) < 0.02


def test_gaps_come_from_the_draw(spark, monkeypatch):
    """A draw that takes nothing finds no gap where there are records, as no category was drawn whole."""
    _, df = population(spark, 300, 8)
    targets = spark.createDataFrame([("c", "big", 9e9, 5), ("c", "none", 1.0, 1)], "config_id string, category string, want_tokens double, floor_examples int")
    short = lambda: {r["category"] for r in sample_report(df, targets).filter("short_tokens").collect()}
    assert short() == {"big", "none"}
    broken = lambda *a: [r | {"eta": -50.0} for r in calibrated(*a)]
    monkeypatch.setattr(calibrate, "calibrated", broken)
    assert short() == {"none"}


def test_targets_that_do_not_converge_are_told(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "ROUNDS", 1)
    _, df = population(spark, 4000, 5)
    targets = spark.createDataFrame(TARGETS[:1], "config_id string, category string, want_tokens double, floor_examples int")
    assert sample_report(df, targets).first()["reason"] == "unconverged"


@pytest.mark.parametrize("histogram", [{s: 2300 for s in range(30, 3030)}, {s: 60 for s in range(30, 3030)}])
def test_splits_of_many_records_are_exact(histogram):
    total = sum(s * n for s, n in histogram.items())
    picked = choose(histogram, SHARES)
    for split in ("test", "validation"):
        assert abs(sum(s * n for s, n in picked[split].items()) - 0.05 * total) <= 0.5
    assert all(sum(p.get(s, 0) for p in picked.values()) == n for s, n in histogram.items())


@pytest.mark.parametrize("seed", range(4))
def test_choice_beyond_the_reach(monkeypatch, seed):
    """With a reach of a few records the totals stay as close as a small component."""
    monkeypatch.setattr(splits, "REACH", 30)
    r = random.Random(seed)
    histogram = {r.randrange(1, 20): r.randrange(20, 40) for _ in range(8)} | {500: 1, 90: 2}
    total = sum(s * n for s, n in histogram.items())
    picked = choose(histogram, {"a": 0.7, "b": 0.2, "c": 0.1})
    for split, share in (("b", 0.2), ("c", 0.1)):
        assert abs(sum(s * n for s, n in picked[split].items()) - share * total) <= min(histogram)
    assert all(sum(p.get(s, 0) for p in picked.values()) == n for s, n in histogram.items())


def test_one_component_that_fits_nowhere():
    assert choose({10**9: 1, 1: 3}, {"a": 0.5, "b": 0.5})["a"] in ({1: 3}, {10**9: 1})
    assert choose({}, SHARES)["test"] == {}


def test_broken_shares_are_refused(spark):
    make = lambda *rows: spark.createDataFrame(rows, "split string, target_share double")
    assert shares_of(make(("a", 0.25), ("b", 0.75)), "split", "target_share") == {"a": 0.25, "b": 0.75}
    for rows in ([("a", 0.5)], [("a", 0.5), ("a", 0.5)], [("a", -0.5), ("b", 1.5)], [(None, 1.0)], [("a", None)], [(f"s{k}", 1 / 1200) for k in range(1200)]):
        with pytest.raises(ValueError):
            shares_of(make(*rows), "split", "target_share")


def test_empty_population(spark):
    _, df = population(spark, 10, 7)
    targets = spark.createDataFrame(TARGETS, "config_id string, category string, want_tokens double, floor_examples int")
    assert proportional_sample(df.limit(0), targets).count() == 0
    assert proportional_sample(df, targets.limit(0)).count() == 0
    assert sample_report(df.limit(0), targets).filter("short_tokens and short_examples").count() == len(TARGETS)
