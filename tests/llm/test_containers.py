import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.words import PUNCT_TOKEN, token_count
from corpusforge.llm.mix import mixed, pfair
from corpusforge.llm.pack import batches, bucket_bounds, packed
from corpusforge.llm.pieces import merged, pieces

DATA = "/root/testdata/sf0.001"


def test_tokens_equal_the_pattern(spark):
    odd = ["a_b-c...d", "x y​z", "‍́é ½ ١", "!!?? ..", "", " \t\x1c\x85", "日本語 text", None]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = dict(map(tuple, spark.createDataFrame(rows, "k bigint, t string").select("k", token_count(F.col("t"))).collect()))
    assert found == {k: len(PUNCT_TOKEN.findall(t or "")) for k, t in rows}


def test_bounds_have_the_least_padding():
    r = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 40), 8)))
        counts = np.array([r.randrange(1, 9) for _ in lengths])

        def cost(bounds):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths.tolist(), counts.tolist()))

        from itertools import combinations

        best = min(cost([*c, int(lengths[-1])]) for c in combinations(lengths[:-1].tolist(), 2))
        assert cost(bucket_bounds(lengths, counts, 3)) == best


def test_many_lengths_are_bounded():
    lengths = np.arange(1, 9001)
    bounds = bucket_bounds(lengths, np.ones(9000, np.int64), 50)
    assert len(bounds) <= 50 and bounds[-1] == 9000


def test_more_lengths_than_4096_still_have_the_least_padding():
    for seed in range(4):
        r = np.random.default_rng(seed)
        lengths = np.sort(r.choice(200_000, 9000, replace=False)) + 1
        counts = r.integers(1, 50, 9000) ** 2
        n, s = np.cumsum(counts), np.cumsum(counts * lengths)
        split = lengths * n + lengths[-1] * (n[-1] - n) - s[-1]  # padding with this length and the last as bounds
        low, high = bucket_bounds(lengths, counts, 2)
        assert high == lengths[-1] and split[np.searchsorted(lengths, low)] == split.min()


def test_batches_place_every_item_once():
    plan, n = batches([3, 5, 9], [10, 7, 4], 10)
    seen, load = Counter(), Counter()
    for k, a, b, per, first in plan:
        for rank in range(a, b):
            seen[k, rank] += 1
            load[first + (rank - a) // per] += [3, 5, 9][k]
    assert sum(seen.values()) == 21 and max(seen.values()) == 1 and max(load.values()) <= 10 and set(load) == set(range(n))


def test_packed(spark):
    r = random.Random(2)
    rows = [(k, r.choice([0, 1, 7, 30, 60, 99, 100, 101, 250, 1000]), "x") for k in range(500)] + [(1000, None, "x"), (None, 40, "x"), (5, 60, "x"), (5, 60, "x")]
    df = spark.createDataFrame(rows, "doc int, n int, container string")
    limits = spark.createDataFrame([("a", 100), ("b", 333), ("bad", 0), ("null", None)], "spec_id string, max_tokens int")
    out = packed(df, "doc", F.coalesce("n", F.lit(0)), limits).collect()
    for spec, cap in (("a", 100), ("b", 333)):
        own = [x for x in out if x["spec_id"] == spec]
        load = Counter()
        for x in own:
            load[x["container"]] += x["tokens"]
            assert x["tokens"] <= x["bound"] <= cap
        assert max(load.values()) <= cap
        assert sum(load.values()) == sum(n or 0 for _, n, _ in rows)
        assert {x["id"] for x in own if x["oversize"]} == {k for k, n, _ in rows if n and n > cap}
        parts = Counter(x["id"] for x in own)
        want = Counter()
        for k, n, _ in rows:
            want[k] += max(1, -(-(n or 0) // cap))
        assert parts == want
        assert sum(load.values()) / (cap * len([c for c, n in load.items() if n])) > 0.9
    assert packed(df.limit(0), "doc", F.col("n"), limits).count() == 0
    assert packed(df, "doc", F.col("n"), limits.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, {"a": 100, "b": 1, "c": 0}, {k: 7 for k in "abcdefg"}])
def test_pfair_stays_within_one_block(blocks):
    slots = pfair(blocks)
    total = sum(blocks.values())
    assert sorted(s for of in slots.values() for s in of) == list(range(total))
    for name, n in blocks.items():
        assert len(slots[name]) == n
        for t in range(total + 1):
            assert abs(sum(s < t for s in slots[name]) - n / total * t) < 1


def test_mixed(spark):
    r = random.Random(3)
    rows = [(k, r.choice(["big"] * 8 + ["small"]), r.randrange(0, 60), "x") for k in range(900)] + [(9000, None, 10, "x"), (9001, "other", 10, "x"), (None, "big", 20, "x"), (7, "big", 30, "x"), (7, "big", 30, "x")]
    df = spark.createDataFrame(rows, "slot int, source string, n int, mix_id string")
    mixture = spark.createDataFrame([("m", "big", 0.5, 1, 8000), ("m", "small", 0.4, 3, 8000), ("m", "gone", 0.1, 5, 8000), ("q", "small", 1.0, 9, 100), ("q", None, 0.0, 1, 100)], "mix_id string, source string, target_share double, max_repeats int, total_tokens bigint")
    chosen, report = mixed(df, "slot", F.col("source"), F.col("n"), mixture)
    rows_, shares = chosen.collect(), {(x["mix_id"], x["source"]): x for x in report.collect()}
    total = {s: sum(n for _, x, n, _ in rows if x == s) for s in ("big", "small")}
    assert abs(shares["m", "big"]["chosen_tokens"] - 4000) <= 60
    assert abs(shares["m", "small"]["chosen_tokens"] - min(3200, 3 * total["small"])) <= 60
    assert shares["m", "small"]["short"] == (3 * total["small"] < 3200) and shares["m", "gone"]["short"] and not shares["q", "small"]["short"]
    assert abs(sum(x["actual_share"] for k, x in shares.items() if k[0] == "m") - 1) < 1e-9
    most = Counter((x["source"], x["repeat"]) for x in rows_ if x["mix_id"] == "m")
    assert max(k for s, k in most if s == "small") <= 2 and {k for s, k in most if s == "big"} == {0}
    for source in ("big", "small"):
        own = sorted(x["start"] for x in rows_ if x["mix_id"] == "m" and x["source"] == source)
        slots = [x["slot"] for x in sorted(rows_, key=lambda x: x["start"]) if x["mix_id"] == "m" and x["source"] == source]
        assert len(set(own)) == len(own) and slots == sorted(slots)
    assert mixed(df.limit(0), "slot", F.col("source"), F.col("n"), mixture)[0].count() == 0
    assert mixed(df, "slot", F.col("source"), F.col("n"), mixture.limit(0))[1].count() == 0


def test_shortage_is_read_from_the_schedule(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", 10) for k in range(100)], "id int, source string, n int")
    mixture = spark.createDataFrame([("m", "a", 0.5, 2, 1990), ("m", "b", 0.5, 2, 2010), ("m", "gone", 0.1, 1, 100)], "mix_id string, source string, target_share double, max_repeats int, total_tokens bigint")
    found = mixed(df, "id", F.col("source"), F.col("n"), mixture)[1].filter("short").select("mix_id", "source")
    assert {r["source"] for r in found.collect()} == {"b", "gone"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and "_before" in plan


def test_texts_longer_than_a_target_come_last(spark):
    df = spark.createDataFrame([(k, "a", n) for k, n in enumerate([1003, 126, 61, 900, 2000, 700])] + [(9, "only", 500)], "id int, source string, n int")
    mixture = spark.createDataFrame([("m", "a", 1.0, 1, 182), ("big", "a", 1.0, 1, 4000), ("m", "only", 1.0, 1, 182), ("m2", "only", 1.0, 2, 900)], "mix_id string, source string, target_share double, max_repeats int, total_tokens bigint")
    chosen, report = mixed(df, "id", F.col("source"), F.col("n"), mixture)
    rows, got = chosen.collect(), {(r["mix_id"], r["source"]): r["chosen_tokens"] for r in report.collect()}
    assert {r["id"] for r in rows if (r["mix_id"], r["source"]) == ("m", "a")} == {1, 2} and got["m", "a"] == 187
    assert abs(got["big", "a"] - 4000) <= 1000 and got["m", "only"] == 0 and got["m2", "only"] == 1000
    starts = sorted((r["start"], r["tokens"]) for r in rows if r["mix_id"] == "big")
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_merging_keeps_strong_boundaries():
    # two paragraphs of three sentences: the weakest boundaries go first
    assert merged(12, {2: 1, 4: 1, 6: 3, 8: 1, 10: 1}, 6, 0) == [0, 6]
    assert merged(30, {}, 10, 2) == [0, 8, 16, 24] or merged(30, {}, 10, 2)[0] == 0
    assert merged(9, {3: 1, 6: 1}, 9, 0) == [0]


def test_pieces(spark):
    r = random.Random(4)

    def text(n):
        return "".join(r.choice(["w", "word", "x1"]) + r.choice([" ", " ", " ", ". ", "! ", ".\n", "\n\n", ", ", "\r\n", ". "]) for _ in range(n))

    rows = [(k, text(r.choice([3, 30, 200, 900]))) for k in range(60)] + [(100, None), (101, ""), (102, "no pause " * 300), (103, "!" * 5000), (104, "a. " * 40000), (0, "rep. " * 100)]
    df = spark.createDataFrame([(*x, "y", 1) for x in rows], "doc int, text string, spec_id string, piece int")
    limits = spark.createDataFrame([("s", 50, 5), ("t", 200, None), ("u", 10, 99), ("bad", None, 1)], "spec_id string, max_tokens int, overlap_tokens int")
    out = defaultdict(list)
    for x in pieces(df, "doc", "text", limits).collect():
        out[x["spec_id"], x["id"]].append(x)
    for spec, most, overlap in (("s", 50, 5), ("t", 200, 0), ("u", 10, 9)):
        for k, t in rows:
            spans = [m.span() for m in PUNCT_TOKEN.finditer(t or "")]
            own = sorted(out.get((spec, k), []), key=lambda x: x["piece"])
            if k == 0:
                continue
            assert bool(own) == (len(spans) > most)
            if not own:
                continue
            assert [x["piece"] for x in own] == list(range(len(own))) and sum(x["own_tokens"] for x in own) == len(spans)
            at = 0
            for x in own:
                assert x["n_tokens"] <= most and x["text"] == t[x["start"] : x["end"]]
                assert x["n_tokens"] - x["own_tokens"] == (min(overlap, at) if x["piece"] else 0)
                assert x["start"] == spans[at - (x["n_tokens"] - x["own_tokens"])][0]
                at += x["own_tokens"]
                if x["ends_at"] == "pause":
                    gap = t[spans[at - 1][0] : spans[at][0]]
                    assert re.search(r"[\r\n]|[.!?]\s", gap)
            stretches = re.split(r"[\r\n]|(?<=[.!?])\s", t)
            inside = max(len(PUNCT_TOKEN.findall(s)) for s in stretches) > most
            assert {x["cut_kind"] for x in own} == {"inside" if inside else "boundary"}
    assert pieces(df.limit(0), "doc", "text", limits).count() == 0
    assert pieces(df, "doc", "text", limits.limit(0)).count() == 0
