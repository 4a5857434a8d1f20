import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.functions.words import clean_name, words
from corpusforge.llm import leaks, queries
from corpusforge.llm.leaks import matches, tile, tilings

DATA = "/root/testdata/sf0.001"


def naive_tiling(text, test, least):
    """Longest common unmarked stretch, marked again and again: the number of covered words by tile length."""
    used_a, used_b, out = [False] * len(text), [False] * len(test), []
    while True:
        best = (0,)
        for i in range(len(text)):
            for j in range(len(test)):
                k = 0
                while i + k < len(text) and j + k < len(test) and text[i + k] == test[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if (k, -j, -i) > (best[0], -best[-1] if len(best) > 1 else 0, -best[1] if len(best) > 1 else 0) and k:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        used_a[i : i + k] = [True] * k
        used_b[j : j + k] = [True] * k


def limited(seeds, size, least):
    """The matches of one text and test that the operator keeps."""
    i, j = (np.array([s[k] for s in seeds], np.int64) for k in (0, 1))
    same = lambda v: np.full(len(seeds), v, np.int64)
    return list(zip(*(x.tolist() for x in matches(same(0), i, j, same(least), same(size))[1:])))


def every(seeds, least):
    """All maximal matches."""
    known = set(seeds)
    out = []
    for i, j in seeds:
        if (i - 1, j - 1) not in known:
            n = 0
            while (i + n, j + n) in known:
                n += 1
            out.append((i, j, n + least - 1))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 60), st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 3))
def test_repeated_matches_are_left_out_without_a_trace(period, times, text, test, least):
    """Periodic texts, whose matches repeat many times: the tiles of the matches kept are those of all matches."""
    text = text + period * times
    seeds = [(i, j) for i in range(len(text) - least + 1) for j in range(len(test) - least + 1) if text[i : i + least] == test[j : j + least]]
    assert tile(limited(seeds, len(test), least), least) == tile(every(seeds, least), least)


def test_long_periodic_texts_stay_small():
    text = ["a", "b"] * 100_000
    tests = leaks.Tests([("t", " ".join(["a", "b"] * 20))], 8)
    i, k, j = tests.seeds(np.array([tests.vocabulary[w] for w in text]))
    kept = matches(k, i, j, tests.lengths[k], tests.sizes[k])
    assert len(i) > 3_000_000 and len(kept[0]) < 100_000
    assert tile(list(zip(*(x.tolist() for x in kept[1:]))), 8) == [(0, 0, 40)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=15), st.integers(1, 4))
def test_tiling_marks_longest_first(text, test, least):
    seeds = [(i, j) for i in range(len(text) - least + 1) for j in range(len(test) - least + 1) if text[i : i + least] == test[j : j + least]]
    tiles = tile(limited(seeds, len(test), least), least)
    want = naive_tiling(text, test, least)
    assert [n for *_, n in tiles] == sorted((n for *_, n in tiles), reverse=True)
    assert max([n for *_, n in tiles], default=0) == max([n for *_, n in want], default=0)
    marks_a, marks_b = [i + k for i, _, n in tiles for k in range(n)], [j + k for _, j, n in tiles for k in range(n)]
    assert len(marks_a) == len(set(marks_a)) and len(marks_b) == len(set(marks_b))
    assert all(text[i : i + n] == test[j : j + n] and n >= least for i, j, n in tiles)
    free_a, free_b = set(range(len(text))) - set(marks_a), set(range(len(test))) - set(marks_b)
    assert not [1 for i, j in seeds if set(range(i, i + least)) <= free_a and set(range(j, j + least)) <= free_b]


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_windows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    r = random.Random(1)
    vocabulary = [f"v{k}" for k in range(60)]
    tests = [(f"t{k}", " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 7, 8, 9, 30])))) for k in range(30)] + [("tnull", None), ("tblank", "..."), (None, "v1 v2"), ("t1same", "V1, v2")]
    corpus = []
    for k in range(300):
        text = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if k % 3 == 0:
            source = r.choice(tests[:30])[1].split()
            a = r.randrange(len(source))
            text[r.randrange(len(text) + 1) : 0] = source[a : a + r.randrange(1, 20)]
        corpus.append((k, " ".join(text), "x"))
    corpus += [(900, None, "x"), (901, "", "x"), (902, "v1 " * 50000, "x"), (0, corpus[0][1], "x")]
    df = spark.createDataFrame(corpus, "n int, text string, test_id string")
    found = tilings(df, "text", spark.createDataFrame(tests, "id string, text string"), "id", "text", 8)
    assert found.columns == ["n", "corpus_test_id", "test_id", "tiles", "longest", "coverage"]
    have = {(x["n"], x["test_id"]) for x in found.collect()}
    want = set()
    for key, t in tests:
        if key and (w := words(t)):
            size = min(8, len(w))
            windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            for n, text, _ in corpus:
                c = words(text)
                if any(tuple(c[k : k + size]) in windows for k in range(len(c) - size + 1)):
                    want.add((n, key))
    assert have == want


def test_reordered_passages(spark):
    test = "one two three four five six seven eight nine ten eleven twelve"
    text = "seven eight nine ten eleven twelve and then one two three four five six"
    rows = tilings(spark.createDataFrame([(1, text)], "n int, text string"), "text", spark.createDataFrame([("t", test)], "id string, text string"), "id", "text", 4, 0.9).collect()
    assert [(r["tiles"], r["longest"], r["coverage"]) for r in rows] == [(2, 6, 1.0)]
    assert tilings(spark.createDataFrame([], "n int, text string"), "text", spark.createDataFrame([("t", test)], "id string, text string"), "id", "text").count() == 0
    assert tilings(spark.createDataFrame([(1, text)], "n int, text string"), "text", spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0


def test_test_tables(spark):
    found = set(map(tuple, queries.p1_found(spark, DATA).select("case_id", "found_in", "record_id").collect()))
    cases = [(r["id"], words(r["prompt"])) for r in spark.read.parquet(f"{DATA}/phase0_v1.parquet").collect()]
    ex = spark.read.parquet(f"{DATA}/examples.parquet")
    records = [("examples", r[0], r[1]) for r in ex.filter(clean_name(ex.split) == "train").select("example_id", "prompt").collect()]
    records += [("documents", str(r[0]), r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = set()
    for where, key, text in records:
        line = f" {' '.join(words(text))} "
        for case, w in cases:
            if w and any(f" {' '.join(w[k : k + 8])} " in line for k in range(max(1, len(w) - 7))):
                want.add((case, where, key))
    assert found == want and want
