"""Overlaps across splits and near-duplicate groups against brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.functions.words import clean_name, words
from corpusforge.llm import near
from corpusforge.llm.components import components
from corpusforge.llm.near import near_groups
from corpusforge.llm import overlaps
from corpusforge.llm.overlaps import overlap_pairs, overlapping_records, split_overlaps
from corpusforge.llm.tiles import Alike, Within, compared
from corpusforge.llm.wordsets import gram_sets, keys_from_arrow, keys_to_arrow, one_of_each, prefix_length, text_grams

DATA = "/root/testdata/sf0.001"


def links(rows, likeness, size=1):
    """All pairs of alike texts, by an index over every gram."""
    sets = {i: text_grams(t, size) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for w in s:
            index[w].append(i)
    out = set()
    for i in sets:
        for j, both in Counter(j for w in sets[i] for j in index[w] if j > i).items():
            if both >= likeness * (len(sets[i]) + len(sets[j]) - both):
                out.add((i, j))
    return out


def groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(root(x), x) for x in parent if root(x) != x}


def corpus(n, seed, edits=2):
    """Texts of which many are edited copies of others, with nulls, blanks, repeated rows and hot words."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 8, 20, 40]))] + ["the"] for _ in range(n // 3)]
    rows = []
    for k in range(n):
        words_ = list(r.choice(base))
        for _ in range(r.randrange(edits + 1)):
            words_[r.randrange(len(words_))] = r.choice(vocabulary)
        rows.append((f"id{k:05d}", " ".join(words_)))
    return rows + [("id90000", None), ("id90001", ""), ("id90002", " ?! "), (None, "w1 w2"), rows[0], rows[0], ("id90003", "Long " * 20000)]


@pytest.mark.parametrize(("likeness", "size"), [(Fraction(3, 4), 1), (Fraction(4, 5), 5), (Fraction(1, 2), 1)])
def test_groups_equal_brute_force(spark, likeness, size):
    rows = corpus(600, 1)
    found = near_groups(spark.createDataFrame(rows, "doc string, body string"), "doc", "body", likeness, size)
    want = groups(links([x for x in dict.fromkeys(rows) if x[0]], likeness, size))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_groups_of_salted_and_dense_cells(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 64)
    r = random.Random(3)
    rows = [(f"a{k:04d}", f"same words in all of them but {r.randrange(40)} and {r.randrange(40)}") for k in range(500)]
    df = spark.createDataFrame(rows, "id string, text string")
    likeness = Fraction(3, 4)
    monkeypatch.setattr(near, "gram_sets", lambda *a, **k: gram_sets(*a, **k, often=20))
    assert sorted(map(tuple, near_groups(df, "id", "text", likeness, 1).collect())) == sorted(groups(links(rows, likeness)))


def test_groups_of_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x y z", "1", 2), ("b", "z y x", "1", 3)], "key string, cell string, id string, n int")
    assert list(map(tuple, near_groups(df, "key", "cell", size=1).collect())) == [("a", "b")]
    assert near_groups(df.limit(0), "key", "cell").count() == 0


@pytest.mark.parametrize("sides", [False, True])
@pytest.mark.parametrize("bound", [Alike(Fraction(3, 4)), Within(Fraction(3, 4))])
def test_tiles_equal_all_pairs(bound, sides):
    r = np.random.default_rng(5)
    sig = r.integers(0, 2**63, (900, 2)).astype(np.uint64) & r.integers(0, 2**63, (900, 2)).astype(np.uint64)
    sig[300:500] = sig[:200] ^ (np.uint64(1) << r.integers(0, 63, (200, 1)).astype(np.uint64))
    n = np.where(np.arange(900) % 7, 30, 34)
    cell = np.repeat([5, 3, 9, 4, 8], [700, 3, 120, 76, 1])[r.permutation(900)]
    place = r.integers(1, 3, 900) if sides or isinstance(bound, Within) else np.zeros(900, np.int64)
    x, y, dense = compared(cell, place, n, sig, bound, None)
    p, q = 3, 4
    bits = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=-1)
    if isinstance(bound, Within):
        ok = (np.bitwise_count((sig[:, None] ^ sig[None]) & sig[:, None]).sum(axis=-1) * q <= (q - p) * n[:, None]) & (n[None] * q >= n[:, None] * p)
        want = {(i, j) for i, j in zip(*np.nonzero(ok)) if place[i] == 1 and place[j] == 2 and cell[i] == cell[j]}
        assert set(zip(x.tolist(), y.tolist())) == want
    else:
        ok = (bits * (p + q) <= (q - p) * (n[:, None] + n[None])) & (np.minimum(n[:, None], n[None]) * q >= np.maximum(n[:, None], n[None]) * p)
        want = {(i, j) for i, j in zip(*np.nonzero(ok)) if i < j and cell[i] == cell[j] and (place[i] + place[j]) % 3 == 0}
        assert {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())} == want
    assert len(x) == len(want) >= 20 and not len(dense)


def test_dense_cells_give_their_rows():
    sig = np.full((600, 2), np.uint64(7))
    cell = np.repeat([1, 2], [598, 2])
    x, y, dense = compared(cell, np.zeros(600, np.int64), np.full(600, 6), sig, Alike(Fraction(3, 4)))
    assert sorted(zip(x.tolist(), y.tolist())) == [(598, 599)] and sorted(dense.tolist()) == list(range(598))


def test_keys_round_trip():
    keys = np.random.default_rng(1).integers(0, 2**63, (50, 2)).astype(np.uint64)
    column = keys_to_arrow(*keys.T)
    assert (keys_from_arrow(column) == keys).all() and (keys_from_arrow(column.slice(7, 11)) == keys[7:18]).all()
    assert keys_to_arrow(*keys[:2].T, np.array([True, False])).to_pylist()[1] is None and len(keys_from_arrow(column.slice(0, 0))) == 0


def test_unlike_records_of_few_words_stay_in_bounded_cells(spark, monkeypatch):
    """Four of forty words each: every word is common, hardly two records are alike."""
    monkeypatch.setattr(near, "CELL", 256)
    r = random.Random(13)
    rows = [(f"r{k:06d}", " ".join(r.sample([f"w{x}" for x in range(40)], 4))) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(8)
    likeness = Fraction(3, 4)
    sets = gram_sets(df, "text", likeness, 1, deeper=near.LEVELS - 1, often=20).cache()
    unique = one_of_each(sets)
    cells, large = near.blocks(unique, likeness)
    if large is not None:
        cells = cells.unionByName(near.own_cells(large)).unionByName(near.cross_cells(large, spark.createDataFrame([], "node binary, root binary")))
    sizes = cells.groupBy("cell").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * near.CELL
    assert cells.count() <= 12 * len(rows)
    monkeypatch.setattr(near, "gram_sets", lambda *a, **k: gram_sets(*a, **k, often=20))
    found = near_groups(df, "id", "text", likeness, 1)
    assert sorted(map(tuple, found.collect())) == sorted(groups(links_of_few(rows)))


def links_of_few(rows):
    """Equal sets only: four words in each, so three in both would be a likeness of 3/5."""
    by = defaultdict(list)
    for i, t in rows:
        by[frozenset(t.split())].append(i)
    return [(of[0], x) for of in by.values() for x in of[1:]]


@pytest.mark.parametrize("salted", [False, True])
def test_large_blocks_without_a_leading_group(spark, monkeypatch, salted):
    """Half of the records share three rare words, with several groups of near copies in them."""
    monkeypatch.setattr(near, "CELL", 50)
    if salted:
        monkeypatch.setattr(near, "LEVELS", 1)
    r = random.Random(17)
    rows = []
    for k in range(400):
        base = [f"b{k % 5}{x}" for x in range(12)]
        base[r.randrange(12)] = f"e{k}"
        rows.append((f"a{k:04d}", " ".join(["x", "y", "z", *base])))
    rows += [(f"c{k:04d}", " ".join(f"d{r.randrange(60)}" for _ in range(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    monkeypatch.setattr(near, "gram_sets", lambda *a, **k: gram_sets(*a, **k, often=10))
    assert sorted(map(tuple, near_groups(df, "id", "text", Fraction(3, 4), 1).collect())) == sorted(groups(links(rows, Fraction(3, 4))))


def test_prefix_holds_a_common_word():
    r = random.Random(7)
    for _ in range(2000):
        a, b = ({r.randrange(30) for _ in range(r.randrange(1, 25))} for _ in range(2))
        if 4 * len(a & b) >= 3 * len(a | b):
            heads = [set(sorted(s)[: prefix_length(np.array(len(s)), Fraction(3, 4))]) for s in (a, b)]
            assert heads[0] & heads[1]


def test_overlaps_equal_brute_force(spark):
    rows = corpus(500, 2)
    r = random.Random(9)
    side = {i: r.choice([True, False, False, None]) for i, _ in rows}
    df = spark.createDataFrame([(i, t, side[i], "x") for i, t in rows], "id string, text string, held_out boolean, key string")
    found = {(a, b) for a, b, *_ in overlap_pairs(df, "id", "text", F.col("held_out"), Fraction(3, 4), 1, Fraction(3, 4)).collect()}
    alike = links([x for x in dict.fromkeys(rows) if x[0]], Fraction(3, 4))
    want = {(a, b) for p in alike for a, b in (p, p[::-1]) if side[a] is True and side[b] is False}
    assert found == want and want


def test_containment(spark):
    df = spark.createDataFrame([("e", "a b c d", True), ("t", "a b c d e", False)], "id string, text string, h boolean")
    pair = overlap_pairs(df, "id", "text", F.col("h"), Fraction(3, 4), 1).first()
    assert tuple(pair) == ("e", "t", 1.0, 0.8)
    alike, members = split_overlaps(df.limit(0), "id", "text", F.col("h"))
    assert alike.count() == 0 and members.count() == 0 and overlapping_records(df.limit(0), "id", "text", F.col("h")).count() == 0


@pytest.mark.parametrize("hot", [2048, 20])
def test_records_inside_longer_ones(spark, monkeypatch, hot):
    """Twenty words inside sixty: containment 1, likeness a third; and every pair by brute force, with salted grams."""
    monkeypatch.setattr(overlaps, "HOT", hot)
    if hot < 100:
        monkeypatch.setattr(overlaps, "gram_sets", lambda *a, **k: gram_sets(*a, **k, often=10))
    r = random.Random(19)
    vocabulary = [f"v{k}" for k in range(300)]
    train = [(f"t{k:03d}", " ".join([*r.sample(vocabulary, r.choice([5, 20, 60])), "common"]), False) for k in range(150)]
    held = [(f"e{k:03d}", " ".join(r.sample(r.choice(train)[1].split(), 5) + r.sample(vocabulary, r.choice([0, 1, 2, 30]))), True) for k in range(80)]
    held += [("e900", "common", True), ("e901", None, True), ("e902", "!", True)]
    df = spark.createDataFrame([*train, *held], "id string, text string, h boolean").repartition(4)
    share = Fraction(3, 4)
    want = {}
    for e, a, _ in held:
        for t, b, _ in train:
            x, y = text_grams(a, 1), text_grams(b, 1)
            if x and len(x & y) >= share * len(x):
                want[e, t] = len(x & y) / len(x), len(x & y) / len(x | y)
    found = {(x["id_eval"], x["id_train"]): (x["containment"], x["likeness"]) for x in overlap_pairs(df, "id", "text", F.col("h"), share, 1).collect()}
    assert {p: tuple(round(v, 9) for v in x) for p, x in found.items()} == {p: tuple(round(v, 9) for v in x) for p, x in want.items()}
    assert any(c == 1 and s < 0.4 for c, s in found.values())
    hit = {x["id"]: x["alike"] for x in overlapping_records(df, "id", "text", F.col("h"), share, 1, share).collect()}
    assert hit == {e: any(s >= share for (a, _), (_, s) in want.items() if a == e) for e, _ in want}


def test_test_tables(spark):
    ex = spark.read.parquet(f"{DATA}/examples.parquet")
    rows = [(r[0], r[1]) for r in ex.select("example_id", "prompt").distinct().collect()]
    want = groups(links(rows, Fraction(3, 4)))
    assert sorted(map(tuple, near_groups(ex, "example_id", "prompt", Fraction(3, 4), 1).collect())) == sorted(want)
    split = clean_name(F.col("split"))
    held = F.when(split == "train", False).when(split.isin("validation", "test"), True)
    side = {r[0]: r[1] for r in ex.select("example_id", held).collect()}
    pairs = {(a, b) for a, b, *_ in overlap_pairs(ex, "example_id", "prompt", held, Fraction(3, 4), 1, Fraction(3, 4)).collect()}
    assert pairs == {(a, b) for p in links(rows, Fraction(3, 4)) for a, b in (p, p[::-1]) if side[a] is True and side[b] is False}


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_components(spark, shape):
    r = random.Random(11)
    pairs = {"path": [(k, k + 1) for k in range(300)], "star": [(0, k) for k in range(1, 300)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "loops": [(5, 5), (5, 5), (7, 8)]}[shape]
    found = {row["node"]: row["root"] for row in components(spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint"), "a", "b").collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(found) == set(parent)
    assert all((found[a] == found[b]) == (root(a) == root(b)) for a in parent for b in list(parent)[:40])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_words():
    assert words("Ｆｕｌｌ ½_x it's ﬁne ² ١٢") == ["full", "1", "2", "x", "it", "s", "fine", "2", "١٢"]
    assert words(None) == [] and words("  ") == []
