"""Evaluation texts inside training texts: problem 1, by greedy string tiling with running Karp-Rabin.

The test texts are a stated query set: they go out in blocks of fewer than ``BLOCK_CHARS`` characters (and one text
more), as a vocabulary, rolling hashes of their word windows and their word numbers; every text of the corpus is read
once per block and nothing of it moves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.words import words
from corpusforge.plans.ranks import running
from corpusforge.plans.stage import staged

BLOCK_CHARS = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 20


class Tests:
    """One block of test texts: word numbers (0 is any other word), and the windows' hashes by length, as sorted arrays."""

    def __init__(self, rows: list[tuple[str, str | None]], min_match: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[str] = []
        texts: list[np.ndarray] = []
        for key, text in rows:
            if key is not None and (found := words(text)):
                self.ids.append(key)
                texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.lengths = np.minimum(self.sizes, min_match)
        self.flat = np.concatenate([*texts, np.zeros(0, np.int64)])
        self.offset = np.cumsum(self.sizes) - self.sizes
        self.codes = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, len(self.vocabulary) + 1, np.int64).astype(np.uint64)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for length in np.unique(self.lengths).tolist():
            own = np.flatnonzero(self.lengths == length)
            hashes = [self.rolling(texts[k], length) for k in own.tolist()]
            counts = np.array([len(h) for h in hashes])
            test, value = np.repeat(own, counts), np.concatenate(hashes)
            place = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
            order = np.lexsort((place, test, value))
            keys, first = np.unique(value[order], return_index=True)
            slots = np.zeros(1 << SLOTS, bool)
            slots[(keys >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
            self.windows[length] = keys, np.append(first, len(value)), test[order], place[order], np.packbits(slots)

    def rolling(self, numbers: np.ndarray, length: int) -> np.ndarray:
        """Karp-Rabin hashes of all windows of ``length`` numbers."""
        code = self.codes[numbers]
        h = code.copy()
        for k in range(1, length):
            h = h[:-1] * BASE + code[k:]
        return h * BASE

    def seeds(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, tests and positions in the tests of all windows that texts share with tests."""
        found = [np.zeros((3, 0), np.int64)]
        code = self.codes[numbers]
        h, known, length = code.copy(), numbers != 0, 1
        for want, (keys, ends, tests, places, packed) in self.windows.items():
            while length < want:
                h = h[:-1] * BASE + code[length:]
                known = known[:-1] & (numbers[length:] != 0)
                length += 1
            at = np.flatnonzero(known)
            value = h[at] * BASE
            hit = np.unpackbits(packed).view(bool)[(value >> np.uint64(64 - SLOTS)).astype(np.int64)]
            at, value = at[hit], value[hit]
            slot = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            same = keys[slot] == value
            at, slot = at[same], slot[same]
            count = ends[slot + 1] - ends[slot]
            of = np.arange(count.sum()) + np.repeat(ends[slot] - (np.cumsum(count) - count), count)
            i, k, j = np.repeat(at, count), tests[of], places[of]
            for w in range(want):
                equal = numbers[i + w] == self.flat[self.offset[k] + j + w]
                i, k, j = i[equal], k[equal], j[equal]
            found.append(np.stack([i, k, j]))
        return tuple(np.concatenate(found, axis=1))


def matches(group: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal matches of each group (a text and a test), from its shared windows: ``group, i, j, length``.

    Windows that follow each other on a diagonal are one match.  ``least`` and ``size`` are each window's words and the
    words of its test.  Of matches of one group that differ in ``i`` alone, only the first ``size * length + 1`` are
    kept: tiles cover ``size`` words of the text at most, each of which touches at most ``length`` of these matches, so one
    that is whole and comes earlier is always left, and tiling never gets to the others.
    """
    order = np.lexsort((j, i - j, group))
    group, i, j, least, size = (x[order] for x in (group, i, j, least, size))
    begins = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (j[1:] != j[:-1] + 1)])) if len(i) else np.zeros(0, np.int64)
    length = np.diff(np.append(begins, len(i))) + least[begins] - 1
    group, i, j, size = (x[begins] for x in (group, i, j, size))
    order = np.lexsort((i, length, j, group))
    group, i, j, length, size = (x[order] for x in (group, i, j, length, size))
    heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (j[1:] != j[:-1]) | (length[1:] != length[:-1])])) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(heads, np.diff(np.append(heads, len(i))))
    kept = rank <= size * length
    return group[kept], i[kept], j[kept], length[kept]


def tile(found: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``position in text, position in test, length`` of the tiles, longest first.

    ``found`` are the maximal matches.  The longest match without a marked word is marked, a match that lost words to
    others goes on with its unmarked stretches, until no match of ``least`` words is left.
    """
    heap = [(-n, j, i) for i, j, n in found]
    heapq.heapify(heap)
    in_text: set[int] = set()
    in_test: set[int] = set()
    tiles = []
    while heap:
        size, j, i = heapq.heappop(heap)
        free = [i + k not in in_text and j + k not in in_test for k in range(-size)]
        if all(free):
            tiles.append((i, j, -size))
            in_text.update(range(i, i - size))
            in_test.update(range(j, j - size))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return tiles


def tilings(corpus: DataFrame, text: str, tests: DataFrame, test_id: str, test_text: str, min_match: int = 8, min_coverage: float = 0.0) -> DataFrame:
    """``corpus`` without its text, with a row for each test text that a corpus text gives away.

    Adds ``test_id``, ``tiles``, ``longest`` (words of the longest tile) and ``coverage`` (share of the test's words
    in tiles), where the coverage is above 0 and at least ``min_coverage``; a corpus column of one of these names is
    kept with ``corpus_`` before it.  A tile has ``min_match`` words in
    sequence, or all of a test that has fewer, so passages count in any order.  Null ids and tests without words
    give nothing, as do null and empty corpus texts; repeated corpus rows give repeated rows.
    """
    spark = corpus.sparkSession
    cases = tests.select(F.col(test_id).alias("id"), F.col(test_text).alias("text")).dropna()
    laid = running(cases.withColumn("_order", F.xxhash64("id", "text")), [], "_order", ["id", "text"], F.length("text"), "_before")
    blocked = staged(laid.select("id", "text", F.floor(F.col("_before") / BLOCK_CHARS).alias("block")))
    blocks = [r["block"] for r in blocked.select("block").distinct().orderBy("block").collect()] or [0]  # one row per BLOCK_CHARS
    added = T._parse_datatype_string("test_id string, tiles int, longest int, coverage double").fields
    corpus = corpus.select(F.col(text), *[F.col(c).alias(f"corpus_{c}" if c in [f.name for f in added] else c) for c in corpus.columns if c != text])
    schema = T.StructType([*corpus.schema.fields[1:], *added])
    found = None
    for block in blocks:
        of = blocked.filter(F.col("block") == block).select("id", "text").collect()
        shared = spark.sparkContext.broadcast(Tests([(r["id"], r["text"]) for r in of], min_match))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            number = known.vocabulary.get
            for batch in batches:
                flat: list[int] = []
                starts = []
                for t in batch.column(0).to_pylist():
                    starts.append(len(flat))
                    flat.extend([number(w, 0) for w in words(t)])
                    flat.append(0)
                numbers, begins = np.array(flat, np.int64), np.array(starts, np.int64)
                i, k, j = known.seeds(numbers)
                row = np.searchsorted(begins, i, side="right") - 1
                tests_ = max(1, len(known.ids))
                group, at_text, at_test, length = matches(row * tests_ + k, i - begins[row], j, known.lengths[k], known.sizes[k])
                heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
                out = []
                for first, last in zip(heads.tolist(), [*heads[1:].tolist(), len(group)]):
                    r, test = divmod(int(group[first]), tests_)
                    tiles = tile(list(zip(at_text[first:last].tolist(), at_test[first:last].tolist(), length[first:last].tolist())), int(known.lengths[test]))
                    coverage = sum(n for *_, n in tiles) / int(known.sizes[test])
                    if coverage >= min_coverage:
                        out.append((r, known.ids[test], len(tiles), max(n for *_, n in tiles), coverage))
                at = pa.array([x[0] for x in out], pa.int32())
                values = [pa.array([x[k] for x in out], kind) for k, kind in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()), (4, pa.float64()))]
                yield pa.record_batch([*(c.take(at) for c in batch.columns[1:]), *values], names=schema.names)

        part = corpus.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found
