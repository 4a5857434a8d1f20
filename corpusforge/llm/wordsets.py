"""Gram sets of records, as the similarity joins need them.

A record's grams (words, or runs of words) are ordered by how many records hold them, rarest first.  Two sets of
likeness >= t must share one of the first ``n - ceil(t n) + 1`` grams of each (the prefix), in any fixed order of all
grams, and a set that is held to the share t in another must share one of its prefix with any gram of the other, so
only records that share a prefix gram are ever compared.  More generally, the first ``n - ceil(t n) + k`` grams hold k
common ones.  The order comes from a sketch: gram hashes fall into buckets that are counted over all records.  The
sketch grows with the texts up to ``2**SKETCH[1]`` buckets; collisions only coarsen the order, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.words import words

SKETCH = 16, 22  # least and greatest number of bits of a bucket
SKETCH_CHARS = 64  # characters of text for a bucket, between these
SEEN_KEYS = 200_000
OFTEN = 4096


def text_grams(text: str | None, size: int) -> set[str]:
    """The distinct word ``size``-grams of a text; of a shorter text the whole; of one without words none."""
    found = words(text)
    if size == 1:
        return set(found)
    return {" ".join(found[k : k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def gram_hashes(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' distinct grams, one text after the other, and each text's number of them."""
    each = [text_grams(t, size) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for s in each for w in s), np.uint64, int(sizes.sum())), sizes


def keys_to_arrow(high: np.ndarray, low: np.ndarray, filled: np.ndarray | None = None) -> pa.Array:
    """128-bit keys as a binary column of 16 bytes each; null where not ``filled``."""
    n = len(high)
    mask = None if filled is None else pa.py_buffer(np.packbits(filled, bitorder="little").tobytes())
    ends = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [mask, ends, pa.py_buffer(np.stack([high, low], axis=1).tobytes())])


def keys_from_arrow(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The 128-bit keys of a binary column without nulls, as rows of two 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    _, ends, data = column.cast(pa.binary()).buffers()
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(-1, 2)


def sketch_bits(df: DataFrame, text: str) -> int:
    """Bits of the sketch's buckets, by the number of characters of all texts."""
    chars = df.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    return min(SKETCH[1], max(SKETCH[0], (chars // SKETCH_CHARS).bit_length()))


def _sums(parts: DataFrame, width: int) -> np.ndarray:
    """Sums per bucket, at most ``width`` rows, as one array (of at most 16 MB)."""
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(width, np.uint32)
    counts[sums["bucket"].to_numpy()] = np.minimum(sums["n"].to_numpy(), 2**32 - 1)
    return counts


def gram_counts(df: DataFrame, text: str, size: int) -> np.ndarray:
    """Records per bucket of gram hashes, over all rows; an upper bound of any gram's records in its bucket."""
    width = 1 << sketch_bits(df, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            hashes, _ = gram_hashes(batch.column(0).to_pylist(), size)
            bucket, n = np.unique((hashes & np.uint64(width - 1)).astype(np.int64), return_counts=True)
            total[bucket] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return _sums(df.select(text).mapInArrow(count, "bucket int, n bigint"), width)


def prefix_length(n: np.ndarray, likeness: Fraction) -> np.ndarray:
    return n + 1 - -(-n * likeness.numerator // likeness.denominator)


def _ordered(texts: list[str | None], size: int, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hashes in the texts' own orders, rarest first: hashes, counts, text, place in the text, and the texts' sizes."""
    hashes, sizes = gram_hashes(texts, size)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often_of = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((hashes, often_of, row))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return hashes[order], often_of[order], row, place, sizes


def prefix_buckets(df: DataFrame, text: str, likeness: Fraction, size: int, counts: np.ndarray) -> np.ndarray:
    """Whether a bucket of the sketch holds a prefix gram of one of the texts."""
    width = len(counts)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(width, bool)
        for batch in batches:
            hashes, _, _, place, sizes = _ordered(batch.column(0).to_pylist(), size, counts)
            head = place < np.repeat(prefix_length(sizes, likeness), sizes)
            met[(hashes[head] & np.uint64(width - 1)).astype(np.int64)] = True
        at = np.flatnonzero(met)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int64))], names=["bucket", "n"])

    return _sums(df.select(text).mapInArrow(mark, "bucket int, n bigint"), width) > 0


def gram_sets(
    df: DataFrame,
    text: str,
    likeness: Fraction,
    size: int = 1,
    deeper: int = 0,
    often: int = OFTEN,
    counts: np.ndarray | None = None,
    scanned: str | None = None,
    wanted: np.ndarray | None = None,
) -> DataFrame:
    """``df`` with a fingerprint of each row's gram set.

    ``key``: a 128-bit hash of the set, equal for equal sets; ``n``: grams in the set; ``sig0, sig1``: a bit for each
    gram's hash, of 128; ``grams``: the hashes of the first ``deeper`` grams more than the prefix, in order, of which
    ``p`` make the prefix and the first ``r`` of these are held by at most ``often`` records; ``first``: whether the
    task had not met the key (per value of the column ``scanned``, if given) among its last ``SEEN_KEYS``, so that
    copies are dropped before any shuffle.  Rows whose boolean ``scanned`` is false have in ``grams`` all their grams
    that fall into ``wanted`` buckets instead of a prefix, ``p`` of them.
    A text without words (null, empty, blank) has a null key, n = 0 and no grams.
    """
    counts = gram_counts(df, text, size) if counts is None else counts
    buckets = np.uint64(len(counts) - 1)
    added = "key binary, n int, sig0 bigint, sig1 bigint, grams array<bigint>, p int, r int, first boolean"
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])
    at = df.columns.index(text)
    side_at = None if scanned is None else df.columns.index(scanned)
    packed = None if wanted is None else np.packbits(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        asked = None if packed is None else np.unpackbits(packed).view(bool)
        for batch in batches:
            hashes, often_of, row, place, sizes = _ordered(batch.column(at).to_pylist(), size, counts)
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            key, sig = np.zeros((2, len(sizes)), np.uint64), np.zeros((2, len(sizes)), np.uint64)
            if len(filled):
                mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                key[0][filled] = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
                other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                other = (other ^ (other >> np.uint64(28))) * np.uint64(0xA0761D6478BD642F)
                key[1][filled] = np.add.reduceat(other ^ (other >> np.uint64(32)), starts)
                bit = np.uint64(1) << ((hashes >> np.uint64(40)) & np.uint64(63))
                for lane in (0, 1):
                    sig[lane][filled] = np.bitwise_or.reduceat(np.where((hashes >> np.uint64(63)) == lane, bit, np.uint64(0)), starts)
            p = prefix_length(sizes, likeness) * (sizes > 0)
            head = place < np.repeat(p, sizes)
            given = place < np.repeat(p + deeper, sizes)
            sides = [True] * len(sizes) if side_at is None else batch.column(side_at).to_pylist()
            if asked is not None:
                hit = asked[(hashes & buckets).astype(np.int64)]
                keep = np.array([s is not False for s in sides], bool)
                of_kept = np.repeat(keep, sizes)
                head, given = np.where(of_kept, head, hit), np.where(of_kept, given, hit)
                p = np.where(keep, p, np.bincount(row[hit], minlength=len(sizes)))
            rare = np.bincount(row[head & (often_of <= often)], minlength=len(sizes))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[given], minlength=len(sizes)))]).astype(np.int32)
            first = np.zeros(len(sizes), bool)
            for k, x in enumerate(zip(key[0].tolist(), key[1].tolist(), sides)):
                if sizes[k] and x not in seen:
                    first[k] = True
                    seen.add(x)
            if len(seen) > SEEN_KEYS:
                seen.clear()
            columns = [
                keys_to_arrow(key[0], key[1], sizes > 0),
                pa.array(sizes.astype(np.int32)),
                pa.array(sig[0].view(np.int64)),
                pa.array(sig[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[given].view(np.int64))),
                pa.array(p.astype(np.int32)),
                pa.array(rare.astype(np.int32)),
                pa.array(first),
            ]
            yield pa.record_batch([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(sets, schema)


def one_of_each(sets: DataFrame, *by: str) -> DataFrame:
    """One row per key (and value of ``by``) of the rows that are ``first`` in their task: the fingerprint without ids and texts."""
    columns = ["n", "sig0", "sig1", "grams", "p", "r"]
    return sets.filter("first").select("key", *by, *columns).groupBy("key", *by).agg(*[F.first(c).alias(c) for c in columns])


def overlap(a: set[str], b: set[str]) -> int:
    return len(a & b)


def measured(pairs: DataFrame, sets: DataFrame, text: str, size: int = 1) -> DataFrame:
    """The gram sets of candidate pairs ``a, b`` of keys, by their texts: ``a, b, n_a, n_b, n_both``.

    Only texts of keys in a pair move: one text of each key meets the pairs' two ends, then the ends meet by pair.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    held = sets.filter("first").select("key", F.col(text).alias("_text")).join(ends.select("key").distinct(), "key", "left_semi")
    texts = held.groupBy("key").agg(F.min("_text").alias("_text"))
    one = [F.min(F.when(F.col("key") == F.col(x), F.col("_text"))).alias(f"t_{x}") for x in "ab"]
    met = ends.join(texts, "key").groupBy("a", "b").agg(*one)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, set[str]] = {}
            out = []
            for x, y, tx, ty in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sx = known.get(x) or known.setdefault(x, text_grams(tx, size))
                sy = known.get(y) or known.setdefault(y, text_grams(ty, size))
                out.append((len(sx), len(sy), overlap(sx, sy)))
            counts = [pa.array([x[j] for x in out], pa.int32()) for j in range(3)]
            yield pa.record_batch([batch.column(0), batch.column(1), *counts], names=["a", "b", "n_a", "n_b", "n_both"])

    return met.select("a", "b", "t_a", "t_b").mapInArrow(measure, "a binary, b binary, n_a int, n_b int, n_both int")


def alike(likeness: Fraction) -> str:
    """The condition on ``n_a, n_b, n_both`` for a likeness of at least ``likeness``."""
    return f"n_both > 0 and n_both * {likeness.denominator}L >= (n_a + n_b - n_both) * {likeness.numerator}L"
