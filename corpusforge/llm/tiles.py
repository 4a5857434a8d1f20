"""Exact comparison of signatures in tiles, by numpy exclusive-or and bit counts.

Rows of a cell are sorted by side and bit count and cut into tiles of ``TILE`` rows.  Pairs inside a tile are compared
along the tile's diagonals, the tiles of all cells of a batch at once; pairs of different tiles of a cell block against
block, unless the tiles' bit counts differ beyond the radius.  Sides (``place``): 0 meets 0, and 1 meets 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa

TILE = 128
DENSE = 8


def bit_count(sig: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sig).sum(axis=-1, dtype=np.int32)


@dataclass(frozen=True)
class Alike:
    """Pairs whose sets may have a likeness of ``t``: differing bits never exceed differing grams, of which there are
    at most (1-t)/(1+t) of the grams of both; bit counts differ by no more than bits do."""

    t: Fraction

    def rough(self, ones_a, ones_b, n_a, n_b):
        p, q = self.t.numerator, self.t.denominator
        return (np.abs(ones_a - ones_b) * (q + p) <= (q - p) * (n_a + n_b)) & (np.minimum(n_a, n_b) * q >= np.maximum(n_a, n_b) * p)

    def fine(self, sig_a, sig_b, n_a, n_b):
        p, q = self.t.numerator, self.t.denominator
        return bit_count(sig_a ^ sig_b) * (q + p) <= (q - p) * (n_a + n_b)

    def apart(self, low_a, high_a, most_a, low_b, high_b, most_b) -> bool:
        p, q = self.t.numerator, self.t.denominator
        return max(low_a - high_b, low_b - high_a) * (q + p) > (q - p) * (most_a + most_b)


@dataclass(frozen=True)
class Within:
    """Pairs of a first set that may be held to the share ``t`` in a second: its bits missing there are missing grams."""

    t: Fraction

    def rough(self, ones_a, ones_b, n_a, n_b):
        p, q = self.t.numerator, self.t.denominator
        return ((ones_a - ones_b) * q <= (q - p) * n_a) & (n_b * q >= n_a * p)

    def fine(self, sig_a, sig_b, n_a, n_b):
        p, q = self.t.numerator, self.t.denominator
        return bit_count((sig_a ^ sig_b) & sig_a) * q <= (q - p) * n_a

    def apart(self, low_a, high_a, most_a, low_b, high_b, most_b) -> bool:
        p, q = self.t.numerator, self.t.denominator
        return (low_a - high_b) * q > (q - p) * most_a


Bound = Alike | Within


def _diagonals(ends: np.ndarray, place: np.ndarray, ones: np.ndarray, n: np.ndarray, sig: np.ndarray, bound: Bound) -> Iterator[tuple]:
    """Pairs inside tiles; ``ends`` is the end of each row's tile."""
    rows = np.arange(len(ends))
    step = 1
    while len(rows := rows[rows + step < ends[rows]]):
        other = rows + step
        ok = (place[rows] + place[other]) % 3 == 0
        x, y = rows[ok], other[ok]
        ok = bound.rough(ones[x], ones[y], n[x], n[y])
        x, y = x[ok], y[ok]
        ok = bound.fine(sig[x], sig[y], n[x], n[y])
        yield x[ok], y[ok]
        step += 1


def _across(tiles: list[tuple[int, int]], place: np.ndarray, ones: np.ndarray, n: np.ndarray, sig: np.ndarray, bound: Bound) -> Iterator[tuple]:
    """Pairs of different tiles of one cell."""
    facts = [(place[s], place[e - 1], int(ones[s:e].min()), int(ones[s:e].max()), int(n[s:e].max())) for s, e in tiles]
    for i, (s, e) in enumerate(tiles):
        first, last, *a = facts[i]
        for j in range(i + 1, len(tiles)):
            of_first, of_last, *b = facts[j]
            if first == last == of_first == of_last and first or bound.apart(*a, *b):
                continue
            r, f = tiles[j]
            ok = bound.rough(ones[s:e, None], ones[None, r:f], n[s:e, None], n[None, r:f])
            ok &= (place[s:e, None] + place[None, r:f]) % 3 == 0
            x, y = np.nonzero(ok)
            x, y = x + s, y + r
            ok = bound.fine(sig[x], sig[y], n[x], n[y])
            yield x[ok], y[ok]


def compared(cell: np.ndarray, place: np.ndarray, n: np.ndarray, sig: np.ndarray, bound: Bound, dense: int | None = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``x, y`` of the pairs of whole cells that may satisfy the bound (``x`` on side 1 if sides differ), and the rows of dense cells.

    A cell with more than ``dense`` such pairs a row gives its rows instead of pairs; comparing it stops there, so what
    a batch of cells holds at a time is linear in its rows.
    """
    ones = bit_count(sig)
    order = np.lexsort((ones, place, cell))
    cell, place, n, sig, ones = cell[order], place[order].astype(np.int64), n[order].astype(np.int64), sig[order], ones[order]
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [len(cell)]]))
    start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    ends = np.minimum(start + ((np.arange(len(cell)) - start) // TILE + 1) * TILE, start + size)
    number = np.repeat(np.arange(len(begins)), sizes)
    pairs = list(_diagonals(ends, place, ones, n, sig, bound))
    x, y = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    most = sizes * (len(cell) if dense is None else dense)
    got = np.bincount(number[x], minlength=len(begins))
    more_x, more_y = [x], [y]
    for c in np.flatnonzero((sizes > TILE) & (got <= most)).tolist():
        b, m = int(begins[c]), int(sizes[c])
        for px, py in _across([(k, min(k + TILE, b + m)) for k in range(b, b + m, TILE)], place, ones, n, sig, bound):
            more_x.append(px)
            more_y.append(py)
            got[c] += len(px)
            if got[c] > most[c]:
                break
    x, y = np.concatenate(more_x), np.concatenate(more_y)
    full = got > most
    kept = ~full[number[x]]
    return order[x[kept]], order[y[kept]], order[full[number]]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups of equal first column, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(lead, lead[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != lead[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
