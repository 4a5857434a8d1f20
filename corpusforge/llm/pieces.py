"""Cutting oversized texts at natural boundaries: problem 8, by agglomerative merging.

A text is first cut at every pause into atomic segments; adjacent segments wait in a heap and merge over the weakest
boundary first, as long as the merged piece and its overlap fit.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.words import PUNCT_TOKEN

PAUSE = re.compile(r"(?:(?<=[.!?])\s|[\r\n])\s*")
LINES = re.compile(r"\r\n|\r|\n")
SPECS = 1000


def pauses(text: str, starts: list[int]) -> dict[int, int]:
    """Token numbers before which the text pauses, with the strength of the pause: 1 sentence, 2 line, 3 paragraph."""
    found: dict[int, int] = {}
    for m in PAUSE.finditer(text):
        at = bisect_left(starts, m.start())
        found[at] = max(found.get(at, 0), 1 + min(2, len(LINES.findall(m.group()))))
    return {k: s for k, s in found.items() if 0 < k < len(starts)}


def merged(n: int, strength: dict[int, int], most: int, overlap: int) -> list[int]:
    """First tokens of the pieces' own parts, of ``n`` tokens with pauses before the tokens in ``strength``.

    A stretch without a pause that doesn't fit into a piece is cut hard (strength 0) into parts that do.
    """
    fit = max(1, most - overlap)
    marks = [0, *sorted(strength), n]
    begins, weights = [], []
    for a, b in zip(marks, marks[1:]):
        for k in range(a, b, fit):
            begins.append(k)
            weights.append(strength.get(k, 0))
    ends = [*begins[1:], n]
    before = list(range(-1, len(begins) - 1))
    after = [*range(1, len(begins)), -1]
    alive = [True] * len(begins)
    heap = [(weights[k], ends[k] - begins[k - 1], k, k - 1, ends[k]) for k in range(1, len(begins))]
    heapq.heapify(heap)
    while heap:
        _, size, k, left, end = heapq.heappop(heap)
        if not alive[k] or before[k] != left or ends[k] != end or end - begins[left] != size:
            continue
        if size + (overlap if left else 0) > most:
            continue  # it only grows from here
        alive[k] = False
        ends[left], after[left] = ends[k], after[k]
        if (nxt := after[k]) >= 0:
            before[nxt] = left
            heapq.heappush(heap, (weights[nxt], ends[nxt] - begins[left], nxt, left, ends[nxt]))
        if left:
            heapq.heappush(heap, (weights[left], ends[left] - begins[before[left]], left, before[left], ends[left]))
    return [b for b, ok in zip(begins, alive) if ok]


def pieces(df: DataFrame, id: str, text: str, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of each text that has more than ``max_tokens`` tokens, for each row of ``limits``.

    ``limits``: ``spec_id, max_tokens, overlap_tokens``; a null overlap is 0, one of ``max_tokens`` or more is
    ``max_tokens - 1``, rows without a positive ``max_tokens`` are left out.  Columns: ``spec_id, id``, ``piece``
    (from 0), ``start, end`` (characters), ``n_tokens`` (with the overlap), ``own_tokens`` (without), ``ends_at``
    (``pause``, ``hard`` or ``end``), ``cut_kind`` (``inside`` if a stretch without a pause has more than
    ``max_tokens`` tokens, else ``boundary``) and, if asked for, the piece's ``text``.  Each piece but the first begins
    with the ``overlap_tokens`` tokens before its own.  Texts that fit, null and empty ones give no rows; repeated rows
    repeat their pieces.
    """
    specs = [(r["spec_id"], r["max_tokens"], min(max(0, r["overlap_tokens"] or 0), r["max_tokens"] - 1)) for r in limits.select("spec_id", "max_tokens", "overlap_tokens").filter("max_tokens > 0").distinct().limit(SPECS + 1).collect()]
    if len(specs) > SPECS:
        raise ValueError(f"more than {SPECS} limits")
    fields = T._parse_datatype_string("piece int, start int, end int, n_tokens int, own_tokens int, ends_at string, cut_kind string" + ", text string" * with_text).fields
    schema = T.StructType([T.StructField("spec_id", T.StringType()), T.StructField("id", df.schema[id].dataType), *fields])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()][: len(fields)]
    least = min((m for _, m, _ in specs), default=0)

    def cut(found: str) -> Iterator[tuple]:
        spans = [m.span() for m in PUNCT_TOKEN.finditer(found)]
        if len(spans) <= least:
            return
        starts = [a for a, _ in spans]
        strength = pauses(found, starts)
        marks = [0, *sorted(strength), len(spans)]
        longest = max(b - a for a, b in zip(marks, marks[1:]))
        for spec, most, overlap in specs:
            if len(spans) <= most:
                continue
            begins = merged(len(spans), strength, most, overlap)
            for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(spans)])):
                lead = max(0, a - overlap) if k else a
                ends = "end" if b == len(spans) else "pause" if b in strength else "hard"
                start, end = spans[lead][0], spans[b - 1][1]
                row = (spec, k, start, end, b - lead, b - a, ends, "inside" if longest > most else "boundary")
                yield (*row, found[start:end]) if with_text else row

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, found in enumerate(batch.column(1).to_pylist()):
                if found and len(found) > least:
                    for row in cut(found):
                        at.append(k)
                        rows.append(row)
                if len(rows) > 4096 or k == batch.num_rows - 1:
                    columns = list(zip(*rows)) or [()] * (1 + len(kinds))
                    yield pa.record_batch([pa.array(columns[0], pa.string()), batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=schema.names)
                    at, rows = [], []

    return df.select(id, text).mapInArrow(scan, schema)
