"""Cutting oversized texts at natural boundaries (problem 5).

Method: agglomerative merging.  A text starts as atomic segments (lines; lines
over the limit are cut at token ends first).  All adjacent pairs stand in a heap
by the strength of the boundary between them; the weakest are merged first while
the combined size plus the overlap fits the limit.

Each piece after the first starts with the last ``overlap`` characters of the
piece before.  Sizes are Unicode code points.

Defined results: null, empty and short texts give no pieces (the operator is for
items over the limit); a text without any natural boundary is cut at the limit.
Repeated rows give repeated pieces.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import sliced

LIMIT, OVERLAP = 6000, 200
_TOKEN_END = re.compile(r"[;,}\])>]\s*|\s+|(?<=\w)(?=\W)")


def atoms(text: str, room: int) -> list[tuple[int, int, float]]:
    """Segments of at most ``room`` characters: (start, end, strength of the boundary after it)."""
    lines = text.splitlines(keepends=True)
    depths, depth = [], 0
    for ln in lines:
        depth = max(0, depth + ln.count("{") - ln.count("}"))
        depths.append(depth)
    out: list[tuple[int, int, float]] = []
    pos = 0
    for i, ln in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        indent = len(nxt) - len(nxt.lstrip(" \t"))
        strength = 4.0 / (1 + depths[i]) + 2.0 / (1 + indent)
        if not ln.strip():
            strength += 3.0 if nxt.strip() else 1.0
        elif not nxt.strip():
            strength -= 1.0  # leave the blank line with what stands before it
        if ln.rstrip() in ("}", "};", "end"):
            strength += 2.0
        end = pos + len(ln)
        while end - pos > room:
            cut = pos + room
            for m in _TOKEN_END.finditer(text, pos + room // 2, cut):
                cut = m.end()
            cut = min(max(cut, pos + 1), pos + room)
            out.append((pos, cut, 0.0))
            pos = cut
        if end > pos:
            out.append((pos, end, strength))
        pos = end
    return out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces' own parts; they partition the text."""
    room = limit - overlap
    if room <= 0 or overlap < 0:
        raise ValueError("the overlap must be smaller than the limit")
    segs = atoms(text, room)
    n = len(segs)
    start = [s for s, _, _ in segs]
    end = [e for _, e, _ in segs]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(segs[i][2], i) for i in range(n - 1)]  # boundary after segment i; ties: first in the text
    last = list(range(n))  # last atom merged into the segment that begins at i
    heapq.heapify(heap)
    first = list(range(n))  # begin of the segment that ends with atom i
    while heap:
        _, i = heapq.heappop(heap)
        left = first[i]
        right = nxt[left]
        if right >= n or not (alive[left] and alive[right]):
            continue
        if end[right] - start[left] + (overlap if start[left] else 0) > limit:
            continue  # segments only grow: this boundary stays
        end[left] = end[right]
        alive[right] = False
        last[left] = last[right]
        first[last[left]] = left
        nxt[left] = nxt[right]
        if nxt[left] < n:
            prev[nxt[left]] = left
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(overlap start, own start, end) of each piece of ``text``."""
    return [(max(0, s - overlap) if i else s, s, e) for i, (s, e) in enumerate(cuts(text, limit, overlap))]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """record_id, piece_no (from 1), n_pieces, start_char, own_start, end_char, piece of each text over ``limit``.

    ``piece`` is the text from ``start_char`` (0-based) to ``end_char``; without
    the overlap it begins at ``own_start``.
    """
    names = ["record_id", "piece_no", "n_pieces", "start_char", "own_start", "end_char", "piece"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ps = pieces(text, limit, overlap)
                rows += [(rid, i, len(ps), o, s, e, text[o:e]) for i, (o, s, e) in enumerate(ps, 1)]
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000]), types)], names)

    over = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).cast("string").alias("text")).where(F.char_length("text") > limit)
    return over.mapInArrow(sliced(run), "record_id string, piece_no int, n_pieces int, start_char long, own_start long, end_char long, piece string")
