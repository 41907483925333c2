"""Packing: documents joined into windows of at most `capacity` tokens by Karmarkar-Karp multiway differencing.

Whole windows are cut off the front of a long document. What is left of each document is dealt whole, a group at a time, by
differencing: the partial partitions with the largest spread merge, the fullest slot of one with the emptiest of the
other, which gives windows of near-equal fill. While one exceeds the capacity, the count of windows rises, as long as
padding stays under SLACK; what exceeds the capacity then is cut off the largest document of its window and put where there
is room. So no document that fits a window is cut but for those tails, and little is padded.

Defined results for odd input: a null or empty text has the end token only; rows that repeat a doc_id are packed each;
a null doc_id is kept; further columns are ignored; an empty table gives no rows. No row is shuffled: a task packs what
it reads, in groups of at most GROUP windows and GROUP_SIZES documents, and sequence ids hold the number of the task above
those that it counts."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import lean
from .tokens import default_paths, encoder, texts

CAPACITY, END_ID = 2048, 1
#: Windows, and documents, that are packed together at most (a document more may be among them).
GROUP, GROUP_SIZES = 256, 1 << 15
#: The share of padding up to which windows are added rather than documents cut.
SLACK = 0.005
#: Sequences of one task.
TASK_BITS = 36
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals sizes to k slots by differencing: the slot of each size, and the slots' sums.

    A partial partition holds the sums of its slots that aren't empty, falling, less the least where all k are in use; the
    members of a slot are a tree whose leaves are sizes, so memory grows with the sizes and not with k times as many."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64), np.bincount([0] * n, weights=sizes, minlength=k).astype(np.int64)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    kids: list[tuple[int, int]] = []

    def part(i: int) -> tuple[np.ndarray, np.ndarray]:
        return parts.pop(i) if i in parts else (sizes[i : i + 1].astype(np.int64), np.array([i]))

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (x, own), (y, other) = part(a), part(b)
        y, other = y[::-1], other[::-1]
        over = max(0, len(x) + len(y) - k)  # slots that both have: the emptiest of one, the fullest of the other last
        total = np.concatenate([x, y[over:]])
        slot = np.concatenate([own, other[over:]])
        if over:
            at = slice(len(x) - over, len(x))
            total[at] += y[:over]
            slot[at] = n + len(kids) + np.arange(over)
            kids.extend(zip(own[at].tolist(), other[:over].tolist(), strict=True))
        order = np.argsort(-total, kind="stable")
        total, slot = total[order], slot[order]
        if len(total) == k:
            total = total - total[-1]
        parts[a] = total, slot
        heapq.heappush(heap, (-int(total[0] - (total[-1] if len(total) == k else 0)), a))
    out = np.zeros(n, np.int64)
    for j, top in enumerate(part(heap[0][1])[1].tolist()):
        stack = [top]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = j
            else:
                stack.extend(kids[x - n])
    return out, np.bincount(out, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int, int, int]]:
    """Pieces (size, start, length, window) of sizes that are at most the capacity, in windows that are."""
    total = int(sizes.sum())
    k = least = max(1, -(-total // capacity))
    while True:
        slot, sums = difference(sizes, k)
        if not len(sizes) or sums.max() <= capacity:
            return [(i, 0, int(n), int(w)) for i, (n, w) in enumerate(zip(sizes, slot, strict=True))]
        if (k + 1) * capacity * (1 - slack) > total:
            break
        k += 1
    if k > least:
        slot, sums = difference(sizes, least)
    out, tails, room = [], [], [(capacity - int(s), w) for w, s in enumerate(sums) if s < capacity]
    for w in range(least):
        over = max(0, int(sums[w]) - capacity)
        own = np.flatnonzero(slot == w)
        for i in own[np.argsort(-sizes[own], kind="stable")].tolist():
            off = min(over, int(sizes[i]))
            over -= off
            if sizes[i] > off:
                out.append((i, 0, int(sizes[i]) - off, w))
            if off:
                tails.append((off, i, int(sizes[i]) - off))
    room.sort()
    for n, i, start in sorted(tails, reverse=True):
        while n:
            at = min(bisect_left(room, (n, -1)), len(room) - 1)  # the least room that holds it, or the largest
            free, w = room.pop(at)
            took = min(free, n)
            out.append((i, start, took, w))
            n, start = n - took, start + took
            if free > took:
                insort(room, (free - took, w))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids (uint32, little-endian)."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(*paths), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << TASK_BITS
        rest: list[tuple] = []  # doc_id, start, doc_tokens, ids
        held = 0
        out: list[tuple] = []
        out_bytes = 0

        def close() -> None:
            nonlocal sequence, rest, held
            fill: dict[int, int] = {}
            number: dict[int, int] = {}
            for i, start, n, w in windows(np.array([len(r[3]) // 4 for r in rest], np.int64), capacity):
                doc_id, first, of, ids = rest[i]
                if w not in number:
                    number[w] = sequence
                    sequence += 1
                at = fill.get(w, 0)
                out.append((doc_id, first + start, n, of, number[w], at, ids[4 * start : 4 * (start + n)]))
                fill[w] = at + n
            rest, held = [], 0

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((doc_id, start, capacity, n, sequence, 0, ids[4 * start : 4 * (start + capacity)]))
                    sequence += 1
                if n > whole:
                    rest.append((doc_id, whole, n, ids[4 * whole :]))
                held += n - whole
                if held >= group * capacity or len(rest) >= GROUP_SIZES:
                    close()
                out_bytes += 4 * n
                if out_bytes > 8 << 20 and out:
                    yield _rows(out)
                    out, out_bytes = [], 0
        if rest:
            close()
        if out:
            yield _rows(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
