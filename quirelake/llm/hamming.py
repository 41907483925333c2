"""All links within a Hamming radius of 64-bit fingerprints, by the generalised pigeonhole principle.

The 64 bits are dealt into m partitions, correlated bits together, with thresholds t_i that add up to radius - m + 1:
two fingerprints within the radius differ by at most t_i bits in some partition i. The number of partitions and their
thresholds come from a dynamic programme over what each choice costs: rows that are probed and estimated candidates.
Every fingerprint sends a row to each value within ceil(t_i / 2) bits of its own in partition i, so that two that are
within t_i meet in a run. Runs are compared by popcount in numpy; only what holds for all 64 bits leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fan_out, lean, mix

#: Microseconds for a probed row (made, shuffled, sorted) and for a compared pair.
ROW_US, PAIR_US = 1.5, 0.003
#: Rows of a run that are compared in one task; a larger run is cut in chunks of this size whose pairs are dealt out.
RUN_ROWS = 65_536
#: Values (rows by columns) that a task holds.
TASK_VALUES = 1 << 22
#: Rows of a run whose pairs are listed together with those of other small runs, and pairs that are listed at once.
FEW, PAIRS = 128, 1 << 20


@dataclass(frozen=True)
class Plan:
    radius: int
    blocks: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(_ball(len(b), t) for b, t in zip(self.blocks, self.thresholds, strict=True))


def _ball(width: int, t: int) -> int:
    return 0 if t < 0 else sum(comb(width, i) for i in range(min((t + 1) // 2, width) + 1))


def bit_statistics(fps: DataFrame, fp: str = "fp") -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set; 64 x 64 sums, whatever the size of the table."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for lo in range(0, len(x), 1 << 16):
                bits = np.unpackbits(x[lo : lo + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(x)
        if n:
            i, j = np.triu_indices(64)
            yield pa.record_batch([pa.array([-1, *(i * 64 + j)], pa.int32()), pa.array([n, *both[i, j]], pa.int64())], ["cell", "n"])

    found = {r["cell"]: r["n"] for r in fps.select(fp).mapInArrow(lean(sums), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((64, 64), np.int64)
    for cell, n in found.items():
        if cell >= 0:
            both[cell // 64, cell % 64] = both[cell % 64, cell // 64] = n
    return found.get(-1, 0), both


def _deal(both: np.ndarray, n: int, m: int) -> tuple[tuple[int, ...], ...]:
    """m partitions of near-equal width; each is grown from its most correlated pair of free bits."""
    p = both.diagonal() / max(n, 1)
    with np.errstate(all="ignore"):
        corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p))))
    corr = np.where(np.isfinite(corr), corr, 1.0)
    np.fill_diagonal(corr, -1)
    free, blocks = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        own: list[int] = []
        left = sorted(free)
        if width > 1 and len(left) > 1:
            sub = corr[np.ix_(left, left)]
            i, j = divmod(int(sub.argmax()), len(left))
            own = [left[i], left[j]]
        while len(own) < width:
            rest = [b for b in left if b not in own]
            own.append(max(rest, key=lambda b: (corr[b, own].sum() if own else 0.0, -b)))
        blocks.append(tuple(sorted(own[:width])))
        free -= set(own[:width])
    return tuple(blocks)


def _within(block: tuple[int, ...], flips: np.ndarray, t: int) -> float:
    """The estimated share of pairs that differ by at most t bits of a partition."""
    if t < 0:
        return 0.0
    dist = np.zeros(len(block) + 1)
    dist[0] = 1
    for b in block:
        dist[1:] = dist[1:] * (1 - flips[b]) + dist[:-1] * flips[b]
        dist[0] *= 1 - flips[b]
    return float(dist[: t + 1].sum())


def plan(n: int, both: np.ndarray, radius: int, pairs: float | None = None) -> Plan:
    """The cheapest partitions and thresholds for n rows. pairs: how many could meet, where other columns of the run's key
    leave fewer than all of them over."""
    pairs = n * n / 2 if pairs is None else pairs
    met = 2 * pairs / max(n, 1)
    p = both.diagonal() / max(n, 1)
    flips = 2 * p * (1 - p)
    best: tuple[float, Plan] | None = None
    for m in range(2, min(radius + 1, 24) + 1):
        blocks = _deal(both, n, m)
        total = radius - m + 1
        most = min(total + m - 1, 8)  # ever larger balls never pay
        # dp[s]: the least cost of the partitions so far with thresholds + 1 adding up to s
        dp: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for block in blocks:
            costs = []
            for t in range(-1, min(most, len(block)) + 1):
                reach = 2 * ((t + 1) // 2) if t > 0 else t
                chunks = int(met * _ball(len(block), t) / (1 << len(block))) // RUN_ROWS  # a hot run sends each row to all its chunks
                costs.append((t, n * _ball(len(block), t) * (1 + chunks) * ROW_US + pairs * _within(block, flips, reach) * PAIR_US))
            now: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in dp.items():
                for t, cost in costs:
                    if s + t + 1 <= total + m and (s + t + 1 not in now or now[s + t + 1][0] > c + cost):
                        now[s + t + 1] = (c + cost, (*ts, t))
            dp = now
        if total + m in dp and (best is None or dp[total + m][0] < best[0]):
            best = (dp[total + m][0], Plan(radius, blocks, dp[total + m][1]))
    assert best, "no plan"
    return best[1]


def probe_keys(fp: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The index of the fingerprint and the key of the run, for every row that the plan sends. A key ends in the number of
    its partition."""
    idx, keys = [], []
    own = np.arange(len(fp))
    for k, (block, t) in enumerate(zip(p.blocks, p.thresholds, strict=True)):
        if t < 0:
            continue
        value = np.zeros(len(fp), np.uint64)
        for j, bit in enumerate(block):
            value |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
        salt = mix(np.array([k + 1], np.uint64))
        for r in range(min((t + 1) // 2, len(block)) + 1):
            for flip in combinations(range(len(block)), r):
                idx.append(own)
                key = mix((value ^ np.uint64(sum(1 << j for j in flip))) ^ salt)
                keys.append((key & ~np.uint64(31)) | np.uint64(k))
    return (np.concatenate(idx), np.concatenate(keys)) if idx else (own[:0], fp[:0])


def chunks_of(node: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deals out the rows of hot runs before they land: a run of m chunks becomes one run for each pair of chunks.

    Returns, for every row that is sent, the index of the given row, the lesser and the greater chunk of its pair, and its side."""
    many = np.flatnonzero(chunks > 1)
    one = np.flatnonzero(chunks <= 1)
    m = chunks[many]
    idx = np.repeat(many, m)
    other = (np.arange(len(idx)) - np.repeat(np.cumsum(m) - m, m)).astype(np.int64)
    own = (mix(node[idx].view(np.uint64)) % np.maximum(chunks[idx], 1).astype(np.uint64)).astype(np.int64)
    zero = np.zeros(len(one), np.int64)
    return (
        np.concatenate([one, idx]),
        np.concatenate([zero, np.minimum(own, other)]),
        np.concatenate([zero, np.maximum(own, other)]),
        np.concatenate([zero, (own > other).astype(np.int64)]),
    )


def chunk_key(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The key of the run of a pair of chunks; a run that is not cut keeps its own. The number of its partition stays."""
    cut = mix(key ^ mix((low * 1_000_003 + high + 1).astype(np.uint64)))
    return np.where(high > 0, (cut & ~np.uint64(31)) | (key & np.uint64(31)), key)


def _few(edge: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b), b before a, of all rows of the given runs, some runs at a time."""
    size = np.diff(edge)[own]
    for part in np.split(own, np.searchsorted(np.cumsum(size * (size - 1) // 2), np.arange(PAIRS, int((size * (size - 1) // 2).sum()) + 1, PAIRS))):
        lo, size = edge[part], np.diff(edge)[part]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(lo, size)
        a = np.repeat(start + place, place)
        b = np.repeat(start, place) + np.arange(len(a)) - np.repeat(np.cumsum(place) - place, place)
        if len(a):
            yield a, b


def run_pairs(rows: DataFrame, order: str, few: Callable, many: Callable, out: str, n_rows: int) -> DataFrame:
    """Meets rows of equal run key. rows has the columns key and side (longs) and others, also longs; the rows of a run, and
    of each of its sides, stand in the order of a column. few(cols, a, b) gives the record batches of index pairs of many small
    runs at once; many(cols, box) those of a larger one: box (lo, hi, lo2, hi2) is rows [lo, hi) against [lo2, hi2), or
    within [lo, hi) where both are the same. A run with both sides is one pair of chunks."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        cols = {c: np.concatenate(x) for c, x in zip(names, zip(*parts, strict=True), strict=True)}
        del parts
        at = np.lexsort((cols[order], cols["side"], cols["key"]))
        cols = {c: x[at] for c, x in cols.items()}
        key = cols["key"]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size, two = np.diff(edge), np.add.reduceat(cols["side"], edge[:-1]) > 0
        small = (size > 1) & (size <= FEW) & ~two
        for a, b in _few(edge, np.flatnonzero(small)):
            yield from few(cols, a, b)
        for i in np.flatnonzero((size > 1) & ~small):
            lo, hi = int(edge[i]), int(edge[i + 1])
            mid = lo + int(np.searchsorted(cols["side"][lo:hi], 1))
            if mid > lo:
                yield from many(cols, (lo, hi, lo, hi) if mid == hi else (lo, mid, mid, hi))

    return rows.repartition(fan_out(rows.sparkSession, n_rows, TASK_VALUES // len(names)), "key").mapInArrow(lean(run), out)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a and b are joined pair by pair; a label is the least index of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (np.not_equal(nxt := label[label], label)).any():
            label = nxt


def close_pairs(fp: np.ndarray, box: tuple[int, int, int, int], radius: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows [lo, hi) and [lo2, hi2) within the radius; i < j where both ranges are the same."""
    lo, hi, lo2, hi2 = box
    same = (lo, hi) == (lo2, hi2)
    for i in range(lo, hi, step):
        a = fp[i : min(i + step, hi)]
        for j in range(i if same else lo2, hi2, step):
            b = fp[j : min(j + step, hi2)]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def links(fps: DataFrame, radius: int, fp: str = "fp", run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (u, v) with u < v whose connected components are those of all pairs of the distinct fingerprints in column
    fp (long) that differ in at most radius bits. Links that join nothing new within a run are left out.

    Runs are counted before they land; one of over run_rows rows is dealt out as pairs of chunks."""
    n, both = bit_statistics(fps, fp)
    p = plan(n, both, radius)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 15):
                x = b.column(0).slice(lo, 1 << 15).to_numpy(zero_copy_only=False).astype(np.int64)
                idx, key = probe_keys(x.view(np.uint64), p)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(x[idx])], ["key", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 12):
                key, x, n = (c.to_numpy(zero_copy_only=False) for c in b.slice(lo, 1 << 12).columns)
                idx, low, high, side = chunks_of(x, n)
                yield pa.record_batch([pa.array(chunk_key(key[idx].view(np.uint64), low, high).view(np.int64)), pa.array(side), pa.array(x[idx])], ["key", "side", "fp"])

    def joined(x: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(label != np.arange(len(label)))
        u, v = x[at], x[label[at]]
        at = u != v
        yield pa.record_batch([pa.array(np.maximum(u, v)[at]), pa.array(np.minimum(u, v)[at])], ["v", "u"])

    def few(cols: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = int(b[0]), int(a[-1]) + 1
        x = cols["fp"][lo:hi]
        a, b = a - lo, b - lo
        near = np.bitwise_count((x[a] ^ x[b]).view(np.uint64)) <= radius
        yield from joined(x, merge(np.arange(hi - lo), a[near], b[near]))

    def many(cols: dict[str, np.ndarray], box: tuple) -> Iterator[pa.RecordBatch]:
        lo, hi = min(box[0], box[2]), max(box[1], box[3])
        label = np.arange(hi - lo)
        for x, y in close_pairs(cols["fp"].view(np.uint64), box, radius):
            label = merge(label, x - lo, y - lo)
        yield from joined(cols["fp"][lo:hi], label)

    rows = fps.select(fp).mapInArrow(lean(probes), "key long, fp long")
    if n > run_rows:  # else no run can be that large
        hot = rows.groupBy("key").count().where(F.col("count") > run_rows).select("key", F.ceil(F.col("count") / run_rows).cast("long").alias("chunks"))
        rows = rows.join(cut(hot), "key", "left").select("key", "fp", F.coalesce("chunks", F.lit(1)).cast("long").alias("chunks")).mapInArrow(lean(deal), "key long, side long, fp long")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("side"), "fp")
    return run_pairs(rows, "fp", few, many, "v long, u long", n * p.rows).select("u", "v").distinct()
