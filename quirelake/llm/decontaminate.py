"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

For each size of an item (in words), a document's windows of that size are fingerprinted. Only windows that could be
similar enough are: the item must share so much weight with the window that at least ceil(threshold x its shingles) of the
window's shingles belong to the benchmark, which a running count tells of every window at once. The fingerprints of the
items of each size stand in a sorted table for each Hamming block, once, under their own value; a window looks in it under
every value within floor(radius / blocks) bits of its own, and so finds every fingerprint within the radius in some block.
Candidates are verified by the weighted Jaccard similarity of their shingles, a shingle's weight being its count.

The benchmark is held by every task, some ten bytes for each of its own. Its size is checked: over MAX_BENCHMARK_BYTES the
items are dealt out in parts, each with a pass of its own over the documents.

Defined results for odd input: a null or empty text, or one without words, has no window; an item without words is left
out; a text or item of fewer words than a shingle has one shingle, its whole sequence, and such an item is found wherever
a text has its words in a row; items of equal text are both reported; items whose item_id is null are reported as one item
of null id; rows that repeat a doc_id are searched each and reported once for each item; a null doc_id is reported as null;
further columns are ignored; an empty documents or benchmark table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bit_counts, cut, lean, majority, quoted, shingle_hashes, slices, span_hashes, text_bytes, unused, without, word_spans

WORDS, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 16, 5
MAX_BENCHMARK_BYTES = 32 << 20


def hashed(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end, and the first of each text."""
    starts, ends, first = word_spans(raw, offsets)
    return shingle_hashes(span_hashes(raw, starts, ends), first, k)


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


@dataclass
class Items:
    """The benchmark, as each task holds it."""

    ids: list[int | None]
    shingles: np.ndarray  # of all items, end to end
    first: np.ndarray
    k: int
    radius: int
    blocks: int
    #: Of items of fewer words than a shingle, by their words: the hash of the whole item, and the items that have it.
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    @cached_property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def known(self) -> np.ndarray:
        return np.unique(self.shingles)

    @cached_property
    def sieve(self) -> np.ndarray:
        """A bit for each value of the low 22 bits: whether some known shingle has it."""
        t = np.zeros(1 << 22, bool)
        t[self.known & np.uint64((1 << 22) - 1)] = True
        return t

    @cached_property
    def fp(self) -> np.ndarray:
        return majority(bit_counts(self.shingles, self.first), self.size)

    @cached_property
    def index(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """By the size of items: for each block, their values in order, and whose they are."""
        out = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            out[n] = []
            for lo, hi in _blocks(self.blocks):
                value = (self.fp[own] >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                order = np.argsort(value, kind="stable")
                out[n].append((value[order], own[order]))
        return out

    @cached_property
    def flips(self) -> list[np.ndarray]:
        """For each block, what lies within floor(radius / blocks) bits of a value, as differences from it."""
        most = self.radius // self.blocks
        return [np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(hi - lo), r)], np.uint64) for lo, hi in _blocks(self.blocks)]

    def near(self, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a fingerprint in f, item of size n) within the radius; all of them, in order."""
        found = [np.zeros((2, 0), np.int64)]
        most = self.radius // self.blocks
        for (value, whose), flips, (lo, hi) in zip(self.index.get(n, []), self.flips, _blocks(self.blocks), strict=False):
            own = (f >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            for i in range(0, len(f), 256):
                part = own[i : i + 256]
                if len(value) <= len(flips):  # fewer values than a window would look up
                    x, y = np.nonzero(np.bitwise_count(part[:, None] ^ value[None, :]) <= most)
                    x, y = x + i, whose[y]
                else:
                    probe = (part[:, None] ^ flips[None, :]).ravel()
                    first, end = np.searchsorted(value, probe), np.searchsorted(value, probe, "right")
                    hit = np.flatnonzero(end > first)
                    count = (end - first)[hit]
                    at = np.repeat(first[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    x, y = np.repeat(hit // len(flips) + i, count), whose[at]
                close = np.bitwise_count(f[x] ^ self.fp[y]) <= self.radius
                found.append(np.stack([x[close], y[close]]))
        x, y = np.unique(np.concatenate(found, axis=1), axis=1)
        return x, y

    @cached_property
    def bags(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [np.unique(self.shingles[a:b], return_counts=True) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def hits(self, h: np.ndarray) -> np.ndarray:
        out = self.sieve[h & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(out)
        near = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = self.known[near] == h[at]
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags of shingles: the sum of the lesser counts by that of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def leaks_of(h: np.ndarray, hit: np.ndarray, items: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """Of a document with shingles h: (item, similarity, first shingle of the window, bits that differ), the best window of each item."""
    best: dict[int, tuple[float, int, int]] = {}
    run = np.concatenate([[0], np.cumsum(hit)])
    for n in np.unique(items.size[items.size > 0]).tolist():
        size = min(n, len(h))
        need = int(np.ceil(threshold * n - 1e-9))
        if size < need:
            continue
        starts = np.flatnonzero(run[size:] - run[:-size] >= need)
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            flat = h[(part[:, None] + np.arange(size)).ravel()]
            fps = majority(bit_counts(flat, np.arange(0, len(flat) + 1, size)), np.full(len(part), size))
            near = items.near(fps, n)
            done: dict[tuple[bytes, int], float] = {}
            for w, i in zip(*(x.tolist() for x in near), strict=True):
                s = int(part[w])
                window = h[s : s + size]
                key = window.tobytes(), i
                if key not in done:
                    done[key] = similarity(np.unique(window, return_counts=True), items.bags[i])
                sim = done[key]
                if sim >= threshold and (i not in best or (-sim, s) < (-best[i][0], best[i][1])):
                    best[i] = sim, s, (int(items.fp[i]) ^ int(fps[w])).bit_count()
    return [(i, *x) for i, x in sorted(best.items())]


def _parts(benchmark: DataFrame, k: int, radius: int, blocks: int) -> list[Items]:
    """The benchmark in parts of bounded size, each with a hash of id and text of its own. An item is found by itself, so what
    is found doesn't depend on their number."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = -(-total // MAX_BENCHMARK_BYTES)
    out = []
    for p in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p)
        got = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        raw, offsets = text_bytes(pa.array([t for _, t in got], pa.string()))
        h, first = hashed(raw, offsets, k)
        count = np.diff(word_spans(raw, offsets)[2])
        keep = np.diff(first) > 0
        ids = [i for (i, _), has in zip(got, keep.tolist(), strict=True) if has]
        first = np.concatenate([[0], np.cumsum(np.diff(first)[keep])]).astype(np.int64)
        if ids:
            short: dict[int, dict[int, list[int]]] = {}
            for i, size in enumerate(count[keep].tolist()):
                if size < k:
                    short.setdefault(size, {}).setdefault(int(h[first[i]]), []).append(i)
            out.append(Items(ids, h, first, k, radius, blocks, short))
    return out


def short_leaks(raw: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(text, item, first word) of the first place where a text has the words of an item shorter than a shingle."""
    for n, table in items.short.items():
        h, first = hashed(raw, offsets, n)
        at = np.flatnonzero(np.isin(h, np.array(list(table), np.uint64)))
        doc = np.searchsorted(first, at, "right") - 1
        one = np.unique(np.stack([doc.astype(np.uint64), h[at]]), axis=1, return_index=True)[1] if len(at) else at
        for d, s in zip(doc[one].tolist(), at[one].tolist(), strict=True):
            for i in table[int(h[s])]:
                yield d, i, int(s - first[d])


SCHEMA = "doc_id long, item_id long, similarity double, start_word long, bits int"


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id") -> DataFrame:
    """A row for each document and item whose best window of the item's size has at least the similarity."""
    names = ["doc_id", "item_id", "similarity", "start_word", "bits"]
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in _parts(benchmark, words, radius, blocks):
        held = docs.sparkSession.sparkContext.broadcast(items)  # at most MAX_BENCHMARK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for b in batches:
                ids, rows = b.column(0), []
                raw, offsets = text_bytes(b.column(1))
                for i, j in slices(offsets):
                    h, first = hashed(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], items.k)
                    rows += [(ids[i + d].as_py(), items.ids[k], 1.0, s, 0) for d, k, s in short_leaks(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], items)]
                    hit = items.hits(h)
                    some = np.concatenate([[0], np.cumsum(hit)])
                    for d in np.flatnonzero(some[first[1:]] > some[first[:-1]]).tolist():
                        own = slice(first[d], first[d + 1])
                        rows += [(ids[i + d].as_py(), items.ids[k], *x) for k, *x in leaks_of(h[own], hit[own], items, threshold)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names)

        out = out.unionByName(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(lean(run), SCHEMA))
    return out.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("similarity", "start_word", "bits"), F.struct(-F.col("similarity"), "start_word", "bits")).alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold an item of the benchmark. A null doc_id is decided row by row of its text."""
    key = unused(docs, "row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = leaks(keyed, benchmark, id_col=key, **how).select(F.col("doc_id").alias(key))
    return without(keyed, key, cut(found)).select(*quoted(docs))
