"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or a part of a longer one that ends after a word whose hash says so (one in LINE_WORDS), so that an
edit changes the paragraphs around it only. Each digest, with its number among equal ones, is dealt to one cell of
each of three tables; a cell holds a count, the exclusive or of the digests, and that of their checks. The sketches of two
versions subtract, and peeling cells that hold one digest recovers those that differ, many pairs at a time in numpy. The
fingerprints themselves, of CELLS cells, are subtracted first; pairs that don't peel are retried with larger sketches, and
those that don't at LAST cells for each digest (equal places of different digests) are compared digest by digest.

Defined results for odd input: a null or empty text, or one without words, has an empty sketch; two empty sketches have
likeness 1; the next document of a row is the one after it by doc_id (nulls first), then text, so rows that repeat a doc_id
follow each other; the only row of a table follows itself; further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType, BooleanType

from .common import fan_out, lean, mix, span_hashes, text_bytes, word_spans

#: Cells of a fingerprint, and how often the cells of a sketch that doesn't peel are doubled.
CELLS, GROWTH = 12, 1
#: Cells for each digest of both at the first retry: half of an edited text differs, mostly all of the next text.
EDITED, NEXT = 0.75, 1.5
#: Cells for each digest of both from which on no retry is made.
LAST = 16
#: Words of a part of a long line, on average.
LINE_WORDS = 8
CELL = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")])


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of texts laid end to end, numbered among equal ones, and the first of each text."""
    starts, ends, first = word_spans(raw, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = span_hashes(raw, starts, ends)
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    last = (words & np.uint64(LINE_WORDS - 1)) == 0
    last[:-1] |= feeds[starts[1:]] > feeds[ends[:-1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])
    place = np.arange(n) - np.repeat(start, stop - start)
    digest = mix(np.add.reduceat(mix(words + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start) + (stop - start).astype(np.uint64))
    at = np.searchsorted(start, first)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((digest, doc))
    d, k = digest[order], doc[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    number = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    out = np.empty_like(digest)
    out[order] = mix(d + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out, at


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(0xFFFFFFFF)


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [((mix(keys + np.uint64((j + 1) * 0x8EBC6AF09C88C6E3 % 2**64)) % np.uint64(third)).astype(np.int64) + j * third) for j in range(3)]


def sketch(keys: np.ndarray, at: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, keys and checks of each set, as rows of cells."""
    rows = len(at) - 1
    base = np.repeat(np.arange(rows), np.diff(at)) * cells
    n, key, check = np.zeros(rows * cells, np.int64), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)
    c = _check(keys)
    for place in _places(keys, cells):
        i = base + place
        n += np.bincount(i, minlength=rows * cells)
        np.bitwise_xor.at(key, i, keys)
        np.bitwise_xor.at(check, i, c)
    return tuple(x.reshape(rows, cells) for x in (n, key, check))


def peel(n: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of differences of sketches: whether each was emptied, how many digests came out, and these as (row, digest, sign)."""
    rows, cells = n.shape
    n, key, check = n.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    found, out = np.zeros(rows, np.int64), []
    live = np.arange(rows * cells)
    while len(live):
        one = live[(np.abs(n[live]) == 1)]
        one = one[_check(key[one]) == check[one]]
        if not len(one):
            break
        row = one // cells
        _, lead = np.unique(mix(key[one] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        one, row = one[lead], row[lead]
        k, sign = key[one], n[one]
        found += np.bincount(row, minlength=rows)
        out.append((row, k, sign))
        c = _check(k)
        touched = []
        for place in _places(k, cells):
            i = row * cells + place
            np.subtract.at(n, i, sign)
            np.bitwise_xor.at(key, i, k)
            np.bitwise_xor.at(check, i, c)
            touched.append(i)
        live = np.unique(np.concatenate(touched))
    clear = ((n == 0) & (key == 0) & (check == 0)).reshape(rows, cells).all(1)
    return clear, found, out


def take(keys: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows."""
    size = np.diff(at)[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    i = np.repeat(at[:-1][rows] - to[:-1], size) + np.arange(to[-1])
    return keys[i], to


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS, share: float = 0.0) -> np.ndarray:
    """How many digests differ between the sets of each row of a and b. Sketches of `cells` cells, the fingerprints, subtract
    first; share: cells for each digest of both at the first retry, for versions that are known to differ much."""
    total = np.diff(a[1]) + np.diff(b[1])
    out = np.zeros(len(total), np.int64)
    # doublings of `cells` that each row is tried at next, and at its first retry
    at = np.zeros(len(total), np.int64)
    retry = np.ceil(np.log2(np.maximum(total * share / cells, 1))).astype(np.int64)
    left = np.arange(len(total))
    while len(left):
        k = int(at[left].min())
        own = left[at[left] == k]
        size = cells << k
        step = max(1, (1 << 20) // size)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            x, y = sketch(*take(*a, part), size), sketch(*take(*b, part), size)
            clear, found, _ = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
            out[part[clear]] = found[clear]
            at[part] = np.where(clear, -1, np.maximum(k + GROWTH, retry[part]))
            for i in part[~clear & (size >= LAST * total[part])].tolist():
                out[i] = len(np.setxor1d(a[0][a[1][i] : a[1][i + 1]], b[0][b[1][i] : b[1][i + 1]]))
                at[i] = -1
        left = left[at[left] >= 0]
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], share: float = 0.0) -> np.ndarray:
    """Twice the digests in common by all of both."""
    total = np.diff(a[1]) + np.diff(b[1])
    return np.where(total > 0, 1 - differences(a, b, share=share) / np.maximum(total, 1), 1.0)


def fingerprints(keys: np.ndarray, at: np.ndarray, cells: int = CELLS) -> list[str]:
    """The cells of each set's sketch, as hex digits."""
    n, key, check = sketch(keys, at, cells)
    out = np.zeros(n.shape, CELL)
    out["n"], out["key"], out["check"] = n, key, check
    raw, size = out.tobytes(), CELL.itemsize * cells
    return [raw[i * size : (i + 1) * size].hex() for i in range(len(n))]


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the start of another."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters of text that are worked on together.
GROUP_CHARS = 1 << 20


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """rows: doc_id, text, next text."""
    changed = [edited(t, u) for _, t, u in rows]
    # the next text is mostly the next row's own
    texts, after = [t for _, t, _ in rows], []
    for i, (_, _, u) in enumerate(rows):
        if i + 1 < len(rows) and rows[i + 1][1] is u:
            after.append(i + 1)
        else:
            after.append(len(texts))
            texts.append(u)
    every = paragraphs(*text_bytes(pa.array(texts, pa.large_string())))
    own, following = take(*every, np.arange(len(rows))), take(*every, np.array(after))
    new = paragraphs(*text_bytes(pa.array(changed, pa.large_string())))
    return pa.record_batch(
        [
            pa.array([i for i, _, _ in rows], pa.int64()),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(fingerprints(*own)),
            pa.array(fingerprints(*new)),
            pa.array(likeness(own, new, EDITED)),
            pa.array(likeness(own, following, NEXT)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def against_next(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likeness to each other and to the next's.

    Rows are dealt out by ranges of doc_id, once; the first row of a range goes to the range before it as well (that of the
    first to the last), so that every task has the row after its last."""
    spark = docs.sparkSession
    least = -(1 << 63)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = fan_out(spark, 1, 1)
    cuts = spark.sparkContext.broadcast(np.unique(np.array(docs.select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n), np.float64)))

    def part_of(k: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts.value, k.astype(np.float64), "right")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            p = part_of(k)
            order = np.lexsort((k, p))
            for i in order[np.concatenate([[True], np.diff(p[order]) > 0])] if len(k) else []:
                low[int(p[i])] = min(low.get(int(p[i]), int(k[i])), int(k[i]))
        if low:
            yield pa.record_batch([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], ["part", "k"])

    # a row for each range, of which there are as many as shuffle partitions
    firsts = sorted((r["part"], r["k"]) for r in own.select("k").mapInArrow(lean(heads), "part int, k long").groupBy("part").agg(F.min("k").alias("k")).collect())
    parts = [p for p, _ in firsts]
    tails = spark.sparkContext.broadcast({k: parts[i - 1] for i, (_, k) in enumerate(firsts)})

    @F.arrow_udf(ArrayType(StructType([StructField("part", IntegerType()), StructField("tail", BooleanType())])))
    def places(k: pa.Array) -> pa.Array:
        keys = k.to_numpy(zero_copy_only=False)
        return pa.array(
            [[{"part": p, "tail": False}] + ([{"part": tails.value[x], "tail": True}] if x in tails.value else []) for x, p in zip(keys.tolist(), part_of(keys).tolist(), strict=True)],
            pa.list_(pa.struct([("part", pa.int32()), ("tail", pa.bool_())])),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        held = None  # the part, doc_id and text of the row that waits for the one after it
        size = 0
        for b in batches:
            for part, tail, k, known, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == part:
                    ready.append((held[1], held[2], text))
                    size += len(text) + len(held[2])
                held = None if tail else (part, k if known else None, text)
                if size >= GROUP_CHARS:
                    yield _compare(ready)
                    ready, size = [], 0
        if ready:
            yield _compare(ready)

    dealt = own.withColumn("at", F.explode(places("k"))).select("at.part", "at.tail", "k", "known", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "tail", "k", "text").mapInArrow(lean(run), SCHEMA)
