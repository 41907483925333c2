"""Quality classifier: a linear-chain CRF labels every line good or bad, its marginals weighted by length score the document.

Lines are described by shares of byte classes and by the lines beside them, each cut into bins at quantiles. Only
documents are labelled: every line starts with its document's label; between fits, lines of a bad document that the model
holds for good are relabelled, its longest bad line excepted.

Defined results for odd input: a null or empty text has no line and scores the share of good documents in the sample;
lines of white space only are left out; rows that repeat a doc_id are scored each; a null doc_id counts as held out (it has
no remainder); without any label every document scores 0.5; further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, slices, span_hashes, text_bytes, word_spans
from .crf import Chain, fit, marginals

#: The most labelled documents that the fit takes, and the most bytes of text of each label among them.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 6 << 20
BINS, FOLDS, THRESHOLD = 8, 5, 0.3


def _members(chars: str) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars.encode())] = 1
    return t


_ALPHA = _members("".join(map(chr, [*range(65, 91), *range(97, 123)])))
_ALPHA[0xC3:0xF5] = 1
CLASSES = {
    "upper": _members("".join(map(chr, range(65, 91)))),
    "alpha": _ALPHA,
    "digit": _members("0123456789"),
    "stop": _members(".!?"),
    "comma": _members(",;:"),
    "mark": _members("#$%&*+<=>@\\^_`{|}~[]()/\"'!-"),
    "vowel": _members("aeiouAEIOU"),
}


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of the lines of texts laid end to end, the lines' lengths, and the first line of each text."""
    n = len(raw)
    cut = np.flatnonzero(raw == 10) + 1 if n else np.zeros(0, np.int64)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], cut[cut < n])
    if not len(starts):
        return np.zeros((0, 3 * 14), np.float32), np.zeros(0), np.zeros(len(offsets), np.int64)
    ends = np.concatenate([starts[1:], [n]])
    ws, we, _ = word_spans(raw, offsets)
    w0, w1 = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    counts = {c: np.add.reduceat(t[raw], starts, dtype=np.int64) for c, t in CLASSES.items()}
    keep = w1 > w0
    starts, ends, w0, w1 = starts[keep], ends[keep], w0[keep], w1[keep]
    counts = {c: x[keep] for c, x in counts.items()}
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # from the first word to the end of the last
    begin, end = ws[w0], we[w1 - 1]
    size, words = (end - begin).astype(np.float64), (w1 - w0).astype(np.float64)
    key = span_hashes(raw, begin, end) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    length = (we - ws).astype(np.float64)
    longest = np.maximum.reduceat(length, w0) if len(w0) else length
    ended = ~_ALPHA[raw[we - 1]].astype(bool) if len(we) else np.zeros(0, bool)
    odd_ends = np.concatenate([[0], np.cumsum(ended)])
    whash = span_hashes(raw, ws, we)
    line_of = np.repeat(np.arange(len(starts)), w1 - w0)
    word_at = np.concatenate([np.arange(a, b) for a, b in zip(w0, w1, strict=True)]) if len(w0) else np.zeros(0, np.int64)
    pair = np.unique(whash[word_at] ^ (line_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
    distinct = np.bincount(line_of[pair], minlength=len(starts))
    same = np.zeros(len(ws), bool)
    same[1:] = whash[1:] == whash[:-1]
    twice = np.concatenate([[0], np.cumsum(same)])
    alpha = np.maximum(counts["alpha"], 1)
    own = np.stack(
        [
            np.log1p(size),
            size / words,
            np.minimum(longest, 100),
            counts["upper"] / alpha,
            counts["digit"] / size,
            counts["stop"] / words,
            counts["comma"] / words,
            counts["mark"] / words,
            counts["alpha"] / size,
            counts["vowel"] / alpha,
            (odd_ends[w1] - odd_ends[w0]) / words,
            distinct / words,
            (twice[w1] - twice[w0]) / words,
            np.minimum(times[back], 8),
        ],
        axis=1,
    ).astype(np.float32)
    # the lines beside it; at an end of the document -1 in every place
    above, below = np.full_like(own, -1), np.full_like(own, -1)
    above[1:], below[:-1] = own[:-1], own[1:]
    edge = first[:-1][np.diff(first) > 0]
    above[edge] = -1
    below[np.concatenate([edge[1:], [len(own)]]) - 1] = -1
    return np.concatenate([own, above, below], axis=1), size, first


@dataclass
class Model:
    cuts: np.ndarray  # of each measure, BINS - 1 quantiles
    chain: Chain
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for j in range(x.shape[1]):
            out[:, j] = np.searchsorted(self.cuts[j], x[:, j], "right") + 1 + j * (BINS + 1)
            out[x[:, j] < 0, j] = j * (BINS + 1)
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, first = line_features(raw, offsets)
        p = marginals(self.chain.scores(self.bins(x)), first, self.chain)[0][:, 1] if len(x) else np.zeros(0)
        weight = np.concatenate([[0.0], np.cumsum(size)])
        good = np.concatenate([[0.0], np.cumsum(size * p)])
        total = weight[first[1:]] - weight[first[:-1]]
        with np.errstate(all="ignore"):
            return np.where(total > 0, np.clip((good[first[1:]] - good[first[:-1]]) / total, 0, 1), self.prior)


def train(texts: list[str], labels: list[int], passes: int = 3) -> Model:
    """Fits the chain to documents with labels 0 and 1."""
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    parts = [line_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 18)]
    x, size = (np.concatenate([p[k] for p in parts]) if parts else line_features(raw, offsets)[k] for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]) if parts else np.zeros(1, np.int64)
    cuts = np.stack([np.quantile(c[c >= 0], np.arange(1, BINS) / BINS) if (c >= 0).any() else np.zeros(BINS - 1) for c in x.T]) if len(x) else np.zeros((x.shape[1], BINS - 1))
    model = Model(cuts, Chain(np.zeros((x.shape[1] * (BINS + 1), 2)), np.zeros((2, 2)), np.zeros((2, 2))), float(np.mean(labels)) if labels else 0.5)
    if len(set(labels)) < 2 or not len(x):
        return model
    y_doc = np.repeat(np.array(labels, np.int64), np.diff(first))
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    y, f = y_doc.copy(), model.bins(x)
    for i in range(passes):
        model.chain = fit(f, y, first, x.shape[1] * (BINS + 1), 2, rounds=60 if i else 100, start=model.chain if i else None)
        if i + 1 == passes:
            break
        p = marginals(model.chain.scores(f), first, model.chain)[0][:, 1]
        y = np.where((y_doc == 0) & (p > 0.5), 1, y_doc)
        longest = np.lexsort((size * (y == 0), doc))[np.cumsum(np.bincount(doc, minlength=len(labels)))[np.bincount(doc, minlength=len(labels)) > 0] - 1]
        y[longest] = y_doc[longest]
    return model


def fold(doc_id) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def fold_column(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def fit_on(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from at most max_docs labelled rows outside the held-out fold, at most half of them of each label, drawn by
    the hash of their doc_id; a text over 1/64 of max_bytes is left to the others of its label."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold_column() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = docs.select("doc_id", "text").where(F.length("text") <= max_bytes // 64)
    picked = known.withColumn("draw", F.xxhash64("doc_id")).where("draw is not null")
    parts = [picked.where(F.col("quality") == q).orderBy("draw", "doc_id").limit(max_docs // 2) for q in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select("doc_id", "quality")
    rows = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    taken, out = {0: 0, 1: 0}, []
    for r in sorted(rows, key=lambda r: zlib.crc32(str(r["doc_id"]).encode()[::-1])):
        size = len((r["text"] or "").encode())
        if taken[r["quality"]] + size <= max_bytes // 2:
            taken[r["quality"]] += size
            out.append((r["text"] or "", r["quality"]))
    return train([t for t, _ in out], [q for _, q in out])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs (columns keep: names; default the id alone) with score and predicted."""
    keep = [id_col] if keep is None else keep
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    held = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers, whatever the size of the tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(b.num_columns - 1))
            for i, j in slices(offsets):
                s = held.value.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = b.slice(i, j - i)
                yield pa.record_batch([*part.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(run), f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    out = score(docs, fit_on(docs, labels))
    return out.select("doc_id", F.coalesce(fold_column() == 0, F.lit(True)).alias("held_out"), "score", "predicted")
