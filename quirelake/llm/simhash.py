"""SimHash near-dedup: fingerprints, links within a Hamming radius by the generalised pigeonhole principle, and classes.

Defined results for odd input: a null or empty text, or one without words, has fingerprint 0 and links like any other;
rows that repeat a doc_id keep a row each; a null doc_id has a fingerprint and belongs to the class of its links, and
never names it unless the class has no other; further columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, lean
from .components import components
from .hamming import links

RADIUS, WORDS, SEED = 4, 4, 42
#: Shingles whose bits are counted at once.
STEP = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the XXH64 (seed 42) of the text's word shingles."""
    # bytes.lower() changes A-Z only; bytes.split() cuts at space and 09-0D only
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(w))
    lo, hi = start[: len(w) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(lo), STEP):
        h = b"".join([digest(line[a:b], SEED) for a, b in zip(lo[i : i + STEP], hi[i : i + STEP], strict=True)])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(lo)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id): the smallest doc_id that links of at most radius bits lead to."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    least = distinct.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    label = cut(least.groupBy("root").agg(F.min("first").alias("component_id")))  # so that the join on a root that many have can be split
    by_fp = least.select("fp", "root").join(label, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(cut(fingerprints(docs, words)), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
