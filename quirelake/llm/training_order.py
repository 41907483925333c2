"""Token-id shards in training order.

Documents are tokenized, ended by end_id, laid end to end within a task and cut into sequences of `stride` ids, which are
staged in the shared folder once. Then their number is known exactly: a sequence's index is how many stand in the tasks
before it, plus its own number there, and a keyed Feistel permutation of the numbers below that count, which walks the cycle
while it leaves them, gives its global slot. Ranges of slots make the shards, each written by one task as a file of
fixed-stride records in order, so that slot s is record s % shard_records of shard s // shard_records and a reader may start
or go on at any slot. The order is the same for the same key and input.

Files are written under a temporary name and renamed, so a task that runs again leaves the same file; what failed attempts
leave, and the staged rows, are removed at the end.

Defined results for odd input: a null or empty text has the end id only; rows that repeat a doc_id are written each; a null
doc_id is kept; the last sequence of a task is padded with end_id, its true length being in the manifest; further columns
are ignored; an id that doesn't fit the width (bytes of an id) is an error; an empty table writes no shard and gives no
rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, fan_out, lean, mix
from .tokens import default_paths, encoder, texts

STRIDE, END_ID, KEY, WIDTH = 2048, 50256, 20240229, 2
#: Bytes of a shard, where there are more of them than shuffle partitions.
SHARD_BYTES = 256 << 20
ROUNDS = 6


def feistel(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    """A keyed permutation of the numbers below 2^bits, bits being even."""
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & mask
    for r in range(ROUNDS):
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
        left, right = right, left ^ (mix(right + salt) & mask)
    return (left << half) | right


def permuted(x: np.ndarray, key: int, n: int) -> np.ndarray:
    """A keyed permutation of the numbers below n: those that leave it are permuted on until they are back."""
    bits = max(2, (n - 1).bit_length() + ((n - 1).bit_length() & 1))
    out = feistel(x.astype(np.uint64), key, bits)
    while len(away := np.flatnonzero(out >= np.uint64(n))):
        out[away] = feistel(out[away], key, bits)
    return out


def sequences(docs: DataFrame, stride: int, end_id: int, width: int, paths: tuple[str, str | None]) -> DataFrame:
    """(task, number, length, first_doc_id, first_start, ids): the sequences of each task, ids of `width` bytes, padded."""
    names = ["task", "number", "length", "first_doc_id", "first_start", "ids"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(*paths), np.array([end_id], kind).tobytes()
        context = TaskContext.get()
        task, number = context.partitionId() if context else 0, 0
        rest, first = b"", (None, 0)  # ids that are still to be cut, the document of the first and its place there
        out: list[tuple] = []

        def add(length: int, ids: bytes) -> None:
            nonlocal number
            out.append((task, number, length, *first, ids))
            number += 1

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                own = np.frombuffer(enc.encode(text), "<u4")
                if width < 4 and len(own) and int(own.max()) >> (8 * width):
                    raise ValueError(f"an id doesn't fit {width} bytes")
                if not rest:
                    first = (doc_id, 0)
                at = -(len(rest) // width)  # where the ids begin, in the document
                rest += own.astype(kind).tobytes() + end
                cut_to = len(rest) // (width * stride) * width * stride
                for lo in range(0, cut_to, width * stride):
                    add(stride, rest[lo : lo + width * stride])
                    first = (doc_id, at + lo // width + stride)
                rest = rest[cut_to:]
                if len(out) >= 1024:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if rest:
            add(len(rest) // width, rest + end * (stride - len(rest) // width))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), "task long, number long, length int, first_doc_id long, first_start long, ids binary")


def slots(staged: DataFrame, counts: dict[int, int], key: int, per_shard: int) -> DataFrame:
    """The staged rows with their slot and shard, ids compressed one by one for the shuffle. counts: the sequences of each task."""
    tasks = sorted(counts)
    first = np.zeros(tasks[-1] + 1, np.int64)  # a number for each task
    first[tasks] = np.cumsum([0, *(counts[t] for t in tasks[:-1])])
    total = sum(counts.values())
    held = staged.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            index = held.value[b.column(0).to_numpy()] + b.column(1).to_numpy()
            slot = permuted(index, key, total).astype(np.int64)
            yield pa.record_batch([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), *b.columns[2:5], pa.array([pack.compress(x) for x in b.column(5).to_pylist()], pa.binary())], ["shard", "slot", *b.schema.names[2:]])

    return staged.mapInArrow(lean(run), "shard int, slot long, length int, first_doc_id long, first_start long, ids binary")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _sweep(spark: SparkSession, folder: str) -> None:
    """Removes the staged rows and what failed attempts left behind."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(folder)) if fs.exists(path(folder)) else ():
        if f.getPath().getName().startswith("_") or f.getPath().getName() == "staged":
            fs.delete(f.getPath(), True)


def write_shards(
    docs: DataFrame, folder: str, shards: int | None = None, stride: int = STRIDE, end_id: int = END_ID, key: int = KEY, width: int = WIDTH, paths: tuple[str, str | None] | None = None
) -> DataFrame:
    """Writes the shards to a folder that all machines share. A row for each sequence: slot, shard, place (its record in the
    file), length, ids_crc32 (of the record), first_doc_id, first_start (the document's ids before it)."""
    spark = docs.sparkSession
    names = ["slot", "shard", "place", "length", "ids_crc32", "first_doc_id", "first_start"]
    schema = "slot long, shard int, place long, length int, ids_crc32 long, first_doc_id long, first_start long"
    sequences(docs, stride, end_id, width, paths or default_paths()).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    counts = {r["task"]: r["n"] for r in staged.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row for each task
    total = sum(counts.values())
    if not total:
        _sweep(spark, folder)
        return spark.createDataFrame([], schema)
    shards = shards or fan_out(spark, total, max(1, SHARD_BYTES // (width * stride)))
    per_shard = -(-total // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        unpack = zstandard.ZstdDecompressor()
        shard, sink = None, None

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{root}/_{attempt}-{shard_name(shard)}", f"{root}/{shard_name(shard)}")

        for b in batches:
            rows = []
            for s, slot, length, doc, start, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    close()
                    shard, place = s, 0
                    sink = store.open_output_stream(f"{root}/_{attempt}-{shard_name(s)}")
                if slot != s * per_shard + place:
                    raise ValueError(f"slot {slot} is not the next of shard {s}")
                ids = unpack.decompress(ids)
                sink.write(ids)
                rows.append((slot, s, place, length, zlib.crc32(ids), doc, start))
                place += 1
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)
        close()

    ordered = slots(staged, counts, key, per_shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    manifest = cut(ordered.mapInArrow(lean(run), schema))
    _sweep(spark, folder)
    return manifest


def read_records(folder: str, shard: int, place: int, count: int = 1, stride: int = STRIDE, width: int = WIDTH) -> np.ndarray:
    """Records of a shard, from a place on."""
    store, root = _open(folder)
    with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
        return np.frombuffer(f.read_at(width * stride * count, width * stride * place), f"<u{width}").reshape(-1, stride)
