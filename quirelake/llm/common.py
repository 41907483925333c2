"""What the operators share: where lineage is cut, and how Arrow batches become numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a numpy pass works on at once; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets
    a temporary one, and any other an error: executors don't see each other's folders."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if root is None and known.isDefined():
        return known.get()
    if root is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quirelake-")
    if not known.isDefined():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: later plans neither repeat the work nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fan_out(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_task))


def lean(run: Callable) -> Callable:
    """A function over batches that gives unused memory back at the end of its partition; workers are used again and again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len + 1 offsets into them; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about size bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept and extended by doubling."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, k, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every byte range, mixed; equal bytes have equal hashes wherever they stand."""
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of texts laid end to end, and the first word of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, and the first shingle of each text.

    A text of fewer words, but one at least, has one shingle: its whole sequence. A text without words has none."""
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(made, out=at[1:])
    doc = np.repeat(np.arange(len(made)), made)
    start = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    size = np.minimum(count, k)[doc]
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        on = j < size
        w = words[np.minimum(start + j, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(on, (out ^ w) * np.uint64(0xA0761D6478BD642F) + np.uint64(j + 1), out)
    return mix(out), at


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (bit 0 first) is set among the hashes of each text."""
    out = np.zeros((len(at) - 1, 64), np.int64)
    step = 1 << 16
    for lo in range(0, len(h), step):
        part = h[lo : lo + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.clip(at - lo, 0, len(part))
        rows = np.flatnonzero(np.diff(cuts))
        out[rows] += np.add.reduceat(bits, cuts[rows], axis=0, dtype=np.int64)
    return out


def majority(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The fingerprint whose bits are set in over half of the hashes."""
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


#: Bits of a sieve; its bitmaps take an eighth of that in bytes, however many keys it holds.
SIEVE_BITS = 1 << 24


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}".lower() in taken:
        name += "_"
    return f"__{name}"


def sieve(keys: DataFrame, key: str, bucket: str, bitmap: str) -> DataFrame:
    """A table of bitmaps (bucket, bitmap) of the keys (longs) to broadcast, bounded by SIEVE_BITS / 8 bytes."""
    at = F.pmod(F.col(key), F.lit(SIEVE_BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bitmap))


def sift(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be among the keys (all that are, and few others), and the rest; neither is shuffled.

    A later join on the key then moves the first part only. Columns of df keep their values, whatever their names."""
    bucket, bitmap, spot, hit = (unused(df, c) for c in ("bucket", "bitmap", "spot", "hit"))
    bits = F.broadcast(sieve(keys, key, bucket, bitmap))  # at most SIEVE_BITS / 8 bytes
    at = F.pmod(F.col(key), F.lit(SIEVE_BITS)) + 1
    marked = df.withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(spot, F.bitmap_bit_position(at)).join(bits, bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{bitmap}`, cast(`{spot}` div 8 + 1 as int), 1)")), 16, 10).cast("int")
    marked = marked.withColumn(hit, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{spot}` % 8 as int))")) != 0, F.lit(False)))
    return marked.where(F.col(hit)).select(*quoted(df)), marked.where(~F.col(hit)).select(*quoted(df))


def quoted(df: DataFrame) -> list[str]:
    """The columns of df, as select takes them whatever signs they hold."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is not among the keys; only rows that the sieve lets through are shuffled."""
    keys = keys.select(key).distinct()
    maybe, rest = sift(df, key, keys)
    return rest.unionByName(maybe.join(keys, key, "left_anti").select(*quoted(df)))
