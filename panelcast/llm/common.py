"""Helpers shared by the operators of this subpackage.

Text-heavy operators read Arrow batches: the UTF-8 bytes of a whole batch are one
NumPy array plus document offsets, so tokenising, hashing and counting run as
array expressions, not as per-row Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import scratch_path

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables and broadcasts that an operator needs only while it runs; removed when it is left."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, [], []

    def path(self, name: str) -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def broadcast(self, value: object) -> Broadcast:
        """``value`` on every worker until the operator is left: tables that read it must be written by then."""
        self.held.append(self.spark.sparkContext.broadcast(value))
        return self.held[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for value in self.held:
            value.destroy()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions so that each holds about ``each`` of ``amount``; never under the
    session's shuffle partitions, so a small input still uses every core."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, int(np.ceil(amount / each)))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a whole text column (one aggregate, one row back)."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: for blobs that go through a shuffle."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8), codec="zstd", asbytes=True)


def unpacked(blob: pa.Scalar, dtype, n: int) -> np.ndarray:
    """The ``n`` items of a packed array."""
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(blob.as_buffer(), decompressed_size=size, codec="zstd"), dtype)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a null-free string column and its len+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)
    offs = offs[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system. The C library keeps the holes that a slice's arrays leave, and idle
    workers would hold theirs beside the busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(merge: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A grouped function whose freed memory goes back to the system after each group."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = merge(key, group)
        give_back()
        return out

    return run


def slices(offs: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about ``limit`` bytes (one long document alone); freed memory goes back after two
    million bytes and at the end."""
    i, n, back = 0, len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
        if i == n or offs[i] - back >= 2_000_000:
            give_back()
            back = offs[i]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting integers beats hashing them by far)."""
    x = np.sort(x)
    if not len(x):
        return x
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_B = 0x100000001B3 * 2 + 1  # an odd base: invertible modulo 2**64
_BINV = pow(_B, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("_POW", _B), ("_INV", _BINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _POW[:n], _INV[:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``buf``; equal spans, equal hashes.

    A polynomial hash from prefix sums modulo 2**64 (the base is odd, so it can be
    shifted back by its inverse), mixed with the span's length.
    """
    if len(start) == 0:
        return np.empty(0, np.uint64)
    pw, inv = _powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, np.uint64)
    # mixed byte values keep the polynomial away from its weak small coefficients
    np.cumsum(_BYTE_MIX[buf] * pw[:-1], out=pre[1:])
    h = (pre[end] - pre[start]) * inv[start]
    return mix64(h + (end - start).astype(np.uint64) * MIX)


_BYTE_MIX = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MIX)

#: Word separators of the operators that split words: space and the ASCII controls tab..CR.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words never cross documents."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~separators[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offs[1:-1]
    bounds = bounds[bounds < len(buf)]
    first[bounds] = inside[bounds]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = bounds[bounds > 0] - 1
    last[cut] = inside[cut]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1
