"""Helpers shared by the operators: shared-folder tables, Arrow text views, vectorised text hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder that goes with the process; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives freed memory back when its task ends: the worker lives on and serves later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z only, whatever the locale and script of the rest."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without a copy. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about `most` bytes, at least one row each: arrays stay in the CPU's caches."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end
        row = end


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()  # one size at a time
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            both = []
            for base in (_ODD, inverse):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 of bytes or code points, for span_hashes()."""
    n = len(codes)
    up, _ = _powers(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end): equal strings have equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], start[i] + length[i])."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start.astype(np.int64) - (ends - length), length)


def byte_set(chars: bytes, high: bool = False) -> np.ndarray:
    """Membership of each byte value; high: all bytes of non-ASCII characters too."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    if high:
        out[128:] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = byte_set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", high=True)
NOT_SPACE = ~byte_set(b" \t\n\r\x0b\x0c")


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a set, never across texts: starts, ends, and the number of runs of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    member = inside[data]
    begin = member.copy()
    begin[1:] &= ~member[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] |= member[cut]
    close = np.zeros(n + 1, bool)
    close[1:n] = member[:-1] & (~member[1:] | begin[1:])
    close[n] = member[-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(close)
    return start, end, np.diff(np.searchsorted(start, offsets))
