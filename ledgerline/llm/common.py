"""Helpers shared by the training-data operators: shared-folder tables, text blocks, word and window hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import ctypes.util
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
#: Bytes of text that one numpy step works on; bounds the memory of a task whatever the batch size.
BLOCK_BYTES = 3 << 20


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _saving = threading.Lock(), {}


@contextlib.contextmanager
def shuffle_files_go(spark: SparkSession):
    """While any table of the session is being saved, shuffle files go as soon as their query ends."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _saving.get(key) or (0, spark.conf.get(CLEANUP, "false"))
        _saving[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _saving[key]
            _saving[key] = (n - 1, before)
            if n == 1:
                del _saving[key]
                spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables written to the cluster's shared checkpoint folder: they cut lineage and outlive executors.

    What nothing reads any more is dropped at once; tables that a result reads lazily go when the driver
    ends. The folder is spark.checkpoint.dir; only a session that runs in one process may lack it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
            if not current.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="ledgerline-")
            if not current.isDefined():
                spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root}/ledgerline-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it reread; its shuffle files go as soon as it is written."""
        path = self.path(name)
        with shuffle_files_go(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._delete(path)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before, or on a lost gateway
            self._delete(self.root)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to suit the input."""
    return min(32768, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, taken: list[str]) -> str:
    """name, or the first longer one that no column has."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df as such, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- text blocks


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, n + 1) and bytes of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, width)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], b[o[0] : o[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_batches(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """(record batch slice, offsets, bytes) for slices of at most about limit bytes of text."""
    for batch in batches:
        o, b = text_buffer(batch.column(column))
        for i, j in blocks(o, limit):
            yield batch.slice(i, j - i), o[i : j + 1] - o[i], b[o[i] : o[j]]
        del o, b
        release()


# ---------------------------------------------------------------- words and hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLES = np.random.default_rng(20240917).integers(1, 2**63, (2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WIN = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Powers are kept up to this one; larger ones are a product of two, so tables stay in the cache.
_STEP = 1 << 15
_powers: dict[int, np.ndarray] = {}


def _low(base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < _STEP."""
    if base not in _powers:
        p = np.full(_STEP, base, U64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


def _high(base: int, last: int) -> np.ndarray:
    """base ** (_STEP * k) for k up to last, at least."""
    have = _powers.get(-base)
    if have is None or len(have) <= last:
        p = np.full(max(256, 2 * last), pow(base, _STEP, 1 << 64), U64)
        p[0] = 1
        have = _powers[-base] = np.multiply.accumulate(p)
    return have


def _power(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2 ** 64."""
    return _low(base)[at & (_STEP - 1)] * _high(base, int(at.max(initial=0)) // _STEP)[at // _STEP]


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of values[start:end] (or of table[values[start:end]]) for each range, from one prefix sum."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    low = _low(base)
    for i in range(0, n, _STEP):
        part = values[i : i + _STEP]
        part = part if table is None else table[part]
        np.multiply(part, low[: len(part)] * _high(base, i // _STEP)[i // _STEP], out=sums[i + 1 : i + 1 + len(part)])
    np.cumsum(sums, out=sums)
    out = sums[ends]
    out -= sums[starts]
    del sums
    inverse = pow(base, -1, 1 << 64)
    for i in range(0, len(out), _STEP):
        out[i : i + _STEP] *= _power(inverse, starts[i : i + _STEP])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of documents, as byte ranges.

    starts, ends: byte range of each word; ptr: first word of each document (n + 1).
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        self.starts = np.flatnonzero(inside & (cut[:-1] | ~before[:-1]))
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        self.ends = np.flatnonzero(inside & (cut[1:] | ~after[1:])) + 1
        self.ptr = np.searchsorted(self.starts, offsets)

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.per_doc)

    def hashes(self, which: int = 0) -> np.ndarray:
        return mix(_ranges(self.data, _ODD[which], self.starts, self.ends, _TABLES[which]) + (self.ends - self.starts).astype(U64))

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every window of k consecutive words of one document."""
        at = window_starts(self.ptr, k)
        return at, mix(_ranges(hashes, _WIN[which], at, at + k))


def window_mask(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which positions start a k-long window that stays inside one of the ranges ptr bounds."""
    ok = np.zeros(int(ptr[-1]) + 1, np.int32)
    last = np.maximum(ptr[1:] - k + 1, ptr[:-1])
    np.add.at(ok, ptr[:-1], 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok[:-1], dtype=np.int32) > 0


def window_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Starts of all k-long windows that stay inside one of the ranges ptr bounds."""
    return np.flatnonzero(window_mask(ptr, k))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a k-long window with one of these starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(b, dtype) -> np.ndarray:
    return np.frombuffer(b, dtype) if b is not None else np.zeros(0, dtype)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups rows by bucket, keeping their order, and the bounds of each bucket."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 65536 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
