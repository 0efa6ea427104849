"""Pieces shared by the text operators: shared folders, word hashing, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words kept with their hashes by one Python worker before it starts afresh.
WORD_CACHE = 50_000
#: Rows of an Arrow batch while tables are written.
ARROW_ROWS = 1000
#: Rows that Python functions hold as objects at a time.
SLICE = 500

#: The C library's way to give free memory back, where it has one.
_GIVE_BACK = getattr(ctypes.CDLL(None), "malloc_trim", None)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keeps ASCII letters (lower-cased), digits and every non-ASCII byte; the rest separates words.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256)
)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is missing, a temporary folder serves, but only in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-binomia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files."""
    path = shared_dir(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """Write a table; rows pass between Spark and Python in batches that suit long texts and lists."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(name, before)


class Scratch:
    """Intermediate tables of one job in the shared folder; each is dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made = spark, shared_dir(spark, name), 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` written and read back, and the path to :meth:`drop`."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        drop_tables(self.spark, *paths)


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system that this library has written."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few are Python objects at a time.

    Memory that a batch left behind goes back to the system: workers outlive their tasks.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if _GIVE_BACK is not None:
        _GIVE_BACK(0)


def space_words(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits on the bytes 09-0D and 20."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def alnum_words(text: str) -> list[bytes]:
    """Lower-cases A-Z; words are runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to :data:`WORD_CACHE` entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_powers(k: int, seed: int) -> np.ndarray:
    """``k`` odd multipliers that depend on ``seed`` only."""
    return mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)


def ngram_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all ``k``-word windows in order; a shorter, non-empty text is one window."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    m = min(n, k)
    mult = odd_powers(m, seed * 31 + m)
    out = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        out += words[j : n - m + 1 + j] * mult[j]
    return mix(out)


def longs(x: np.ndarray) -> pa.Array:
    """uint64 values as the signed longs with the same bits."""
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
