"""Helpers that the text operators share: shared storage, code shipping, word boundaries and hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_shipped: dict[str, str] = {}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in tests; a cluster
    must name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='quarrymill-')}"
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends in files that outlive any executor.

    The plan that was written isn't run again, so Spark may delete its shuffle files at the end of the write.
    """
    path = fresh_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


class Cuts:
    """Tables cut to the shared folder, which can be dropped when no later result reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        write_once(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that cut() or fresh_path() made and no later result reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quarrymill-code-"), "quarrymill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(PACKAGE.rglob("*.py")):
            out.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names and types; a null text becomes the empty text."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB, so that a batch of long texts fits a Python worker. All operators want the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def lean(task: Callable):
    """A task of mapInArrow that leaves its worker as small as it can: Spark keeps workers, and they keep what was freed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(it)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row's first byte (one more than rows), without a copy where Arrow allows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


#: Powers of an odd multiplier and of its inverse modulo 2**64, extended as texts need them.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BASE = 0x9E3779B97F4A7C55
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def words(text: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of one text starts and ends (white space: U+0020 and U+0009 to U+000D), and a 64-bit hash of its bytes.

    The hash is a polynomial over the bytes by prefix sums, scrambled; it stands for the word's text.
    """
    if lower:
        text = TO_LOWER[text]
    edge = np.diff(np.concatenate(([True], SPACE[text], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, one behind the other, and the offset of each text's first word (one more than texts).

    data: the texts' bytes; at: each text's first byte, as utf8() has them. Hashes are those of words().
    """
    data, at = data[at[0] : at[-1]], at - at[0]
    if lower:
        data = TO_LOWER[data]
    gap = SPACE[data]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edge = at[:-1][at[:-1] < at[1:]]  # where texts that aren't empty begin; a word never goes on there
    first[edge] = ~gap[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = ~gap[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def spans(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of about so many bytes at most, or one text that is longer: arrays that stay in the cache."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * GOLDEN + h[k : k + n])
    return out


def batches(it: Iterator[pa.RecordBatch], rows: int, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that each has at most so many rows and, unless it is one row, so many bytes."""
    for b in it:
        at = 0
        size = max(1, min(rows, b.num_rows if b.nbytes <= most_bytes else int(b.num_rows * most_bytes / b.nbytes) or 1))
        while at < b.num_rows:
            yield b.slice(at, size)
            at += size
