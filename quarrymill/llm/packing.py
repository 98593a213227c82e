"""Best-fit packing by patterns: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END_ID, FILE = 2048, 0, "word_bpe_49k.json"
#: Lengths tried as second, and as third, of a pattern; tokens that a pattern may leave free; its documents at most; steps of the fit; rows numbered in one piece.
FREQUENT, THIRD, SLACK, DOCUMENTS, FIT_STEPS, NUMBERED = 24, 6, 3, 16, 600, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Each document's ids and its end id, cut into pieces of capacity tokens only where longer: one row a piece, with a checksum.

    A null text counts as empty, and is the end id alone; repeated rows each give their pieces.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    path = path or tokens.default_path(FILE)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for b in common.batches(it, 4000, 16 << 20):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.id_text(docs, id_col, text_col).mapInArrow(common.lean(task), PIECES)


def patterns(count: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of DOCUMENTS lengths at most that occur and leave SLACK tokens free at most. count: how often each length occurs, by length.

    A pattern is one, two or three lengths, of which all but the first are frequent, or one length and another as often as it fits, or once
    less; then the longest length that still fits, where it fills the sequence.
    """
    there = np.flatnonzero(count)
    fits = np.searchsorted(there, np.arange(capacity + 1), side="right") - 1  # the longest length that occurs and fits
    often = there[np.argsort(-count[there], kind="stable")[:FREQUENT]].tolist()
    found = set()

    def close(*head: int) -> None:
        room = capacity - sum(head)
        if 0 <= room <= SLACK:
            found.add(tuple(sorted(head, reverse=True)))
        elif room > 0 and (k := fits[room]) >= 0 and room - there[k] <= SLACK:
            found.add(tuple(sorted((*head, int(there[k])), reverse=True)))

    def filled(head: tuple[int, ...], n: int) -> None:
        times = (capacity - sum(head)) // n
        if 1 <= times < DOCUMENTS:
            close(*head, *(n,) * times)
            close(*head, *(n,) * (times - 1))

    for a in there.tolist():
        close(a)
        filled((), a)
        for b in often:
            if a + b > capacity:
                continue
            close(a, b)
            filled((a,), b)
            filled((b,), a)
            if 2 * a >= capacity // 2:
                for c in often[:THIRD]:
                    if a + b + c <= capacity:
                        close(a, b, c)
    return sorted(found)


def fit(found: list[tuple[int, ...]], count: np.ndarray) -> tuple[np.ndarray, float]:
    """Repeat counts of patterns by non-negative least squares against the histogram, and the share of pieces by which they miss it.

    A piece weighs its tokens. Projected gradient steps with momentum, which starts anew whenever it points uphill.
    """
    size = np.array([len(p) for p in found])
    col, row = np.repeat(np.arange(len(found)), size), np.concatenate([np.array(p) for p in found])
    weight = np.arange(len(count)) / max(len(count) - 1, 1)
    made = lambda x: np.bincount(row, x[col], len(count))
    back = lambda r: np.bincount(col, (weight * r)[row], len(found))
    v, most = np.ones(len(found)), 1.0
    for _ in range(20):  # the largest curvature
        v = back(made(v))
        most = np.linalg.norm(v)
        v /= most
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(y - back(made(y) - count) / (1.05 * most), 0)
        t = 1.0 if (y - new) @ (new - x) > 0 else t
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x, float(np.abs(made(x) - count).sum() / max(count.sum(), 1))


def rounded(found: list[tuple[int, ...]], x: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """Patterns (by place in found) and how often each is used: fractions are carried on from pattern to pattern, most used first, and none is
    used more often than its lengths are left. Takes what it uses from left."""
    out, carry = [], 0.0
    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] <= 1e-6:
            break
        carry += x[k]
        times = int(carry + 1e-9)
        carry -= times
        if times:
            names, each = np.unique(found[k], return_counts=True)
            times = min(times, int((left[names] // each).min()))
            if times:
                left[names] -= each * times
                out.append((k, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where pieces go: rows (length, first rank, sequence of the first rank, offset); ranks of a length follow on to the next row's.

    The histogram has at most capacity lengths, whatever the input. Fitted patterns come first; the rest is packed by best fit from the
    longest length down, again as patterns that repeat while their lengths last.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0

    def place(pattern: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in pattern:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times

    if left.any() and (found := patterns(left, capacity)):
        for k, times in rounded(found, fit(found, left.astype(float))[0], left):
            place(list(found[k]), times)
    while left.any():
        pattern, room, spare = [], capacity, left.copy()
        while (fitting := np.flatnonzero(spare[: room + 1])).size:
            pattern.append(int(fitting[-1]))
            spare[fitting[-1]] -= 1
            room -= int(fitting[-1])
        names, each = np.unique(pattern, return_counts=True)
        times = int((left[names] // each).min())
        left[names] -= each * times
        place(pattern, times)
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def numbered(cut: DataFrame, histogram: DataFrame) -> DataFrame:
    """rank of each piece among those of its length, from 0. Lengths are numbered in groups of about NUMBERED pieces, dealt by row (`copy`), whatever
    its id, and groups of a length follow one another, so that no task gets all pieces of a common length or id."""
    groups = cut.join(F.broadcast(histogram), "length").withColumn("group", F.pmod(F.xxhash64("copy"), F.ceil(F.col("count") / NUMBERED)))
    own = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32", "copy")
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.groupBy("length", "group").agg(F.count("*").alias("n")).select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = groups.withColumn("own", F.row_number().over(own))
    return ranked.join(base, ["length", "group"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of docs with the sequence each is in and its offset there; sequences have no gaps and capacity tokens at most.

    Only the histogram of lengths, at most capacity rows, reaches the driver. An empty table gives an empty result. Null ids and repeated
    rows are packed like any others; of pieces of one length any may stand in any of their places.
    """
    made = common.cut(pieces(docs, id_col, text_col, capacity, path).withColumn("copy", F.monotonically_increasing_id()), "pieces")
    counts = [(int(r["length"]), int(r["count"])) for r in made.groupBy("length").count().collect()]
    histogram = made.sparkSession.createDataFrame(counts, "length long, count long")
    rows = plan(dict(counts), capacity)
    keys = rows[:, 0] << 40 | rows[:, 1]

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            at = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1] if len(rows) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3].copy())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(made, histogram).mapInArrow(common.lean(task), f"{PIECES}, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 2048 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
