"""Hard-negative mining with an inverted multi-index.

A vector's two halves each have a codebook; a pair of nearest centroids is a cell. For a block of anchors the sums of half scores, each with
the radius of its centroid added, bound what a cell can hold; a heap over both sorted lists visits cells by falling bound and stops where
no anchor can find better. Positives come first: the best rows of a few cells give a floor, and every cell whose bound reaches it is
visited. Their scores set each window for negatives, which is certified in the same way. A visit is a row of a join of anchors with chunks of cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that codebooks are fitted on; steps of the fit; centroids a half at most; rows a cell should have; rows of first visits.
SAMPLE, FIT_STEPS, MOST, PER_CELL, FIRST_ROWS = 4096, 8, 64, 256, 2048
#: Rows and bytes of a chunk of a cell, and of a block of anchors, at most.
CHUNK, CHUNK_BYTES, BLOCK, BLOCK_BYTES = 1024, 1 << 20, 256, 1 << 18
#: Quantised components are held within this, so that scores of 1024 components fit a long.
HELD = float(1 << 26)
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, labels: Column | None = None) -> DataFrame:
    """vec_id, label and v (doubles) of the rows that take part."""
    v = vectors[vector_col].cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = vectors[label_col].cast("long") if labels is None else labels.cast("long")
    return vectors.filter(vectors[id_col].isNotNull() & vectors[label_col].isNotNull() & v.isNotNull() & good).select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Quantised vectors, a row each; one that is shorter counts as ended by zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)), -HELD, HELD)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


class Index:
    """What the tasks know: codebooks, radii of their centroids, and how many chunks each cell has; all bounded by MOST, whatever the input."""

    def __init__(self, dims: int, kind: str, books: list[np.ndarray]):
        self.dims, self.kind, self.books = dims, kind, books
        self.size = len(books[0]), len(books[1])
        self.radii = [np.zeros(n) for n in self.size]
        self.rows = np.zeros(self.size, np.int64)
        self.rows_a_chunk = max(64, min(CHUNK, CHUNK_BYTES // (dims * np.dtype(kind).itemsize)))
        self.rows_a_block = max(16, min(BLOCK, BLOCK_BYTES // (dims * np.dtype(kind).itemsize)))

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.dims // 2], x[:, self.dims // 2 :]]

    def assign(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The nearest centroid of each half, and how far it is."""
        near, far = [], []
        for half, book in zip(self.halves(x), self.books, strict=True):
            near.append(np.argmin((book * book).sum(axis=1) - 2 * half @ book.T, axis=1))
            far.append(np.sqrt(((half - book[near[-1]]) ** 2).sum(axis=1)))
        return near, far

    def chunks(self, u: int, v: int) -> int:
        return -(-int(self.rows[u, v]) // self.rows_a_chunk)

    def bounds(self, a: np.ndarray) -> list[np.ndarray]:
        """For each anchor and centroid of a half, the most that a row of that centroid can add to the score; rounding is allowed for."""
        return [
            (s := half @ book.T + np.sqrt((half * half).sum(axis=1))[:, None] * r) + 1e-9 * np.abs(s) + 1e-3
            for half, book, r in zip(self.halves(a.astype(float)), self.books, self.radii, strict=True)
        ]

    def visits(self, a: np.ndarray, floor: np.ndarray, rows: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
        """Cells by falling bound, each with the anchors that its rows can matter to; so long as a bound reaches some anchor's floor, and for as
        many rows as asked."""
        first, second = self.bounds(a)
        one, two = first.max(axis=0), second.max(axis=0)
        by, along = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap, least, seen = [(-one[by[0]] - two[along[0]], 0, 0)], floor.min(), 0
        while heap and -heap[0][0] >= least and (rows is None or seen < rows):
            _, i, j = heapq.heappop(heap)
            u, v = by[i], along[j]
            if self.rows[u, v]:
                mine = np.flatnonzero(first[:, u] + second[:, v] >= floor)
                if len(mine):
                    seen += int(self.rows[u, v])
                    yield int(u), int(v), mine
            if j + 1 < len(along):
                heapq.heappush(heap, (-one[by[i]] - two[along[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(by):
                heapq.heappush(heap, (-one[by[i + 1]] - two[along[0]], i + 1, 0))


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Centroids by Lloyd's steps from the first different rows; a centroid without rows stays where it is."""
    book = np.unique(x, axis=0, return_index=True)[1]
    book = x[np.sort(book)[:size]].copy()
    for _ in range(FIT_STEPS):
        near = np.argmin((book * book).sum(axis=1) - 2 * x @ book.T, axis=1)
        for k in range(len(book)):
            if (near == k).any():
                book[k] = x[near == k].mean(axis=0)
    return book


def fitted(rows: DataFrame) -> Index | None:
    """Codebooks from SAMPLE rows, those with the least hash of vec_id; then radii and sizes of cells from all rows. None without rows."""
    q = F.transform("v", lambda x: F.least(F.abs(F.floor(x * SCALE).cast("double")), F.lit(HELD)))
    measured = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    if not measured["n"]:
        return None
    dims = max(int(measured["dims"]), 2)
    kind = "<f4" if measured["most"] < 1 << 24 else "<f8" if measured["most"] < 1 << 53 else "<i8"
    sample = rows.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(max(256, min(SAMPLE, (64 << 20) // (8 * dims)))).select("v").toArrow()
    x = matrix(sample.column("v").combine_chunks(), dims)
    size = max(1, min(MOST, int((measured["n"] / PER_CELL) ** 0.5)))
    index = Index(dims, kind, [codebook(x[:, : dims // 2], size), codebook(x[:, dims // 2 :], size)])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radii = np.zeros(index.size, np.int64), [np.zeros(s) for s in index.size]
        for b in common.batches(it, 4096):
            near, far = index.assign(matrix(b.column("v"), dims))
            np.add.at(n, tuple(near), 1)
            for r, at, d in zip(radii, near, far, strict=True):
                np.maximum.at(r, at, d)
        u, v = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u, v, n[u, v], radii[0][u], radii[1][v])], ["u", "v", "n", "r", "s"])

    found = rows.select("v").mapInArrow(common.lean(task), "u long, v long, n long, r double, s double").groupBy("u", "v").agg(F.sum("n").alias("n"), F.max("r").alias("r"), F.max("s").alias("s"))
    for r in found.collect():
        index.rows[r["u"], r["v"]] = r["n"]
        for k, at, d in ((0, r["u"], r["r"]), (1, r["v"], r["s"])):
            index.radii[k][at] = max(index.radii[k][at], d)
    return index


def placed(rows: DataFrame, index: Index) -> DataFrame:
    """vec_id, label, cell (u, v) and the quantised vector's bytes."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, 4096):
            x = matrix(b.column("v"), index.dims)
            (u, v), _ = index.assign(x)
            data = x.astype(index.kind)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(u), pa.array(v), pa.array([r.tobytes() for r in data], pa.binary())], ["vec_id", "label", "u", "v", "data"])

    return rows.mapInArrow(common.lean(task), "vec_id long, label long, u long, v long, data binary")


def packed(dealt: DataFrame, most: int, apart: tuple[str, ...]) -> DataFrame:
    """Rows that follow one another, at most so many, in one row of bytes; none with two values of the columns `apart`."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, number = None, [], (TaskContext.get().partitionId() << 32)

        def done() -> pa.RecordBatch:
            ids, labels, data = zip(*held, strict=True)
            values = [number, *key, len(ids), np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), b"".join(data)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["pack", *apart, "n", "ids", "labels", "data"])

        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in (*apart, "vec_id", "label", "data")), strict=True):
                if held and (row[: len(apart)] != key or len(held) == most):
                    yield done()
                    held, number = [], number + 1
                key = row[: len(apart)]
                held.append(row[len(apart) :])
        if held:
            yield done()

    return dealt.select(*apart, "vec_id", "label", "data").mapInArrow(common.lean(task), f"pack long, {''.join(f'{c} long, ' for c in apart)}n long, ids binary, labels binary, data binary")


VISIT = "u long, v long, part long, block long, who binary, wanted binary, low binary, high binary, ids_a binary, labels_a binary, data_a binary"


def found(blocks: DataFrame, chunks: DataFrame, index: Index, same: bool, most: int, rows: int | None) -> DataFrame:
    """block, who (the anchor's place there), window, score, other: the best rows so far in each anchor's windows.

    blocks: packed anchors with marks (who, window, low, high), scores that a row may have there; same: rows of the anchor's label, else of others; rows: first visits only.
    """
    dims, kind = index.dims, index.kind

    def plan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], kind).reshape(-1, dims)
                ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                who = np.array([m["who"] for m in r["marks"]], np.int64)
                window, low, high = (np.array([m[c] for m in r["marks"]], t) for c, t in (("window", np.int64), ("low", np.float64), ("high", np.float64)))
                floor = np.full(len(a), np.inf)
                np.minimum.at(floor, who, low)
                for u, v, mine in index.visits(a, floor, rows):
                    asked = np.flatnonzero(np.isin(who, mine))
                    asked = asked[np.argsort(who[asked], kind="stable")]
                    for part in range(index.chunks(u, v)):
                        values = [u, v, part, r["pack"], who[asked].tobytes(), window[asked].tobytes(), low[asked].tobytes(), high[asked].tobytes(), ids[mine].tobytes(), labels[mine].tobytes(), a[mine].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], [c.split()[0] for c in VISIT.split(", ")])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                a, rows = (np.frombuffer(r[c], kind).reshape(-1, dims) for c in ("data_a", "data"))
                ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
                s = a @ rows.T
                fits = np.frombuffer(r["labels_a"], "<i8")[:, None] == labels
                fits = fits & (np.frombuffer(r["ids_a"], "<i8")[:, None] != ids) if same else ~fits
                who, window = np.frombuffer(r["who"], np.int64), np.frombuffer(r["wanted"], np.int64)
                low, high = np.frombuffer(r["low"], np.float64), np.frombuffer(r["high"], np.float64)
                row = np.unique(who, return_inverse=True)[1]
                for first in range(0, len(who), 64):
                    k = slice(first, first + 64)
                    at, other = np.nonzero(fits[row[k]] & (s[row[k]] >= low[k, None]) & (s[row[k]] <= high[k, None]))
                    got = s[row[k]][at, other]
                    by = np.lexsort((ids[other], -got, at))
                    at, other, got = at[by], other[by], got[by]
                    best = np.arange(len(at)) - np.searchsorted(at, at) < most
                    at, other, got = at[best], other[best], got[best]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["block"], np.int64)), pa.array(who[k][at]), pa.array(window[k][at]), pa.array(got.astype(np.int64)), pa.array(ids[other])], ["block", "who", "window", "score", "other"])

    visits = blocks.mapInArrow(common.lean(plan), VISIT)
    scored = visits.join(chunks.drop("pack"), ["u", "v", "part"]).mapInArrow(common.lean(score), "block long, who long, window long, score long, other long")
    rank = F.row_number().over(Window.partitionBy("block", "who", "window").orderBy(F.desc("score"), "other"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def marked(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """blocks with their anchors' marks, of which a block has as many as its anchors times their windows."""
    each = marks.groupBy("pack").agg(F.collect_list(F.struct("who", "window", "low", "high")).alias("marks"))
    return blocks.join(each, "pack")


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", labels: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The hard negatives of each anchor and positive, by the columns of RESULT.

    anchor: which rows (by vec_id, label) are anchors; labels: labels in place of label_col's. Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Components are floor(256 * x), held within 2**26; shorter vectors count as ended by zeros; scores are exact integers, ties go to the smaller vec_id. Rows
    with the anchor's vec_id are never its positives; other repeated rows count each. A pair without a row in its window, and an empty
    table, give nothing. Codebooks come from a bounded sample; every row is in the index, and the result is exact. Cells that hold many
    rows are split into chunks, so one vector repeated without end is many chunks.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    rows = usable(vectors, id_col, vector_col, label_col, labels)
    index = fitted(rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    cells = common.cut(placed(rows, index), "cells")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(index.rows.sum()) // (64 * index.rows_a_chunk))
    n = spark.createDataFrame([(u, v, index.chunks(u, v)) for u, v in zip(*map(np.ndarray.tolist, np.nonzero(index.rows)), strict=True)], "u long, v long, chunks long")
    part = F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    dealt = cells.join(F.broadcast(n), ["u", "v"]).withColumn("part", part).repartition(tasks, "u", "v", "part").sortWithinPartitions("u", "v", "part", "vec_id")  # n: MOST * MOST rows at most
    chunks = common.cut(packed(dealt, 2 * index.rows_a_chunk, ("u", "v", "part")), "chunks")
    chosen = cells.filter(anchor).repartitionByRange(tasks, "u", "v", "vec_id").sortWithinPartitions("u", "v", "vec_id")
    blocks = common.cut(packed(chosen, index.rows_a_block, ()), "anchors")

    c = F.col
    every = blocks.select("pack", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)).alias("who"), F.lit(0).cast("long").alias("window"))
    open_ = (F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    first = found(marked(blocks, every.select("*", *open_)), chunks, index, True, positives, FIRST_ROWS).filter(c("rank") == positives)
    floors = every.join(first.select(c("block").alias("pack"), "who", c("score").cast("double").alias("low")), ["pack", "who"], "left")
    floors = floors.select("pack", "who", "window", F.coalesce("low", open_[0]).alias("low"), open_[1])
    pairs = common.cut(found(marked(blocks, floors), chunks, index, True, positives, None), "positives")

    lowest, highest = F.ceil(F.lit(low) * c("score") / 100), F.floor(F.lit(high) * c("score") / 100)
    windows = pairs.select(c("block").alias("pack"), "who", c("rank").cast("long").alias("window"), lowest.cast("double").alias("low"), highest.cast("double").alias("high")).filter("low <= high")
    some = found(marked(blocks, windows), chunks, index, False, negatives, FIRST_ROWS).filter(c("rank") == negatives)
    certain = windows.join(some.select(c("block").alias("pack"), "who", "window", c("score").cast("double").alias("third")), ["pack", "who", "window"], "left")
    certain = certain.select("pack", "who", "window", F.greatest("low", "third").alias("low"), "high")
    last = found(marked(blocks, certain), chunks, index, False, negatives, None).select(c("block"), c("who"), c("window"), c("score").alias("negative_score"), c("other").alias("negative_id"), c("rank").cast("int").alias("rank"))

    names = blocks.select(c("pack").alias("block"), "ids", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)).alias("who"))
    names = names.mapInArrow(anchor_ids, "block long, who long, anchor_id long")
    told = pairs.select("block", "who", c("rank").cast("long").alias("window"), c("score").alias("positive_score"), c("other").alias("positive_id")).join(names, ["block", "who"])
    return last.join(told, ["block", "who", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchor_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids = [int(np.frombuffer(x, "<i8")[k]) for x, k in zip(b.column("ids").to_pylist(), b.column("who").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("who"), pa.array(ids, pa.int64())], ["block", "who", "anchor_id"])


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, labels=label)
