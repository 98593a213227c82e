"""Benchmark decontamination by pigeonhole edit matching: exact piece hits by Aho-Corasick, verified with Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: An item may differ by one edit in so many characters, whatever its length; items searched at once, in characters.
EDIT_EVERY, BLOCK_CHARS = 12, 4_000_000
MATCHES = "doc_id long, item_id long, distance int, start int, end int"


def normal(text: str) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return " ".join(text.lower().split())


def budget(size: int) -> int:
    return size // EDIT_EVERY


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """The item in so many pieces of nearly equal length, each with its place."""
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item_masks: dict[str, int], size: int, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the item to any part of text, if most or less, and the first place where such a part ends.

    Column differences are held as bits of two integers, one step a character of text.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, None
    get = item_masks.get
    left = len(text)
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
            if score == 0:
                break
        left -= 1
        if score - left > most:
            break
    return best


class Block:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, budget(len(t))) for i, t in items]
        self.masks: list[dict[str, int] | None] = [None] * len(items)
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, most) in enumerate(self.items):
            for at, piece in pieces(t, most + 1):
                where.setdefault(piece, []).append((k, at))
        self.find = ahocorasick.Automaton()
        for piece, places in where.items():
            self.find.add_word(piece, (len(piece), tuple(places)))
        if where:
            self.find.make_automaton()

    def mask(self, k: int) -> dict[str, int]:
        if self.masks[k] is None:
            self.masks[k] = masks(self.items[k][1])
        return self.masks[k]

    @staticmethod
    def first(item: str, part: str, distance: int) -> int:
        """Where the longest-ending match of so many edits that ends with part begins, by the same search backwards."""
        back = myers(masks(item[::-1]), len(item), part[::-1], distance)
        return len(part) - back[1]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, distance, start and end of the best part, for each item that text holds within its budget."""
        windows: dict[int, list[list[int]]] = {}
        if not len(self.find):
            return []
        for last, (size, places) in self.find.iter(text):
            for k, at in places:
                _, item, most = self.items[k]
                start = last + 1 - size - at
                a, b = start - most, start + len(item) + most
                own = windows.setdefault(k, [])
                if own and a <= own[-1][0] + most and a >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], b)  # the same diagonal, nearly: one window for both
                else:
                    own.append([a, b])
        out = []
        for k, spans in windows.items():
            item_id, item, most = self.items[k]
            best = None
            for a, b in sorted(spans):
                part = text[max(a, 0) : b]
                if len(part) < len(item) - most or not alike(part, item, most):
                    continue
                got = myers(self.mask(k), len(item), part, most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], self.first(item, part[: got[1]], got[0]) + max(a, 0), max(a, 0) + got[1])
                    if not best[0]:
                        break
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))


def masks(item: str) -> dict[str, int]:
    """For each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for n, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << n
    return out


def alike(part: str, item: str, most: int) -> bool:
    """False only if the item has so many two-letter pieces that part lacks that their distance is over most."""
    lost = sum(item[k : k + 2] not in part for k in range(0, len(item) - 1, 2))
    return lost <= most


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of about BLOCK_CHARS characters, one at a time; one empty block if there are none.

    Items are normalised and dealt into blocks on Spark; the driver holds one block, never all items.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normal(t or "") for t in b.column(1).to_pylist()], pa.string())], ["item_id", "item"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(task), "item_id long, item string")
    items = common.cut(items.filter("item != ''").distinct(), "items")
    count = max(1, -(-(items.agg(F.sum(F.length("item"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(count):
        own = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(count)) == k)
        yield [(r[0], r[1]) for r in own.orderBy("item_id", "item").toLocalIterator()]


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start and end (in normalised text) for each pair of a document and an item that it holds within the item's
    error budget, once a pair with the best place.

    The items are the query set: block by block they go to the tasks, each block is searched over all documents and its matches are
    written, so that a task's automaton and what the driver holds stay bounded. Null or empty texts and items match nothing; repeated
    documents each give their pairs, repeated items one; items that share an id are each searched; a null id is passed on; a
    document's whole text is searched. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    texts = common.id_text(docs, id_col, text_col)

    def search(block: list[tuple[int, str]]):
        def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = Block(block)
            for b in it:
                rows = [(doc, *m) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in look.matches(normal(t))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        return task

    out = None
    for block in blocks(benchmark):
        found = common.cut(texts.mapInArrow(common.lean(search(block)), MATCHES), "matches")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item.

    Whole rows go through the search and no id is read: rows with a null id are searched as others are, and rows that share an id
    stay or go each by its own text. A null text holds nothing. What one block of items leaves is written before the next is searched.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    at, schema = docs.columns.index(text_col), docs.schema

    def search(block: list[tuple[int, str]]):
        def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = Block(block)
            for b in it:
                yield b.filter(pa.array([not (t and look.matches(normal(t))) for t in b.column(at).to_pylist()], pa.bool_()))

        return task

    left = None
    for block in blocks(benchmark):
        docs = docs if left is None else common.cut(left, "clean")
        left = docs.mapInArrow(common.lean(search(block)), schema)
    return left


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items found in them."""
    return find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
