"""Document fingerprints by improbable features: byte windows ranked by how rare their entropy is, in chained Bloom filters.

Every window of WINDOW bytes has an entropy class; classes that few windows of all documents have rank first. The lowest ranked window of
every run of RUN windows (the leftmost of several) is a feature. Features go, in text order, into Bloom filters of BITS bits, EACH to a filter, and the chain of
filters is the fingerprint. Two chains are as alike as the mean, over the filters of the shorter one, of the best normalised bit overlap
with a filter of the other.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, RUN, BITS, EACH, HASHES = 16, 32, 2048, 160, 5
#: Windows below so many bits of entropy tell little; they rank last. Bytes of text a task sorts; bytes that arrays are made of at once, of a long text and of several short ones; standard deviations of chance overlap that don't count.
PLAIN, TASK_BYTES, AT_ONCE, TOGETHER, SIGMAS = 1.0, 32 << 20, 1 << 20, 1 << 17, 3.0
#: count * log2(count) in units of 2**-20: integers, so that sliding sums have no drift.
PART = np.array([0] + [round(c * math.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1)], np.int64)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of every window: the sum of count * log2(count) over its bytes, high where entropy is low."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)  # equal bytes among the WINDOW - 1 before and behind
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    seen = np.bincount(data[:WINDOW], minlength=256)
    out = np.empty(n, np.int64)
    out[0] = PART[seen].sum()
    gone, come = ahead[: n - 1], back[WINDOW:]
    out[1:] = out[0] + np.cumsum(PART[gone] - PART[gone + 1] + PART[come + 1] - PART[come])
    return out


def entropy(of: int) -> float:
    return math.log2(WINDOW) - of / WINDOW / (1 << 20)


def ranks(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Classes in ascending order, and the rank of each: rare ones first, of equally rare ones those with higher entropy; plain ones last."""
    by = sorted(counts, key=lambda c: (entropy(c) < PLAIN, counts[c], c))
    known = np.array(sorted(counts), np.int64)
    place = {c: k for k, c in enumerate(by)}
    return known, np.array([place[c] for c in known.tolist()], np.int64)


def keyed(own: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rank and place of every window in one number, so that a minimum is the leftmost of the lowest ranked."""
    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
    place = np.where(known[at] == own, rank[at] + 1, 0) if len(known) else np.zeros(len(own), np.int64)
    return place << 32 | np.arange(len(own))  # a class that no document has, as an edited text alone may, is rarest of all


def lowest(low: np.ndarray) -> np.ndarray:
    """The minimum of every run of RUN windows, by minima of 2, 4, ... windows."""
    width = 1
    while width < RUN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return low


def apart(x: np.ndarray) -> np.ndarray:
    """x without repeats next to each other."""
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def long_picked(data: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the features of one long text stand, AT_ONCE runs at a time, so that memory stays bounded."""
    runs = len(data) - WINDOW + 1 - RUN + 1
    found = []
    for a in range(0, runs, AT_ONCE):
        own = classes(data[a : min(a + AT_ONCE, runs) + RUN - 1 + WINDOW - 1])
        found.append(apart(a + (lowest(keyed(own, known, rank)) & 0xFFFFFFFF)))
    return apart(np.concatenate(found))  # places never go back from run to run


def picked(data: np.ndarray, at: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the features of many short texts, one behind the other, stand. at: each text's first byte, and the end.

    Windows and runs are those inside a text. Fewer than RUN windows count as one run; a text without a window has no place here.
    """
    low = keyed(classes(data), known, rank)
    windows = np.diff(at) - WINDOW + 1
    runs, few = at[:-1][windows > RUN], at[:-1][(windows > 0) & (windows <= RUN)]
    found = []
    if len(runs):
        edge = np.zeros(len(low) + 1, np.int8)
        edge[runs] = 1
        edge[runs + (windows - RUN + 1)[windows > RUN]] -= 1
        found.append(apart(lowest(low)[np.cumsum(edge[: len(low) - RUN + 1]).astype(bool)] & 0xFFFFFFFF))
    if len(few):
        ends = few + windows[(windows > 0) & (windows <= RUN)]
        low = np.append(low, np.iinfo(np.int64).max)
        found.append(np.minimum.reduceat(low, np.column_stack((few, ends)).ravel())[::2] & 0xFFFFFFFF)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of the WINDOW bytes at each place."""
    both = np.ascontiguousarray(data[at[:, None] + np.arange(WINDOW)]).view("<u8").reshape(-1, 2)
    return common.mix(common.mix(both[:, 0] + common.GOLDEN) * common.GOLDEN + both[:, 1])


def tiny(text: np.ndarray) -> np.ndarray:
    """The one feature of a text shorter than a window: the whole text, with its length."""
    return hashed(np.concatenate((text, np.zeros(WINDOW - 1 - len(text), np.uint8), np.array([len(text)], np.uint8))), np.zeros(1, np.int64))


def chains(features: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters of each text, a row of BITS / 8 bytes each. features: those of all texts; count: how many each text has."""
    filters = -(-count // EACH)
    base, first = np.cumsum(filters) - filters, np.cumsum(count) - count
    which = np.repeat(base, count) + (np.arange(len(features)) - np.repeat(first, count)) // EACH
    out = np.zeros((int(filters.sum()), BITS // 8), np.uint8)
    for a in range(0, len(features), EACH << 10):
        part, row = features[a : a + (EACH << 10)], which[a : a + (EACH << 10)]
        bits = np.zeros((row[-1] - row[0] + 1, BITS), bool)
        for k in range(HASHES):
            bits[row - row[0], (part >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
        out[row[0] : row[-1] + 1] |= np.packbits(bits, axis=1)
    return np.split(out, base[1:]) if len(count) else []


def fingerprints(texts: list[bytes], known: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text; short texts are taken together, TOGETHER bytes at a time."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out: list[np.ndarray] = []
    for a, b in common.spans(at, TOGETHER):
        data, own = np.frombuffer(b"".join(texts[a:b]), np.uint8), at[a : b + 1] - at[a]
        if len(data) > AT_ONCE:
            place = long_picked(data, known, rank)
        else:
            place = picked(data, own, known, rank)
        features = hashed(data, place)
        count = np.diff(np.searchsorted(place, own))
        size = np.diff(own)
        for k in np.flatnonzero((size > 0) & (size < WINDOW))[::-1]:
            features = np.insert(features, int(count[:k].sum()), tiny(data[own[k] : own[k + 1]])[0])
            count[k] = 1
        out += chains(features, count)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (no more in common than by chance) to 1. Equal chains are alike; a chain without filters is like none but its equal."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    other = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = []
    for f in a:
        own = int(np.bitwise_count(f).sum())
        shared = np.concatenate([np.bitwise_count(b[k : k + 4096] & f).sum(axis=1, dtype=np.int64) for k in range(0, len(b), 4096)])
        mean = own * other / BITS
        chance = mean + SIGMAS * np.sqrt(mean * (1 - own / BITS) * (1 - other / BITS))
        most = np.minimum(own, other)
        room = np.maximum(most - chance, 1e-9)
        score = np.where(chance < most, np.clip((shared - chance) / room, 0, 1), shared == np.maximum(own, other))
        best.append(float(score.max()))
    return sum(best) / len(best)


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def filters_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


def class_counts(rows: DataFrame) -> tuple[dict[int, int], int]:
    """How many windows of all texts have each class (as many classes as a window's bytes can be split up, whatever the input), and the bytes of all texts."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        size = 0
        for b in it:
            data, at = common.utf8(b.column(0))
            size += int(at[-1] - at[0])
            for a, z in common.spans(at, TOGETHER):
                for first in range(int(at[a]), max(int(at[z]) - WINDOW + 1, int(at[a]) + 1), AT_ONCE):
                    own = classes(data[first : min(first + AT_ONCE + WINDOW - 1, int(at[z]))])
                    across = at[a + 1 : z, None] - first - np.arange(1, WINDOW)  # windows that reach into the next text
                    kept = np.ones(len(own), bool)
                    kept[across[(across >= 0) & (across < len(own))]] = False
                    values, n = np.unique(own[kept], return_counts=True)
                    for v, c in zip(values.tolist(), n.tolist(), strict=True):
                        counts[v] = counts.get(v, 0) + c
        counts[-1] = size
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["class", "n"])

    got = {r["class"]: r["n"] for r in rows.select("text").mapInArrow(common.lean(task), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    size = got.pop(-1, 0)
    return got, size


def first_keys(rows: DataFrame, tasks: int) -> list[tuple]:
    """The first (doc_id, tie) of each of so many ranges of the rows, in order: as many rows as ranges reach the driver."""
    keys = rows.select("doc_id", "tie").repartitionByRange(tasks, "doc_id", "tie")
    first = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("doc_id", "tie")).alias("k"))
    return sorted(((r["k"]["doc_id"], r["k"]["tie"]) for r in first.collect()), key=order)


def order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or 0, key[1])


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each row's text and of its edited text, and their likeness, by the columns of SCHEMA.

    The edited text ends with the start of the next row's text, by ascending doc_id (a null first; rows of one doc_id by a hash of their
    texts; after the last row the first). A null or empty text has no features and an empty fingerprint, which is like an empty one alone; a text
    shorter than a window is one feature; an only row is its own next; an empty table gives an empty result; every repeated row gives a row; other
    columns aren't read. Texts move once, to the range of their ids; the first row of a range is sent to the range before, too. Rows
    that share both doc_id and text are in one range, which is read in batches.
    """
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    rows = common.id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    counts, size = class_counts(rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    keys = first_keys(rows, tasks)
    if not keys:
        return spark.createDataFrame([], SCHEMA)
    known, rank = ranks(counts)

    starts = [order(k) for k in keys]
    nulls = sum(not s[0] for s in starts)  # ranges whose first doc_id is null stand before all others
    ids, ties = np.array([s[1] for s in starts], np.int64), np.array([s[2] for s in starts], np.int64)

    def place(doc: int | None, tie: int) -> int:
        a, b = (0, nulls) if doc is None else (nulls + int(np.searchsorted(ids[nulls:], doc, "left")), nulls + int(np.searchsorted(ids[nulls:], doc, "right")))
        return max(a + int(np.searchsorted(ties[a:b], tie, "right")) - 1, 0)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, tie = b.column("doc_id").to_pylist(), b.column("tie").to_pylist()
            own = [place(d, t) for d, t in zip(doc, tie, strict=True)]
            first = [k for k, p in enumerate(own) if starts[p] == order((doc[k], tie[k]))]
            at = np.array([*range(len(own)), *first], np.int64)
            range_ = np.array([*own, *((own[k] - 1) % len(starts) for k in first)], np.int32)
            guest = np.arange(len(at)) >= len(own)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(range_), pa.array(guest)], [*b.schema.names, "range", "guest"])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next row isn't read yet
        for b in it:
            guests = b.column("guest").to_pylist()
            n = guests.index(True) + 1 if True in guests else len(guests)  # of the next range's first row one copy is enough
            if held and held[-1][3]:
                continue
            texts = b.column("text").slice(0, n).to_pylist()
            made = fingerprints([t.encode() for t in texts], known, rank)
            rows = held + list(zip(b.column("doc_id").slice(0, n).to_pylist(), texts, made, guests, strict=False))
            edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for (_, t, _, _), (_, after, _, _) in zip(rows, rows[1:], strict=False)]
            others = fingerprints(edited, known, rank)
            out = [
                (doc, len(t), hashlib.sha256(e).hexdigest(), text_of(own), text_of(o), likeness(own, o), likeness(own, after))
                for (doc, t, own, _), (_, _, after, _), e, o in zip(rows, rows[1:], edited, others, strict=False)
            ]
            held = rows[-1:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES.types, strict=True)], TYPES.names)

    dealt = rows.mapInArrow(common.lean(deal), "doc_id long, text string, tie long, range int, guest boolean").repartitionById(len(starts), F.col("range"))
    return dealt.sortWithinPartitions("guest", "doc_id", "tie").select("doc_id", "text", "guest").mapInArrow(common.lean(task), SCHEMA)


TYPES = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to the edited text's and the next document's."""
    return compare(common.table(spark, sf_dir, "documents"))
