"""Exact n-gram Jaccard join by universe partition: a set's tokens fall into segments whose number depends on its size band.

Two sets with Jaccard similarity J or more differ in at most d tokens, d following from their sizes. Sizes fall into bands; a set is
indexed in its own band and, for smaller partners, in those below that can hold one. A band divides the universe of token hashes into more
segments than d. Two similar sets therefore agree in a segment (pigeonhole), and what a set is indexed by is allocated at the least cost
in entries that loses no pair:

- a set that fills more than d segments: a hash of each filled one. All but d of them agree with those of any similar set, so that a
  set that shares fewer keys with others has no similar one;
- a set that fills fewer has these, and besides half as many, longer segments with their one-deletion neighbourhoods, in which two such
  sets agree as some segment of theirs differs by one token at most.

Entries meet by key. Sets that share a key form a bundle, named by the least of them, so that the keys of near copies, which are many,
make few bundles. Members of a bundle are compared in blocks by parity bitmaps, which bound the number of differing tokens from below;
pairs that pass are verified on whole sets. Pairs already connected aren't compared again, and a bundle's first pairs are stars around
its best connected members, so that a group of thousands of near copies costs about as many pairs as it has members. What stays
quadratic is the comparison, within blocks, of members that are near one another but aren't connected.

A key that more than 1 / HOT of all sets share never meets in one task: such keys, counted while the sets are made, go with the code,
and their entries name the bundle at once. Equal sets, by 128 bits of their tokens' hashes, are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Members compared in one block; pairs verified around one center in one piece; bits of the row filter; bytes of text hashed at once.
BLOCK, STAR, FILTER_BITS, AT_ONCE = 2048, 256, 1 << 24, 1 << 19
#: Sizes of a band differ by this factor at most; segments for each token that may differ; bits of a bitmap for each token, and at most.
BAND, SPARE, SKETCH, SKETCH_MOST = Fraction(3, 2), 1.17, 4, 8192
#: A key is hot with so many sets or more and this share of all sets; keys counted at once.
HOT_LEAST, HOT, COUNTED = 256, 512, 1 << 20
ONE, HALF, SALT = np.uint64(1), np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


class Sets:
    """Sets of token hashes, one behind the other: each sorted, without repeats."""

    def __init__(self, tokens: np.ndarray, at: np.ndarray):
        self.tokens, self.at, self.n = tokens, at, np.diff(at)

    @staticmethod
    def of(data: np.ndarray, at: np.ndarray) -> Sets:
        """Shingle sets of texts (A-Z lower-cased, white space words); a text of fewer words than a shingle has is one, without words none."""
        h, w = common.words_of(data, at, lower=True)
        many = np.diff(w)
        size = np.where(many >= SHINGLE, many - SHINGLE + 1, np.minimum(many, 1))
        out = np.concatenate(([0], np.cumsum(size)))
        tokens = np.empty(out[-1], np.uint64)
        whole = np.zeros(out[-1], bool)
        short = np.flatnonzero((many > 0) & (many < SHINGLE))
        whole[out[short]] = True
        owner = np.repeat(np.arange(len(many)), many)
        if len(h) >= SHINGLE:
            tokens[~whole] = runs(h, SHINGLE)[owner[: 1 - SHINGLE] == owner[SHINGLE - 1 :]]
        for k in short:
            tokens[out[k]] = runs(h[w[k] : w[k + 1]], int(many[k]))[0]
        for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
            tokens[a:b].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        new[out[:-1][size > 0]] = True
        return Sets(tokens[new], np.concatenate(([0], np.cumsum(new)))[out])

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.at[k] : self.at[k + 1]]

    def take(self, which: np.ndarray) -> Sets:
        n = self.n[which]
        at = np.concatenate(([0], np.cumsum(n)))
        return Sets(self.tokens[np.repeat(self.at[which] - at[:-1], n) + np.arange(at[-1])], at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by set, modulo 2**64."""
        out, some = np.zeros(len(self.n), np.uint64), self.n > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.at[:-1][some])
        return out

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes that together stand for a set."""
        n = self.n.astype(np.uint64)
        return tuple(common.mix(self.sums(common.mix(self.tokens * k + k)) + n).view(np.int64) for k in (common.GOLDEN, SALT))

    def sketches(self) -> list[bytes]:
        """Parity bitmaps: each token flips a bit. A bitmap folds into one of half as many bits by exclusive or."""
        bits = np.minimum(64 << np.maximum(np.ceil(np.log2(np.maximum(self.n, 1) * SKETCH / 64)).astype(np.int64), 0), SKETCH_MOST)
        base = np.concatenate(([0], np.cumsum(bits)))
        at = (self.tokens & np.repeat((bits - 1).astype(np.uint64), self.n)).astype(np.int64) + np.repeat(base[:-1], self.n)
        raw = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [raw[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many consecutive word hashes."""
    out = np.full(len(h) - size + 1, size, np.uint64)
    factors = np.cumsum(np.full(size, SALT, np.uint64)) * common.GOLDEN | ONE
    for k in range(size):
        out += h[k : k + len(out)] * factors[k]
    return common.mix(out)


class Bands:
    """Size bands, the segments of each, and the index entries of sets."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.num, self.den = numerator, denominator
        self.tops = [1]

    def band(self, n: np.ndarray) -> np.ndarray:
        """The band of sets of n tokens: band k holds sizes over tops[k - 1] up to tops[k]."""
        while len(n) and self.tops[-1] < n.max():
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))
        return np.searchsorted(self.tops, n)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most tokens in which similar sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num

    def entries(self, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all entries, whose they are, in order, and how many keys each set shares at least if it has a similar one."""
        keys, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        need = np.full(len(sets.n), np.iinfo(np.int64).max)
        marks = common.mix(sets.tokens + SALT)
        own, n = self.band(sets.n), sets.n
        tops = np.array(self.tops)
        below, down = -(-n * self.num // self.den), 0
        while True:
            band = own - down
            # in its own band a set may be the smaller of a pair, in those below it is the larger
            use = np.flatnonzero((n > 0) & (band >= 0) & (tops[np.maximum(band, 0)] >= below))
            if not len(use):
                break
            d = self.differ(n, self.largest(n)) if not down else self.differ(n, np.minimum(n, tops[np.maximum(band, 0)]))
            use = use[d[use] > 0]  # else similar sets are equal
            for k, w in self.allocated(sets, marks, use, band[use], d[use], need):
                keys.append(k)
                whose.append(w)
            down += 1
        whose = np.concatenate(whose)
        order = np.argsort(whose, kind="stable")
        return np.concatenate(keys)[order], whose[order], need

    def allocated(self, sets: Sets, marks: np.ndarray, use: np.ndarray, band: np.ndarray, d: np.ndarray, need: np.ndarray):
        """Entries of some sets in one band each, where each may differ from a partner in d tokens."""
        if not len(use):
            return
        part = sets.take(use)
        mark = Sets(marks, sets.at).take(use).tokens
        tops = np.array(self.tops)[band]
        most = self.differ(tops, self.largest(tops))
        salt = common.mix(band.astype(np.uint64) + SALT)
        owner = part.owner()
        segment = self.place(part, np.ceil(SPARE * (most + 1)).astype(np.int64))
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        of = owner[at]
        filled = np.bincount(of, minlength=len(use))
        yield common.mix(np.add.reduceat(mark, at) + (segment[at] + ONE) * common.GOLDEN + salt[of]), use[of]
        need[use] = np.minimum(need[use], np.maximum(filled - d, 1))
        few = np.flatnonzero(filled <= d)
        if len(few):
            yield from self.neighbourhoods(part.take(few), Sets(mark, part.at).take(few).tokens, use[few], most[few], salt[few])

    @staticmethod
    def place(part: Sets, segments: np.ndarray) -> np.ndarray:
        """The segment of each token: equal ranges of the upper half of its bits, so that a set's segments stand in order."""
        return ((part.tokens >> HALF) * np.repeat(segments.astype(np.uint64), part.n)) >> HALF

    def neighbourhoods(self, part: Sets, mark: np.ndarray, whose: np.ndarray, most: np.ndarray, salt: np.ndarray):
        segments = most // 2 + 1  # two differing tokens in each are more than a pair may have
        base = np.concatenate(([0], np.cumsum(segments)))
        at = self.place(part, segments).astype(np.int64) + np.repeat(base[:-1], part.n)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, at, mark)
        name = common.mix(np.repeat(salt + common.GOLDEN, segments)) + (np.arange(base[-1]) - np.repeat(base[:-1], segments)).astype(np.uint64) * SALT
        yield common.mix(total + name), np.repeat(whose, segments)
        yield common.mix(total[at] - mark + name[at]), np.repeat(whose, part.n)


SETS = "doc_id long, row long, n long, h long, p long, need long, sketch binary, keys binary, often binary"


def task_sets(bands: Bands):
    """Each text's set: size, prints and, where the task meets the set first, bitmap and index keys. Rows without n hold common keys."""

    def often(keys: list[np.ndarray], whose: list[np.ndarray], sets: int) -> bytes:
        """key, count and least set of the keys that many of the last sets have."""
        k, h = np.concatenate(keys), np.concatenate(whose)
        order = np.argsort(k)
        k, h = k[order], h[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        n = np.diff(np.append(at, len(k)))
        pick = n >= max(8, sets // HOT)
        return np.stack((k[at].view(np.int64), n, np.minimum.reduceat(h, at)), 1)[pick].tobytes()

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # sets that this task has met; copies add nothing
        row, schema = TaskContext.get().partitionId() << 40, pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("p", pa.int64()), ("need", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary()), ("often", pa.binary())])
        keys, whose, held, counted = [], [], 0, 0

        def rare() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"often": often(keys, whose, counted)}], schema=schema)

        for b in it:
            data, at = common.utf8(b.column(1))
            for x, y in common.spans(at, AT_ONCE):
                sets = Sets.of(data, at[x : y + 1])
                h, p = sets.prints()
                if len(seen) > 1 << 20:
                    seen.clear()
                fresh = []
                for k, both in enumerate(zip(h.tolist(), p.tolist(), strict=True)):
                    if sets.n[k] and both not in seen:
                        seen.add(both)
                        fresh.append(k)
                fresh = np.array(fresh, np.int64)
                new = sets.take(fresh)
                own, of, least = bands.entries(new)
                keys.append(own)
                whose.append(h[fresh][of])
                held, counted = held + len(own), counted + len(fresh)
                cuts, raw = (np.searchsorted(of, np.arange(len(fresh) + 1)) * 8).tolist(), own.tobytes()
                sketch, entries, need = ([None] * len(sets.n) for _ in range(3))
                for k, s, m, i, j in zip(fresh.tolist(), new.sketches(), least.tolist(), cuts[:-1], cuts[1:], strict=True):
                    sketch[k], need[k], entries[k] = s, m, raw[i:j]
                empty = pa.array(sets.n == 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(np.arange(row, row + y - x)), pa.array(sets.n), *(pc.if_else(empty, pa.scalar(None, pa.int64()), pa.array(v)) for v in (h, p)), pa.array(need, pa.int64()), pa.array(sketch, pa.binary()), pa.array(entries, pa.binary()), pa.nulls(y - x, pa.binary())], schema=schema)
                row += y - x
                if held > COUNTED:
                    yield rare()
                    keys, whose, held, counted = [], [], 0, 0
        if held:
            yield rare()

    return task


def task_common(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, k].copy()) for k in range(3)], ["key", "n", "h"])


def task_entries(hot: np.ndarray, names: np.ndarray):
    """key and set of each entry; of hot keys the bundle's name instead."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, at = common.utf8(b.column(1))
            size = np.diff(at) // 8
            keys = data[at[0] : at[-1]].view(np.int64)
            h = np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)
            is_hot = np.zeros(len(keys), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                is_hot = hot[place] == keys
                keys = np.where(is_hot, names[place], keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(h), pa.array(is_hot)], ["key", "h", "hot"])

    return task


def task_bundles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle (the least set with the key), h and number of the keys that several sets share, from rows sorted by key; hot rows as they are."""

    def shared(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size, low = np.diff(np.append(at, len(keys))), np.minimum.reduceat(h, at)
        on = low != np.maximum.reduceat(h, at)
        return np.stack((np.repeat(low[on], size[on]), h[np.repeat(on, size)]), 1)

    def answer(found: list[np.ndarray]) -> pa.RecordBatch:
        rows, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array(times)], ["bundle", "h", "keys"])

    held = [np.zeros(0, np.int64)] * 2
    for b in it:
        key, h, hot = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        found = [np.stack((key[hot], h[hot]), 1)]
        key, h = np.concatenate((held[0], key[~hot])), np.concatenate((held[1], h[~hot]))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
        if last:
            found.append(shared(key[:last], h[:last]))
        held = [key[last:], h[last:]]
        yield answer(found)
    if len(held[0]):
        yield answer([shared(*held)])


def near_pairs(n: np.ndarray, sketch: list[bytes], comp: np.ndarray | None, part: np.ndarray, num: int, den: int):
    """Pairs (i < j) that the bitmaps don't rule out, of different components and, where parts differ, of different parts, and their bounds."""
    width = min(map(len, sketch)) // 8
    maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width), 0) for s in sketch])
    across = part.min() != part.max()
    left, right, gap = [], [], []
    for i in range(len(n) - 1):
        d = np.bitwise_count(maps[i] ^ maps[i + 1 :]).sum(1, dtype=np.int64)
        ok = (den + num) * np.maximum(d, np.abs(n[i + 1 :] - n[i])) <= (den - num) * (n[i + 1 :] + n[i])
        if comp is not None:
            ok &= comp[i + 1 :] != comp[i]
        if across:
            ok &= part[i + 1 :] != part[i]
        j = np.flatnonzero(ok)
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j + i + 1)
            gap.append(d[j])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(gap)


def stars(left: np.ndarray, right: np.ndarray, gap: np.ndarray, size: int) -> list[tuple[int, int]]:
    """For each member with a pair one pair: with the best connected member next to it, greedily; else with its nearest."""
    a, b, g = np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((gap, gap))
    order = np.lexsort((b, g, a))
    a, b = a[order], b[order]
    degree = np.bincount(a, minlength=size)
    at = np.concatenate(([0], np.cumsum(degree))).tolist()
    done, out = np.zeros(size, bool), []
    for c in np.argsort(-degree, kind="stable").tolist():
        if not degree[c]:
            break
        if done[c]:
            continue
        near = b[at[c] : at[c + 1]]
        free = near[~done[near]]
        out += [(c, x) for x in free.tolist()] if len(free) else [(int(near[0]), c)]
        done[free] = done[c] = True
    return out


def task_pairs(num: int, den: int, all_pairs: bool):
    """a, b of candidate pairs within each piece, from rows sorted by piece; unless all are wanted, at most one pair a member, and a row
    (bundle, null) where more pairs are left."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def look(piece: slice) -> list[tuple[int, int | None]]:
            if piece.stop - piece.start < 2:
                return []
            node, n, part, bundle = (have[c][piece] for c in ("node", "n", "part", "bundle"))
            comp = have["component"][piece] if "component" in have else None
            left, right, gap = near_pairs(n, sketch[piece], comp, part, num, den)
            if not len(left):
                return []
            if all_pairs:
                return list(zip(node[left].tolist(), node[right].tolist(), strict=True))
            picked = stars(left, right, gap, len(n))
            more = [(int(bundle[0]), None)] if len(left) > len({(min(p), max(p)) for p in picked}) else []
            return [(int(node[i]), int(node[j])) for i, j in picked] + more

        have: dict[str, np.ndarray] = {}
        sketch: list[bytes] = []
        for b in it:
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "sketch"}
            have = {c: np.concatenate((have[c], v)) for c, v in now.items()} if have else now
            sketch = sketch + b.column("sketch").to_pylist()
            piece = have["piece"]
            cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist()]
            yield answer([p for x, y in zip(cuts[:-1], cuts[1:], strict=True) for p in look(slice(x, y))])
            have, sketch = {c: v[cuts[-1] :] for c, v in have.items()}, sketch[cuts[-1] :]  # the last piece may go on
        if have:
            yield answer(look(slice(0, len(sketch))))

    def answer(found: list) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def passing(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The rows that a bitmap of row_filter lets through; a null passes."""
    at = common.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
    on = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & ONE
    return np.flatnonzero(on.astype(bool) | ~ids.is_valid().to_numpy(zero_copy_only=False))


def row_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, whatever the input, that lets through every given id and few others."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = common.mix(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((ONE << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    found = ids.mapInArrow(common.lean(task), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return bits


def task_texts(bits: np.ndarray):
    """h, p and text of the rows that may be asked for, each set once a task."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in it:
            b = b.take(pa.array(passing(bits, b.column(0))))
            data, at = common.utf8(b.column(1))
            for x, y in common.spans(at, AT_ONCE):
                h, p = Sets.of(data, at[x : y + 1]).prints()
                if len(seen) > 1 << 20:
                    seen.clear()
                pick = []
                for k, both in enumerate(zip(h.tolist(), p.tolist(), strict=True)):
                    if both not in seen:
                        seen.add(both)
                        pick.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(h[pick]), pa.array(p[pick]), b.column(1).take(pa.array(np.array(pick, np.int64) + x))], ["h", "p", "text"])

    return task


def task_verify(num: int, den: int):
    """The pairs whose whole sets are similar enough, from rows sorted by center and piece, the center's own text (no b) first."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, mine = None, None
        for b in it:
            data, at = common.utf8(b.column(3))
            a, piece, other = (b.column(k).to_pylist() for k in range(3))
            keep = []
            for x, y in common.spans(at, AT_ONCE):
                sets = Sets.of(data, at[x : y + 1])
                for k in range(x, y):
                    p = sets[k - x]
                    if other[k] is None:
                        center, mine = (a[k], piece[k]), p.copy()
                        continue
                    assert center == (a[k], piece[k]), "a center's text is missing"
                    both = int((p[np.minimum(np.searchsorted(p, mine), len(p) - 1)] == mine).sum())
                    if den * both >= num * (len(p) + len(mine) - both):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 2)], ["a", "b"])

    return task


def components(edges: DataFrame, cuts: common.Cuts) -> DataFrame:
    """node and component (its smallest node) of every node of an edge table (a, b), by alternating large and small stars.

    Each round replaces edges by others that keep the components; it ends when the edges are all stars. No component is ever gathered.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """a > b. large: link larger neighbours of a node to the smallest; else its smaller ones and itself."""
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        rest = e.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select("a", F.col("m").alias("b"))).distinct()

    now = cuts(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        new = cuts(star(star(now, True), False), "edges")
        cuts.drop(now)
        got, now = state(new), new
        if got == seen:
            break
        seen = got
    return now


def labels(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def pieces(bundles: DataFrame, profile: DataFrame, label: DataFrame | None, salt: int, across: bool) -> DataFrame:
    """Members of bundles with their bitmaps, dealt into pieces of about BLOCK members, sorted by piece.

    label: the components so far; bundles within one component are left out. across: the pieces of a large bundle hold two of its parts
    each, so that all pairs meet; else one, dealt anew by the salt.
    """
    rows = bundles
    if label is not None:
        rows = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("bundle").agg(F.count("*").alias("size"), *([F.min("component").alias("lo"), F.max("component").alias("hi")] if label is not None else []))
    sizes = sizes.filter("size > 1" if label is None else "lo != hi").select("bundle", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "bundle").withColumn("part", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int"))
    if across:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lower, upper = F.least("part", "other"), F.greatest("part", "other")
        rows = rows.withColumn("piece", F.xxhash64("bundle", lower, upper)).withColumn("part", F.when(F.col("blocks") == 1, 0).otherwise(F.col("part")))
    else:
        rows = rows.withColumn("piece", F.xxhash64("bundle", "part")).withColumn("part", F.lit(0))
    rows = rows.select("piece", "part", "bundle", "node", *(["component"] if label is not None else [])).join(profile.select("node", "n", "sketch"), "node")
    return rows.repartition("piece").sortWithinPartitions("piece", "node")


def verified(pairs: DataFrame, texts: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs (a: center, b) whose whole sets are similar enough. A center's pairs are dealt into pieces of about STAR pairs, and
    its text goes once to each piece."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("pieces"))
    dealt = pairs.join(many, "a").withColumn("piece", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int"))
    others = dealt.select("a", "piece", "b").join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "piece", "b", "text")
    centers = dealt.select("a", "piece").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "piece", F.lit(None).cast("long").alias("b"), "text")
    rows = centers.unionByName(others).repartition("a", "piece").sortWithinPartitions("a", "piece", "b")
    return rows.mapInArrow(common.lean(task_verify(*ratio)), "a long, b long")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: its set's size and the smallest doc_id that links reach.

    Documents link when the Jaccard similarity of their shingle sets is numerator / denominator or more; all links count. A null,
    empty or blank text has an empty set and is its own component; repeated rows each give a row, and rows that share an id are each
    linked by their own text; a null id is no one's smallest, so that it names no component but one of null ids only; other columns
    aren't read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    cuts, ratio = common.Cuts(spark), (numerator, denominator)
    docs = common.id_text(docs, id_col, text_col)
    made = cuts(docs.mapInArrow(common.lean(task_sets(Bands(*ratio))), SETS), "sets")
    sets = made.filter("n is not null")
    classes = sets.filter("h is not null").groupBy("h", "p").agg(F.min("doc_id").alias("first"), F.min("need").alias("need"), F.min(F.when(F.col("keys").isNotNull(), F.col("row"))).alias("row"))
    # two sets with one h, of 64 bits, are told apart by p
    twin = F.row_number().over(Window.partitionBy("h").orderBy("p"))
    classes = common.cut(classes.withColumn("twin", twin).select("h", "p", "first", "row", "need", F.when(F.col("twin") == 1, F.col("h")).otherwise(F.xxhash64("h", "twin")).alias("node")), "classes")

    count = classes.count()
    hot = made.filter("often is not null").select("often").mapInArrow(common.lean(task_common), "key long, n long, h long").groupBy("key").agg(F.sum("n").alias("n"), F.min("h").alias("h"))
    hot = hot.filter(F.col("n") >= max(HOT_LEAST, count / HOT)).orderBy("key").toArrow()  # HOT times a set's mean entries at most
    entries = sets.filter("keys is not null").select("h", "keys").mapInArrow(common.lean(task_entries(hot.column("key").to_numpy(), hot.column("h").to_numpy())), "key long, h long, hot boolean")
    entries = entries.repartition(F.when(F.col("hot"), F.xxhash64("h")).otherwise(F.col("key"))).sortWithinPartitions("key")
    shared = cuts(entries.mapInArrow(common.lean(task_bundles), "bundle long, h long, keys long").groupBy("bundle", "h").agg(F.sum("keys").alias("keys")), "shared")

    asked = shared.groupBy("h").agg(F.sum("keys").alias("keys")).join(classes, "h").filter("keys >= need").drop("keys")
    profile = cuts(asked.join(sets.select("row", "n", "sketch"), "row").select("h", "p", F.col("first").alias("doc_id"), "node", "n", "sketch"), "profile")
    bundles = cuts(shared.join(profile.select("h", "node"), "h").select("bundle", "node"), "bundles")
    sizes = common.cut(sets.select("doc_id", "n", "h", "p"), "sizes")
    cuts.drop(shared, made)  # the keys have done their work
    first = cuts(pieces(bundles, profile, None, 1, False).mapInArrow(common.lean(task_pairs(*ratio, False)), "a long, b long").distinct(), "pairs")
    left = bundles.join(first.filter("b is null").select(F.col("a").alias("bundle")).union(bundles.groupBy("bundle").count().filter(F.col("count") > BLOCK).select("bundle")).distinct(), "bundle", "left_semi")
    left = cuts(left, "left")
    pairs = first.filter("b is not null")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(left.select("node")).distinct()
    asked = cuts(profile.join(named, "node", "left_semi").select("h", "p", "doc_id", "node"), "asked")
    texts = docs.mapInArrow(common.lean(task_texts(row_filter(asked.select("doc_id")))), "h long, p long, text string")
    texts = cuts(texts.join(asked.select("h", "p", "node"), ["h", "p"]).select("node", "text"), "texts")

    edges = components(verified(pairs, texts, ratio), cuts)
    for turn in (2, 3):
        again = pieces(left, profile, labels(edges), turn, turn == 3).mapInArrow(common.lean(task_pairs(*ratio, turn == 3)), "a long, b long").filter("b is not null")
        pairs = cuts(again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct() if turn == 3 else again.distinct(), "pairs")
        new = components(verified(pairs, texts, ratio).union(edges), cuts)
        cuts.drop(pairs, edges)
        edges = new
    cuts.drop(first, left, asked, texts, bundles, profile)
    label = labels(edges)
    least = classes.join(label, "node").groupBy("component").agg(F.min("first").alias("least"))
    least = least.join(classes.select(F.col("node").alias("component"), F.col("first").alias("own")), "component").select("component", F.least("least", "own").alias("component_id"))
    known = label.union(label.select("component", "component").distinct()).toDF("node", "component").join(least, "component").select("node", "component_id")
    known = classes.join(known, "node", "left").select("h", "p", F.coalesce("component_id", "first").alias("component_id"))
    out = sizes.join(known, ["h", "p"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id; a null id comes after all others, and of rows
    that share an id one, whichever, stays.

    Rows are numbered and written first, so that components are of rows, not of ids. A row with a null, empty or blank text is its
    own component and stays.
    """
    rows = docs.toDF(*(cells := [f"cell{k}" for k in range(len(docs.columns))]))
    id_, text = (cells[docs.columns.index(c)] for c in (id_col, text_col))
    rows = common.cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = cluster(rows, "row", text).select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", F.col(id_).alias("id")), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(cells).toDF(*docs.columns)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents at 80 of 100."""
    return cluster(common.table(spark, sf_dir, "documents"))
