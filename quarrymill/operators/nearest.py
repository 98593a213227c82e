"""The nearest rows of many queries, exactly, in cells of rows by queries.

A cell's scores are first estimated by one product of matrices; a query's rows whose estimate reaches its k-th best, less what rounding can cost, are then scored
one component after another in double precision, so that a score depends on its two vectors only, and equal vectors tie wherever they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Estimates, and pairs to be scored, that are held at once.
HELD = 1 << 21
#: A squared length outside these takes no part in estimates; its pairs are all scored.
TAME = 1e-100, 1e100


class Vectors:
    """Vectors as rows of a matrix, ended by zeros; where each has its first null and its first value that isn't finite, and its squared length after so many values."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        there, size = column.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()  # without what stands under nulls
        none, flat = flat.is_null().to_numpy(zero_copy_only=False), pc.fill_null(flat.cast(pa.float64()), 0).to_numpy(zero_copy_only=False)
        odd = ~np.isfinite(flat)
        width = int(size.max(initial=0))
        at = np.arange(width) < size[:, None]

        def first(marks: np.ndarray) -> np.ndarray:
            if not marks.any():
                return np.full(len(size), width, np.int64)
            spread = np.zeros(at.shape, bool)
            spread[at] = marks
            return np.where(spread.any(axis=1), spread.argmax(axis=1), width)

        self.x = np.zeros(at.shape)
        self.x[at] = np.where(odd, 0, flat)
        self.null_at, self.odd_at = np.where(there, first(none), 0), first(odd)
        self.size = np.where(there, size, np.iinfo(np.int64).max)  # a null vector is as long as the other one
        self.columns = np.ascontiguousarray(self.x.T)
        self.squares = np.zeros((len(size), width + 1))
        np.cumsum(self.x * self.x, axis=1, out=self.squares[:, 1:])
        self.units: dict = {}

    def __len__(self) -> int:
        return len(self.size)

    def kinds(self) -> list[int]:
        """The lengths there are; null vectors are of the whole width."""
        return np.unique(np.minimum(self.size, self.x.shape[1])).tolist()

    def unit(self, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the vectors of a length, their first n values at length 1, which of them can't be estimated and which are null."""
        if (size, n) not in self.units:
            if len(self.units) > 3:
                self.units.clear()
            at = np.flatnonzero(np.minimum(self.size, self.x.shape[1]) == size)
            s = self.squares[at, n]
            tame = (s > TAME[0]) & (s < TAME[1])
            unit = self.x[at, :n] / np.sqrt(np.where(tame, s, np.inf))[:, None]
            self.units[size, n] = at, unit, (n > self.odd_at[at]) | ~tame & (s != 0), (n > 0) & (n > self.null_at[at])
        return self.units[size, n]


def scored(rows: Vectors, queries: Vectors, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of pairs and whether each is null, as vector.cosine tells: of as many values as the shorter has, 0 where that is none or a length is 0, null where one of
    them is null, not a number where one isn't finite. Of vectors of floats a score is, to the last bit, SQL's list_cosine_similarity of them as doubles."""
    n = np.minimum(np.minimum(rows.size[i], queries.size[q]), max(rows.x.shape[1], queries.x.shape[1]))
    width = min(rows.x.shape[1], queries.x.shape[1], int(n.max(initial=0)))  # beyond it the shorter one's zeros stand
    dot = np.zeros(len(i))
    for k in range(width):
        dot += rows.columns[k][i] * queries.columns[k][q]
    a, b = rows.squares[i, np.minimum(n, rows.x.shape[1])], queries.squares[q, np.minimum(n, queries.x.shape[1])]
    with np.errstate(all="ignore"):
        both = a * b
        size = np.where((both > TAME[0] ** 2) & (both < TAME[1] ** 2), np.sqrt(both), np.sqrt(a) * np.sqrt(b))
        score = np.where((n <= 0) | (size == 0), 0.0, np.clip(dot / size, -1, 1))
    score[(n > 0) & ((n > rows.odd_at[i]) | (n > queries.odd_at[q]))] = np.nan
    return score, (n > 0) & ((n > rows.null_at[i]) | (n > queries.null_at[q]))


def estimates(rows: Vectors, queries: Vectors, start: int, end: int) -> np.ndarray:
    """About the cosine of each of these queries with each row: infinity where it can't be estimated or isn't a number, minus infinity where it is null."""
    out = np.zeros((end - start, len(rows)))
    for size in rows.kinds():
        for other in queries.kinds():
            n = min(size, other)
            (i, a, odd, null), (q, b, q_odd, q_null) = rows.unit(size, n), queries.unit(other, n)
            part = slice(*np.searchsorted(q, (start, end)))
            if not len(q[part]):
                continue
            got = b[part] @ a.T
            got[q_odd[part][:, None] | odd] = np.inf
            got[q_null[part][:, None] | null] = -np.inf
            out[np.ix_(q[part] - start, i)] = got
    return out


def best(ids: pa.ChunkedArray, rows: Vectors, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every query the k best rows: places of queries and rows, scores, and which of these are null. Not a number comes first and null last; ties by id."""
    rank = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="first").to_numpy(zero_copy_only=False).astype(np.int64)
    least = 16 * (rows.x.shape[1] + 8) * np.finfo(float).eps  # twice what rounding may cost either way
    found, step = [], max(1, HELD // max(1, len(rows)))
    for start in range(0, len(queries) if len(rows) else 0, step):
        near = estimates(rows, queries, start, min(start + step, len(queries)))
        sure = np.where(np.isposinf(near), -np.inf, near)  # what can't be estimated pushes nothing out
        floor = np.partition(sure, len(rows) - k, axis=1)[:, len(rows) - k] if k < len(rows) else np.full(len(near), -np.inf)
        at, i = np.nonzero(near >= (floor - least)[:, None])
        q = at + start
        score, null = np.empty(len(i)), np.empty(len(i), bool)
        for s in range(0, len(i), HELD // 8):
            part = slice(s, s + HELD // 8)
            score[part], null[part] = scored(rows, queries, i[part], q[part])
        key = np.where(null, np.inf, np.where(np.isnan(score), -np.inf, -score))
        order = np.lexsort((rank[i], key, q))
        q, i, score, null = q[order], i[order], score[order], null[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[nth < k], i[nth < k], score[nth < k], null[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def cell(rows: pa.Table, queries: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best rows (id, v) of each query (q, v) in a cell: q, id, score."""
    q, i, score, null = best(rows.column("id"), Vectors(rows.column("v")), Vectors(queries.column("q_v")), k)
    return pa.table([queries.column("q").take(pa.array(q)), rows.column("id").take(pa.array(i)), pa.array(score, pa.float64(), mask=null)], names=["q", "id", "score"]).cast(schema)
