"""Which of many words texts hold, by one walk over the texts: from every place at once, down a trie of the words, as long as any word goes on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries of a table of all steps; a larger trie is searched by its sorted edges. Places of texts that are walked from at once, and cells of what is found.
DENSE, PLACES, CELLS = 1 << 23, 1 << 18, 1 << 24


class Words:
    """A trie of different words, none of them empty. Its edges are sorted by state and character; an edge leads to the state of its number, the root is 0."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.letters = "".join(sorted(set().union(*words)))
        self.width = len(self.letters) + 1
        size = np.array([len(w) for w in words], np.int64)
        self.longest = int(size.max(initial=0))
        codes, start = self.codes("".join(words), self.table()), np.cumsum(size) - size
        state, edges, base = np.zeros(self.n, np.int64), [np.full(1, -1, np.int64)], 1
        ends = []
        for level in range(self.longest):
            alive = np.flatnonzero(size > level)
            each, at = np.unique(state[alive] * self.width + codes[start[alive] + level], return_inverse=True)
            state[alive] = base + at
            edges.append(each)
            base += len(each)
            over = alive[size[alive] == level + 1]
            ends.append((state[over], over))
        self.edges = np.concatenate(edges)
        self.word = np.full(base, -1, np.int32)
        for s, w in ends:
            self.word[s] = w

    def table(self) -> np.ndarray:
        """Every character's number; 0 for those of no word."""
        out = np.zeros(0x110000, np.int32)
        out[np.array([ord(x) for x in self.letters], np.int64)] = np.arange(1, self.width)
        return out

    @staticmethod
    def codes(text: str, table: np.ndarray) -> np.ndarray:
        return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] if text else np.zeros(0, np.int32)

    def held(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For stretches of the texts, in order: a row a text, of which words it holds."""
        table, dense = self.table(), None
        if len(self.edges) * self.width <= DENSE:
            dense = np.zeros(len(self.edges) * self.width, np.int32)
            dense[self.edges[1:]] = np.arange(1, len(self.edges))

        def step(state: np.ndarray, code: np.ndarray) -> np.ndarray:
            key = state * np.int64(self.width) + code
            if dense is not None:
                return dense[key]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            return np.where(self.edges[at] == key, at, 0)

        most, start = max(1, CELLS // max(1, self.n)), 0
        while start < len(texts):
            end, places = start, 0
            while end < len(texts) and end - start < most and (end == start or places + len(texts[end]) <= PLACES):
                places += len(texts[end])
                end += 1
            yield self.walked(texts[start:end], table, step)
            start = end

    def walked(self, texts: list[str], table: np.ndarray, step) -> np.ndarray:
        out = np.zeros(len(texts) * self.n, bool)
        size = np.array([len(t) for t in texts], np.int64) + 1
        codes = np.zeros(int(size.sum()) + self.longest, np.int32)  # a 0 after every text, which no word goes over
        for t, at in zip(texts, np.cumsum(size) - size, strict=True):
            codes[at : at + len(t)] = self.codes(t, table)
        row = np.repeat(np.arange(len(texts)) * self.n, size)
        for first in range(0, len(row), PLACES):
            at = first + np.flatnonzero(codes[first : min(first + PLACES, len(row))])
            state = np.zeros(len(at), np.int32)
            for level in range(self.longest):
                state = step(state, codes[at + level])
                on = np.flatnonzero(state)
                if not len(on):
                    break
                at, state = at.take(on), state.take(on)
                word = self.word.take(state)
                hit = np.flatnonzero(word >= 0)
                out[row.take(at.take(hit)) + word.take(hit)] = True
        return out.reshape(len(texts), self.n)
