"""Encoding with public tokenizers, by units that a vocabulary can't join: each distinct unit is encoded once a task."""

from __future__ import annotations

import re
from functools import cache, cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import common

#: Distinct units, and characters of them, that a task remembers before it starts afresh.
REMEMBER, REMEMBER_CHARS = 500_000, 5_000_000
#: Classes of bytes. Solid: visible ASCII; gap: blank or line feed; mark: punctuation that ends a run of letters.
SOLID, LETTER, GAP, MARK = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x7F] |= SOLID
CLASS[[*range(65, 91), *range(97, 123)]] |= LETTER
CLASS[[0x20, 0x0A]] |= GAP
CLASS[[ord(c) for c in ".,!?;:%"]] |= MARK
#: First byte of U+00C0 to U+00FF in UTF-8, and the last of the two that are no letters.
LATIN, TIMES, OVER = 0xC3, 0x97, 0xB7
#: A unit that both vocabularies keep as one piece, whatever stands before it and when another such unit follows.
WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: The blank, as a byte-level vocabulary's tokens have it.
BLANK = "Ġ"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where, in UTF-8 bytes, a unit starts: both vocabularies' rules divide a text there whatever stands around.

    Before a blank or line feed after a visible character, before a mark after a letter, and after a line feed between two visible
    characters. What is visible or a letter is told for ASCII and U+00C0 to U+00FF; elsewhere units just stay longer.
    """
    kind, starts, latin = CLASS[data], np.zeros(len(data), bool), np.zeros(len(data), bool)
    latin[1:] = data[:-1] == LATIN
    solid, letter = (kind & SOLID != 0) | latin, (kind & LETTER != 0) | (latin & (data != TIMES) & (data != OVER))
    starts[1:] = (solid[:-1] & (kind[1:] & GAP != 0)) | (letter[:-1] & (kind[1:] & MARK != 0))
    starts[1:] |= (starts & (data == 0x0A))[:-1] & ((kind & SOLID != 0) | (data == LATIN))[1:]
    return starts


class Encoder:
    """Encodes texts as the tokenizers library does, without adding special tokens, by the units of unit_starts().

    special: a special token's string in a text becomes that token, as in the library's encode(); else it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.path, self.special, self.marked = path, special, Tokenizer.from_file(path)
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(self.marked.get_added_tokens_decoder().items(), reverse=True))
        #: Tokens that end a word where the vocabulary marks ends, else those that begin one, as only its blank does.
        self.suffix, self.edge = self.marked.model.end_of_word_suffix or "", np.zeros(self.marked.get_vocab_size(), bool)
        self.edge[[i for t, i in self.marked.get_vocab(with_added_tokens=False).items() if (t.endswith(self.suffix) if self.suffix else t.startswith(BLANK))]] = True
        self.forget()

    @cached_property
    def plain(self):
        """The tokenizer to which special tokens' strings in a text are ordinary text."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.units = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.marked.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of units that are WORDs, joined as they are."""
        ids = self.ids("".join(units))
        cuts = np.flatnonzero(self.edge[ids])
        assert len(cuts) == len(units), "a word has not one edge"
        return ids, np.diff(cuts, prepend=-1) if self.suffix else np.diff(cuts, append=len(ids))

    def learn(self, new: list[str]) -> None:
        """Encode distinct units: words in one call, others without the special string joined by it in another."""
        words, safe, odd = [], [], []
        for u in new:
            (words if WORD(u) else odd if "<|" in u else safe).append(u)
        parts, sizes = [], []
        if words:
            ids, size = self.words(words)
            parts.append(ids)
            sizes.append(size)
        if safe:
            ids = self.ids(self.mark.join(safe))
            marks = ids == self.mark_id
            parts.append(ids[~marks])
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
            assert len(sizes[-1]) == len(safe), "a unit encodes to the mark"
        if odd:
            parts += [np.array(e.ids, np.uint32) for e in (self.marked if self.special else self.plain).encode_batch(odd, add_special_tokens=False)]
            sizes.append(np.array([len(p) for p in parts[-len(odd) :]], np.int64))
        more, size = np.concatenate(parts), np.concatenate(sizes)
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.units + len(size) > len(self.start):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.size[self.units : self.units + len(size)] = size
        self.start[self.units : self.units + len(size)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(more)] = more
        self.known.update(zip(words + safe + odd, range(self.units, self.units + len(size)), strict=True))
        self.used += len(more)
        self.units += len(size)
        self.chars += sum(map(len, new))

    def places(self, units: list[str]) -> np.ndarray:
        """Where distinct units are remembered; those not known yet are learned."""
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(missing := np.flatnonzero(at < 0)):
            self.learn(new := [units[k] for k in missing.tolist()])
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return at

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column without nulls."""
        if self.units > REMEMBER or self.chars > REMEMBER_CHARS:
            self.forget()
        data, at = common.utf8(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        starts = unit_starts(data)
        starts[at[at < len(data)]] = True
        edges = np.append(np.flatnonzero(starts), len(data))
        coded = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        units = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sizes = self.size[units]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at_flat = np.repeat((self.start[units] - (ends - sizes)).astype(np.int32), sizes)
        at_flat += np.arange(total, dtype=np.int32)
        ids = self.flat[at_flat]
        bounds = np.concatenate(([0], ends))[np.searchsorted(edges, at)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def encoder(path: str, special: bool = False) -> Encoder:
    """One a Python worker: later tasks find its units known."""
    return Encoder(path, special)
