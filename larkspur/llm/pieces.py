"""Lattices of all segmentations of words into the pieces of a fixed public vocabulary.

Words of a batch are laid end to end as code points. A node stands before each of a word's
characters and one after its last; an edge is a vocabulary piece between two nodes. Pieces
are found by rolling hashes of every substring up to the longest piece, for all words at once.
A character that is no piece of its own still gets an edge, of its UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from larkspur.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Stands for a space inside pieces.
SPACE = "▁"


@dataclass
class Lattice:
    """Edges sorted by their first node; node numbers run through the words."""

    first: np.ndarray  # each word's first node
    length: np.ndarray  # each word's characters
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray  # vocabulary number, or -(bytes) for a character that is no piece

    def begins(self) -> np.ndarray:
        """The place of each node's first edge, and the number of edges at the end."""
        return np.r_[0, np.cumsum(np.bincount(self.source, minlength=int(self.length.sum()) + len(self.length)))]


class Vocabulary:
    """The pieces of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, size = self.model, self.model.get_piece_size()
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.size = size
        self.text = [m.id_to_piece(i) for i in range(size)]
        self.plain = np.array(plain, np.int64)
        self.byte = np.full(256, -1, np.int64)
        for i in range(size):
            if m.is_byte(i):
                self.byte[int(self.text[i][3:5], 16)] = i
        chars = [np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32) for i in plain]
        lengths = np.array([len(c) for c in chars])
        self.longest = int(lengths.max())
        #: No piece goes on with a space after something else, so that words are lattices of their own.
        assert not any(SPACE in p.lstrip(SPACE) for p in (self.text[i] for i in plain))
        hashes = np.zeros(len(plain), np.uint64)
        for k, c in enumerate(chars):
            h = 0
            for x in self.spread(c).tolist():
                h = (h * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        #: By length and 18 bits of the hash: one more than the place of a piece of these in its table, 0 if there is none.
        self.slots = np.zeros((self.longest + 1, 1 << 18), np.uint16 if len(plain) < 1 << 16 else np.uint32)
        self.tables = {}
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            own = own[np.argsort(hashes[own])]
            self.tables[int(n)] = hashes[own], self.plain[own]
            self.slots[n, (mix(hashes[own]) >> np.uint64(46)).astype(np.int64)] = np.arange(1, len(own) + 1)

        #: Characters of pieces of two and more, numbered from 1, and which two stand side by side in one.
        longer = [c for c in chars if len(c) > 1]
        self.kind = np.zeros(0x110000, np.uint16)
        inside = np.unique(np.concatenate(longer))
        self.kind[inside] = np.arange(1, len(inside) + 1)
        self.beside = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for c in longer:
            self.beside[self.kind[c[:-1]], self.kind[c[1:]]] = True

    def cuts(self, text: str, forced: np.ndarray) -> np.ndarray:
        """The places where a run of characters begins, no piece going across from the one before, with those ``forced``."""
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        begins = np.zeros(len(kinds), bool)
        begins[forced] = True
        begins[1:] |= ~self.beside[kinds[:-1], kinds[1:]]
        return np.flatnonzero(begins)

    @staticmethod
    def spread(chars: np.ndarray) -> np.ndarray:
        return mix(chars.astype(np.uint64) + np.uint64(0x51ED270B))

    def lattice(self, words: list[str]) -> Lattice:
        length = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = len(chars)
        word = np.repeat(np.arange(len(words)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(n)  # characters to the word's end
        first = np.cumsum(length + 1) - length - 1
        node = np.arange(n) + word
        codes = self.spread(chars)
        hashed = np.zeros(n, np.uint64)
        sources, targets, pieces = [], [], []
        covered = np.zeros(n, bool)
        at = np.arange(n)
        for size in range(1, self.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            hashed[at] = hashed[at] * BASE + codes[at + size - 1]
            if size not in self.tables:
                continue
            values = hashed[at]
            place = self.slots[size][(mix(values) >> np.uint64(46)).astype(np.int64)]
            may = np.flatnonzero(place)
            keys, numbers = self.tables[size]
            values, place = values[may], place[may].astype(np.int64) - 1
            hit = keys[place] == values
            other = np.flatnonzero(~hit)  # no piece, or one that shares its bits with another
            place[other] = np.minimum(np.searchsorted(keys, values[other]), len(keys) - 1)
            hit[other] = keys[place[other]] == values[other]
            found = at[may[hit]]
            if size == 1:
                covered[found] = True
            sources.append(node[found])
            targets.append(node[found] + size)
            pieces.append(numbers[place[hit]])
        bare = np.flatnonzero(~covered)
        if len(bare):
            size = 1 + (chars[bare] > 0x7F) + (chars[bare] > 0x7FF) + (chars[bare] > 0xFFFF)
            sources.append(node[bare])
            targets.append(node[bare] + 1)
            pieces.append(-size.astype(np.int64))
        source, target, piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (sources, targets, pieces))
        order = np.argsort(source, kind="stable")
        return Lattice(first, length, source[order], target[order], piece[order])

    def bytes_of(self, char: str) -> list[int]:
        return self.byte[list(char.encode())].tolist()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
