"""Hashed text features for linear models, built for whole batches with numpy.

Words of a batch are numbered once; n-grams and skip-grams are mixes of their words' hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

from larkspur.llm.common import Memo, mix


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def pair(left: np.ndarray, right: np.ndarray, kind: int) -> np.ndarray:
    return mix(left * np.uint64(3) + mix(right + np.uint64(kind)))


#: Words whose hashes a worker remembers; they are soon worked out again.
MOST = 100_000


class Words:
    """Hashes of words, remembered."""

    def __init__(self, extra=None):
        self.extra = extra
        self.memo = Memo(lambda words: (word_hashes(words), *(extra(words) if extra else ())), MOST)

    def of(self, words: list[list[str]]) -> tuple[np.ndarray, ...]:
        """(text number, hash, extras) of every word."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.memo.codes([w for ws in words for w in ws])
        arrays = self.memo.arrays()
        return np.repeat(np.arange(len(words)), counts), *(a[codes] for a in arrays)


def grams(owner: np.ndarray, hashes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each two words that stand ``gap`` apart in a text; gap 1 is a bigram."""
    if len(hashes) <= gap:
        return owner[:0], hashes[:0]
    same = owner[gap:] == owner[:-gap]
    return owner[gap:][same], pair(hashes[:-gap][same], hashes[gap:][same], gap)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)
