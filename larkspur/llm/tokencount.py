"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens that a batch adds are held end to end in one array of symbols. In
each round every sequence finds the lowest rank among its adjacent pairs, and all
occurrences of that pair in it are merged, for all sequences at once, until none
has a pair that merges. What survives are the tokens.

Null texts count as empty: 0 bytes, 0 tokens. A special string inside a text is one
token, as the library's default has it. Repeated rows are counted each for itself. Very long texts are worked on whole, an empty table
gives an empty table; columns named as the results are replaced, and others may have any name.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larkspur.llm.common import Memo, arrow_map, slices, sums, with_fields

#: The pattern by which byte-level BPE cuts text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = "n_bytes long, n_tokens long"
NONE = np.int64(1 << 40)


class Merger:
    """Counts tokens of pre-tokens with the merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # bytes stand in the file as printable characters: those that are printable as themselves, the rest from U+0100 up
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: chr(b) for b in shown}
        letters |= {b: chr(0x100 + i) for i, b in enumerate(x for x in range(0x100) if x not in letters)}
        self.first = np.array([vocab[letters[b]] for b in range(0x100)], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.keys)] = True
        cut = "|".join(map(regex.escape, self.special))
        self.pattern = regex.compile(f"{cut}|{PRE_TOKENS}" if cut else PRE_TOKENS)
        self.cut = regex.compile(f"({cut})") if cut else None
        self.plain = regex.compile(PRE_TOKENS)
        self.memo = Memo(lambda words: (self.count(words),))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, NONE for pairs that don't merge."""
        out = np.full(len(left), NONE)
        keys = left * self.size + right
        may = np.flatnonzero(self.seen[self._slot(keys)])
        at = np.searchsorted(self.keys, keys[may])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[may]
        out[may[hit]] = self.ranks[at[hit]]
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The library splits special strings off first, so no pre-token looks past one."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain.findall(text)
        parts = self.cut.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.plain.findall(part))]

    def count(self, words: list[str]) -> np.ndarray:
        """How many tokens each pre-token has."""
        out = np.ones(len(words), np.int64)
        raw = [b"" if w in self.special else w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return out
        symbols = self.first[np.frombuffer(b"".join([raw[i] for i in live]), np.uint8)]
        owner = np.repeat(np.arange(len(live)), sizes[live])
        rank = np.full(len(symbols), NONE)  # of each symbol with its right neighbour
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(owner)])
            done = best == NONE
            out[live[owner[starts[done]]]] = lengths[done]
            if done.all():
                return out
            if done.any():
                keep = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                best, lengths = best[~done], lengths[~done]
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            # of overlapping occurrences (aaa) each second one goes, from the left
            run = np.cumsum(np.r_[True, (np.diff(hits) != 1)]) - 1
            first = hits[np.r_[True, np.diff(run) != 0]]
            hits = hits[(hits - first[run]) % 2 == 0]
            symbols[hits] = self.made[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # where the merged symbols stand afterwards: each merge before removes one
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed] = NONE
            inner = changed[changed < len(symbols) - 1]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])

    def text_counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        parts = []
        for a, b in slices(texts):
            words = [self.pre_tokens(t) if t else [] for t in texts[a:b]]
            codes = self.memo.codes([w for ws in words for w in ws])
            (known,) = self.memo.arrays()
            parts.append(sums(known[codes], np.fromiter(map(len, words), np.int64, len(words))))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the UTF-8 bytes and the tokens of ``text``; columns of these names are replaced."""
    docs = docs.drop(n_bytes, n_tokens)

    def work(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        sizes = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
        yield batch.append_column(n_bytes, pa.array(sizes)).append_column(n_tokens, pa.array(merger(path).text_counts(texts)))

    return arrow_map(docs, work, with_fields(docs, f"{n_bytes} long, {n_tokens} long"))
