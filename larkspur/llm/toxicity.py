"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, bigrams and one-word skip-grams of a text's lower-cased runs of
letters, as slots of a hash table. Every coordinate has its own learning rate, and an L1
term keeps a weight at zero until its gradients outweigh it, so what is broadcast is a
short list of slots and weights. The model is fitted on a bounded sample of labelled rows.

Null and empty texts score as the bias alone. Rows that repeat score alike. Without any labelled row, as with none that is labelled 1,
there is nothing to tell toxic texts by and every score is 0. Very long texts are worked on whole; an empty table gives an empty table.
Further columns may have any name; one named as the score is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import about, arrow_map, one_text, slices, with_fields
from larkspur.llm.hashed import Words, grams, slots

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 22
#: Labelled rows that are learned from, and passes over them.
SAMPLE, PASSES = 6_000, 4
#: FTRL-proximal's learning rate (alpha, beta) and its L1 and L2 terms.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1

_words: list[Words] = []


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every word, bigram and skip-gram, repeats included."""
    if not _words:
        _words.append(Words())
    owner, hashes = _words[0].of([LETTERS.findall(t.lower()) if t else [] for t in texts])
    parts = [(owner, hashes), grams(owner, hashes, 1), grams(owner, hashes, 2)]
    return np.concatenate([p[0] for p in parts]), slots(np.concatenate([p[1] for p in parts]), BITS)


def distinct(owner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner << BITS | slot)
    return key >> BITS, key & ((1 << BITS) - 1)


def train(examples: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, slots, weights) by passes of FTRL-proximal over (slots, label); the bias is -inf if no label is 1."""
    if not any(label for _, label in examples):
        return -np.inf, np.zeros(0, np.int64), np.zeros(0)
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, which has no L1 term
    order = np.random.default_rng(0)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1 * (at < size)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(z[at]) <= L1) & (at < size), 0.0, w)

    for _ in range(PASSES):
        for i in order.permutation(len(examples)):
            at, label = np.append(examples[i][0].astype(np.int64), size), examples[i][1]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    kept = np.flatnonzero(np.abs(z[:size]) > L1)
    return float(weights(np.array([size]))[0]), kept, weights(kept)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    """Learns from about ``sample`` of the labelled keys that ``learn_from`` marks.

    A key that is labelled more than once has the highest label; null labels don't count. Of several texts of a key one is taken, so that what is
    learned from stays bounded however often a key repeats.
    """
    marked = labels.filter(learn_from & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    chosen = about(marked, sample, "key")  # bounded, so it may be broadcast
    rows = one_text(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key"), "label")

    def work(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            owner, slot = distinct(*features(texts[a:b]))
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).cast(pa.int32()), lists], ["key", "label", "slots"])

    schema = with_fields(rows.select("key"), "label int, slots array<int>")
    found = arrow_map(rows, work, schema).toArrow().sort_by("key")
    lists = found["slots"].combine_chunks() if len(found) else []
    return train([(lists[i].values.to_numpy(), label) for i, label in enumerate(found["label"].to_pylist())])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic; a column of this name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def work(batch: pa.RecordBatch):
        bias, kept, weights = shared.value
        if not dense:
            dense.append(np.zeros(1 << BITS, np.float32))
            dense[0][kept] = weights
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        total = np.full(len(texts), bias)
        for a, b in slices(texts):
            owner, slot = features(texts[a:b])
            used = dense[0][slot] != 0
            owner, slot = distinct(owner[used], slot[used])
            total[a:b] += np.bincount(owner, dense[0][slot], b - a)
        yield batch.append_column(out, pa.array(np.where(total > -np.inf, 1 / (1 + np.exp(-np.clip(total, -500, 500))), 0.0)))

    return arrow_map(docs, work, with_fields(docs, f"{out} double"))
