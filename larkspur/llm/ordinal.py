"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - w . x) with one weight vector over hashed features of
the text and ordered thresholds, the first one free and the steps between them powers of e. Both are fitted by Adam
to the likelihood of the grades, P(grade = j) = P(grade <= j) - P(grade <= j - 1), on a bounded sample of graded rows.
Features are the shares of a text's tokens that hash to each slot: the tokens themselves
(space-separated), their shapes, bigrams of shapes, and marks for a token that repeats the one before.

A null or empty text has no tokens and is scored by the thresholds alone. Rows that repeat score alike. Very long texts are worked on whole.
An empty table gives an empty table; without any graded row every expected grade is 0. Columns named as the results are replaced; others may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import about, arrow_map, one_text, slices, with_fields
from larkspur.llm.hashed import Words, pair, slots, word_hashes

BITS = 18
#: Graded rows that are learned from, passes over them, rows to a step.
SAMPLE, PASSES, STEP = 4_000, 12, 128
RATE, L2 = 0.05, 1e-4
#: Shares of tokens are stretched by this, so that a feature of every second token counts as about 1.
STRETCH = 4.0

_words: list[Words] = []
RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "Xx" if m.group()[0].isupper() else "x"), (re.compile(r"\d+"), lambda m: "9"), (re.compile(r"([^\w\s])\1+"), lambda m: m.group(1) + "+")]


def shape(word: str) -> str:
    for pattern, put in RUNS:
        word = pattern.sub(put, word)
    return word[:12]


def shapes(words: list[str]) -> tuple[np.ndarray]:
    return (word_hashes(["\0" + shape(w) for w in words]),)


def features(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(tokens per text, [(text number, slot)] by kind of feature)."""
    if not _words:
        _words.append(Words(shapes))
    split = [t.split() if t else [] for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    owner, hashes, kinds = _words[0].of(split)
    same = owner[1:] == owner[:-1]
    marks = np.where(hashes[1:] == hashes[:-1], np.uint64(11), np.uint64(12))
    parts = [(owner, hashes), (owner, kinds), (owner[1:][same], pair(kinds[:-1], kinds[1:], 1)[same]), (owner[1:][same], marks[same])]
    return n, [(o, slots(h, BITS)) for o, h in parts]


def likelihood(value: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-log P(grade), its slope by ``value``, its slopes by ``cuts``) for each row."""
    bounds = np.clip(np.r_[-np.inf, cuts, np.inf][None, :] - value[:, None], -40, 40)
    rows = np.arange(len(value))
    upto = 1 / (1 + np.exp(-bounds))
    upto[:, 0], upto[:, -1] = 0.0, 1.0
    low, high = upto[rows, grade], upto[rows, grade + 1]
    chance = np.maximum(high - low, 1e-15)
    slopes = np.zeros((len(value), len(cuts) + 2))
    slopes[rows, grade + 1] -= high * (1 - high) / chance
    slopes[rows, grade] += low * (1 - low) / chance
    return -np.log(chance), 1 - low - high, slopes[:, 1:-1]


def cuts_of(steps: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the steps between them."""
    return np.cumsum(np.r_[steps[:1], np.exp(steps[1:])])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from (slots, values, grade 0 .. grades - 1)."""
    w, steps = np.zeros(1 << BITS), np.zeros(max(0, grades - 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    mc, vc = np.zeros_like(steps), np.zeros_like(steps)
    order = np.random.default_rng(0)
    for _ in range(PASSES if examples and grades > 1 else 0):
        rows = order.permutation(len(examples))
        for i in range(0, len(rows), STEP):
            part = [examples[r] for r in rows[i : i + STEP]]
            n = np.array([len(p[0]) for p in part])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            owner = np.repeat(np.arange(len(part)), n)
            _, by_value, by_cut = likelihood(np.bincount(owner, w[at] * x, len(part)), cuts_of(steps), np.array([p[2] for p in part]))
            used, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, by_value[owner] * x, len(used)) / len(part) + L2 * w[used]
            m[used], v[used] = 0.9 * m[used] + 0.1 * g, 0.99 * v[used] + 0.01 * g * g
            w[used] -= RATE * m[used] / (np.sqrt(v[used]) + 1e-6)
            # a step moves its own threshold and all above
            gc = np.cumsum(by_cut.mean(0)[::-1])[::-1] * np.r_[1.0, np.exp(steps[1:])]
            mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
            steps = steps - RATE * mc / (np.sqrt(vc) + 1e-6)
    return w, cuts_of(steps)


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "grade", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, learn_from: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Learns from about ``sample`` graded keys; of a key's several grades the highest, nulls apart, and of its several texts one."""
    graded = ratings if learn_from is None else ratings.filter(learn_from)
    graded = graded.filter(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(grade).cast("int").alias("grade"))
    rows = one_text(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(about(graded, sample, "key")), "key"), "grade")

    def work(batch: pa.RecordBatch):
        texts, grades, keys = batch.column(1).to_pylist(), batch.column(2), batch.column(0)
        for a, b in slices(texts):
            n, parts = features(texts[a:b])
            both = np.concatenate([o << BITS | s for o, s in parts])
            key, count = np.unique(both, return_counts=True)
            owner = key >> BITS
            ends = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
            share = (STRETCH * count / n[owner]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), grades.slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array((key & ((1 << BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(share))], ["key", "grade", "slots", "share"])

    schema = with_fields(rows.select("key", "grade"), "slots array<int>, share array<float>")
    found = arrow_map(rows, work, schema).toArrow().sort_by("key")
    grades = found["grade"].to_pylist()
    as_arrays = [found[c].combine_chunks() for c in ("slots", "share")] if len(grades) else []
    examples = [(as_arrays[0][i].values.to_numpy(), as_arrays[1][i].values.to_numpy(), g) for i, g in enumerate(grades)]
    return train(examples, max(grades, default=0) + 1)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", expected: str = "expected_grade", tail: str = "tail_probability", at_least: int = 1) -> DataFrame:
    """``docs`` with the expected grade and P(grade >= at_least); columns of these names are replaced."""
    docs = docs.drop(expected, tail)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def work(batch: pa.RecordBatch):
        w, cuts = shared.value
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        value = np.zeros(len(texts))
        for a, b in slices(texts):
            n, parts = features(texts[a:b])
            total = sum(np.bincount(o, w[s], b - a) for o, s in parts)
            value[a:b] = STRETCH * total / np.maximum(n, 1)
        above = 1 / (1 + np.exp(-np.clip(value[:, None] - cuts, -500, 500)))
        chance = np.ones(len(texts)) if at_least <= 0 else above[:, at_least - 1] if at_least <= len(cuts) else np.zeros(len(texts))
        yield batch.append_column(expected, pa.array(above.sum(1))).append_column(tail, pa.array(chance))

    return arrow_map(docs, work, with_fields(docs, f"{expected} double, {tail} double"))
