"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, learned by
expectation-maximisation over all segmentations of sample words. A word's probability in a
language is the sum over all its segmentations, by the forward algorithm; a text's
is the product over its words, a word being a run of letters and the marks on them, lower-cased (one longer
than ``LONGEST`` is scored in parts). Only these count, so a text without a letter is
``und`` with score 0; so is a null one. Equal scores go to the alphabetically first language. Rows that repeat get the same
language, very long texts are worked on whole, an empty table gives an empty table, and without any labelled text every text is ``und``.
Columns named as the results are replaced; others may have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Memo, arrow_map, slices, sums, with_fields
from larkspur.llm.pieces import SPACE, Lattice, vocabulary

LONGEST = 40
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONGEST - 1))
#: Labelled texts that are learned from, in all, and rounds of expectation-maximisation.
SAMPLE, ROUNDS = 800, 3
#: The least number of texts to draw of a language, where it has so many.
LEAST = 16
#: Added to each piece's expected count, and the odds of a byte that stands for an unlisted character.
SMOOTH, BYTE = 0.05, 1e-4


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def levels(lattice: Lattice, nodes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The edges' order by the place of ``nodes`` in their words, and each place's range in it."""
    word = np.searchsorted(lattice.first, nodes, "right") - 1
    place = nodes - lattice.first[word]
    place = place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place  # sorted by counting if narrow
    order = np.argsort(place, kind="stable") if (nodes[1:] >= nodes[:-1]).all() else np.lexsort((nodes, place))
    cuts = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0, True]) if len(order) else np.zeros(1, int)
    return order, list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def sweep(lattice: Lattice, weight: np.ndarray, forward: bool) -> np.ndarray:
    """Sums over all paths from a word's start (forward) or to its end, per node and column of ``weight``."""
    here, there = (lattice.target, lattice.source) if forward else (lattice.source, lattice.target)
    value = np.zeros((int(lattice.length.sum()) + len(lattice.length), weight.shape[1]))
    value[lattice.first if forward else lattice.first + lattice.length] = 1
    order, ranges = levels(lattice, here)
    for a, b in ranges if forward else reversed(ranges):
        edges = order[a:b]
        nodes = here[edges]
        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        value[nodes[starts]] += np.add.reduceat(weight[edges] * value[there[edges]], starts, axis=0)
    return value


def edge_weights(lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """probability: [pieces, languages]."""
    out = probability[np.maximum(lattice.piece, 0)]
    bare = lattice.piece < 0
    out[bare] = (BYTE ** -lattice.piece[bare].astype(float))[:, None]
    return out


def learn(vocab, counts: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """(languages, [pieces, languages] probabilities) from the words' counts by language."""
    languages = sorted(counts)
    probability = np.zeros((vocab.size, len(languages)))
    for k, language in enumerate(languages):
        words = sorted(counts[language])
        times = np.array([counts[language][w] for w in words], float)
        lattice = vocab.lattice([SPACE + w for w in words])
        owner = np.searchsorted(lattice.first, lattice.source, "right") - 1
        p = np.zeros((vocab.size, 1))
        p[vocab.plain] = 1 / len(vocab.plain)
        inside = lattice.piece >= 0
        for _ in range(ROUNDS):
            w = edge_weights(lattice, p)
            alpha, beta = sweep(lattice, w, True), sweep(lattice, w, False)
            share = alpha[lattice.source] * w * beta[lattice.target] / beta[lattice.first][owner]
            got = np.bincount(lattice.piece[inside], (share[:, 0] * times[owner])[inside], vocab.size)
            p[:] = 0
            p[vocab.plain, 0] = (got[vocab.plain] + SMOOTH) / (got.sum() + SMOOTH * len(vocab.plain))
        probability[:, k] = p[:, 0]
    return languages, probability


class Scorer:
    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.vocab, self.languages, self.probability = vocabulary(path), languages, probability
        self.memo = Memo(lambda words: (self.word_scores(words),))

    def word_scores(self, words: list[str]) -> np.ndarray:
        lattice = self.vocab.lattice([SPACE + w for w in words])
        return np.log(np.maximum(sweep(lattice, edge_weights(lattice, self.probability), True)[lattice.first + lattice.length], 1e-300))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods [texts, languages], words)."""
        totals, numbers = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            words = [words_of(t) for t in texts[a:b]]
            n = np.fromiter(map(len, words), np.int64, len(words))
            codes = self.memo.codes([w for ws in words for w in ws])
            (known,) = self.memo.arrays()
            totals.append(sums(known[codes].reshape(-1, len(self.languages)), n))
            numbers.append(n)
        return np.concatenate(totals), np.concatenate(numbers)


@lru_cache(2)
def scorer(path: str, languages: tuple[str, ...], raw: bytes) -> Scorer:
    return Scorer(path, list(languages), np.frombuffer(raw).reshape(-1, len(languages)))


def fit(docs: DataFrame, path: str, learn_from: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Learns from about ``sample`` of the rows that ``learn_from`` marks and that have text and language.

    The sample is drawn per language, an equal number of each or all that there are, so that none is missed; of very many
    languages ``LEAST`` rows each make it larger.
    """
    labelled = docs.filter(learn_from & F.col(text).isNotNull() & F.col(lang).isNotNull())
    numbers = labelled.groupBy(F.col(lang).alias("__lang")).count().collect()
    each = max(LEAST, sample // max(1, len(numbers)))
    below = docs.sparkSession.createDataFrame([(r[0], int(min(1.0, each / r[1]) * (1 << 40))) for r in numbers], "__lang string, __below long")
    drawn = F.pmod(F.xxhash64(key, lang, text), F.lit(1 << 40)) < F.col("__below")
    chosen = labelled.join(F.broadcast(below), F.col(lang) == F.col("__lang")).filter(drawn)

    def count(batch: pa.RecordBatch):
        for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(t)
            yield pa.RecordBatch.from_pydict({"lang": [language] * len(words), "word": words}, pa.schema([("lang", pa.string()), ("word", pa.string())]))

    found = arrow_map(chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")), count, "lang string, word string").groupBy("lang", "word").count().toArrow()
    counts: dict[str, dict[str, int]] = {}
    for language, word, n in zip(*(found.column(i).to_pylist() for i in range(3))):
        counts.setdefault(language, {})[word] = n
    return learn(vocabulary(path), counts)


def identify(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the most likely language and its posterior probability; columns of these names are replaced."""
    docs = docs.drop(lang, score)
    languages, probability = tuple(model[0]), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(probability.tobytes())

    def work(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        if languages:
            total, n = scorer(path, languages, shared.value).scores(texts)
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        else:
            n, best, share = np.zeros(len(texts), int), [], []
        names = [languages[k] if m else "und" for k, m in zip(best, n)] if languages else ["und"] * len(texts)
        yield batch.append_column(lang, pa.array(names, pa.string())).append_column(score, pa.array(np.where(n > 0, share, 0.0) if languages else np.zeros(len(texts))))

    return arrow_map(docs, work, with_fields(docs, f"{lang} string, {score} double"))
