"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The test items are indexed; each training text is cut into overlapping passages of words, each of
which is a query. A posting's impact is its BM25 contribution as a share of what its item scores
against itself, so that one threshold serves items of any length. Block-max WAND walks the
postings in item order and skips blocks of items whose best impacts, added up over the passage's terms, can't
reach the threshold; only blocks of terms that are needed to reach it are looked at, as the others, which are the frequent ones, can't without them.
All items above it are retrieved, none are cut off by rank. What it retrieves is verified word by word: at least
``OVERLAP`` of the item's five-word shingles stand in the passage, and at least ``PART`` of the words of
its question (all but the last sentence) and of its answer (the last sentence) do.

Passages are long enough, and overlap by enough, that an item that a text quotes lies in
one of them. Items without words match nothing, and so do null and empty texts. Repeated rows are each reported;
of equal passages of a text the first is. Very long texts are worked on whole, and empty tables give no row. Only keys and texts are read; further
columns may have any name, and a result named as the key is called ``found_`` and its name.

Items are dealt by length, as they set the length of passages, and into parts of about ``ITEMS`` items and ``CHARS`` characters, each with an index of
its own, so that what is broadcast is bounded. Document frequencies and the mean length are those of all items, so that
what is found does not depend on the parts.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_map, durable, ragged, slices, with_fields

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: BM25's k1 and b, the items in a block, the share of an item's own score that is retrieved.
K1, B, BLOCK, THRESHOLD = 1.2, 0.75, 4, 0.6
SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
#: Items and characters of a part, and the words up to which items are dealt together: the first bound, and by how much each next one is larger.
ITEMS, CHARS, SHORT, LONGER = 20_000, 16_000_000, 256, 4
#: Texts are searched together up to about so many characters.
SLICE = 200_000
#: A passage has at least so many words.
PASSAGE = 96


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Index:
    """Items of a part. ``usual``: (number of items, their mean words, items by word) of all parts; without it, of these items."""

    def __init__(self, items: list[tuple[int, str | None]], usual: tuple[int, float, dict[str, int]] | None = None):
        rows = [(i, t, words_of(t)) for i, t in items]
        rows = sorted(((i, t, w) for i, t, w in rows if w), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.keys = [r[0] for r in rows]
        self.terms: dict[str, int] = {}
        found: dict[int, list[tuple[int, int]]] = {}
        sequences = []
        for n, (_, _, words) in enumerate(rows):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words]
            sequences.append(ids)
            for t, times in Counter(ids).items():
                found.setdefault(t, []).append((n, times))
        number, mean, items_of = usual or (len(rows), sum(map(len, sequences)) / max(1, len(rows)), {w: len(found[t]) for w, t in self.terms.items()})
        own = np.zeros(len(rows))
        raw = {}
        for word, t in self.terms.items():
            postings, n_items = found[t], items_of[word]
            idf = math.log(1 + (number - n_items + 0.5) / (n_items + 0.5))
            raw[t] = [(n, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(sequences[n]) / mean))) for n, f in postings]
            for n, x in raw[t]:
                own[n] += x
        #: By term: items and impacts, and the term's highest.
        self.items, self.impact = [], []
        blocks, highest, counts = [], [], []
        self.top = np.zeros(len(self.terms) + 1)  # the last is for words in no item
        for t in range(len(self.terms)):
            at, value = [n for n, _ in raw[t]], [x / own[n] for n, x in raw[t]]
            self.items.append(at)
            self.impact.append(value)
            best: dict[int, float] = {}
            for n, x in zip(at, value):
                best[n // BLOCK] = max(best.get(n // BLOCK, 0.0), x)
            blocks += best
            highest += best.values()
            counts.append(len(best))
            self.top[t] = max(value)
        #: Blocks are ranges of BLOCK items; by term, end to end, those that it occurs in with its highest impact there.
        self.blocks, self.highest = np.array(blocks, np.int64), np.array(highest, float)
        self.block_count = np.array([*counts, 0], np.int64)
        self.block_at = np.cumsum(self.block_count) - self.block_count
        self.n_blocks = -(-len(rows) // BLOCK)
        #: Terms and blocks as one number, in order.
        self.places = np.repeat(np.arange(len(self.block_count)), self.block_count) * self.n_blocks + self.blocks
        longest = max(map(len, sequences), default=1)
        self.width = max(PASSAGE, 3 * longest)
        self.step = self.width - longest - longest // 4  # an item may have grown by a quarter
        self.shingles = [self.shingles_of(s) for s in sequences]
        self.parts = []
        for _, text, words in rows:
            sentences = [s for s in (words_of(x) for x in SENTENCE.split(text)) if s]
            answer = sentences[-1] if len(sentences) > 1 else words
            question = [w for s in sentences[:-1] for w in s] or words
            self.parts.append((frozenset(self.terms[w] for w in question), frozenset(self.terms[w] for w in answer)))

    @staticmethod
    def shingles_of(ids: list[int]) -> frozenset:
        n = min(SHINGLE, len(ids))
        return frozenset(zip(*(ids[i:] for i in range(n))))

    def reachable(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> list[list[int]]:
        """For each passage the blocks whose highest impacts, over its distinct terms, add up to the threshold.

        ``passage`` rises. All passages of a text are worked on at once.
        """
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        top = np.cumsum(self.top[term])
        first = np.searchsorted(passage, np.arange(passages + 1))
        below = np.r_[0.0, top][first[:-1]]
        # without the terms from here on, a passage's terms don't reach the threshold
        needed = top - below[passage] >= threshold - 1e-9
        n = self.block_count[term[needed]]
        at = ragged(self.block_at[term[needed]], n)
        place = np.repeat(passage[needed], n) * self.n_blocks + self.blocks[at]
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        bound = np.add.reduceat(self.highest[at[order]], starts) if len(place) else np.zeros(0)
        place = place[starts]
        owner, block = place // max(1, self.n_blocks), place % max(1, self.n_blocks)
        # what the other terms can add to each of these blocks at most, then what they do
        others = np.bincount(passage[~needed], self.top[term[~needed]], passages)
        may = bound + others[owner] >= threshold - 1e-9
        owner, block, bound = owner[may], block[may], bound[may]
        n_others = np.bincount(passage[~needed], minlength=passages)
        begins = np.cumsum(n_others) - n_others
        pick = ragged(begins[owner], n_others[owner])
        wanted = term[~needed][pick] * self.n_blocks + np.repeat(block, n_others[owner])
        found = np.minimum(np.searchsorted(self.places, wanted), max(0, len(self.places) - 1))
        if len(wanted):
            added = np.where(self.places[found] == wanted, self.highest[found], 0.0)
            bound = bound + np.bincount(np.repeat(np.arange(len(owner)), n_others[owner]), added, len(owner))
        hit = bound >= threshold - 1e-9
        return [x.tolist() for x in np.split(block[hit], np.searchsorted(owner[hit], np.arange(1, passages)))]

    def search(self, terms: list[int], threshold: float = THRESHOLD, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct ``terms`` score at ``threshold`` or above."""
        slack = threshold - 1e-9
        if blocks is None:
            blocks = self.reachable(np.zeros(len(terms), np.int64), np.array(terms, np.int64), 1, threshold)[0]
        out: list[tuple[int, float]] = []
        if not blocks:
            return out
        # item, place, term; from the first block that can reach the threshold on
        cursors = self.moved([[-1, 0, t] for t in terms], blocks[0] * BLOCK)
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.top[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            ahead = bisect.bisect_left(blocks, item // BLOCK)
            if ahead == len(blocks):
                break
            if blocks[ahead] != item // BLOCK:
                # no item before the next such block can reach the threshold
                target = blocks[ahead] * BLOCK
            elif cursors[0][0] == item:
                score = 0.0
                for own, place, t in cursors:
                    if own != item:
                        break
                    score += self.impact[t][place]
                if score >= slack:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            cursors = self.moved(cursors, target)
        return out

    def moved(self, cursors: list[list[int]], target: int) -> list[list[int]]:
        """The cursors at their first items from ``target`` on; those that have none are gone."""
        out = []
        for own, place, t in cursors:
            if own < target:
                place = bisect.bisect_left(self.items[t], target, place)
                if place == len(self.items[t]):
                    continue
                own = self.items[t][place]
            out.append([own, place, t])
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item key, passage's first word, score, overlap, question's and answer's overlap), best passage of each item."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple]]:
        """``matches`` for each text; their passages are searched together."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.keys:
            return out
        none = len(self.terms)
        ids = [[self.terms.get(w, none) for w in words_of(t)] for t in texts]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        sequence = np.fromiter((i for own in ids for i in own), np.int64, int(length.sum()))
        number = np.where(length > 0, np.maximum(1, -(-(length - (self.width - self.step)) // self.step)), 0)
        owner = np.repeat(np.arange(len(texts)), number)
        begins = ragged(np.zeros(len(texts), np.int64), number) * self.step
        sizes = np.minimum(begins + self.width, length[owner]) - begins
        starts = (np.cumsum(length) - length)[owner] + begins
        both = np.repeat(np.arange(len(begins)), sizes) * (none + 1) + sequence[ragged(starts, sizes)]
        both.sort()
        pairs = both[np.flatnonzero(np.diff(both, prepend=-1))]
        best: dict[tuple[int, int], tuple] = {}
        for p, blocks in enumerate(self.reachable(pairs // (none + 1), pairs % (none + 1), len(begins), THRESHOLD)):
            if not blocks:
                continue
            of, begin = int(owner[p]), int(begins[p])
            part = ids[of][begin : begin + self.width]
            terms = set(part)
            terms.discard(none)
            grams: dict[int, frozenset] = {}
            for item, score in self.search(sorted(terms), THRESHOLD, blocks):
                own = self.shingles[item]
                size = len(next(iter(own)))
                if size not in grams:
                    grams[size] = frozenset(zip(*(part[i:] for i in range(size))))
                overlap = len(own & grams[size]) / len(own)
                question, answer = (len(p & terms) / len(p) for p in self.parts[item])
                if overlap >= OVERLAP and question >= PART and answer >= PART and ((of, item) not in best or overlap > best[of, item][3]):
                    best[of, item] = self.keys[item], begin, score, overlap, question, answer
        for (of, _), found in best.items():
            out[of].append(found)
        return out


FOUND = "item_id long, passage long, bm25 double, overlap double, question_overlap double, answer_overlap double"


def length_class(words: int) -> int:
    """0 up to ``SHORT`` words, and one more for each ``LONGER`` times as many."""
    found, most = 0, SHORT
    while words > most:
        found, most = found + 1, most * LONGER
    return found


def indexes(items: DataFrame, key: str, text: str) -> list[Index]:
    """The indexes of all parts."""
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def count(batch: pa.RecordBatch):
        split = [words_of(t) for t in batch.column(1).to_pylist()]
        sizes = pa.array([len(w) for w in split], pa.int64())
        kinds = pa.array([length_class(len(w)) for w in split], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, sizes, kinds], ["key", "text", "words", "kind"])

    def distinct(batch: pa.RecordBatch):
        found = [(k, p, w) for k, p, t in zip(*(c.to_pylist() for c in batch.columns)) for w in set(words_of(t))]
        kind, part, word = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), pa.array(word, pa.string())], ["kind", "part", "word"])

    counted = durable(arrow_map(rows, count, "key long, text string, words long, kind int").filter("words > 0"))
    kinds = counted.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.sum("words").alias("words")).orderBy("kind").collect()
    if not kinds:
        return []
    number = sum(r.n for r in kinds)
    mean = sum(r.words for r in kinds) / number
    parts = {r.kind: max(-(-r.n // ITEMS), -(-r.chars // CHARS)) for r in kinds}
    if sum(parts.values()) == 1:
        return [Index([tuple(r) for r in counted.select("key", "text").collect()])]
    share = F.pmod(F.xxhash64("key", "text"), F.element_at(F.create_map(*(F.lit(x).cast("int") if i % 2 == 0 else F.lit(x) for kv in parts.items() for i, x in enumerate(kv))), F.col("kind")))
    dealt = counted.withColumn("part", share)
    words = durable(arrow_map(dealt.select("kind", "part", "text"), distinct, "kind int, part long, word string"))
    total = durable(words.groupBy("word").count())
    out = []
    for kind, n in parts.items():
        for part in range(n):
            mine = (F.col("kind") == kind) & (F.col("part") == part)
            items_of = {r.word: r["count"] for r in words.filter(mine).select("word").distinct().join(total, "word").collect()}
            out.append(Index([tuple(r) for r in dealt.filter(mine).select("key", "text").collect()], (number, mean, items_of)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, FOUND): one row for each row of ``docs`` and item that it quotes."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    names = [f"found_{n}" if n.lower() == key.lower() else n for n in (f.split()[0] for f in FOUND.split(", "))]
    schema = with_fields(rows.select(key), ", ".join(f"{n} {f.split()[1]}" for n, f in zip(names, FOUND.split(", "))))
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared):
            at, found, texts = [], [], batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE):
                for i, got in enumerate(shared.value.matches_of(texts[a:b])):
                    at += [a + i] * len(got)
                    found += got
            columns = [pa.array([f[c] for f in found], pa.int64() if c < 2 else pa.float64()) for c in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema.names)

        out = out.union(arrow_map(rows, work, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that quote no item."""
    spark = docs.sparkSession
    for index in indexes(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            clean = [not got for a, b in slices(texts, SLICE) for got in shared.value.matches_of(texts[a:b])]
            yield batch.filter(pa.array(clean, pa.bool_()))

        docs = arrow_map(docs, work, docs.schema)
    return docs
