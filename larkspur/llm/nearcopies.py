"""Near copies: texts whose sets of word shingles have a Jaccard similarity of a given value at least.

Candidates come from SimHash fingerprints and the vantage-point trees of ``simhash``; every candidate is verified on the whole sets.
At a similarity of 0.8 the fingerprints of whole texts differ in 10 of 64 bits, give or take 3, where triangle
bounds prune nothing. So a text has several fingerprints: that of all its shingles, and ``SAMPLES`` more, each of the
``SAMPLED`` shingles that are least in an order of its own. Texts of similarity s share each of these with a probability of about
s to the power ``SAMPLED``: at 0.8 all of them miss a pair in 1 of 300 cases, at 0.9 in 1 of 30,000. All fingerprints go through the trees
together, and those that differ in ``RADIUS`` bits or fewer, and by links of such, make a group.

Texts of equal sets are one node. In a group, nodes are compared with one of them, which differs from round to round, and
nodes that are joined need no more links; after the rounds each node that isn't of a group's largest component is compared with
all others. In groups of over ``WIDE`` nodes only with those that share a shingle which is rare enough: if shingles are put in an order, rare ones first, sets that
have ``least_common`` shingles in common have the first of them at places from which on both have as many left. So no link is lost, and a copy
with changes of its own in more than about a ninth of its shingles meets no other copy. Pairs whose sizes rule the similarity out, or whose sketches do, aren't verified: a sketch is a bit of the least shingle in each of ``BITS``
orders, and at a similarity s it differs in (1 - s) / 2 of them, so that at 0.8 more than ``FARTHEST`` differ in 1 pair of 5,000, and at 0.7 in 14 of 15.
No pair is left out for the size of a group.

A text of fewer words than a shingle is a shingle of its own; texts without words are equal, and a null text counts as empty.
An empty table gives an empty table. Columns may have any name. Very long texts are worked on whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.common import arrow_map, fresh, let_go, mix, stored

WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of samples, the shingles in each, and the bits that linked fingerprints differ in at most.
SAMPLES, SAMPLED, RADIUS = 8, 3, 2
#: The bits of a sketch, and those that the sketches of a pair differ in at most.
BITS, FARTHEST = 1024, 136
SKETCH = [f"s{i}" for i in range(BITS // 64)]
#: Rounds of comparing a group's nodes with one of them before others are compared.
STARS = 3
#: Groups of more nodes are compared by rare shingles after the rounds; sizes that differ by less than this factor are a class there.
WIDE, CLASS = 64, 1.05
#: How often shingles occur is counted by so many leading bits of their hashes.
PLACE_BITS = 20
PLACE_SHIFT = np.uint64(64 - PLACE_BITS)
#: Nodes up to this number are broadcast to pick their texts; beyond it they are joined.
BROADCAST_MOST = 1_000_000
#: Texts that a Python worker holds the shingles of at once.
SLICE = 256
#: Factors that put shingles in orders of their own; odd, so that none fall together.
ORDERS = mix(np.arange(1, SAMPLES + 1).astype(np.uint64)) | np.uint64(1)
SKETCH_ORDERS = mix(np.arange(1, BITS + 1).astype(np.uint64) + np.uint64(1 << 20)) | np.uint64(1)


@lru_cache(64)
def known(text: str | None, words: int) -> np.ndarray:
    return np.unique(simhash.shingles(text, words))


def fingerprints(every: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The fingerprints of all shingles, repeats included, and of the samples of the distinct ones."""
    if len(distinct) <= SAMPLED:
        samples = np.full(SAMPLES, simhash.majority(distinct), np.uint64)
    else:
        least = np.stack([distinct[np.argpartition(distinct * order, SAMPLED - 1)[:SAMPLED]] for order in ORDERS])
        bits = np.unpackbits(least.astype(">u8").view(np.uint8).reshape(SAMPLES, SAMPLED, 8), axis=2).sum(1)
        samples = np.packbits(2 * bits > SAMPLED, axis=1).view(">u8").astype(np.uint64).ravel()
    return np.r_[np.uint64(simhash.majority(every)), samples]


def sketch(distinct: np.ndarray) -> np.ndarray:
    """A bit of the least shingle in each order, as 64-bit values."""
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 512):
        least = np.minimum(least, (distinct[i : i + 512, None] * SKETCH_ORDERS).min(0))
    # the order's inverse would give the shingle; a bit of a hash of the product does as well, being the same for the same shingle
    return np.packbits((mix(least) >> np.uint64(32)).astype(np.uint8) & 1).view("<u8").astype(np.uint64)


def least_common(a: int, b: int, similarity: float) -> int:
    """The least number of common elements of sets of ``a`` and ``b`` elements that are so similar."""
    return math.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)


def nodes(rows: DataFrame, words: int) -> DataFrame:
    """(set, n, prints, sketch, first): each distinct set of shingles, its size, fingerprints and sketch, and the first row that has it."""

    def work(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, SLICE):
            yield made(batch.slice(i, SLICE))

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, size, prints, sketches = [], [], [], []
        for text in batch.columns[-1]:
            every = simhash.shingles(text.as_py(), words)
            found = np.unique(every)
            digest.append(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))
            size.append(len(found))
            prints.append(fingerprints(every, found))
            sketches.append(sketch(found))
        flat = np.concatenate([np.zeros(0, np.uint64), *prints]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SAMPLES + 1, dtype=np.int32)), pa.array(flat))
        bits = np.stack([np.zeros(len(SKETCH), np.uint64), *sketches])[1:].view(np.int64)
        columns = [pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(np.array(size, np.int32)), lists, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(SKETCH)))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "set", "n", "prints", *SKETCH])

    kind = rows.schema["key"].dataType.simpleString()
    marked = arrow_map(rows.select("key", "a", "b", "text"), work, f"key {kind}, a long, b long, set long, n int, prints array<long>, {', '.join(f'{c} long' for c in SKETCH)}")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "a", "b")).alias("first")
    found = marked.groupBy("set").agg(first, F.first("n").alias("n"), F.min_by("prints", F.struct("a", "b")).alias("prints"), *(F.first(c).alias(c) for c in SKETCH))
    return stored(found.select("set", "n", F.array_distinct("prints").alias("prints"), *SKETCH, "first"))


def may_be(similarity: float, x: str, y: str) -> Column:
    """Whether sets of these sizes, of which ``rest`` elements at most are common, and of these sketches are to be verified."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    enough = F.least(f"{x}rest", f"{y}rest") >= F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)
    differ = sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in SKETCH), F.lit(0))
    return enough & (differ <= FARTHEST)


def texts_of(sets: DataFrame, points: DataFrame, rows: DataFrame) -> DataFrame:
    """(set, text): a text of each of the sets."""
    marks = sets.join(points.select("set", F.col("first.a").alias("ra"), F.col("first.b").alias("rb")), "set")
    small = sets.count() <= BROADCAST_MOST
    texts = rows.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "text").join(F.broadcast(marks) if small else marks, ["ra", "rb"])
    return stored(texts.groupBy("set").agg(F.first("text").alias("text")))


def by_rare(sets: DataFrame, points: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(h, set, rest): the groups in which pairs of the sets meet that may be as similar, by a shared shingle and the classes of both sizes.

    ``rest`` is how many of a set's shingles come no earlier than the shared one, in the order of how many sets have them; shingles whose hashes
    begin alike are counted together, so that the counts are of a bounded number. Shingles of one set alone aren't dealt.
    """
    texts = texts_of(sets, points, rows)

    def count(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, SLICE):
            found = [np.unique(simhash.shingles(text.as_py(), words)) for text in batch.slice(i, SLICE).columns[0]]
            place, n = np.unique(np.concatenate(found) >> PLACE_SHIFT, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(n)], ["place", "n"])

    found = arrow_map(texts.select("text"), count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << PLACE_BITS, np.int64)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    shared = points.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))

    def place(batch: pa.RecordBatch):
        own, size, elements, rests = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.columns[1]):
            found = np.unique(simhash.shingles(text.as_py(), words))
            often = shared.value[found >> PLACE_SHIFT]
            first = np.lexsort((found, often))[: int((1 - similarity) * len(found) + 1e-6) + 1]
            dealt = np.flatnonzero(often[first] > 1)
            own.append(np.full(len(dealt), key, np.int64))
            size.append(np.full(len(dealt), len(found), np.int32))
            elements.append(found[first[dealt]].view(np.int64))
            rests.append((len(found) - dealt).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, size, elements, rests)], ["set", "n", "e", "rest"])

    placed = arrow_map(texts.select("set", "text"), place, "set long, n int, e long, rest int")
    # partners are of similarity * n elements at least, and of as many at most as leave enough in common from here on
    kind = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log(CLASS)).cast("int")
    fewest, most = similarity * F.col("n") - 1e-6, F.least(F.col("n") / similarity, F.col("rest") * ((1 + similarity) / similarity) - F.col("n")) + 1e-6
    met = placed.filter(most >= fewest).select("set", "rest", "e", kind(F.col("n")).alias("own"), F.explode(F.sequence(kind(fewest), kind(most))).alias("other"))
    return met.select(F.xxhash64("e", F.least("own", "other"), F.greatest("own", "other")).alias("h"), "set", "rest")


def verified(pairs: DataFrame, points: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose similarity is as asked."""
    texts = texts_of(stored(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()), points, rows)

    def work(batch: pa.RecordBatch):
        found = []
        for i in range(batch.num_rows):
            s, t = (known(c[i].as_py(), words) for c in batch.columns[2:])
            if len(np.intersect1d(s, t, assume_unique=True)) >= least_common(len(s), len(t), similarity):
                found.append(i)
        yield batch.select(["a", "b"]).take(pa.array(found, pa.int64()))

    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
    return stored(arrow_map(both.select("a", "b", "x", "y"), work, "a long, b long"))


def links(points: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): for each set that is linked, the least of its component.

    Steps are stored as tables, not checkpoints: a checkpoint hands on its estimated size, which joins multiply from round to round.
    """
    spark = points.sparkSession
    prints = points.select("set", F.explode("prints").alias("fp"))
    near = simhash.roots(simhash.links(stored(prints.select("fp").distinct()), RADIUS))
    dealt = stored(prints.join(near.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.coalesce("root", "fp").alias("h"), "set").distinct())
    shared = dealt.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1").select("h")
    known_of = ("set", "n", "rest", *SKETCH)
    let_go(spark)
    groups = stored(dealt.join(shared, "h").join(points.select("set", "n", F.col("n").alias("rest"), *SKETCH), "set"))
    edges, tried, tied, all_narrow = None, None, spark.createDataFrame([], "node long, root long"), False
    rooted = lambda x: x.join(tied.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    for turn in range(2 * STARS + 1):
        if turn == STARS:
            at = stored(rooted(groups))
            mixed = stored(at.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low < high").select("h", "size"))
            groups = groups.join(mixed.filter(F.col("size") <= WIDE).select("h"), "h")
            wide = stored(at.join(mixed.filter(F.col("size") > WIDE).select("h"), "h").select("set").distinct())
            if not (all_narrow := wide.isEmpty()):
                groups = groups.unionByName(by_rare(wide, points, rows, words, similarity).join(points.select("set", "n", *SKETCH), "set"))
            groups = stored(groups)
            let_go(spark)
        if STARS <= turn < 2 * STARS and all_narrow:
            continue
        at = stored(rooted(groups))
        if turn < 2 * STARS:
            # at first any node; where rare shingles tell, one with few changes of its own
            by = F.struct(F.lit(0) if turn < STARS else -F.col("rest"), F.xxhash64("set", F.lit(turn)))
            one = F.min(F.struct(by.alias("by"), *known_of, "root")).alias("o")
            open_ = at.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), one).filter("low < high")
            met = at.join(open_.select("h", *(F.col(f"o.{c}").alias(f"o_{c}") for c in (*known_of, "root"))), "h").filter("root <> o_root")
        else:
            # a group's nodes outside its largest component, each with all nodes of other components
            parts = stored(at.groupBy("h", "root").agg(F.count("*").alias("size")))
            largest = parts.groupBy("h").agg(F.max(F.struct("size", "root"))["root"].alias("most"), F.count("*").alias("parts")).filter("parts > 1").select("h", "most")
            other = at.join(largest, "h").filter("root <> most").select("h", "most", *(F.col(c).alias(f"o_{c}") for c in (*known_of, "root")))
            met = at.join(other, "h").filter("root <> o_root AND (root = most OR set < o_set)")
        pairs = met.filter(may_be(similarity, "", "o_")).select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        let_go(spark)
        found = verified(pairs, points, rows, words, similarity)
        edges = found if edges is None else edges.union(found)
        tied = stored(simhash.roots(edges))
        let_go(spark)
    return tied


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near copies: that with the least key (nulls last), then the least text hash.

    Of rows that repeat with key and text one stays. Rows are known by 128 bits of hashes of key and text.
    """
    marks = dict(zip(fresh(docs, "a", "b"), (F.xxhash64(key, text), F.xxhash64(text, key, F.lit(1)))))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(c.alias(n) for n, c in zip("ab", marks.values())))
    points = nodes(rows, words)
    tied = links(points, rows, words, similarity).withColumnRenamed("node", "set")
    first = points.select("set", "first").join(tied, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select(*(F.col(f"first.{x}").alias(n) for x, n in zip("ab", marks)))
    return docs.withColumns(marks).join(kept, list(marks), "left_semi").dropDuplicates(list(marks)).select(*docs.columns)
