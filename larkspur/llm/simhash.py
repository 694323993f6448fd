"""SimHash fingerprints and exact near-duplicate search with vantage-point trees.

A vantage-point tree, fitted on a bounded sample of fingerprints, cuts the Hamming
space into shards: at each node a fingerprint no farther from the vantage point than
the median lives on the inner side, any other on the outer side. By the triangle
inequality two fingerprints within ``radius`` have distances to the vantage point that
differ by ``radius`` at most, so that only those near the boundary visit the other
side, and of a pair it is enough that the inner one does. Shards are searched in
memory by more of the same splits. Every pair within the radius is found; what
leaves a shard is a spanning forest of its links, and rounds of contraction, until few are left, join
these into components.

A text without words has the fingerprint zero, and so is linked like any other; a null
text counts as empty. Repeated rows share a fingerprint. An empty table gives an empty result. Very long texts are worked on
whole. Only key and text are read; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import about, arrow_map, bound_batches, durable, fresh, with_fields

#: Home fingerprints that a shard should hold: one of so many of all, and the least and most; and those that a split in memory stops at.
#: The fewer the shards, the fewer fingerprints visit several; a shard of the most takes 8 MB besides its guests.
SHARD_SHARE, SHARD_LEAST, SHARD_MOST, SMALL = 64, 1 << 14, 1 << 20, 512
#: The tree's sample: one fingerprint of so many, and the least and most of it.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 16, 1 << 13, 1 << 19
#: Links up to this number are joined in one task, which holds some 100 bytes for each.
GATHERED = 1 << 18
SEED = 42


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest, n = xxhash.xxh64_intdigest, min(words, len(parts)) - 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - n].tolist(), ends[n:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    return majority(shingles(text, words))


def fingerprints(rows: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``rows`` with ``fp``, the fingerprint's 64 bits as a signed long, in place of ``text``."""
    rows = rows.select(*(c for c in rows.columns if c not in (text, "fp")), text)

    def work(batch: pa.RecordBatch):
        found = np.fromiter((fingerprint(t, words) for t in batch.columns[-1].to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return arrow_map(rows, work, with_fields(rows.drop(text), "fp long"))


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


@dataclass
class Split:
    vantage: np.uint64
    median: int
    inner: Split | int
    outer: Split | int


def split_of(points: np.ndarray, radius: int, tries: int = 4) -> tuple[np.uint64, int] | None:
    """The vantage point and median of those tried that leave the fewest points at the boundary."""
    best = None
    for i in range(tries):
        vantage = points[(i * 7919 + len(points) // 2) % len(points)]
        far = distance(points, vantage)
        counts = np.bincount(far, minlength=66)
        upto = np.cumsum(counts)
        for median in range(int(np.searchsorted(upto, 0.35 * len(points))), int(np.searchsorted(upto, 0.65 * len(points))) + 1):
            inside = int(upto[median])
            if not 0 < inside < len(points):
                continue
            near = int(upto[min(65, median + radius)] - (upto[median - radius] if median >= radius else 0))
            cost = near + 0.5 * abs(2 * inside - len(points))
            if best is None or cost < best[0]:
                best = cost, vantage, median
    return best and best[1:]


def grow(points: np.ndarray, leaf: int, radius: int, count: list[int]) -> Split | int:
    """A tree whose leaves are numbered in order and hold about ``leaf`` of ``points``."""
    at = split_of(points, radius) if len(points) > leaf else None
    if at is None:
        count[0] += 1
        return count[0] - 1
    inside = distance(points, at[0]) <= at[1]
    return Split(*at, grow(points[inside], leaf, radius, count), grow(points[~inside], leaf, radius, count))


def sides(homes: np.ndarray, guests: np.ndarray, vantage: np.uint64, median: int, radius: int) -> tuple:
    """Masks: homes inside, homes inside that visit the outer side, guests to the inner and to the outer side."""
    h, g = distance(homes, vantage), distance(guests, vantage)
    inside = h <= median
    return inside, inside & (h > median - radius), g <= median + radius, g > median - radius


def route(tree: Split | int, homes: np.ndarray, guests: np.ndarray, radius: int, out: list) -> None:
    """Adds (leaf, homes, guests) for each leaf that gets any."""
    if not len(homes) and not len(guests):
        return
    if not isinstance(tree, Split):
        out.append((tree, homes, guests))
        return
    inside, visit, to_inner, to_outer = sides(homes, guests, tree.vantage, tree.median, radius)
    route(tree.inner, homes[inside], guests[to_inner], radius, out)
    route(tree.outer, homes[~inside], np.concatenate([guests[to_outer], homes[visit]]), radius, out)


def near_pairs(homes: np.ndarray, guests: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius of two homes, or of a home and a guest."""
    found, todo = [], [(homes, guests)]
    while todo:
        homes, guests = todo.pop()
        at = split_of(homes, radius, 1) if len(homes) > SMALL else None
        if at is not None:
            inside, visit, to_inner, to_outer = sides(homes, guests, *at, radius)
            todo.append((homes[inside], guests[to_inner]))
            todo.append((homes[~inside], np.concatenate([guests[to_outer], homes[visit]])))
            continue
        for others, own in ((homes, True), (guests, False)):
            for i in range(0, len(others), 2048):
                part = others[i : i + 2048]
                a, b = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= radius)
                if own:
                    a, b = a[a + i < b], b[a + i < b]
                if len(a):
                    found.append((part[a], homes[b]))
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links a-b, each node that isn't its component's least, with that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(points: DataFrame, radius: int = 2, shard: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that join just those that paths of near pairs join."""
    spark, total = points.sparkSession, points.count()
    wanted = min(SAMPLE_MOST, max(SAMPLE_LEAST, total // SAMPLE_SHARE))
    sample = about(points.select("fp"), wanted, "fp").toArrow()["fp"].to_numpy().view(np.uint64)
    shard = shard or min(SHARD_MOST, max(SHARD_LEAST, total // SHARD_SHARE))
    leaves = [0]
    tree = grow(np.sort(sample), max(8, shard * len(sample) // max(1, total)), radius, leaves)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batch: pa.RecordBatch):
        parts: list = []
        route(shared.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), np.zeros(0, np.uint64), radius, parts)
        sizes = [(len(h), len(g)) for _, h, g in parts]
        leaf = np.repeat(np.array([x[0] for x in parts], np.int32), [n + m for n, m in sizes])
        both = np.concatenate([np.zeros(0, np.uint64), *(x for _, h, g in parts for x in (h, g))])
        home = np.repeat(np.tile([True, False], len(parts)), [x for n in sizes for x in n])
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(both.view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        fp, home = group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(zero_copy_only=False).astype(bool)
        pairs = near_pairs(np.sort(fp[home]), np.sort(fp[~home]), radius)
        a = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in pairs)])
        b = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in pairs)])
        a, b = forest(a.view(np.int64), b.view(np.int64))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return arrow_map(points.select("fp"), deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(search, "a long, b long")


def gathered(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b) the least node of its component, found in one task; for links of a bounded number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        nodes = np.unique(np.concatenate([a, b]))
        root, (moved, least) = nodes.copy(), forest(a, b)
        root[np.searchsorted(nodes, moved)] = least
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    bound_batches(edges.sparkSession)
    return edges.select("a", "b").coalesce(1).mapInArrow(work, "node long, root long")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b) the least node of its component.

    While there are more than ``GATHERED`` links, in each round a node is contracted into that of itself and its neighbours which is first in
    an order of the round's own, so that a chain of any length loses more than half of its nodes a round. The links left are joined in one
    task: a round is a dozen stages, and the driver holds what each leaves. Going back through the rounds gives each node its root.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while edges.count() > GATHERED:
        by = lambda node, turn=len(rounds): F.struct(F.xxhash64(node, F.lit(turn)).alias("by"), F.col(node).alias("low"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(by("b")).alias("best"))
        step = durable(least.select(F.col("a").alias("node"), F.least("best", by("a"))["low"].alias("low")))
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("low").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("low").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = durable(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = durable(gathered(edges))
    if not rounds:
        return found
    for step in reversed(rounds):
        later = found.withColumnRenamed("node", "low")
        found = step.join(later, "low", "left").select("node", F.coalesce("root", "low").alias("root"))
    found = durable(found)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def named(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (key, fp and more) with ``component``, the least key that near links reach."""
    points = durable(prints.groupBy("fp").agg(F.min("key").alias("least")))
    tied = roots(links(points, radius)).withColumnRenamed("node", "fp")
    grouped = durable(points.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(grouped.join(least, "root").select("fp", "component"), "fp")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component): component is the least key that near links reach, a row's own included.

    Fingerprints link at ``radius`` or fewer differing bits. A null key is never a
    component's least key unless no other is there.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named(durable(fingerprints(rows, "text", words)), radius).select("key", "fp", "component")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that with the least key (nulls last), then the least text hash.

    Of rows that repeat with key and text one stays. Rows are known by 128 bits of hashes of
    key and text, so that the texts are shuffled once, for the final selection.
    """
    marks = dict(zip(fresh(docs, "a", "b"), (F.xxhash64(key, text), F.xxhash64(text, key, F.lit(1)))))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(c.alias(n) for n, c in zip("ab", marks.values())))
    prints = named(durable(fingerprints(rows, "text", words)), radius)
    first = prints.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "a", "b")).alias("first"))
    kept = first.select(*(F.col(f"first.{x}").alias(n) for x, n in zip("ab", marks)))
    return docs.withColumns(marks).join(kept, list(marks), "left_semi").dropDuplicates(list(marks)).select(*docs.columns)
