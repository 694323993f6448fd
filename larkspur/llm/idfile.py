"""Token ids in Simple-8b words, written as sharded block files and read back.

A 64-bit word holds a selector in its top four bits and, below, as many ids as fit at
that selector's width, the first id lowest. Selector 14 stands for one id of more than
60 bits: the word's payload is its place in the block's list of escaped values. Selector
15 is not used.

File format: a folder of Parquet files, so that any store that Spark writes to will do and
Spark's commit protocol keeps out what lost executors left behind. A row is a block:

- shard int, block int, start_in_shard long, n_ids long,
- keys array<long>: the keys of its documents, in order,
- counts array<int>: their numbers of ids; running sums are the documents' offsets,
- words binary: little-endian Simple-8b words; word_ids binary: for each ``STRIDE`` words
  the number of ids before them (little-endian 32 bits), from where a reader can begin,
- escaped array<long>.

Shards are in ascending key order, nulls first, and blocks and documents in them too; rows
of the same key are in text order. A document is never split over blocks, however long. Null and empty texts have the end id alone, repeated rows are
documents each, and an empty table gives files without rows. Only key and text are read; further columns may have any name.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Memo, arrow_map, ragged, scratch, slices, sums

#: How many values of how many bits the selectors 0 to 13 pack.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 14
COUNT_OF = np.array([c for c, _ in PACKS] + [1, 0], np.int64)
STRIDE = 128
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 16

SCHEMA = "shard int, block int, start_in_shard long, n_ids long, keys array<long>, counts array<int>, words binary, word_ids binary, escaped array<long>"


#: The first pack, from the narrowest, that holds values of so many bits.
PACK_OF_BITS = np.array([next((k for k, (_, w) in enumerate(PACKS) if w >= b), ESCAPE) for b in range(65)], np.uint8)
PACK_OF_SHORT = PACK_OF_BITS[[v.bit_length() for v in range(1 << 16)]]


def narrowest(values: np.ndarray) -> np.ndarray:
    """The number of the narrowest pack that holds each value, ESCAPE where none does."""
    if len(values) and int(values.max()) < 1 << 16:
        return PACK_OF_SHORT[values]
    out = np.zeros(len(values), np.uint8)
    for k, (_, bits) in enumerate(PACKS):
        out[values >> np.uint64(bits) > 0] = k + 1
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of unsigned 64-bit values: each word takes as many as fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    windows = {1: np.concatenate([narrowest(values), np.full(PACKS[0][0], 255, np.uint8)])}  # the most over 1, 2, 4 ... values
    while (size := 2 * max(windows)) <= PACKS[0][0]:
        half = windows[size // 2]
        windows[size] = np.maximum(half, np.concatenate([half[size // 2 :], np.full(size // 2, 255, np.uint8)]))
    selector = np.full(n, ESCAPE, np.uint8)
    for k in range(len(PACKS) - 1, -1, -1):
        count = PACKS[k][0]
        size = max(w for w in windows if w <= count)
        most = np.maximum(windows[size][:n], windows[size][count - size : count - size + n])
        selector[most <= k] = k
    # where the next word begins, and that 2, 4 and 8 words on; only every eighth is walked
    jumps = [np.append(np.minimum(np.arange(n) + COUNT_OF[selector], n), n)]
    while len(jumps) < 4:
        jumps.append(jumps[-1][jumps[-1]])
    far, i, walked = memoryview(jumps[-1]), 0, []
    while i < n:
        walked.append(i)
        i = far[i]
    begins = np.array(walked, np.int64)
    for jump in reversed(jumps[:-1]):
        begins = np.stack([begins, jump[begins]], 1).ravel()
    begins = begins[begins < n]
    chosen = selector[begins]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(chosen == k)
        for j in range(count if len(rows) else 0):
            words[rows] |= values[begins[rows] + j] << np.uint64(j * bits)
    out = np.flatnonzero(chosen == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    return words, values[begins[out]]


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values of ``words``; all words of a selector are taken apart at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT_OF[chosen]
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(chosen == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            out[begins[rows] + j] = (words[rows] >> np.uint64(j * bits)) & mask
    rows = np.flatnonzero(chosen == ESCAPE)
    out[begins[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def word_offsets(words: np.ndarray) -> np.ndarray:
    """The number of ids before each STRIDE-th word."""
    counts = COUNT_OF[(words >> np.uint64(60)).astype(np.int64)]
    return (np.cumsum(counts) - counts)[::STRIDE].astype("<u4")


def ids_between(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Ids begin to end of a block, unpacking only the strides that hold them."""
    first = max(0, int(np.searchsorted(offsets, begin, "right")) - 1)
    last = int(np.searchsorted(offsets, end, "left"))
    got = unpack(words[first * STRIDE : last * STRIDE], escaped)
    base = int(offsets[first]) if len(offsets) else 0
    return got[begin - base : end - base]


#: A line that is a word of lower-case letters, then punctuation: both are pre-tokens, and neither changes when normalised.
LINE = re.compile("^(?:([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)|([^\n]+))$", re.MULTILINE)


class Pool:
    """Numbers for strings, in order of first sight, and the ids of each, end to end."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict = defaultdict(itertools.count().__next__)
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def codes(self, strings: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.index.__getitem__, strings), np.int64, len(strings))
        if len(self.index) > len(self.counts):
            ids, counts = self.encode(list(itertools.islice(self.index, len(self.counts), None)))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return codes


class WordEncoder:
    """Ids by the tokenizers library, each distinct run of non-space encoded once.

    For lower-casing tokenizers that drop white space, whose normalizer and cuts never
    reach across it, and that mark a pre-token's last id with ``</w>``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words that need neither normalising nor cutting
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.heads, self.others = Pool(self.head_ids), Pool(self.other_ids)
        self.memo = Memo(self.learn, 1_000_000)

    def head_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per word) of words of lower-case letters, many to a call."""
        lines = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        got = [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *got])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't close each word with one piece")
        return ids, np.diff(ends, prepend=0)

    def other_ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(counts.sum())), counts

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.memo.known:
            self.ids = np.zeros(0, np.uint32)
            self.heads.clear(), self.others.clear()
        found = LINE.findall(b"\n".join(chunks).decode())
        # each chunk is a head, which may be empty, and something after it, which may be empty
        heads, others = self.heads.codes([h for h, _, _ in found if h]), self.others.codes([t or o for _, t, o in found if t or o])
        has = np.array([[bool(h), bool(t or o)] for h, t, o in found], bool).reshape(-1, 2)
        pool = np.concatenate([self.heads.ids, self.others.ids])
        sizes = np.concatenate([self.heads.counts, self.others.counts])
        begins = np.cumsum(sizes) - sizes
        which = np.zeros(has.shape, np.int64)
        which[has[:, 0], 0] = heads
        which[has[:, 1], 1] = len(self.heads.counts) + others
        n = np.where(has, sizes[which] if len(sizes) else 0, 0)
        new = pool[ragged(np.where(has, begins[which] if len(sizes) else 0, 0).ravel(), n.ravel())]
        counts = n.sum(1)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, new])
        return starts, counts

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end``; their counts)."""
        # bytes: only A-Z and ASCII white space count. The case of special strings matters.
        raw = [t.encode() if t else b"" for t in texts]
        words = [(b if b"<|" in b else b.lower()).split() for b in raw]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.memo.codes([w for ws in words for w in ws])
        starts, counts = self.memo.arrays()
        n = counts[codes]
        totals = sums(n, per_text) + 1
        out = np.full(int(totals.sum()), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(totals) - 1] = False
        out[inner] = self.ids[ragged(starts[codes], n)]
        return out, totals


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def block_row(shard: int, block: int, start: int, keys: list, counts: np.ndarray, ids: np.ndarray) -> dict:
    words, escaped = pack(ids)
    return {"shard": shard, "block": block, "start_in_shard": start, "n_ids": len(ids), "keys": keys, "counts": counts.tolist(), "words": words.astype("<u8").tobytes(), "word_ids": word_offsets(words).tobytes(), "escaped": escaped.view(np.int64).tolist()}


BLOCK_TYPE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("words", pa.binary()), ("word_ids", pa.binary()), ("escaped", pa.list_(pa.int64()))])


def write_ids(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of ``text``, a document closed by ``end``, to ``folder`` in ascending ``key`` order.

    Null texts are empty: their only id is ``end``. Rows that repeat are written as often. Rows
    of a hot key (nulls) are dealt out by a hash of their text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def run(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        pending = 0

        def flush():
            nonlocal block, start, keys, held, sizes, pending
            row = block_row(shard, block, start, keys, np.concatenate(sizes), np.concatenate(held))
            block, start, keys, held, sizes, pending = block + 1, start + row["n_ids"], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], BLOCK_TYPE)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, counts = encoder(path).encode(texts[a:b], end)
                ends = np.cumsum(counts)
                i, done = a, 0
                while i < b:
                    # as many whole documents as the block takes, one at least
                    j = max(i + 1, a + int(np.searchsorted(ends, done + BLOCK_IDS - pending, "right")))
                    upto = int(ends[j - a - 1])
                    keys += names[i:j]
                    sizes.append(counts[i - a : j - a])
                    held.append(ids[done:upto])
                    pending += upto - done
                    i, done = j, upto
                    if pending >= BLOCK_IDS or i < b:
                        yield flush()
        if pending:
            yield flush()

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").mode("overwrite").parquet(folder)


def read_blocks(spark, folder: str) -> DataFrame:
    """The blocks with ``start``, the number of ids in all blocks before.

    Only one count per shard goes through the driver.
    """
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    starts, total = [], 0
    for shard, n in blocks.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        starts.append((shard, total))
        total += n
    before = spark.createDataFrame(starts, "shard int, before long")
    return blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("start_in_shard"))


def read_ids(spark, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: key, start, n_tokens, ids_crc32 and, if wanted, ids."""
    blocks = read_blocks(spark, folder).select("start", "keys", "counts", "words", "escaped")
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def work(batch: pa.RecordBatch):
        for start, keys, counts, words, escaped in zip(*(c.to_pylist() for c in batch.columns)):
            ids = unpack(np.frombuffer(words, "<u8"), np.array(escaped, np.int64).view(np.uint64))
            counts = np.array(counts, np.int64)
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            columns = [pa.array(keys, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return arrow_map(blocks, work, schema)


def id_file(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` to ``folder`` (by default a new one in the shared folder) and reads them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "ids")
    write_ids(docs, folder, path, end, key, text)
    return read_ids(spark, folder, key)
