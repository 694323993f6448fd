"""What several operators of this subpackage share: batches, memos, durable cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import re
import shutil
import tempfile
import uuid
import weakref
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are worked on in slices of about so many characters, which bounds a Python worker's memory.
SLICE_CHARS = 2_000_000
#: Row groups of stored tables are smaller than usual: a task holds one in memory until it is full.
BLOCK_BYTES = 16 << 20
#: Rows and bytes of a batch that a Python worker is given at once, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_500, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
#: A worker forgets what it has remembered about words once it holds so many.
MEMO_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, a temporary folder is set on one machine (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, in one of the application's own that goes when it ends."""
    folder = f"{shared_dir(spark)}/larkspur-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that no lost executor can take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from there; for wide rows."""
    folder = scratch(df.sparkSession, "table")
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage, for operators of many rounds: what past ones have shuffled and broadcast goes only then, and the heap shrinks."""
    trim()
    spark._jvm.System.gc()


def key_share(key: Column | str, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; a null key counts as remainder of the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def about(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, the same ones on every run: those with the lowest hash of ``keys``, which should differ from row to row."""
    share = min(1.0, bound / max(1, df.count()))
    if share >= 1.0:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))


def one_text(rows: DataFrame, *more: str) -> DataFrame:
    """(key, text, more): one row of each key, that with the least hash of its text."""
    first = F.min(F.struct(F.xxhash64("text").alias("by"), "text", *more)).alias("first")
    return rows.groupBy("key").agg(first).select("key", "first.text", *(f"first.{c}" for c in more))


#: What workers remember, to be forgotten when they turn to another operator.
_remembered: weakref.WeakSet = weakref.WeakSet()
_operator = ""


def remember(found) -> None:
    """``found.clear()`` is called when the worker turns to another operator."""
    _remembered.add(found)


def turn_to(operator: str) -> None:
    """Workers are used again from stage to stage; what one operator has remembered goes when another begins, and its memory back to the system."""
    global _operator
    if operator == _operator:
        return
    for found in list(_remembered):
        found.clear()
    _operator = operator
    trim()


def trim() -> None:
    """Gives the memory that this process has let go of back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python hold rows and bytes of a bounded number, as texts may be long; settings that are smaller stay."""
    for key, most in BATCH.items():
        found = int(spark.conf.get(key).rstrip("b"))
        if found <= 0 or found > most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``work`` over each Arrow batch of ``df``."""
    bound_batches(df.sparkSession)
    operator = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(operator)
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """``df``'s schema and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = f"__{name}"
        while found in taken:
            found += "_"
        out.append(found)
        taken.add(found)
    return out


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text makes one of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


class Memo:
    """Numbers for words, in order of first sight, with arrays of what is known of each.

    ``learn(new words) -> one array of rows per array kept``.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, ...]], most: int = MEMO_WORDS):
        self.learn, self.most = learn, most
        self.clear()
        remember(self)

    def clear(self) -> None:
        self.index: defaultdict = defaultdict(itertools.count().__next__)
        self.known = 0
        self.parts: list[list[np.ndarray]] = []

    def codes(self, words: list) -> np.ndarray:
        if self.known > self.most:
            self.clear()
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The arrays for all numbers given so far; call after codes()."""
        if len(self.index) > self.known or not self.parts:
            new = list(itertools.islice(self.index, self.known, None))
            got = self.learn(new)
            self.parts = [[np.concatenate([*old, part])] for old, part in zip(self.parts or [[] for _ in got], got)]
            self.known = len(self.index)
        return tuple(part[0] for part in self.parts)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(max(size, len(self.room) * 3 // 2), self.room.dtype)
            room[: self.size] = self.now
            self.room = room
        self.room[self.size : size] = values
        self.size = size

    def take(self, at: np.ndarray, values: np.ndarray | None = None) -> None:
        """Keeps the elements at these places only, in their order, or ``values`` in their stead."""
        self.room[: len(at)] = self.now[at] if values is None else values
        self.size = len(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each unsigned 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of ``counts`` values each; 0 for an empty group."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + counts[i] - 1 for each i, one after the other."""
    if not len(counts) or not (total := int(counts.sum())):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
