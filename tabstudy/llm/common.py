"""Helpers shared by the corpus operators: lineage cuts, Arrow batches of texts, ragged arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; only under a local master without one, a temporary one (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tabstudy-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tabstudy-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what the write has shuffled is of no more use after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


SLICE_ROWS = 500  # rows whose texts are Python objects at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_KEPT: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """``make(*args)``, made once for all tasks of a stage that a worker runs; gone when it begins a task of another stage."""
    key = (_stage(), make, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]


def _stage() -> int:
    context = TaskContext.get()
    return context.stageId() if context else -1


def _begin() -> None:
    for key in [k for k in _KEPT if k[0] != _stage()]:
        del _KEPT[key]


def _release() -> None:
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the system's also gives back what is not Arrow's
        pool.release_unused()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose memory goes back to the system when a task ends: workers live on, idle ones too, beside those of later stages."""

    def task(batches):
        _begin()
        yield from run(batches)
        _release()

    return task


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function from Arrow batch to Arrow batch, some hundred rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(lean(run), schema)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in sorted arrays, and the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start+1, ... over all given ranges."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


class _Numbers(dict):
    """Numbers keys in the order of their first use; ``new`` has those that were numbered since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Ragged:
    """Integer lists, and further numbers, of keys that occur again and again. Beyond ``limit`` keys the most used half stays."""

    def __init__(self, make: Callable[[list], tuple], limit: int = 500_000, extras: int = 0):
        """``make`` gives for new keys their lists as (values, lengths, extra numbers...)."""
        self.make, self.limit = make, limit
        self.slots, self.used = _Numbers(), 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.length, self.seen = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))
        self.extra = [np.zeros(1 << 14) for _ in range(extras)]

    def find(self, keys: list) -> np.ndarray:
        """Slot of each key, until the next call."""
        if len(self.slots) > self.limit:
            self._shrink()
        found = np.fromiter(map(self.slots.__getitem__, keys), dtype=np.int64, count=len(keys))
        if self.slots.new:
            self._add(*self.make(self.slots.new))
            self.slots.new = []
        n = len(self.slots)
        self.seen[:n] += np.bincount(found, minlength=n)
        return found

    def _add(self, values: np.ndarray, lengths: np.ndarray, *extras: np.ndarray) -> None:
        n = len(self.slots)
        at = n - len(lengths)
        grown = lambda x, size: np.concatenate([x, np.zeros(max(size - len(x), len(x)), dtype=x.dtype)]) if size > len(x) else x
        self.flat = grown(self.flat, self.used + len(values))
        self.start, self.length, self.seen = grown(self.start, n), grown(self.length, n), grown(self.seen, n)
        self.extra = [grown(x, n) for x in self.extra]
        self.flat[self.used:self.used + len(values)] = values
        self.start[at:n] = self.used + np.cumsum(lengths) - lengths
        self.length[at:n] = lengths
        self.seen[at:n] = 0
        for x, own in zip(self.extra, extras):
            x[at:n] = own
        self.used += len(values)

    def _shrink(self) -> None:
        n = len(self.slots)
        seen = self.seen[:n]
        kept = np.flatnonzero((seen > 1) & (seen >= np.partition(seen, n // 2)[n // 2]))[-(self.limit // 2 + 1):]
        keys = list(self.slots)
        old = self.slots
        self.slots = _Numbers()
        self.slots.update((keys[i], k) for k, i in enumerate(kept.tolist()))
        del old
        values, lengths, extras = self.gather(kept), self.length[kept], [x[kept] for x in self.extra]
        self.used = 0
        self._add(values, lengths, *extras)

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The lists of these slots, one after the other."""
        return self.flat[ranges(self.start[slots], self.length[slots])]
