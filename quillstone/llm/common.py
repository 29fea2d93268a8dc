"""Shared pieces of the corpus operators: Arrow text buffers, vectorised words, hashes, blobs.

A *chunk* is a run of whole rows of one Arrow batch whose texts lie in one byte
buffer; a text is never cut, so a chunk holds at least one row however long it is.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

U64 = np.uint64
CHUNK_BYTES = 2 << 20
#: Collections after a write, and seconds before each: one alone finds its shuffle files still held.
COLLECTIONS, SETTLE = 3, 0.3
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MIX_1, MIX_2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/quillstone-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage: checkpoint files in the shared folder survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """At most 1,000 rows in an Arrow batch of this session: with texts of some kB the usual 10,000 take tens of MB in each task, on both sides."""
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= 1000:
        spark.conf.set(BATCH_ROWS, 1000)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as Parquet, so later reads need only the columns they use.

    Shuffle files that made it are no longer needed once it is there; the collection
    asked for lets Spark's cleaner remove them. The driver's Python gives back what it has freed too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    for _ in range(COLLECTIONS):
        time.sleep(SETTLE)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    release()
    return out


def discard(df: DataFrame) -> None:
    """Removes a written() table that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray, by: np.uint64 = MIX_1) -> np.ndarray:
    """A bijection on 64 bits that spreads entropy to all of them."""
    h = h ^ (h >> U64(31))
    h = h * by
    h ^= h >> U64(29)
    h = h * MIX_2
    return h ^ (h >> U64(32))


def byte_table(lower: bool = True, seed: int = 7) -> np.ndarray:
    """A fixed random odd number for each byte; A-Z share those of a-z if lower."""
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    out = []
    for x in (base, pow(base, -1, 2**64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Chunk:
    """Rows of a batch: `first` is the index of the first in the batch, data their bytes, off their borders."""

    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off = first, data, off

    def __len__(self) -> int:
        return len(self.off) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the rows' borders; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's rows in runs of about `limit` bytes."""
    n = len(column)
    if not n:
        return
    data, off = text_buffer(column)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield Chunk(at, data[off[at] : off[end]], off[at : end + 1] - off[at])
        at = end


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no part of a word of letters and digits: all below 0x80 but 0-9, A-Z, a-z.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False
PUNCT[128:] = False


class Words:
    """Words of a chunk: start and end (bytes), hash, and per row the range of its words."""

    def __init__(self, chunk: Chunk, separators: np.ndarray, table: np.ndarray, pw: tuple[np.ndarray, np.ndarray]):
        data, off = chunk.data, chunk.off
        n = len(data)
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = off[:-1][off[:-1] < n]
        begins[firsts] = inside[firsts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = off[1:] - 1
        lasts = lasts[(lasts >= 0) & (lasts < n)]
        ends[lasts] = inside[lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        if n:
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[data] * pw[0][:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * pw[1][self.start])
            self._sums, self._back = sums, pw[1]
        else:
            self.hash = np.zeros(0, np.uint64)
        self.range = np.searchsorted(self.start, off)

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of k bytes or more, and hashes of their first k bytes."""
        long = np.flatnonzero(self.end - self.start >= k)
        if not len(long):
            return long, self.hash[:0]
        at = self.start[long]
        return long, mix((self._sums[at + k] - self._sums[at]) * self._back[at] + U64(k))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.range) - 1), np.diff(self.range))


class Powers:
    """powers() of at least the length asked for, kept between chunks."""

    def __init__(self) -> None:
        self.pw = powers(1)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.pw[0]):
            self.pw = powers(max(n, CHUNK_BYTES + 1))
        return self.pw


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in a row; a row of fewer words, but not none, gives its whole run. With their rows and first words."""
    count = np.diff(words.range)
    short = (count > 0) & (count < k)
    h = words.hash
    n = len(h)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * MIX_1 + h[j : n - k + 1 + j]) if len(out) else out
    first = np.arange(len(out))
    row = words.row()
    good = row[: len(out)] == row[k - 1 :] if len(out) else np.zeros(0, bool)
    out, first = out[good], first[good]
    rows = row[first] if len(first) else np.zeros(0, np.int64)
    if short.any():
        extra = count[short].astype(np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = mix(extra[has] * MIX_2 + h[words.range[:-1][short][has] + j])
        out = np.concatenate([out, extra])
        rows = np.concatenate([rows, np.flatnonzero(short)])
        first = np.concatenate([first, words.range[:-1][short]])
        order = np.argsort(rows, kind="stable")
        out, rows, first = out[order], rows[order], first[order]
    return out, rows, first


def release() -> None:
    """Gives freed memory back: Python workers are used again, and what they and the driver keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def annotated(df: DataFrame, make, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """All columns of df and new ones, in one pass without a shuffle.

    fields: (name, Arrow type, Spark type) of each new column; a column of df
    that has such a name gives way. make() runs once a task and returns a
    function from a batch to the arrays of the new columns.
    """
    small_batches(df.sparkSession)
    names = [f[0] for f in fields]
    taken = {x.lower() for x in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    by_name = {f.name: f for f in df.schema.fields}
    schema = StructType([by_name[c] for c in keep])
    for name, _, kind in fields:
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(batches):
        work = make()
        for batch in batches:
            new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, (_, t, _) in zip(work(batch), fields, strict=True)]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + new
            yield pa.RecordBatch.from_arrays(arrays, names=keep + names)
        del work
        release()

    return df.mapInArrow(run, schema)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys, and the runs' lengths."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return start, np.diff(np.append(start, len(sorted_keys)))


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each column) for every bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    columns = [c[order] for c in columns]
    for s, n in zip(*groups(b)):
        yield int(b[s]), *[c[s : s + n] for c in columns]


def joined(blobs, kind) -> np.ndarray:
    """One array from a column of blobs."""
    return np.frombuffer(b"".join(x for x in blobs.to_pylist() if x), kind)
