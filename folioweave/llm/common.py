"""What the operators of this subpackage share: Arrow text buffers, vectorised hashing, shared folders, packed exchange.

All per-byte work is done in numpy over whole Arrow batches, cut into slices of at most ``SLICE`` bytes, so memory does
not follow the size of a partition; one document alone may exceed a slice and then forms a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20
BATCH_ROWS = 2000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_kept: dict = {}
_tables: list[DataFrame] = []


def kept(key, make: Callable):
    """What a worker keeps from task to task: one object at a time, so workers that several operators share hold no more than
    the last one's caches."""
    if _kept.get("key") != key:
        forget()
        _kept.update(key=key, value=make())
    return _kept["value"]


def forget() -> None:
    _kept.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _enter(keeps) -> None:
    if _kept.get("key") != keeps:
        forget()


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps=None) -> DataFrame:
    """df.mapInArrow(run, schema) in tasks that first drop what other operators kept in the worker (but for the object kept
    under ``keeps``) and give their memory back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


def tune(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir; in local mode a temporary folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/folioweave"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    _tables.append(out)
    return out


def moved(stage: Callable[..., DataFrame], spark: SparkSession, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """What a stage makes of docs, as a table; the tables that the stage itself wrote are deleted behind it."""
    before = len(_tables)
    out = written(stage(spark, docs, sf_dir), name)
    for table in [t for t in _tables[before:] if t is not out]:
        dropped(table)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind a result of written(), once all that reads it has been written in turn."""
    spark = df.sparkSession
    _tables[:] = [t for t in _tables if t is not df]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps: it does so when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, from file sizes; no job runs. 0 where it knows none (it then says 2**63)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 0


def partitions_for(df: DataFrame, each: int = 8 << 20) -> int:
    """Shuffle partitions that follow the input: about ``each`` estimated bytes a partition, four a core or the session's count (the
    smaller) at least, so small inputs aren't written as hundreds of files."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(least, min(200_000, -(-input_bytes(df) // each)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers, n = column.buffers(), len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes, or one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end]; equal content hashes equally wherever it stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with fold_case A-Z share the values of a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if fold_case:
        table[65:91] = table[97:123]
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside a row, and the index of its row."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mask = is_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def ascii_words() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lower-cased: digits, letters, all of 0x80 and above."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def blank_words() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def by_bucket(bucket: np.ndarray, arrays: list[np.ndarray], order: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, one bucket after another."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable") if order is None else order
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
    arrays = [a[order] for a in arrays]
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
        yield int(sorted_bucket[a]), [x[a:b] for x in arrays]


def dealt(df: DataFrame, partitions: int, column: str = "bucket") -> DataFrame:
    """df sorted by bucket in partitions that hold equally many buckets each."""
    return df.repartitionById(partitions, F.pmod(F.col(column), F.lit(partitions)).cast("int")).sortWithinPartitions(column)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs, whatever others stand beside them."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A vocabulary file; folder overrides the place where the public files are installed."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
