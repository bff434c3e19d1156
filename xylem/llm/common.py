"""What the operators share: the shared folder, lineage cuts, batches of text and hashes of them."""

from __future__ import annotations

import ctypes
import gc
import mmap
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one step of a batch, in bytes: the arrays of eight bytes a byte stay small beside an executor's memory.
SLICE_BYTES = 4 << 20
U64 = np.uint64
#: glibc's allocator keeps what is freed unless it is told.
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where that is unset, it is below the warehouse; in local mode, as in
    tests, below this machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{tempfile.gettempdir()}/xylem-checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there, and lost executors cost nothing before it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._xylem_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._xylem_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffled files that no table refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Give what this Python worker has freed back to the system: workers outlive their stage, and an executor's stand beside its JVM."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


#: Growth of a Python worker's memory that is worth the time to give it back: a task with few rows takes less than that.
_GROWTH = 16 << 20
_least = 0


def _settled() -> None:
    """Give memory back if this worker has grown by _GROWTH since it last did."""
    global _least
    if _resident() >= _least + _GROWTH:
        give_back()
        _least = _resident()


def _resident() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * mmap.PAGESIZE
    except OSError:
        return 1 << 62  # not known: always give back


def tidy(work):
    """work, a function of batches, with memory given back before and after it where there is some."""

    def run(batches):
        _settled()
        try:
            yield from work(batches)
        finally:
            _settled()

    return run


def doc_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator on texts reads, as (doc_id long, text string)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about limit bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - 1).clip(0) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column end to end, and where each row's begin (one more for the end). Null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers, modulo 2**64, of an odd number and of its inverse."""
    size = max(_POWERS, default=0)
    if size < n:
        size = -(-n >> 18) + 1 << 18
        _POWERS.clear()
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**place, modulo 2**64; span_hash() takes spans of them."""
    up, _ = powers(len(flat) + 1)
    out = np.zeros(len(flat) + 1, U64)
    np.cumsum((flat.astype(U64) + U64(1)) * up[: len(flat)], out=out[1:])
    return out


def span_sum(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash() before it is mixed: the same wherever the bytes stand, but with poor low bits."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the bytes stand."""
    return mix64(span_sum(prefix, start, end))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each of many runs, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
