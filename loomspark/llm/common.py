"""Shared pieces: the shared scratch folder, written intermediate tables, and byte-level word kernels.

The kernels work on the UTF-8 buffer of an Arrow string column, so a batch of texts is cut into words and
hashed without a Python object per word. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D;
as those are ASCII, byte runs and code-point runs are the same.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy kernel call works on; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20
#: Bytes of a long text that a kernel has arrays for at once.
SEGMENT_BYTES = 1 << 20
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session gets a temporary one.

    Elsewhere a folder must be named: one of the driver's own would lose what executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return (found if ":" in found else f"file://{found}").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """*df* written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`; the caller has no later use of it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(shared_dir(spark).replace("file:///", "file:/")) or folder.startswith(shared_dir(spark)):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on and are shared by stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """*run*, a function of Arrow batches, with :func:`settle` after its last batch."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            settle()

    return tidied


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file that others see whole or not at all; a task that runs again replaces it by the same bytes."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{root}/{name}")


def get_file(folder: str, name: str) -> bytes | None:
    """The bytes of a file, or None if there is none."""
    fs, root = filesystem(folder)
    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_table(seed: int, lower: bool) -> np.ndarray:
    values = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept up to the length of a segment."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SEGMENT_BYTES), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= SEGMENT_BYTES:
            _powers[base] = have
    return have[:n]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - (at[0] if len(at) else 0)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of *batch* whose texts have about *most* bytes together; a longer text stands alone."""
    lengths = np.diff(string_buffer(batch.column(column))[1])
    begin, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of each text's words among them.

    Works through the bytes in segments, so that a long text needs memory for its words, not for each byte.
    """
    starts, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(data)
    for lo in range(0, n, SEGMENT_BYTES):
        hi = min(n, lo + SEGMENT_BYTES)
        inside = np.zeros(hi - lo + 2, dtype=bool)  # with the byte before and the byte after
        inside[1:-1] = ~_SPACE[data[lo:hi]]
        inside[0], inside[-1] = lo > 0 and not _SPACE[data[lo - 1]], hi < n and not _SPACE[data[hi]]
        edge = np.zeros(hi - lo + 1, dtype=bool)  # words don't cross texts
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
        own = inside[1:-1]
        starts.append(lo + np.flatnonzero(own & (~inside[:-2] | edge[:-1])))
        ends.append(lo + 1 + np.flatnonzero(own & (~inside[2:] | edge[1:])))
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, offsets)


_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, equal for equal words wherever they stand. lower: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if (seed, lower) not in _TABLES:
        _TABLES[seed, lower] = _byte_table(seed, lower)
    out, first = np.empty(len(starts), dtype=np.uint64), 0
    while first < len(starts):  # words of a segment at a time
        lo = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, lo + SEGMENT_BYTES, side="right")))
        b, e = starts[first:last] - lo, ends[first:last] - lo
        n = int(e[-1])
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLES[seed, lower][data[lo : lo + n]] * powers(_BASE, n), out=total[1:])
        h = (total[e] - total[b]) * powers(_INVERSE, n)[b]
        out[first:last] = mix64(h + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def window_hashes(words: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Hashes of all runs of *width* word hashes; entry i stands for words i .. i + width - 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64(multiplier | 1)
    h = words[:n].copy()
    for k in range(1, width):
        h *= m
        h += words[k : k + n]
    return mix64(h)
