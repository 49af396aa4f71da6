"""Shared helpers of the corpus operators: text rules, shared storage, key stores.

Shared storage is the folder named by ``spark.checkpoint.dir``.  Intermediate
tables and index files go there, never to a machine-local folder, so that a
lost executor costs recomputation of its tasks only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every byte that is not part of a word becomes a space.  Words are
#: runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
WORD_TABLE = bytes(
    b + 32
    if 0x41 <= b <= 0x5A
    else 0x20
    if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F
    else b
    for b in range(256)
)
#: A-Z to a-z and nothing else.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates become ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")


_CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, clear: Callable[[], None]) -> None:
    """Tell how an operator's cache in this Python worker is emptied."""
    _CACHES[owner] = clear


_OWNER = [""]


def claim(owner: str) -> None:
    """Empty the caches of all other operators and give their memory back: workers live longer than a stage."""
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Have executors return memory of work that is over, before another operator begins.

    Heaps of executors grow up to their bound and idle workers keep their caches;
    neither is freed by itself.  Nothing is read or computed, and where a task of
    another job runs meanwhile it only pauses.
    """
    bounded_batches(spark)
    cores = spark.sparkContext.defaultParallelism

    def idle(batches):
        claim("")
        yield from batches

    spark.range(0, 4 * cores, 1, 4 * cores).mapInPandas(idle, "id long").write.format("noop").mode("overwrite").save()
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def words_of(text: str | None) -> list[bytes]:
    return to_bytes(text).translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes: ten thousand long texts at once are too much for a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(name) or "").rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set (tests) a local one is made."""
    bounded_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), f"quantmere-{os.getpid()}")
        os.makedirs(root[len("file://") :], exist_ok=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quantmere/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of intermediate tables that goes when what was made of them is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, shared_path(spark, name)

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written to the folder and read again: cuts the lineage."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


def put_file(uri: str, data: bytes) -> None:
    """Write under a name of this attempt, then move: readers never see half a file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def put_array(uri: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array))
    put_file(uri, out.getvalue())


def get_array(uri: str) -> np.ndarray:
    """Memory-mapped where the store has local paths, so pages load on demand."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    return np.load(io.BytesIO(get_file(uri)))


def slices(sizes, limit: int):
    """Yield (from, to) over consecutive items whose sizes sum to about ``limit``."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
