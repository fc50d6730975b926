"""What the operators share: the shared work folder, text in batches, words, CRC-32 splits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of ASCII white space and of capital letters, as the contracts have them.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where one machine is all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="work-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/trialforge/{name}-{uuid.uuid4().hex}"


#: Rows, and bytes, of an Arrow batch at most, where rows are large.
FEW_ROWS, FEW_BYTES = 64, 16 << 20
BATCH, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


#: Whether Spark deletes a query's shuffle files when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **wanted) -> Iterator[None]:
    """Settings of the session for as long as it takes to write a table."""
    usual = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, name: str, large_rows: bool = False, rows: int = FEW_ROWS) -> DataFrame:
    """The frame, written once in the shared folder and read back: later steps do not depend on the executors that made
    it, nor on the shuffle files that led to it, which are deleted at once. large_rows: Arrow batches have `rows` at most."""
    return stored_at(df, name, large_rows, rows)[0]


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    for x in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_at(df: DataFrame, name: str, large_rows: bool = False, rows: int = FEW_ROWS) -> tuple[DataFrame, str]:
    """The same, and where it is."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with settings(spark, **{CLEAN: "true"} | ({BATCH: str(rows), BYTES: f"{FEW_BYTES}b"} if large_rows else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_held: dict = {}


def held(kind: type, *arguments):
    """kind(*arguments), kept in a Python worker from task to task until another one is asked for: only one such memory at a time."""
    key = (kind.__module__, kind.__name__, *arguments)
    if key not in _held:
        _held.clear()
        _held[key] = kind(*arguments)
    return _held[key]


def unheld() -> None:
    """Lets go of what held() keeps, in a worker whose task needs none of it."""
    _held.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Held out: crc32(doc_id as text) mod modulus is the remainder. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def raw_text(column: Column) -> Column:
    """Text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(column.cast("binary"), F.lit(b""))


def chunks(values: list[bytes], limit: int) -> Iterator[slice]:
    """Slices of values with about `limit` bytes each; one longer value stands alone."""
    start, total = 0, 0
    for i, x in enumerate(values):
        if total and total + len(x) > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(x)
    if start < len(values):
        yield slice(start, len(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def as_text(raw: pa.Array) -> pa.Array:
    """Bytes (or text) as strings, without a copy and unchecked: for kernels that look at ASCII characters alone. Offsets begin at 0, which some kernels take for granted."""
    raw = raw.cast(pa.large_binary())
    _, ends, data = raw.buffers()
    ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends - ends[0]), (data or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0])))


def words_in(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For texts split at ASCII white space: the number of each word in a list of distinct ones, where each text's words begin (and, last, how many there are), and that list."""
    split = pc.ascii_split_whitespace(text)
    starts, words = split.offsets.to_numpy().astype(np.int64), split.values
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        starts = np.append(0, np.cumsum(full))[starts]
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), starts - starts[0], coded.dictionary


def pieces_of(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A column of bytes in slices of about `limit` bytes each; one longer value stands alone."""
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield column.slice(a, b - a)
        a = b


def released() -> None:
    """Gives memory that a Python worker no longer uses back to the machine, at the end of a task: the worker stays for later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
