"""What the corpus operators share: tables, shared storage, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and an RE2 character class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one below /tmp only where none is named (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = f"file:///tmp/checkpoints/{os.getpid()}"
    return top.rstrip("/")


FILE_ROWS = 1 << 16  # of a file of a table that is known to be small
HEAP_FULL = 0.5  # share of the driver's heap


def stored(df: DataFrame, *partition_by: str, rows: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back, which cuts the lineage. rows: how many it has at most, if known;
    few rows go to few files, as each file costs its writer some processes and each task that reads it an opening.

    Executors may be lost afterwards: the rows are in shared storage. The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    release_driver(spark)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, Arrow batches have so many rows at most: for actions on rows that are large each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Memory that this process holds free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _array(spark: SparkSession, kind: JavaClass, *items: object) -> JavaObject:
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def release_driver(spark: SparkSession) -> None:
    """Memory that the driver holds free goes back to the system: of its Python, and of its JVM both heap and native memory.

    Each action compiles code and plans anew, which leaves free pieces in the C library's arenas; they add up over the many
    actions of an operator. Heap is collected only where it has grown to more than HEAP_FULL of what it may be.
    """
    release()
    jvm = spark._jvm
    own = jvm.java.lang.Runtime.getRuntime()
    if own.totalMemory() > HEAP_FULL * own.maxMemory():
        jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # only some JVMs have the command; its class is open to reflection by its interface only
        find = jvm.java.lang.Class.forName
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        call = find("javax.management.MBeanServer").getMethod("invoke", _array(spark, jvm.Class, *map(find, kinds)))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = _array(spark, jvm.Object, name, "systemTrimNativeHeap", _array(spark, jvm.Object), _array(spark, jvm.String))
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a task's function of Arrow batches, with release() at its end.

    Python workers live on between tasks and stages and several of them share an executor, so what one of them keeps is
    missing for the others.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the Arrow batches with their texts as UTF-8 bytes, null as empty; short, so that a task holds few texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            raw = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            yield batch, [x or b"" for x in raw.to_pylist()]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


_BYTE, _ODD = _tables()
_BASE = int(_ODD[0])
_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(1 << 16, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, dtype=np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


_SOLID = np.ones(256, dtype=bool)
_SOLID[list(SPACE_CHARS.encode())] = False
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _sums(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words begin and end, and what gives the hash of any stretch: sums before each byte, and what each start divides by."""
    solid = np.zeros(len(raw) + 2, dtype=bool)
    np.take(_SOLID, raw, out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE).take(raw) * up, out=sums[1:])
    return edge[::2], edge[1::2], sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix64((sums.take(stop) - sums.take(start)) * down.take(start) + (stop - start).astype(np.uint64))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, in order: polynomial sums over bytes, all words at once."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    start, stop, sums, down = _sums(raw, lower)
    return _hashes(sums, down, start, stop)


def spaced_hashes(text: bytes, mark: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with the white space before it, and a function for the hashes of the words alone by their
    numbers; then where the white space, the word and what follows begin.

    Words that begin with the byte mark, with a blank after each, end a text; white space does not reach into the text before.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    start, stop, sums, down = _sums(raw, True)
    first = np.append(0, stop[:-1])
    first[1:] += raw.take(start[:-1]) == mark
    return _hashes(sums, down, first, stop), lambda i: _hashes(sums, down, start.take(i), stop.take(i)), first, start, stop


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width words; of all words together if there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = words[:n] * _ODD[1]
    for i in range(1, width):
        total += words[i : i + n]
        total *= _ODD[1 + i % 7]
    return mix64(total + np.uint64(width))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
