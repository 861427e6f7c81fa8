"""Helpers shared by the corpus operators: cutting lineage, Arrow slices and byte views."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Seconds between two sweeps of the driver.
SWEEP_S = 3.0


def _checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's spark.checkpoint.dir. A folder of this machine only where all tasks run here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the shared checkpoint folder."""
    _checkpoints(df.sparkSession)
    sweep(df.sparkSession)
    return df.checkpoint(eager=True)


_SWEPT = [float("-inf")]


def sweep(spark: SparkSession) -> None:
    """Collects the driver's garbage, at most every SWEEP_S seconds.

    Spark removes shuffle files, broadcasts and checkpoints from the disks and memory of all machines once
    the driver's garbage that names them is collected, which else happens only when its heap is full.
    What the JVM has freed outside its heap (compilers, plans' code, buffers) goes back to the machine too.
    """
    if time.monotonic() - _SWEPT[0] >= SWEEP_S:
        release()
        spark.sparkContext._jvm.System.gc()
        trim_driver(spark)
        _SWEPT[0] = time.monotonic()


def trim_driver(spark: SparkSession) -> str:
    """Has the driver's JVM give free memory outside its heap back, as glibc keeps it; what the JVM says, empty if it can't."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:  # the server's own class is closed to reflection, its interface is not
        return jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JJavaError:  # before Java 17.0.9, or not HotSpot
        return ""


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for written tables."""
    return f"{_checkpoints(spark)}/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that shared_folder has named, with all that is in it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


_RESIDENT: dict[str, object] = {}


def resident(key: str | None, build: Callable[[], object] = dict) -> object:
    """What an operator keeps in a Python worker between batches and tasks: built once under its key.

    A worker keeps one operator's state at a time. When another operator begins (with its own key, or
    with None if it keeps nothing), the state before is dropped and its memory is given back.
    """
    if key is None or key not in _RESIDENT:
        if _RESIDENT or key is None:
            _RESIDENT.clear()
            release()
        if key is None:
            return None
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Gives memory that is free inside the process back to the machine, as workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the session to hand at most ``rows`` rows at once to Python, as whole documents can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose ``column`` holds about ``most`` bytes of text at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def texts(array: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in array.to_pylist()]


def joined_bytes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All values end to end, and the n + 1 offsets between them."""
    offsets = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, values), dtype=np.int64, count=len(values)), out=offsets[1:])
    return np.frombuffer(b"".join(values), dtype=np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
