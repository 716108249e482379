"""What the operators of this package share: session settings, scratch tables, packed blobs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay below this size, so that long texts don't pile up in a Python worker.
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that hold memory and disk down; they don't change results."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cloakframe-")  # driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCOPES: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The scratch folders that are named while the block runs, for whoever knows when they are done with."""
    _SCOPES.append(paths := [])
    try:
        yield paths
    finally:
        # by identity: a block and one around it hold equal lists where all folders were named in both
        del _SCOPES[next(k for k, x in enumerate(_SCOPES) if x is paths)]


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (at most `files` files) and read again: it cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    # no marker file: whoever reads the table has its path from here, after the job
    (df if files is None else df.coalesce(files)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str, files: int | None = None) -> DataFrame:
    """What make() gives, stored; every other scratch table that it wrote goes."""
    with scratch_paths() as paths:
        out = stored(made := make(), label, files)
    discard(made.sparkSession, paths[:-1])
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders that no later result reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, 0 where it has none; only sets numbers of partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def partitions(df: DataFrame, target: int = 32 << 20) -> int:
    """Partitions of about target bytes, and at least as many as the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // target))


def writers(df: DataFrame, target: int = 32 << 20) -> int:
    """Files of a table that is made from df: many small ones cost more than they help. Two a core at least, then by df's size."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def release_memory() -> None:
    """Gives freed memory back: workers live on, and later stages shouldn't find what earlier ones once needed."""
    import ctypes

    global _POWERS
    _POWERS = None
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """A full collection in the driver's JVM and, by a task for every core, in the executors': heaps that earlier work has
    grown are given back, so that they don't add to what the next stage's Python workers need. Results don't change."""
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one blob: the length, then column after column."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for d in dtypes:
        out.append(np.frombuffer(blob, dtype=d, count=n, offset=at))
        at += n * np.dtype(d).itemsize
    return out


def unpack_all(blobs: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    parts = [unpack(b, dtypes) for b in blobs]
    if not parts:
        return [np.empty(0, d) for d in dtypes]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def flat_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after the other, and the offsets of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE, _POWERS = 0x9E3779B97F4A7C15, None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least n of each."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS
