"""Small helpers that the operators of this subpackage share."""

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: a worker holds a few of them with what it makes of them.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whole; Python workers get it in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add, compared as Spark does: case-blind."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` needs to share it, compared as Spark does: case-blind."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    The session's setting is used where there is one; a session without it gets a
    folder of the working machine if it runs on that alone, and else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = held.get() if held.isDefined() else os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of a table of ids that go into one file.
ROWS_A_FILE = 250_000


def files_for(rows: int) -> int:
    """How many files a table of ids with so many rows gets."""
    return max(1, -(-rows // ROWS_A_FILE))


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` with its lineage cut by checkpoint() in the shared folder, in ``files`` files if given: dealt anew, since one task for many sorted parts would hold the memory of all."""
    df = df if files is None else df.repartition(files)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, files: int | None = None, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in ``files`` files if given (see ``cut``), read again."""
    df = df if files is None else df.repartition(files)
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released() -> None:
    """Gives back what a task has freed: Python workers stay for later tasks, and their allocators would hold it until then."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges that hold about ``most`` bytes each, one row at least."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from joined bytes and the offsets of its rows."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
