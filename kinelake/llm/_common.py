"""Shared pieces of the corpus operators: the shared folder, materialised tables, text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word: a run of bytes other than space and \t..\r.  ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_KEY, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
BATCH_BYTES = 4 << 20

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="kinelake-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return _own_dir[0]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the bytes of an Arrow batch where the session still has the default.

    The default of 64 MB is held several times over by each task: in the JVM's buffers, on the way, and in the worker.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, DEFAULT_BATCH).rstrip("b") == DEFAULT_BATCH:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kinelake-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinelake_table = (spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables this process wrote to the shared folder; call it when results have been stored."""
    for session, path in [x for x in _written if x[0] is spark]:
        _delete(session, path)
        _written.remove((session, path))


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing still to be computed reads."""
    for df in tables:
        spark, path = df._kinelake_table
        _delete(spark, path)
        _written.remove((spark, path))


def n_written() -> int:
    """How many tables are there now, for :func:`discard_since`."""
    return len(_written)


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written after :func:`n_written` gave ``mark``, but for those of ``keep``, which need none of them once written."""
    for spark, path in _written[mark:]:
        if (spark, path) not in [df._kinelake_table for df in keep]:
            _delete(spark, path)
            _written.remove((spark, path))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give what a worker no longer needs back to the system: idle workers live on beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def word_count(column) -> object:
    """Number of words of a string column; null counts 0."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
