"""Tables in the folder that all executors share, and broadcasts whose size is checked."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of at most so many rows and bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, on one machine only, in a local folder that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tesela-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    return f"{base.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written and read again: its lineage ends there, and what was drawn or numbered in it stays as it is."""
    path = folder(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def _bytes(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return 16 + 16 * F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0))
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcast if its rows and bytes are within bounds."""
    size = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    found = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if found.n <= BROADCAST_ROWS and (found.b or 0) <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Bounds what goes to a Python worker at a time: texts can be long, and the default is 10,000 rows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def release() -> None:
    """Hands a worker's freed memory back to the system; workers are used again by later stages, beside the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
