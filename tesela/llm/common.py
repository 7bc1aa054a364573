"""What the training-data operators share: tables in the shared folder, size-checked broadcasts, words and clashing columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, in the regular expressions of Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = rf"[\x20\x09-\x0D]*{WORD}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of at most so many rows, of ROW_BYTES on average, may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, ROW_BYTES = 1_000_000, 48

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where that is unset on one machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tesela-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tesela/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the table to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _bytes(name: str, kind: T.DataType) -> Column:
    """About the bytes of a value: 8, and what strings and arrays hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(name), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.lit(8) + 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1) * F.coalesce(F.size(name), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialized table for broadcast if its rows and bytes are within bounds; otherwise the join shuffles."""
    size = sum((_bytes(f"`{f.name}`", f.dataType) for f in df.schema.fields), F.lit(0))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if found.n <= rows and (found.b or 0) <= rows * ROW_BYTES else df


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Bounds what a Python worker holds at a time: texts can be long, and the default is 10,000 rows a batch."""
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


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def others(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of the input that an operator hands on: those that no column it makes is named like, in any case of letters."""
    taken = {x.lower() for x in made}
    return [c for c in df.columns if c.lower() not in taken]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    return F.col(f"`{name}`")
