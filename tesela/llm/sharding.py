"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash. Pass two loads one bucket at a time,
shuffles it by Fisher-Yates and numbers it; the buckets end to end are the shuffled order, which is dealt to the shards in
turn, so shards differ by one row at most. The shards are written as Parquet, one folder for each.

Defined results: a null text counts as empty; a null id is hashed like a value; an empty table makes no rows; rows that
are equal in id and text fall into one bucket and are interchangeable; input columns named like an output column are
replaced by it. A very long text counts by its bytes, so its bucket holds fewer others; a single text larger
than a bucket is held whole by the task that shuffles it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.llm.common import col, others, shared_path, small, table

BUCKET_BYTES = 16 << 20
SEED = 20_25
MADE = ["shard", "slot"]
_BUCKET, _HASH, _PLACE, _BASE = "__bucket", "__hash", "__place", "__base"


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of 0..n-1: each place, from the last, swaps with a uniform one at or before it."""
    order = np.arange(n)
    if n > 1:
        last = np.arange(n - 1, 0, -1)
        picks = rng.integers(0, last + 1)
        out = order.tolist()
        for i, j in zip(last.tolist(), picks.tolist(), strict=True):
            out[i], out[j] = out[j], out[i]
        order = np.asarray(out)
    return order


def _bucket_shuffler(seed: int):
    def shuffled(key: tuple, bucket: pa.Table) -> pa.Table:
        # rows arrive in any order after a shuffle, so a retried task sorts them first
        bucket = bucket.sort_by([(_HASH, "ascending")])
        order = fisher_yates(bucket.num_rows, np.random.default_rng([seed, int(key[0].as_py())]))
        return bucket.take(pa.array(order)).append_column(pa.field(_PLACE, pa.int64()), pa.array(np.arange(bucket.num_rows)))

    return shuffled


def write_shards(df: DataFrame, out: str, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffles the whole table into `shards` folders under `out`; returns the written table with `shard` and `slot`.

    `slot` counts the rows of a shard from 0 without gaps. Repeated runs with one seed give the same order."""
    keep = others(df, [*MADE, _BUCKET, _HASH, _PLACE, _BASE])
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce(col(text), F.lit("")))).alias("b")).first()
    buckets = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stats.n // 100), -(-int((stats.b or 0) + 64 * stats.n) // bucket_bytes))
    dealt = df.select(*map(col, keep), F.xxhash64(F.lit(seed), col(key), col(text)).alias(_HASH)).withColumn(_BUCKET, F.pmod(F.xxhash64(F.lit(~seed), F.col(_HASH)), F.lit(buckets)).cast("int"))
    sizes = df.select(F.pmod(F.xxhash64(F.lit(~seed), F.xxhash64(F.lit(seed), col(key), col(text))), F.lit(buckets)).cast("int").alias(_BUCKET)).groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.selectExpr(_BUCKET, f"sum(n) over (order by {_BUCKET}) - n as {_BASE}")
    schema = T.StructType([*dealt.schema.fields, T.StructField(_PLACE, T.LongType())])
    placed = dealt.groupBy(_BUCKET).applyInArrow(_bucket_shuffler(seed), schema)
    index = F.col(_BASE) + F.col(_PLACE)
    numbered = placed.join(small(bases, 100_000), _BUCKET).select(*map(col, keep), (index % shards).cast("int").alias("shard"), F.floor(index / F.lit(shards)).cast("long").alias("slot"))
    numbered.write.partitionBy("shard").parquet(out)
    return df.sparkSession.read.schema(numbered.schema).parquet(out)


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return write_shards(docs, shared_path(spark, "shards")).select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_external_shuffle": op3_external_shuffle}
ORACLES: dict[str, str] = {}
