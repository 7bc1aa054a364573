"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

The hashes of a text's five-word shingles are dealt once into bins by their high bits; a bin keeps its least hash. An
empty bin takes over the value of another, which a fixed sequence of bins, hashed from the empty bin's number and the
attempt, reaches first. Of each value the low bits of a mixed form are packed. Two fingerprints agree in a share
J + (1 - J) / 2^bits of their bins; solved for J, that is the likeness, free of the bias from chance agreement.

Defined results: a text without words has the empty fingerprint, which is like itself (1) and like nothing else (0);
null is as empty; texts with the same shingles have the same fingerprint; the neighbour order is descending id, null ids
last, equal ids by a hash of their texts; an empty table makes no rows; other columns, whatever their names, are not handed
on. A very long text is hashed whole, as a batch of arrays of its own; its sketch is as short as any other."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import col, materialize, release, small_batches, table
from tesela.llm.shingles import mix, shingle_sets, utf8

BINS, BITS = 1024, 4
_ATTEMPTS = 64
_tries: dict[int, np.ndarray] = {}


def _probe(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in that attempt."""
    if bins not in _tries:
        at = np.arange(bins, dtype=np.uint64)[None, :] + np.arange(1, _ATTEMPTS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        _tries[bins] = (mix(at) >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    if attempt < _ATTEMPTS:
        return _tries[bins][attempt]
    return (np.arange(bins) + attempt) % bins  # sparse texts: the attempts past the table walk on through all bins


def sketch(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Low-order bits of the densified bins, one byte a bin; empty for no hashes. `hashes` is sorted, `bins` a power of two."""
    if not len(hashes):
        return np.empty(0, np.uint8)
    bin_of = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bin_of, prepend=-1))
    least, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[bin_of[first]] = hashes[first]
    full[bin_of[first]] = True
    open_bins, attempt = np.flatnonzero(~full), 0
    while len(open_bins):
        to = _probe(bins, attempt)[open_bins]
        hit = full[to]
        least[open_bins[hit]] = least[to[hit]]
        open_bins, attempt = open_bins[~hit], attempt + 1
    # mixed with the bin's number, so that a value which fills many bins agrees by chance in each of them anew
    return (mix(least + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**bits - 1)).astype(np.uint8)


def pack(values: np.ndarray, bits: int = BITS) -> str:
    """Base64 of the values' low bits, side by side."""
    if not len(values):
        return ""
    flat = np.unpackbits(values[:, None], axis=1)[:, 8 - bits :]
    return base64.b64encode(np.packbits(flat).tobytes()).decode()


def unpack(text: str, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8))
    return np.packbits(np.pad(flat.reshape(-1, bits), ((0, 0), (8 - bits, 0))), axis=1)[:, 0] if len(flat) else np.empty(0, np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of two sketches, from 0 to 1, chance agreement taken out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / len(a) - chance) / (1 - chance))))


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`key`, `fingerprint` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(sketch(s, bins, bits), bits) for s in shingle_sets(utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.string())], names=[key, "fingerprint"])
        release()

    return df.select(col(key), col(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


def compare(df: DataFrame, left: str, right: str, bits: int = BITS, name: str = "likeness") -> DataFrame:
    """Adds the likeness of two columns of fingerprints."""

    @F.pandas_udf("double")
    def near(a, b):
        import pandas as pd

        return pd.Series([likeness(unpack(x, bits), unpack(y, bits), bits) for x, y in zip(a, b, strict=True)])

    return df.withColumn(name, near(col(left), col(right)))


def _bucket(key: str, bounds: list) -> Column:
    """Number of bounds at or below the key, by binary search over a constant array."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(F.get(known, low + s - 1) <= F.col(key), low + s).otherwise(low))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ranges of descending key, each range followed by the first row of the next one (`__tail`), sorted in its partition.

    The rows are shuffled once. Only one narrow row for each range goes through the driver's plan besides."""
    spark = df.sparkSession
    small_batches(spark)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [])) if ranges > 1 else []
    rows = df.select(col(key), col(text), F.xxhash64(col(text)).alias("__mark"), (-F.coalesce(_bucket(key, bounds), F.lit(-1))).alias("__range"))
    order = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"), (-F.col("__mark").cast("decimal(20,0)")).alias("mark"))
    heads = materialize(rows.groupBy("__range").agg(F.max(order).alias("head")).select("__range", "head.key", (-F.col("head.mark")).cast("long").alias("mark")), "range-heads")
    # each range is followed by the next range's head, the last one by the first's: a table of a row for each range
    found = heads.orderBy("__range").collect()
    follows = spark.createDataFrame([(a["__range"], b["key"], b["mark"]) for a, b in zip(found, found[1:] + found[:1], strict=True)], "r int, k long, m long")
    tails = rows.join(F.broadcast(follows), F.col(key).eqNullSafe(F.col("k")) & F.col("__mark").eqNullSafe(F.col("m"))).select(key, text, "__mark", F.col("r").alias("__range"), F.lit(True).alias("__tail"))
    both = rows.withColumn("__tail", F.lit(False)).unionByName(tails)
    # a range is a partition, by its number: hashed, ranges would meet in some and leave others empty
    return both.repartitionById(len(bounds) + 2, (F.col("__range") + F.lit(len(bounds))).cast("int")).sortWithinPartitions("__range", "__tail", F.col(key).desc_nulls_last(), "__mark")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # the last row, which waits for the one after it
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            if pending:
                rows.insert(0, pending)
            pending = rows[-1]
            for at in range(0, len(rows) - 1, 500):
                part = rows[at : at + 501]
                texts = [r[1] or "" for r in part]
                prints = [sketch(s) for s in shingle_sets([t.encode() for t in texts])]
                pairs = [i for i in range(len(part) - 1) if not part[i][3]]
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in pairs]
                coded = [e.encode() for e in edited]
                edits = [sketch(s) for s in shingle_sets(coded)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([part[i][0] for i in pairs], pa.int64()),
                        "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in coded],
                        "fingerprint": [pack(prints[i]) for i in pairs],
                        "edited_fingerprint": [pack(e) for e in edits],
                        "near_edited": [likeness(prints[i], e) for i, e in zip(pairs, edits, strict=True)],
                        "near_next": [likeness(prints[i], prints[i + 1]) for i in pairs],
                    },
                    schema=schema,
                )
        release()

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLES: dict[str, str] = {}
