"""SimHash near-duplicates: fingerprints of 64 bits, linked at 3 or fewer differing bits, through an index of positional bytes.

Two fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share 5 positional bytes at
least: that is the guaranteed count. The inverted index lists distinct fingerprints (copies are one) under positional
bytes, three at a time: of any 5 shared positions three lie in one half of the 8, so each pair meets in one of the 8 lists
of three positions within a half, and lists have 1 in 2^24 of unlike fingerprints. In a list the shared positional bytes of
each pair are tallied; pairs that reach the count are verified bit by bit.

A list of more than LIST fingerprints (near copies in masses, texts of one template) is never held whole: it is listed
again under a fourth and a fifth positional byte, which its pairs must share too, and then under three of the six nibbles
that are left, of which at most three differ. Those lists have 2^12 = LIST members at most, so no list is ever cut or dropped.
Of a list's links only those that join what it had not joined are handed on; classes are the same, and there are fewer rows
than fingerprints instead of all pairs.

Defined results: a null text counts as empty; texts without words have fingerprint zero, which links like any other; one
with fewer than three words is one shingle; a null key belongs to its text's class but never names it (a class of null keys
alone has a null id); repeated rows give repeated rows; an empty table makes no rows; columns besides key and text are not
read. Texts are hashed in blocks of a MB, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import LOWER, UPPER, col, drop_table, materialize, release, small, small_batches, table
from tesela.llm.components import components
from tesela.llm.shingles import utf8

WORDS, SEED, BITS, LEAST, LIST = 3, 42, 3, 5, 1 << 12
BLOCK_BYTES = 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text in parts of about that size, parted at white space."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + size) if at + size < len(text) else None
        yield text[at : end.start() if end else len(text)]
        at = end.start() if end else len(text)


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every shingle; of the whole sequence if it is shorter."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > WORDS:
        starts, ends = starts[: 1 - WORDS], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    parts = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def simhash(text: bytes) -> int:
    """Each bit is that of most shingles; 0 for a text without words, and for a tie."""
    total, counts, left = 0, np.zeros(64, np.int64), []

    def add(words: list[bytes]) -> int:
        found = hashes(words).astype("<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[8 * j : 8 * j + 8] += np.bincount(found[:, j], minlength=256) @ _SET
        return len(found)

    for part in blocks(text):
        left += part.translate(_LOWER).split()
        if len(left) >= WORDS:  # else they wait for the next part's words
            total += add(left)
            left = left[1 - WORDS :]
    if left and not total:
        total = add(left)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` (the input's type) and `fp`, the fingerprint as a signed long, of every row."""
    small_batches(df.sparkSession)
    rows = df.select(col(key).alias("key"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(simhash, utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])
        release()

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _octet(*places: int) -> int:
    return sum(0xFF << 8 * p for p in places)


def levels() -> Iterator[dict[int, list[int]]]:
    """Bits under which fingerprints are listed: of each list that is too long, by its bits, those of the lists it is dealt to."""
    now = [_octet(*x) for half in (range(4), range(4, 8)) for x in combinations(half, 3)]
    yield {0: now}
    for _ in range(2):
        # whatever is still to be shared, a pair shares one of any four positions that are left
        step = {m: [m | _octet(p) for p in [p for p in range(8) if not m & _octet(p)][:4]] for m in now}
        yield step
        now = sorted({x for found in step.values() for x in found})
    yield {m: [m | sum(15 << 4 * p for p in x) for x in combinations([p for p in range(16) if not m & 15 << 4 * p], 3)] for m in now}


def tally(mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists, which stand one after another: rows of pairs that share LEAST bytes and differ in BITS bits at most.

    Pairs are met by their distance in the list, all lists at once. Links between rows that are joined already are left out."""
    fp = fp.view(np.uint64)
    listed = fp & mask.view(np.uint64)
    root, one, two = np.arange(len(fp)), [], []
    at, far = np.arange(len(fp)), 0

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while True:
        far += 1
        at = at[at + far < len(fp)]
        at = at[(mask[at] == mask[at + far]) & (listed[at] == listed[at + far])]
        if not len(at):
            break
        differ = fp[at] ^ fp[at + far]
        octets = differ | differ >> np.uint64(4)
        octets |= octets >> np.uint64(2)
        octets |= octets >> np.uint64(1)
        shared = 8 - np.bitwise_count(octets & np.uint64(0x0101010101010101))
        enough = np.flatnonzero(shared >= LEAST)
        a = at[enough[np.bitwise_count(differ[enough]) <= BITS]]
        a = a[root[a] != root[a + far]]
        for i in a.tolist():
            x, y = top(i), top(i + far)
            if x != y:
                root[max(x, y)] = min(x, y)
                one.append(i)
                two.append(i + far)
    return np.array(one, np.int64), np.array(two, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists at a time: what may go on in the next batch waits for it."""
    rest = (np.empty(0, np.int64), np.empty(0, np.int64))

    def measured(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = tally(mask, fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    for batch in batches:
        mask, fp = (np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest))
        if len(fp):
            last = int(np.argmax((mask == mask[-1]) & (fp & mask == fp[-1] & mask[-1])))  # the first row of the last list
            rest = mask[last:], fp[last:]
            yield measured(mask[:last], fp[:last])
    yield measured(*rest)


def near_links(distinct: DataFrame, limit: int = LIST) -> DataFrame:
    """Links `a`, `b` that join the distinct fingerprints `fp` into the classes of all pairs at BITS or fewer differing bits."""
    spark = distinct.sparkSession
    *steps, end = levels()
    rows, links = None, None
    for step in [*steps, end]:
        if rows is None:
            lists = F.array(*[F.lit(_signed(m)) for m in step[0]])
            listed = distinct.select("fp", F.explode(lists).alias("mask"))
        else:
            # a table of at most some thousand rows, whatever the input
            deal = spark.createDataFrame([(_signed(m), _signed(x)) for m, found in step.items() for x in found], "mask long, bits long")
            listed = rows.join(F.broadcast(deal), "mask").select("fp", F.col("bits").alias("mask")).distinct()  # lists of several long ones
        listed = listed.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        short, long = listed, None
        if step is not end:  # there a list has 2^12 members at most
            long = materialize(listed.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("mask", "shared"), "simhash-long")
            short = listed.join(small(long), ["mask", "shared"], "left_anti")
        found = materialize(short.repartition("mask", "shared").sortWithinPartitions("mask", "shared").select("mask", "fp").mapInArrow(_links, "a long, b long"), "simhash-links")
        links = found if links is None else links.unionAll(found)
        if long is None or not long.limit(1).count():
            break
        rows = materialize(listed.join(small(long), ["mask", "shared"], "left_semi").select("fp", "mask"), "simhash-rows")
    return links


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIST) -> DataFrame:
    """`key`, `fingerprint` (16 hex digits) and `component_id`, the smallest key that can be reached by links, of every row."""
    docs = materialize(fingerprints(df, key, text), "simhash")
    # copies are one fingerprint before anything is listed; counts are partial sums before they are shuffled
    kinds = materialize(docs.groupBy("fp").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-kinds")
    linked = materialize(components(near_links(kinds.select("fp"), limit)), "simhash-linked")
    lows = materialize(linked.join(kinds, linked["node"] == kinds["fp"]).groupBy("comp").agg(F.min("low").alias("least")), "simhash-lows")
    linked_lows = linked.join(small(lows), "comp").select(F.col("node").alias("fp"), "least")
    groups = kinds.select("fp", "low", "n").join(linked_lows, "fp", "left").filter("n > 1 or least is not null")
    groups = materialize(groups.select(F.col("fp").alias("of"), F.coalesce("least", "low").alias("least")), "simhash-groups")
    for done in (kinds, linked, lows):
        drop_table(done)
    named = docs.join(small(groups), F.col("fp") == F.col("of"), "left")
    return named.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("least", "key").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_simhash": op11_simhash}
ORACLES: dict[str, str] = {}
