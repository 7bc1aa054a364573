"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; the energy of each frame's spectrum is folded into twelve pitch classes,
smoothed over time and scaled to length one. Sixteen filters, differences of rectangles of that image, are read from its
integral image at every frame and quantized to two bits each: one 32-bit integer for each position. Integers of two
recordings that are equal in their high bits vote for their offset; at the offset with most votes the share of unequal bits tells whether they match.

Recordings with equal fingerprints are one class. A search takes a stated set of queries against all classes, in blocks:
each block of queries is an index of sorted integers in memory, past which all classes stream; blocks are searched by
many tasks, each with a share of the classes. No pairs are made but the matches.

Defined results: a null, empty or too short recording has no integers and matches nothing; its class is itself; silence
has integers like any sound; equal rows are one class; of offsets with equal votes the smallest in size, then the smaller
one counts; rows with a null id are left out of classes and searches; an empty table makes no rows; other columns, whatever
their names, are not handed on. A very long recording is decoded whole by one task and is searched as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import col, materialize, small, table

RATE, FRAME, HOP = 5512, 2048, 344
LOWEST, HIGHEST, SMOOTH = 60.0, 2000.0, np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
#: Width in frames of the widest filter.
WIDEST = 16
# The three bounds between the four levels of each filter's response (quartiles over 600 melodies).
LEVELS = np.array(
    [
        [-0.25, 0.0, 0.25],
        [-0.11, 0.43, 1.11],
        [-0.4, 0.01, 0.4],
        [-0.4, 0.0, 0.4],
        [-1.04, -0.56, -0.13],
        [-0.69, -0.63, -0.57],
        [-0.46, -0.0, 0.45],
        [-0.87, -0.4, 0.05],
        [-0.22, -0.0, 0.23],
        [-0.23, -0.0, 0.24],
        [-0.7, -0.11, 0.4],
        [-0.17, 0.01, 0.16],
        [-0.46, -0.0, 0.46],
        [0.05, 0.5, 0.95],
        [-0.42, 0.01, 0.42],
        [-0.4, -0.0, 0.39],
    ]
)
#: Integers vote by their high bits, those of the first filters; noise in the others leaves the vote.
VOTE_BITS, VOTES, BIT_ERROR, OVERLAP, BLOCK = 16, 2, 0.3, 24, 2_000
_fold: list = []


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, pitch class, classes, frames): kinds in turn, with classes and widths that spread over the image."""
    return [(k % 6, (5 * k) % 12 if k % 6 else 0, (3, 12, 4, 6)[k % 4] if k % 6 else 12, (4, 8, 12, 16)[(k // 2) % 4]) for k in range(16)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames of mono samples, one row a frame."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.empty((0, 12), np.float32)
    if not _fold:
        freq = np.fft.rfftfreq(FRAME, 1 / RATE)
        bins = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
        note = (12 * np.log2(freq[bins] / 440.0)) % 12
        fold = np.zeros((len(bins), 12), np.float32)
        low = np.floor(note).astype(int)
        fold[np.arange(len(bins)), low % 12] = 1 - (note - low)  # a tone between two classes counts for both
        fold[np.arange(len(bins)), (low + 1) % 12] += note - low
        _fold.extend((bins, fold, np.hanning(FRAME).astype(np.float32)))
    bins, fold, window = _fold
    frames = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(samples, np.float32), FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * window, axis=1)[:, bins]).astype(np.float32) ** 2
    image = energy @ fold
    if len(image) >= len(SMOOTH):
        image = sum(w * image[k : len(image) - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    length = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(length > 1e-6, image / np.maximum(length, 1e-6), 0).astype(np.float32)


def responses(image: np.ndarray) -> np.ndarray:
    """Of every position the sixteen filters' responses, from the integral image."""
    n = len(image) - WIDEST + 1
    if n < 1:
        return np.empty((0, 16))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x1: int, x2: int, y1: int, y2: int) -> np.ndarray:
        return total[at + x2, y2] - total[at + x1, y2] - total[at + x2, y1] + total[at + x1, y1]

    out = []
    for kind, y, h, w in filters():
        y = min(y, 12 - h)
        up, mid, third = y + h // 2, w // 2, w // 3
        if kind == 0:  # later against earlier, all classes from y
            a, b = area(mid, w, y, y + h // 2), area(0, mid, y, y + h // 2)
        elif kind == 1:  # upper against lower classes
            a, b = area(0, w, up, y + h), area(0, w, y, up)
        elif kind == 2:  # later against earlier frames
            a, b = area(mid, w, y, y + h), area(0, mid, y, y + h)
        elif kind == 3:  # crossed quarters
            a = area(0, mid, up, y + h) + area(mid, w, y, up)
            b = area(0, mid, y, up) + area(mid, w, up, y + h)
        elif kind == 4:  # middle classes against those beside them
            t = h // 3
            a, b = area(0, w, y + t, y + h - t), area(0, w, y, y + t) + area(0, w, y + h - t, y + h)
        else:  # middle frames against those beside them
            a, b = area(third, w - third, y, y + h), area(0, third, y, y + h) + area(w - third, w, y, y + h)
        out.append(np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))))
    return np.stack(out, axis=1)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """32-bit integers of a recording: two bits for each filter, in a code where neighbouring levels differ in one bit."""
    r = responses(chroma(samples))
    level = np.array([0, 1, 3, 2], np.uint32)[(r[:, :, None] >= LEVELS).sum(axis=2)]
    out = np.zeros(len(r), np.uint32)
    for k in range(r.shape[1]):
        out = out << np.uint32(2) | level[:, k]
    return out


def pcm(cell: bytes | None) -> np.ndarray:
    """Samples of 16-bit mono PCM at RATE; a last odd byte is left out."""
    return np.frombuffer(cell[: len(cell) // 2 * 2], "<i2").astype(np.float32) / 32768 if cell else np.empty(0, np.float32)


def fingerprints(df: DataFrame, key: str, media: str, samples: Callable = pcm) -> DataFrame:
    """key, `fingerprint` (its integers as little-endian bytes) of every row; `samples` decodes a cell of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(samples(x)).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["key", "fingerprint"])

    return df.select(col(key).cast("long").alias("key"), col(media)).mapInArrow(run, "key long, fingerprint binary")


class Index:
    """Fingerprints of a block of queries by their integers."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints, self.longest = prints, max(map(len, prints), default=0)
        items = (np.concatenate(prints) if prints else np.empty(0, np.uint32)) >> np.uint32(32 - VOTE_BITS)
        order = np.argsort(items, kind="stable")
        self.items = items[order]
        self.owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])[order]
        self.place = np.concatenate([np.arange(len(p)) for p in prints])[order] if prints else order

    def align(self, other: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, votes, bit error) of all that match: query position + offset = position in `other`."""
        vote = other >> np.uint32(32 - VOTE_BITS)
        a, b = np.searchsorted(self.items, vote, "left"), np.searchsorted(self.items, vote, "right")
        n = b - a
        if not n.any():
            return []
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shift = np.repeat(np.arange(len(other)), n) - self.place[at]
        wide = len(other) + self.longest  # one number for each query and offset
        pairs, votes = np.unique(self.owner[at] * (2 * wide) + shift + wide, return_counts=True)
        enough = votes >= VOTES
        if not enough.any():
            return []
        votes, queries, offsets = votes[enough], pairs[enough] // (2 * wide), pairs[enough] % (2 * wide) - wide
        order = np.lexsort((offsets, np.abs(offsets), -votes, queries))
        best = order[np.concatenate([[True], np.diff(queries[order]) > 0])]
        out = []
        for query, offset, count in zip(queries[best].tolist(), offsets[best].tolist(), votes[best].tolist(), strict=True):
            mine = self.prints[query]
            start, stop = max(0, -offset), min(len(mine), len(other) - offset)
            if stop - start >= OVERLAP:
                error = float(np.bitwise_count(mine[start:stop] ^ other[start + offset : stop + offset]).sum()) / (32 * (stop - start))
                if error <= BIT_ERROR:
                    out.append((query, offset, count, error))
        return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, part, role, key, fingerprint, sorted: the queries of a block, then the classes that pass them."""
    names, kinds = ["query", "key", "offset", "votes", "bit_error"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    where, keys, prints, index = None, [], [], None
    for batch in batches:
        out = []
        for block, part, role, key, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (block, part) != where:
                where, keys, prints, index = (block, part), [], [], None
            items = np.frombuffer(data, "<u4")
            if role == 0:
                keys.append(key)
                prints.append(items)
                continue
            index = index or Index(prints)
            out += [(keys[q], key, offset, votes, error) for q, offset, votes, error in index.align(items) if keys[q] != key]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)


def search(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """`key`, `fingerprint` of queries against those of all classes -> query, key, offset, votes, bit_error of every match."""
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), "key", "fingerprint")
    passed = classes.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "key", "fingerprint")
    rows = asked.unionAll(passed).repartition(parts, "block", "part").sortWithinPartitions("block", "part", "role")
    return rows.mapInArrow(_search, "query long, key long, offset long, votes long, bit_error double")


def sonify(vector: list[float] | None) -> np.ndarray:
    """A vector as a melody: each value a note of an eighth of a second, about three semitones for each deviation from 0."""
    if not vector:
        return np.empty(0, np.float32)
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    v = v / max(1e-12, float(np.sqrt((v**2).mean())))
    pitch = 330.0 * 2.0 ** (np.clip(3 * v, -18, 18) / 12)
    phase = np.repeat(pitch * (2 * np.pi / RATE), RATE // 8).cumsum() % (2 * np.pi)
    phase = phase.astype(np.float32)
    return np.sin(phase) + 0.5 * np.sin(2 * phase)


def op10_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so every row of `embeddings` is rendered as a recording of its own. Queries are the rows
    whose id is divisible by 20. A row each: its class, and, where the row stands for a class with a query in it, the links."""
    prints = materialize(fingerprints(table(spark, sf_dir, "embeddings").filter("vec_id is not null"), "vec_id", "embedding", sonify), "audio-prints")
    marked = prints.withColumn("mark", F.when(F.length("fingerprint") > 0, F.sha2("fingerprint", 256)).otherwise(F.concat(F.lit("none "), F.col("key").cast("string"))))
    members = marked.groupBy("mark").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n"), F.max(F.col("key") % 20 == 0).alias("asked"))
    members = materialize(members, "audio-classes")
    known = marked.join(small(members), "mark")
    classes = materialize(known.filter("key = class_id and length(fingerprint) > 0").select("key", "fingerprint", "asked").dropDuplicates(["key"]), "audio-reps")
    found = search(classes.filter("asked").select("key", "fingerprint"), classes.select("key", "fingerprint"))
    links = materialize(found.groupBy(F.col("query").alias("q")).agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("class_id"), "offset", "votes", "bit_error"))).alias("links")), "audio-links")
    out = known.join(links, F.col("key") == F.col("q"), "left")
    text = F.regexp_replace(F.base64("fingerprint"), "[\r\n]", "")
    return out.select(
        F.col("key").alias("vec_id"),
        "class_id",
        (F.length("fingerprint") / 4).cast("long").alias("n_items"),
        text.alias("fingerprint"),
        F.col("asked").alias("is_query_class"),
        F.when(F.col("asked") & (F.col("key") == F.col("class_id")), F.coalesce(F.size("links"), F.lit(0)).cast("long")).alias("n_links"),
        "links",
    )


QUERIES = {"op10_audio_fingerprints": op10_audio_fingerprints}
ORACLES: dict[str, str] = {}
