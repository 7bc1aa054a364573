"""N-gram Jaccard join in metric space: exact links at a Jaccard similarity, and their components.

1 - Jaccard is a metric, and the radius is 1 - similarity. Shingles stand in one common order, those last that a sample
finds often or a first round of prefixes finds in more than a few documents; any order gives the same result, and the
lists that make it are bounded. The first shingles of a set, its prefix (a share of the radius, and `1 + extra`), hold at
least `1 + extra` shingles of any set within the radius, and the two sizes are within the similarity of each other.

1. Pivots. In each of two overlapping windows of sizes every prefix shingle elects a pivot, the document with the least
   seeded hash of those that have it there; who has the shingle sees that pivot. Linked sets share `1 + extra` elections
   at least, so a document that took part in fewer has no link and goes. One that took part in more may leave those of its
   pivots that the fewest shingles elected, as long as less than half of the `1 + extra` are lost: two that link lose
   less than all, and still see one pivot together.
2. Regions. A pivot's region holds all documents that see it; a document at the boundary of several is replicated to each.
   A region meets its pivot in pieces of bounded size, so a region of a third of all documents is spread over tasks.
   Documents within the radius of a pivot are linked to it.
3. Recursion. What is left are documents of a region that are not yet connected with its pivot. Only they, and those that
   the triangle inequality leaves (distance to the pivot within the radius of theirs), can have links not yet known. A
   region with too many gets sub-pivots and is parted into Voronoi cells, each document at home with the nearest one;
   documents at most two radii further from a sub-pivot than from their own, and within the radius of its cell's distances,
   are replicated to that cell. Within a task, a recursive Voronoi index (sub-pivots, cells, cell radii) is searched.
Links between documents already connected are not needed for components and are not looked for again.

Documents with equal sets are one class from the second step on, so copies cost little more. Components are found in tables.

Defined results: a document without words has the empty set and is linked with nothing; null is as empty; fewer words
than a shingle make one shingle; rows with one key are one document, linked if any of its texts is; a null key gets no
component and links nothing; an empty table makes no rows; other columns are handed on by `near_duplicates` only. A very
long text is a batch of arrays of its own; its set is held whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.llm.common import col, drop_table, materialize, others, release, small, small_batches, table
from tesela.llm.components import stars
from tesela.llm.shingles import WORDS, mix, shingle_sets, utf8

#: Percent. Two documents link at 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: One document in SAMPLE is looked at for frequent shingles; from FREQUENT times on (in one task's part twice), at most
#: FREQUENT_MOST of them, go last in the order. This steers the work, not the result.
SAMPLE, FREQUENT, FREQUENT_MOST = 4, 4, 500_000
#: A shingle that more than COMMON prefixes of the first round have goes last, too. Percent of a set's size by which its
#: prefix is longer than one shared shingle needs.
COMMON, EXTRA = 6, 5
#: Sizes of what a task holds at a time: prefix shingles, documents that meet a pivot, documents of a cell, and of a leaf;
#: and about how many documents search a cell in one task.
BUCKET_TOKENS, REGION_ROWS, BLOCK_ROWS, LEAF, SEARCH_ROWS = 1_000_000, 256, 500, 96, 1_000


def prefix_length(n: int, similarity: int = SIMILARITY) -> int:
    """So many first shingles of a set of n share 1 + n * EXTRA // 100, or as many as the other set's, with those of any
    set at the similarity or above."""
    return min(n, n - (similarity * n + 99) // 100 + 1 + n * EXTRA // 100) if n else 0


def needed(n: int, similarity: int = SIMILARITY) -> int:
    """So many prefix shingles at least a set of n shares with any set at the similarity or above."""
    return 1 + -(-similarity * n // 100) * EXTRA // 100


def size_class(n: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Classes of sizes; those of two sets that link are equal or neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100.01 / similarity)).astype(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


# ---- step 0: frequent shingles


def frequent_shingles(df: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """Sorted hashes of shingles that a sample of documents has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(utf8(batch.column(0)), words)
            if sets:
                hashes, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

    some = df.filter(F.pmod(F.xxhash64(F.lit("sample"), col(key)), F.lit(SAMPLE)) == 0).select(col(text))
    found = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(found.orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).select("h").toArrow()["h"].to_numpy().view(np.uint64))


# ---- step 1: sets, prefixes and regions


def codes(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle's bucket and the upper half of its hash. Two that agree are parted in the order alike, which is an order still."""
    return (tokens % np.uint64(buckets)) << np.uint64(32) | tokens >> np.uint64(32)


def _listed(s: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    """Which shingles of a set are among those that go last, a sorted list of codes."""
    if not len(last):
        return np.zeros(len(s), bool)
    code = codes(s, buckets)
    at = np.searchsorted(last, code)
    at[at == len(last)] = 0
    return last[at] == code


def _by_bucket(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Order by place, the places there are, and from where to where each one goes."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    at = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
    return order, place[at[:-1]], list(zip(at, at[1:], strict=False))


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(x: np.ndarray) -> bytes:
    """64-bit integers as the least one and what each has above it, in as few bytes as the most needs."""
    low, most = int(x.min()), int(x.max())
    width = next(w for w in _KINDS if most - low < 1 << 8 * w)
    return np.int64(low).tobytes() + (x.astype(np.int64).view(np.uint64) - np.int64(low).view(np.uint64)).astype(_KINDS[width]).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    above = np.frombuffer(data, _KINDS[(len(data) - 8) // n], offset=8).astype(np.uint64)
    return (above + np.frombuffer(data, np.uint64, 1)).view(np.int64)


def _common_shingles(df: DataFrame, key: str, text: str, words: int, similarity: int, buckets: int, frequent: np.ndarray) -> np.ndarray:
    """Codes of shingles that more than a few documents have in a first round of prefixes. Halves of hashes tell them apart in a bucket."""
    often = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        for batch in batches:
            sets = [s for k, s in zip(batch.column(0).to_pylist(), shingle_sets(utf8(batch.column(1)), words), strict=True) if len(s) and k is not None]
            if sets:
                code = codes(np.concatenate([s[~_listed(s, last, buckets)][: prefix_length(len(s), similarity)] for s in sets]), buckets)
                order, bucket, cuts = _by_bucket((code >> np.uint64(32)).astype(np.int32))
                halves = code[order].astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([halves[a:b].tobytes() for a, b in cuts], pa.binary())], names=["bucket", "halves"])
        release()

    first = df.select(col(key).cast("long").alias("key"), col(text)).mapInArrow(run, "bucket int, halves binary")
    found = first.repartition(buckets, "bucket").mapInArrow(_common, "code long, n long")
    return found.orderBy(F.desc("n"), "code").limit(FREQUENT_MOST).select("code").toArrow()["code"].to_numpy().view(np.uint64)


def _prefixes(df: DataFrame, key: str, text: str, words: int, similarity: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Rows of three kinds: (key, n, sig) a document; (bucket, tokens, keys, sizes) rare prefix shingles; (token, key, n) frequent ones."""
    often = df.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("token", pa.int64()), ("draw", pa.int64())])

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            sets = shingle_sets(utf8(batch.column(1)), words)
            yield rows(key=keys, n=[len(s) for s in sets], sig=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets])
            rare, rare_of, sizes, hot, hot_of, hot_sizes = [], [], [], [], [], []
            for k, s in zip(keys, sets, strict=True):
                if not len(s) or k is None:
                    continue
                known = _listed(s, last, buckets)
                first = s[~known]
                most = prefix_length(len(s), similarity)
                rare.append(first[:most])
                rare_of.append(np.full(len(rare[-1]), k, np.int64))
                sizes.append(np.full(len(rare[-1]), len(s), np.int32))
                if most > len(first):
                    hot.append(s[known][: most - len(first)])
                    hot_of.append(np.full(len(hot[-1]), k, np.int64))
                    hot_sizes.append(np.full(len(hot[-1]), len(s), np.int64))
            if hot:
                who = np.concatenate(hot_of)
                yield rows(token=np.concatenate(hot).view(np.int64), key=who, n=np.concatenate(hot_sizes), draw=draw(who))
            if rare:
                tokens, owner, size = np.concatenate(rare), np.concatenate(rare_of), np.concatenate(sizes)
                order, bucket, cuts = _by_bucket((tokens % np.uint64(buckets)).astype(np.int32))
                tokens, owner, size = tokens[order], owner[order], size[order]
                yield rows(bucket=bucket, tokens=[tokens[a:b].tobytes() for a, b in cuts], keys=[pack(owner[a:b]) for a, b in cuts], sizes=[pack(size[a:b]) for a, b in cuts])
        release()

    return df.select(col(key).cast("long").alias("key"), col(text)).mapInArrow(run, "key long, n long, sig binary, bucket int, tokens binary, keys binary, sizes binary, token long, draw long")


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of rows that are equal in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def draw(keys: np.ndarray) -> np.ndarray:
    """The seeded hash by which pivots are elected; the least one wins."""
    return mix(keys.view(np.uint64)).view(np.int64)


def _elected(similarity: int):
    """x, p, votes: of how many of x's prefix shingles of this bucket p is the pivot; x = p where it is x itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for i, kind in enumerate((np.uint64, np.int64, np.int32)):
                parts[i] += [np.frombuffer(x, kind) for x in batch.column(i).to_pylist()]
        if not parts[0]:
            return
        tokens = np.concatenate(parts[0])
        parts[0].clear()
        order = np.argsort(tokens, kind="stable")
        same = tokens[order[1:]] == tokens[order[:-1]]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # what one document alone has goes
        tokens = tokens[order]
        keys, sizes = (np.concatenate(x)[order] for x in parts[1:])
        parts.clear()
        first, count = _runs(tokens)
        token, kind = np.repeat(np.arange(len(first)), count), size_class(sizes, similarity)
        del tokens, sizes
        keys, token, window = np.tile(keys, 2), np.tile(token, 2), np.concatenate([kind, kind - 1])
        order = np.lexsort((draw(keys), window, token))
        keys, token, window = keys[order], token[order], window[order]
        first, count = _runs(token, window)
        pivot, several = np.repeat(keys[first], count), np.repeat((keys[first] != keys[first + count - 1]), count)
        keys, pivot, token = keys[several], pivot[several], token[several]
        order = np.lexsort((token, pivot, keys))
        keys, pivot, token = keys[order], pivot[order], token[order]
        once, _ = _runs(keys, pivot, token)  # a shingle counts once, even if both windows elect the same pivot
        keys, pivot = keys[once], pivot[once]
        first, count = _runs(keys, pivot)
        for at in range(0, len(first), 1 << 17):
            rows = first[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(pivot[rows]), pa.array(count[at : at + (1 << 17)])], names=["x", "p", "votes"])
        del keys, pivot, token, window, order, first, count, several, once
        release()

    return run


def _ballots(similarity: int, slots: int):
    """slot, x, p, votes: the rows of `_elected` as blocks, one for each slot of documents x; a pair is no row until it is counted."""
    found = _elected(similarity)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(t, unpack(k, len(t) // 8).tobytes(), unpack(n, len(t) // 8).astype(np.int32).tobytes()) for t, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.binary()) for i in range(3)], names=["tokens", "keys", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found(wide(batches)):
            if batch.num_rows:
                x, p, votes = (c.to_numpy() for c in batch.columns)
                order, slot, cuts = _by_bucket((mix(x.view(np.uint64)) % np.uint64(slots)).astype(np.int32))
                x, p, votes = x[order], p[order], votes[order].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(c, pa.binary()) for c in ([pack(x[a:b]) for a, b in cuts], [pack(p[a:b]) for a, b in cuts], [votes[a:b].tobytes() for a, b in cuts]))], names=["slot", "x", "p", "votes"])
        release()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, p, votes: of how many prefix shingles of x in all buckets p is the pivot."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for x, p, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            votes = np.frombuffer(v, np.int32)
            for held, c in zip(parts, (unpack(x, len(votes)), unpack(p, len(votes)), votes), strict=True):
                held.append(c)
    if not parts[0]:
        return
    x, p, votes = map(np.concatenate, parts)
    parts.clear()
    order = np.lexsort((p, x))
    x, p, votes = x[order], p[order], votes[order].astype(np.int64)
    first, _ = _runs(x, p)
    votes = np.add.reduceat(votes, first)
    for at in range(0, len(first), 1 << 17):
        rows = first[at : at + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]), pa.array(p[rows]), pa.array(votes[at : at + (1 << 17)])], names=["x", "p", "votes"])
    del x, p, votes, order, first
    release()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of prefix shingles of more than a few documents, and of how many."""
    code = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(h, np.uint32) | np.uint64(b) << np.uint64(32) for batch in batches for b, h in zip(*(c.to_pylist() for c in batch.columns), strict=True))]))
    first, n = _runs(code)
    yield pa.RecordBatch.from_arrays([pa.array(code[first][n > COMMON].view(np.int64)), pa.array(n[n > COMMON])], names=["code", "n"])
    del code
    release()


# ---- step 2: distances to the pivots


def _met(rows: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[tuple, int, int, int, np.ndarray]]:
    """(region and part, role, document, component, set) of rows p, part, role, x, comp, text."""
    for batch in rows:
        sets = shingle_sets(utf8(batch.column(5)), words)
        for p, part, role, x, comp, s in zip(*(batch.column(i).to_pylist() for i in range(5)), sets, strict=True):
            yield (p, part), role, x, comp, s


def _measured(words: int):
    """p, x, q, common, together: of documents x of region p and its pivots q the sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, pivots, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["p", "x", "q", "common", "together"])

        for where, role, x, _, s in _met(batches, words):
            if where != region:
                region, pivots = where, []
            if role == 0:
                pivots.append((x, s))
                continue
            for q, pivot in pivots:
                common = overlap(pivot, s)
                out.append((where[0], x, q, common, len(pivot) + len(s) - common))
            if len(out) >= 10_000:
                yield made()
                out.clear()
        yield made()
        release()

    return run


# ---- step 3: what the pivots leave


class Cells:
    """Sets in a recursive Voronoi index. `near` returns the numbers of all sets that link with the given one."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray | None = None, similarity: int = SIMILARITY, leaf: int = LEAF):
        self.sim, self.numbers = similarity, np.arange(len(sets)) if numbers is None else numbers
        self.cells: list[tuple[float, float, Cells]] = []
        own = [sets[i] for i in self.numbers.tolist()]
        if len(own) > leaf:
            pivots = np.linspace(0, len(own) - 1, max(2, int(len(own) ** 0.5) // 2)).astype(np.int64)
            self._index([own[i] for i in pivots.tolist()])
            away = np.stack([1 - self._common(s) / self._union(s) for s in own])
            home = away.argmin(axis=1)
            groups = [np.flatnonzero(home == c) for c in range(len(pivots))]
            if max(map(len, groups)) < 0.9 * len(own):  # else pivots do not part these sets
                for c, inside in enumerate(groups):
                    if len(inside):
                        d = away[inside, c]
                        self.cells.append((float(d.min()), float(d.max()), Cells(sets, self.numbers[inside], similarity, leaf)))
                    else:
                        self.cells.append((0.0, -1.0, None))
                return
        self._index(own)

    def _index(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def _common(self, s: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def _union(self, s: np.ndarray) -> np.ndarray:
        return np.maximum(1, self.sizes + len(s) - self._common(s))

    def near(self, s: np.ndarray) -> list[int]:
        common = self._common(s)
        union = self.sizes + len(s) - common
        if not self.cells:
            return self.numbers[(100 * common >= self.sim * union) & (common > 0)].tolist()
        away = 1 - common / np.maximum(1, union)
        reach = 1 - self.sim / 100 + 1e-9
        return [i for d, (low, high, cell) in zip(away.tolist(), self.cells, strict=True) if cell and low - reach <= d <= high + reach for i in cell.near(s)]


def _searched(words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, block, cells, joined, out = None, [], None, {}, []

        def root(c: int) -> int:
            while joined.setdefault(c, c) != c:
                joined[c] = c = joined[joined[c]]
            return c

        for where, role, x, comp, s in _met(batches, words):
            if where != region:
                region, block, cells, joined = where, [], None, {}
            if role == 0:
                block.append((x, comp, s))
                continue
            cells = cells or Cells([b[2] for b in block], similarity=similarity)
            for i in cells.near(s):
                a, b = root(block[i][1]), root(comp)
                if a != b:  # links inside what is connected add nothing
                    joined[max(a, b)] = min(a, b)
                    out.append((x, block[i][0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[], []])], names=["a", "b"])
        release()

    return run


def _cells(rows: DataFrame, measure, radius: float) -> DataFrame:
    """Regions with too many documents apart from their pivot, as rows of their Voronoi cells: p, part, role, x, comp.

    Rows p, x, comp, apart, left. Sub-pivots are about two for each cell's worth of the documents apart, by a seeded hash.
    A cell that is still too large is dealt into blocks, which all documents near the cell's border or in it search; a cell
    that many search is laid out once for each slice of them, so that neither side of a task grows with the region."""
    hashed = F.xxhash64(F.lit("cell"), "p", "x")
    apart = rows.filter("apart")
    drawn = apart.filter(F.pmod(hashed, F.col("left")) < F.ceil(2 * F.col("left") / BLOCK_ROWS)).select("p", "x")
    least = apart.groupBy("p").agg(F.min(F.struct(hashed.alias("h"), "x")).alias("m")).select("p", "m.x")
    subs = materialize(drawn.unionAll(least).distinct(), "jaccard-subs")
    parts = materialize(rows.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / REGION_ROWS).alias("parts")), "jaccard-sub-parts").withColumnRenamed("p", "r")
    members = rows.join(small(parts), F.col("p") == F.col("r")).select("p", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"), "x")
    heads = subs.join(small(parts), F.col("p") == F.col("r")).select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "x")
    away = materialize(measure(members, heads).select("p", "x", "q", "d", "far"), "jaccard-away")
    # a key of several texts visits all cells of its region, where all documents are then at home
    homes = away.groupBy(F.col("p").alias("hp"), F.col("x").alias("hx")).agg(F.min(F.struct("d", "q")).alias("home"), F.max(F.col("far") > F.col("d")).alias("wide"))
    homes = materialize(rows.join(homes, (F.col("p") == F.col("hp")) & (F.col("x") == F.col("hx"))).select("p", "x", "comp", "apart", "wide", "home.d", "home.q"), "jaccard-homes")
    spread = materialize(homes.filter("wide and apart").select(F.col("p").alias("wp")).distinct(), "jaccard-wide")
    homes = homes.join(small(spread), F.col("p") == F.col("wp"), "left").withColumn("apart", F.col("apart") | F.col("wp").isNotNull())
    cells = homes.filter("apart").groupBy(F.col("p").alias("cp"), F.col("q").alias("cq")).agg((F.min("d") - radius).alias("low"), (F.max("d") + radius).alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    cells = materialize(cells, "jaccard-cells")
    own = homes.select(F.col("p").alias("op"), F.col("x").alias("ox"), "comp", "wide", F.col("d").alias("nearest"))
    placed = away.join(own, (F.col("p") == F.col("op")) & (F.col("x") == F.col("ox"))).join(small(cells), (F.col("p") == F.col("cp")) & (F.col("q") == F.col("cq")))
    visits = placed.filter(F.col("wide") | ((F.col("d") <= F.col("nearest") + 2 * radius) & (F.col("d") >= F.col("low")) & (F.col("d") <= F.col("high"))))
    visits = materialize(visits.select("p", "q", "blocks", "x", "comp"), "jaccard-visits")
    # whoever is at home in a cell visits it, so every cell is in this table
    slices = materialize(visits.groupBy(F.col("p").alias("sp"), F.col("q").alias("sq"), "blocks").agg(F.ceil(F.count(F.lit(1)) / SEARCH_ROWS).alias("slices")), "jaccard-slices")
    place = (F.col("p") == F.col("sp")) & (F.col("q") == F.col("sq"))
    part = F.xxhash64("q", "block", "slice").alias("part")
    at_home = homes.filter("apart").select("p", "q", "x", "comp").join(small(slices), place).withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    at_home = at_home.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    visits = visits.drop("blocks").join(small(slices), place).withColumn("slice", _slice())
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return at_home.select("p", part, F.lit(0).alias("role"), "x", "comp").unionAll(visits.select("p", part, F.lit(1).alias("role"), "x", "comp"))


def _slice() -> Column:
    """The one of `slices` in which a document x searches."""
    return F.pmod(F.xxhash64(F.lit("slice"), "x"), F.col("slices"))


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """key, `n_shingles`, `component_id` of every row."""
    spark = df.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    buckets = max(4, -(-int(size / 6 * (1 - similarity / 100 + EXTRA / 100)) // BUCKET_TOKENS))
    # a first round of prefixes finds the shingles there that more than a few documents have; they go last in the second
    frequent = np.unique(codes(frequent_shingles(df, key, text, words), buckets))
    frequent = np.union1d(frequent, _common_shingles(df, key, text, words, similarity, buckets, frequent))
    made = materialize(_prefixes(df, key, text, words, similarity, buckets, frequent), "jaccard-prefixes")
    docs = materialize(made.filter("sig is not null").select("key", "n", "sig"), "jaccard-docs")
    # classes of equal sets: copies point to the smallest key
    equal = materialize(docs.filter("n > 0 and key is not null").groupBy("sig").agg(F.min("key").alias("first"), F.max("key").alias("other")).filter("first <> other").select(F.col("sig").alias("same"), "first"), "jaccard-equal")
    named, same = docs.filter("key is not null"), small(equal, 250_000)
    least = F.floor(F.ceil(F.col("n") * similarity / 100) * EXTRA / 100) + 1
    by_key = named.join(same, F.col("sig") == F.col("same"), "left").groupBy(F.col("key").alias("k")).agg((F.min("sig") < F.max("sig")).alias("several"), F.min("first").alias("r"), F.min(F.when(F.col("n") > 0, least)).cast("long").alias("need"))
    by_key = materialize(by_key, "jaccard-keys")
    copies = by_key.filter("not several and r <> k").select("k", "r")
    # a key with several sets keeps its own pairs, of all its texts, and is linked with its representatives
    own = named.join(small(by_key.filter("several").select("k")), F.col("key") == F.col("k"), "left_semi")
    bridges = own.join(same, F.col("sig") == F.col("same")).filter("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    # step 1: who sees which pivot, by how many shingles
    rare = made.filter("bucket is not null").select("tokens", "keys", "sizes", "bucket").repartition(buckets, "bucket").select("tokens", "keys", "sizes").mapInArrow(_ballots(similarity, buckets), "slot int, x binary, p binary, votes binary")
    # a document and its pivot come out of each bucket that holds a shingle of theirs
    rare = rare.repartition(buckets, "slot").select("x", "p", "votes").mapInArrow(_counted, "x long, p long, votes long")
    kind = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.01 / similarity))).cast("int")
    hot = made.filter("token is not null").select("token", "key", "draw", F.explode(F.array(kind, kind - 1)).alias("window"))
    heads = hot.groupBy("token", "window").agg(F.min(F.struct("draw", F.col("key").alias("p"))).alias("m"), F.min("key").alias("low"), F.max("key").alias("high"))
    heads = materialize(heads.filter("low <> high").select(F.col("token").alias("t"), F.col("window").alias("w"), "m.p"), "jaccard-heads")
    often = hot.join(small(heads), (F.col("token") == F.col("t")) & (F.col("window") == F.col("w"))).select(F.col("key").alias("x"), "p", F.lit(1).cast("long").alias("votes"))
    seen = materialize(rare.unionAll(often).groupBy("x", "p").agg(F.sum("votes").alias("votes")), "jaccard-seen")
    drop_table(made)
    votes = seen.groupBy(F.col("x").alias("voter")).agg(F.sum("votes").alias("all"))
    alive = materialize(votes.join(small(by_key), F.col("voter") == F.col("k")).filter(F.col("all") >= F.col("need")).select("k", "need"), "jaccard-alive")
    by_votes = Window.partitionBy("x").orderBy("votes", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = seen.filter("x <> p").join(small(alive), F.col("x") == F.col("k")).withColumn("lost", F.sum("votes").over(by_votes)).filter("lost > (need - 1) div 2").select("x", "p")
    pairs = kept.join(small(alive.select(F.col("k").alias("a"))), F.col("p") == F.col("a"), "left").select("x", "p", F.col("a").isNotNull().alias("alive"))
    for c in ("x", "p"):
        pairs = pairs.join(small(copies), F.col(c) == F.col("k"), "left").withColumn(c, F.coalesce("r", c)).drop("k", "r")
    pairs = materialize(pairs.filter("x <> p").groupBy("x", "p").agg(F.max("alive").alias("alive")), "jaccard-pairs")
    # step 2: a region has its pivot, if that may have links, and its documents; one alone has nothing to meet
    parts = pairs.groupBy(F.col("p").alias("q")).agg(F.ceil(F.count(F.lit(1)) / REGION_ROWS).alias("parts"), F.count(F.lit(1)).alias("all"), F.max("alive").alias("alive")).filter("alive or all > 1").select("q", "parts")
    parts = materialize(parts, "jaccard-parts")
    regions = materialize(pairs.join(small(parts), F.col("p") == F.col("q")).select("x", "p", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part")), "jaccard-regions")
    wanted = materialize(regions.select(F.col("x").alias("id")).unionAll(parts.select(F.col("q").alias("id"))).distinct(), "jaccard-wanted")
    texts = materialize(df.select(col(key).cast("long").alias("id"), col(text).alias("text")).join(small(wanted), "id", "left_semi"), "jaccard-texts")

    met: list[DataFrame] = []

    def meet(rows: DataFrame, run, schema: str) -> DataFrame:
        """Rows p, part, role, x, comp with their texts, those of a region's part together, role 0 first."""
        met.append(materialize(rows, "jaccard-met"))
        # few rows go to the texts, which then move once, to their regions
        with_text = texts.join(small(met[-1]), F.col("x") == F.col("id")).select("p", "part", "role", "x", "comp", "text")
        return with_text.repartition(tasks, "p", "part").sortWithinPartitions("p", "part", "role").mapInArrow(run, schema)

    def measure(members: DataFrame, pivots: DataFrame) -> DataFrame:
        """Rows p, part, x against the pivots p, part, x of the same region and part."""
        none = F.lit(None).cast("long").alias("comp")
        both = pivots.select("p", "part", F.lit(0).alias("role"), "x", none).unionAll(members.select("p", "part", F.lit(1).alias("role"), "x", none))
        met = meet(both, _measured(words), "p long, x long, q long, common long, together long")
        return met.groupBy("p", "x", "q").agg(F.min(1 - F.col("common") / F.col("together")).alias("d"), F.max(1 - F.col("common") / F.col("together")).alias("far"), F.max(F.col("common") * 100 >= F.col("together") * similarity).alias("near"))

    first_pivots = parts.select(F.col("q").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("q").alias("x"))
    measured = materialize(measure(regions, first_pivots), "jaccard-measured")
    links = measured.filter("near").select(F.col("x").alias("a"), F.col("p").alias("b"))
    linked = stars(links.unionAll(bridges))

    # what the pivots leave: documents not connected with their pivot, and those within the radius of them
    def comp_of(rows: DataFrame, column: str, name: str) -> DataFrame:
        found = small(linked).select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        return rows.join(found, F.col(column) == F.col("__n"), "left").withColumn(name, F.coalesce("__c", column)).drop("__n", "__c")

    known = materialize(comp_of(comp_of(measured.select("x", "p", "d", "far"), "x", "comp"), "p", "home"), "jaccard-known")
    radius = 1 - similarity / 100 + 1e-9
    apart = F.col("comp") != F.col("home")
    stats = known.groupBy(F.col("p").alias("q")).agg(F.count(F.when(apart, 1)).alias("left"), F.count(F.lit(1)).alias("all"), F.min(F.when(apart, F.col("d"))).alias("low"), F.max(F.when(apart, F.col("far"))).alias("high"))
    open_regions = materialize(stats.filter("left > 0 and all > 1").select("q", "left", F.ceil(F.col("all") / SEARCH_ROWS).alias("slices"), (F.col("low") - radius).alias("low"), (F.col("high") + radius).alias("high")), "jaccard-open")
    inside = known.join(small(open_regions), F.col("p") == F.col("q")).filter("far >= low and d <= high").select("p", "x", "comp", apart.alias("apart"), "left", "slices")
    inside = materialize(inside, "jaccard-inside")
    one = inside.filter(F.col("left") <= BLOCK_ROWS)
    laid = one.filter("apart").select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("part"), F.lit(0).alias("role"), "x", "comp")
    rest = laid.unionAll(one.select("p", _slice().alias("part"), F.lit(1).alias("role"), "x", "comp"))
    large = inside.filter(F.col("left") > BLOCK_ROWS).drop("slices")
    if large.limit(1).count():
        rest = rest.unionAll(_cells(large, measure, radius))
    late = materialize(meet(rest, _searched(words, similarity), "a long, b long"), "jaccard-late")
    # join the components found at first by the late links
    ends = comp_of(comp_of(late, "a", "a1"), "b", "b1").select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    merged = stars(ends).select(F.col("node").alias("m"), F.col("comp").alias("into"))
    out = docs.join(small(copies), F.col("key") == F.col("k"), "left").withColumn("node_of", F.coalesce("r", "key"))
    out = comp_of(out, "node_of", "comp").join(small(merged), F.col("comp") == F.col("m"), "left")
    for done in (equal, heads, seen, alive, pairs, parts, regions, wanted, texts, measured, known, open_regions, inside, late, *met):
        drop_table(done)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("into", "comp").alias("component_id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The input without the near duplicates: of each component the document with the smallest key stays."""
    classes = near_duplicate_classes(df, key, text, words, similarity)
    gone = materialize(classes.filter(f"component_id <> `{key}`").select(col(key).alias("__gone")).distinct(), "jaccard-gone")
    return df.select(*map(col, others(df, []))).join(small(gone), col(key) == F.col("__gone"), "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}
