"""Packing of token sequences by non-negative least squares over a histogram of lengths.

Documents are cut into whole windows and a remainder. The histogram of the remainders' lengths, at most one bin for each
length, is all that the driver sees. It enumerates the pairs and triples of lengths that fill a window exactly (a twelfth
of the window's square at most), solves how often to use each by non-negative least squares against the histogram, and
rounds down. The solve starts with the pairs and takes in those triples that would still lessen the error, until no other
would: what it leaves out has no part in the solution of all patterns. What is left over is packed
greedily: the longest piece first, then always the longest that fits; where nothing fits, a piece is cut to fill the gap
and its other part stays to be packed. Only the very last sequence can stay short; it is cut into powers of two.

The plan speaks of the r-th piece of a length. Ranks come from counts by length and a hash of the document, so a length
that a third of all documents have is numbered by many tasks. Token ids are computed where a piece is made and thrown
away; those of the few pieces that the plan cuts are computed again.

Defined results: a null text counts as empty, so its document is one end token; a document is known by key and text, and
rows equal in both are packed each; an empty table makes no rows; other columns of the input are not handed on. A very long
text is encoded whole, in a slice of its own, and makes a piece for each window; the remainder is packed like any other."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.llm.common import col, materialize, release, small, small_batches, table

TOKENIZER, WINDOW_IDS, END = "word_bpe_49k.json", 2048, 1
#: Steps of the least squares for each set of patterns, patterns taken in at a time, and the gain below which none is.
ROUNDS, TAKEN, GAIN = 150, 8_192, 0.5
CACHE_WORDS, RANK_ROWS, SLICE_BYTES = 400_000, 20_000, 4 << 20
_PIECES = "key {k}, mark long, start long, length long, ids_crc32 long, doc_tokens long"


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers; words are what stands between blanks and line feeds.

    The tokenizer drops white space and never joins signs across it, so a text's ids are its words' ids end to end. A new
    word of Latin-1 signs is cut into the tokenizer's pieces and merged by ranks: a merged token is the only one of its
    bytes, and the word's end is one more byte that merges first. Any other word goes through the tokenizer itself."""

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self[""] = b""
        with open(path) as f:
            spec = json.load(f)
        self.merge = None
        norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        steps, cuts = [x["type"] for x in norm.get("normalizers", [])], pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and model.get("end_of_word_suffix") == "</w>":
            self.special = tuple(x["content"][:2] for x in spec["added_tokens"])
            self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall
            self._ranks(model)

    def _ranks(self, model: dict) -> None:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as they are
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        byte = {c: bytes([b]) for b, c in sign.items()}
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        self.id_of = [vocab[sign[b]] for b in range(256)] + [vocab[sign[b] + end] for b in range(256)]
        for pair in model["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            data = b"".join(byte[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end)
            ranks[data] = len(self.id_of)
            self.id_of.append(vocab[token])
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def forget(self) -> None:
        """Lets the remembered words go; the tokenizer stays."""
        self.clear()
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.forget()
        ids = None
        if self.merge and not any(x in word for x in self.special):
            try:
                word.encode("latin-1")
                of, merge = self.id_of, self.merge
                ids = [of[r] for piece in self.cut(word.lower()) for r in merge(piece.encode() + b"\xff")]
            except UnicodeEncodeError:
                pass
        if ids is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = found = array("I", ids).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        find = self.__getitem__
        return [b"".join(map(find, t.replace("\n", " ").split(" "))) for t in texts]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The worker's own encoder."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _coded(texts: list[str | None], path: str, end: bytes) -> Iterator[bytes]:
    at, size, part = words_of(path), 0, []
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > SLICE_BYTES:
            yield from (ids + end for ids in at.encode(part))
            size, part = 0, []
    yield from (ids + end for ids in at.encode(part))


# ---- the plan, on the driver, from the histogram alone


def patterns(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and triples of lengths that occur and fill the window exactly, as rows of three (0: none)."""
    window = len(hist) - 1
    there = np.flatnonzero(hist[:window])
    there = there[there > 0]
    pairs = np.stack([i := there[(there <= window // 2) & (hist[window - there] > 0)], window - i, np.zeros_like(i)], axis=1)
    triples = [np.empty((0, 3), np.int64)]
    for i in there[there <= window // 3].tolist():
        j = there[(there >= i) & (there <= (window - i) // 2)]
        k = window - i - j
        ok = hist[k] > 0
        triples.append(np.stack([np.full(ok.sum(), i), j[ok], k[ok]], axis=1))
    return pairs, np.concatenate(triples)


def _error(rows: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """How many pieces of each length the patterns use, less those that there are."""
    short = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=len(hist)) - hist
    short[0] = 0
    return short


def least_squares(rows: np.ndarray, hist: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimizes |A x - hist|, A counting the lengths of each pattern, by accelerated projected gradient."""
    if not len(rows):
        return np.empty(0)
    flat = rows.ravel()
    step = 1.0 / max(1.0, 3 * np.bincount(flat[flat > 0]).max())
    x = y = np.zeros(len(rows)) if start is None else start
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0.0, y - step * _error(rows, y, hist)[rows].sum(axis=1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def solve(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often to use each: least squares over all pairs and triples, by taking in those that gain."""
    rows, rest = patterns(hist)
    x = least_squares(rows, hist)
    while len(rest):
        gain = -_error(rows, x, hist)[rest].sum(axis=1)
        best = np.argsort(-gain, kind="stable")[:TAKEN]
        best = best[gain[best] > GAIN]
        if not len(best):
            break
        rows, rest = np.concatenate([rows, rest[best]]), np.delete(rest, best, axis=0)
        x = least_squares(rows, hist, np.concatenate([x, np.zeros(len(best))]))
    return rows, x


class Plan:
    """Where the r-th piece of a length goes: for each length, breaks of r and, between them, the segments
    (start in the piece, length, sequence of the first r, offset, r of that sequence)."""

    def __init__(self, hist: np.ndarray):
        self.window = len(hist) - 1
        self.sequences = 0
        self.placed: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        # runs of pieces still to pack, by their present length: (length of the piece, first rank, number, start)
        self.open = {int(n): [(int(n), 0, int(c), 0)] for n, c in enumerate(hist) if c and n}
        self.left = {n: runs[0][2] for n, runs in self.open.items()}
        self.sizes = sorted(self.left)
        if self.left.get(self.window):
            self._use([self.window], self.left[self.window])
        rows, x = solve(hist)
        self.solved = 0
        for at in np.argsort(-x, kind="stable"):
            if x[at] < 1:
                break
            parts = [n for n in rows[at].tolist() if n]
            if times := min([int(x[at]), *(self.left.get(n, 0) // parts.count(n) for n in parts)]):
                self._use(parts, times)
                self.solved += times
        while self.sizes:
            self._greedy()
        self.tables = {n: self._table(segments) for n, segments in self.placed.items()}

    def _take(self, size: int, number: int) -> list[tuple[int, int, int, int]]:
        got, runs = [], self.open[size]
        self.left[size] -= number
        while number:
            piece, rank, count, start = runs.pop()
            if count > number:
                runs.append((piece, rank + number, count - number, start))
                count = number
            got.append((piece, rank, count, start))
            number -= count
        if not self.left[size]:
            del self.left[size], self.open[size]
            self.sizes.remove(size)
        return got

    def _place(self, runs: list, length: int, offset: int) -> None:
        first = self.sequences
        for piece, rank, count, start in runs:
            self.placed.setdefault(piece, []).append((rank, count, start, length, first, offset))
            first += count

    def _use(self, parts: list[int], times: int, cut: int = 0) -> None:
        """Packs the parts, `times` over; of the last part only `cut` ids, if given, the rest stays open."""
        offset = 0
        for at, size in enumerate(parts):
            runs = self._take(size, times)
            length = cut if cut and at == len(parts) - 1 else size
            self._place(runs, length, offset)
            if length < size:
                rest = size - length
                self.open.setdefault(rest, []).extend((p, r, c, s + length) for p, r, c, s in runs)
                if rest not in self.left:
                    insort(self.sizes, rest)
                self.left[rest] = self.left.get(rest, 0) + times
            offset += length
        self.sequences += times

    def _greedy(self) -> None:
        parts, used, room = [], {}, self.window
        while room and (at := bisect_right(self.sizes, room)):
            while at and self.left[self.sizes[at - 1]] == used.get(self.sizes[at - 1], 0):
                at -= 1
            if not at:
                break
            size = self.sizes[at - 1]
            parts.append(size)
            used[size] = used.get(size, 0) + 1
            room -= size
        cut = 0
        if room:  # the shortest piece that is left and too long for the gap fills it
            more = next((n for n in self.sizes[bisect_left(self.sizes, room) :] if self.left[n] > used.get(n, 0)), None)
            if more is None:
                return self._last(parts)
            cut = room
            parts.append(more)
            used[more] = used.get(more, 0) + 1
        self._use(parts, min(self.left[n] // c for n, c in used.items()), cut)
        return None

    def _last(self, parts: list[int]) -> None:
        """The rest of the corpus, less than a window: sequences of powers of two, without padding."""
        total = sum(parts)
        rooms = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        offset = 0
        for size in parts:
            ((piece, rank, count, start),) = self._take(size, 1)
            while size:
                length = min(size, rooms[0] - offset)
                self._place([(piece, rank, count, start)], length, offset)
                start, size, offset = start + length, size - length, offset + length
                if offset == rooms[0]:
                    rooms.pop(0)
                    self.sequences += 1
                    offset = 0

    @staticmethod
    def _table(segments: list) -> tuple[list[int], list[list[tuple[int, int, int, int, int]]]]:
        breaks = sorted({r for s in segments for r in (s[0], s[0] + s[1])})
        at = {b: i for i, b in enumerate(breaks)}
        inside: list[list] = [[] for _ in breaks]
        for rank, count, start, length, first, offset in sorted(segments, key=lambda s: s[2]):
            for i in range(at[rank], at[rank + count]):
                inside[i].append((start, length, first, offset, rank))
        return breaks, inside

    def find(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """The segments (start, length, sequence, offset) of the piece of that length and rank."""
        breaks, inside = self.tables[length]
        return [(s, n, first + rank - r0, off) for s, n, first, off, r0 in inside[bisect_right(breaks, rank) - 1]]


# ---- the distributed part


def pieces(df: DataFrame, key: str, text: str, path: str, window: int, end: int) -> DataFrame:
    """Whole windows and the remainder of every document, with the CRC-32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = array("I", [end]).tobytes()
        for batch in batches:
            owner, start, length, crc, total = [], [], [], [], []
            for row, ids in enumerate(_coded(batch.column(2).to_pylist(), path, stop)):
                view, n = memoryview(ids), len(ids) // 4
                for at in range(0, n, window):
                    owner.append(row)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(view[4 * at : 4 * (at + window)]))
                    total.append(n)
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=names)
        words_of(path).forget()
        release()

    names = ["key", "mark", "start", "length", "ids_crc32", "doc_tokens"]
    return df.select(col(key).alias("key"), F.xxhash64(col(text)).alias("mark"), col(text).alias("text")).mapInArrow(run, _PIECES.format(k=df.schema[key].dataType.simpleString()))


def ranked(made: DataFrame, total: int) -> DataFrame:
    """Adds `rank`, from 0 without gaps among the pieces of a length."""
    salts = max(1, -(-total // RANK_ROWS))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("key", "mark", "start"), F.lit(salts)).cast("int"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "mark", "start")) - 1
    return salted.withColumn("place", place).join(bases, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("base") + F.col("place")).drop("l", "s", "salt", "place", "base")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_IDS, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, path = df.sparkSession, tokenizer or tokenizer_path()
    small_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    made = materialize(pieces(df, key, text, path, window, end), "pack-pieces")
    hist = np.zeros(window + 1, np.int64)
    for length, n in made.groupBy("length").count().collect():  # a row for each length at most
        hist[length] = n
    plan = spark.sparkContext.broadcast(Plan(hist))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = plan.value.find
        for batch in batches:
            got = [(row, *s) for row, (n, r) in enumerate(zip(batch.column(3).to_pylist(), batch.column(6).to_pylist(), strict=True)) for s in find(n, r)]
            row, shift, length, sequence, offset = (np.array(x, np.int64) for x in zip(*got, strict=True)) if got else [np.empty(0, np.int64)] * 5
            at = pa.array(row)
            whole = length == np.asarray(batch.column(3))[row]
            crc = pa.array(np.asarray(batch.column(4))[row], mask=~whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.asarray(batch.column(2))[row] + shift), pa.array(length), crc, batch.column(5).take(at), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["key", "mark", "start", "length", "ids_crc32", "doc_tokens"]
    placed = materialize(ranked(made, int(hist.sum())).select(*names, "rank").mapInArrow(place, _PIECES.format(k=kind) + ", sequence_id long, offset long"), "pack-placed")
    cuts = materialize(placed.filter("ids_crc32 is null").groupBy("key", "mark").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts")), "pack-cuts")
    texts = df.select(col(key).alias("k"), F.xxhash64(col(text)).alias("m"), col(text).alias("text")).join(small(cuts, 100_000), F.col("k").eqNullSafe(F.col("key")) & (F.col("m") == F.col("mark")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = array("I", [end]).tobytes()
        for batch in batches:
            rows = []
            for i, (ids, parts) in enumerate(zip(_coded(batch.column(2).to_pylist(), path, stop), batch.column(3).to_pylist(), strict=True)):
                view = memoryview(ids)
                rows += [(i, p["start"], p["length"], zlib.crc32(view[4 * p["start"] : 4 * (p["start"] + p["length"])]), len(ids) // 4, p["sequence_id"], p["offset"]) for p in parts]
            i, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), *map(pa.array, rest)], names=[*names, "sequence_id", "offset"])
        words_of(path).forget()
        release()

    done = texts.select("key", "mark", "text", "cuts").mapInArrow(cut, _PIECES.format(k=kind) + ", sequence_id long, offset long").dropDuplicates(["sequence_id", "offset"])
    return placed.filter("ids_crc32 is not null").unionByName(done).select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(df: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The token ids themselves: `sequence_id`, `ids`. For keys that are unique."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = array("I", [end]).tobytes()
        for batch in batches:
            out: dict[str, list] = {"sequence_id": [], "offset": [], "ids": []}
            for ids, parts in zip(_coded(batch.column(0).to_pylist(), path, stop), batch.column(1).to_pylist(), strict=True):
                for p in parts:
                    out["sequence_id"].append(p["sequence_id"])
                    out["offset"].append(p["offset"])
                    out["ids"].append(np.frombuffer(ids, "<u4")[p["start"] : p["start"] + p["length"]].astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))
        words_of(path).forget()
        release()

    parts = packed.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    cut = df.join(parts, col(key) == F.col("__key")).select(col(text), "parts").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_pack": op1_pack}
ORACLES: dict[str, str] = {}
