"""Phrases of 2 to 5 words that stand together more often than their parts make likely, by hierarchical pair naming.

Every frequent word has a name, and every frequent phrase of k words is the pair of the names of its first and last k-1
words: the pair is counted over the whole corpus and gets a name of its own. A phrase that is frequent is made of frequent
ones, so a position goes on to the next length only while its phrase is frequent. The two names of a pair are also its
parents: the counts of all beginnings and ends of a phrase (for its cuts) come down that chain, and a phrase lies within a
longer one that is as frequent exactly if it is a parent of one that is.

Texts are held as blocks of some MB of words, by numbers that hold in the block alone: 4 bytes a position. A block counts
its own pairs and sends them, packed by hash, to as many buckets as there are shuffle partitions; a bucket adds up what all
blocks sent, names the frequent pairs, and answers each block with the names of those it has. So rows are blocks times
buckets at most, each with many pairs, and a language that holds a third of all rows is only more blocks. A bucket holds a
pair once for each block that has it.

Defined results: a null text counts as empty, a null language is `und`; pieces without words count for nothing; repeated
rows count each time; an empty table, or one without frequent phrases, makes no rows; other columns are not read. A very
long text is read in parts of a MB, which end no piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.llm.common import LOWER, UPPER, col, drop_table, materialize, release, small, small_batches, table
from tesela.llm.shingles import mix, utf8
from tesela.llm.simhash import blocks

LONGEST, LEAST, TOP = 5, 100, 2000
WORDS_A_BLOCK = 1_500_000
NO_LANGUAGE = "und"
#: Capitals in lower case, signs that end a piece as one of them, a tab as a space.
_PLAIN = bytes.maketrans(UPPER.encode() + b".,;:!?\x0a\x0b\x0c\x0d\x09", LOWER.encode() + b"," * 10 + b" ")
GAP = -1
#: Rows of blocks (`ids`), of what they send to a bucket (`base` is the first number of it in the block) and of languages.
SENT = {"block": pa.int64(), "ids": pa.binary(), "bucket": pa.int64(), "base": pa.int64(), "words": pa.list_(pa.binary()), "one": pa.binary(), "two": pa.binary(), "counts": pa.binary(), "lang": pa.string(), "n": pa.int64()}
SENT_SCHEMA = "block long, ids binary, bucket long, base long, words array<binary>, one binary, two binary, counts binary, lang string, n long"
#: Rows of names, and of what a bucket answers a block: numbers of the block and their names.
NAMED = {"id": pa.int64(), "word": pa.binary(), "one": pa.int64(), "two": pa.int64(), "f": pa.int64(), "block": pa.int64(), "numbers": pa.binary(), "names": pa.binary()}
NAMED_SCHEMA = "id long, word binary, one long, two long, f long, block long, numbers binary, names binary"


def packed(x: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers by planes of their bytes, high ones apart from low ones, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def unpacked(x: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rows(columns: dict[str, pa.DataType], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in columns.items()], list(columns))


class Block:
    """Words of some texts as numbers of this block (GAP between pieces and texts), and the words by language."""

    def __init__(self, number: int):
        self.number, self.words, self.parts, self.size = number, {}, [], 0
        self.next = count().__next__

    def add(self, lang: str, text: bytes) -> None:
        known = self.words.get(lang)
        if known is None:
            known = self.words[lang] = defaultdict(self.next, {b",": GAP})
        for part in blocks(text):
            words = part.translate(_PLAIN).replace(b",", b" , ").split()
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            self.size += len(words) + 1
        self.parts.append(np.array([GAP], np.int32))

    def rows(self, buckets: int) -> pa.RecordBatch:
        """The block's words in order, its distinct words by bucket (a word, a blank, the language), and words by language."""
        ids = np.concatenate(self.parts)
        keys, old, langs = [], [], []
        for lang, known in self.words.items():
            tail = b" " + lang.encode()
            keys += [w + tail for w in known if w != b","]
            old += [i for i in known.values() if i != GAP]
            langs.append((lang, len(known) - 1))
        old = np.array(old, np.int64)
        counts = np.bincount(ids[ids >= 0], minlength=len(old))[old]
        bucket = np.array([hash_of(k) % buckets for k in keys], np.int64)
        order = np.argsort(bucket, kind="stable")
        new = np.full(len(old) + 1, GAP, np.int32)
        new[old[order]] = np.arange(len(old))
        keys, counts_in, bucket = [keys[i] for i in order.tolist()], counts[order], bucket[order]
        rows = [{"block": self.number, "ids": packed(new[ids], "<i4")}]
        for b, low, high in _stretches(bucket):
            rows.append({"block": self.number, "bucket": b, "base": low, "words": keys[low:high], "counts": packed(counts_in[low:high])})
        at = 0
        for lang, n in langs:
            rows.append({"lang": lang, "n": int(counts[at : at + n].sum())})
            at += n
        return _rows(SENT, rows)


def hash_of(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _stretches(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each stretch of equal ones."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for low, high in zip(first, [*first[1:], len(bucket)], strict=False):
        yield int(bucket[low]), low, high


def word_blocks(df: DataFrame, text: str = "text", lang: str = "lang", words_a_block: int = WORDS_A_BLOCK) -> DataFrame:
    """Blocks of the texts, their distinct words by bucket, and their words by language."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        block = Block(next(numbers))
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                block.add(name, text)
                if block.size >= words_a_block:
                    yield block.rows(buckets)
                    block = Block(next(numbers))
        if block.parts:
            yield block.rows(buckets)
        release()

    return df.select(F.coalesce(col(lang), F.lit(NO_LANGUAGE)).alias("lang"), col(text).alias("text")).mapInArrow(run, SENT_SCHEMA)


def _naming(least: int):
    """Adds up what blocks sent to a bucket; names what is frequent, and tells each block its own."""

    def named(sent: pa.Table) -> pa.Table:
        sent = sent.sort_by([("block", "ascending"), ("base", "ascending")])  # so that a retried task names alike
        counts = [unpacked(x) for x in sent["counts"].to_pylist()]
        sizes = np.array(list(map(len, counts)))
        counts = np.concatenate(counts)
        if sent["one"].null_count:
            found = sent["words"].combine_chunks().flatten().dictionary_encode()
            number = np.asarray(found.indices, np.int64)
            keys = lambda which: {"word": found.dictionary.take(pa.array(which)).to_pylist()}
            kinds = len(found.dictionary)
        else:
            one, two = (np.concatenate([unpacked(x) for x in sent[c].to_pylist()]) for c in ("one", "two"))
            order = np.lexsort((two, one))
            fresh = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
            number = np.empty(len(one), np.int64)
            number[order] = np.cumsum(fresh) - 1
            first = order[fresh]
            keys = lambda which: {"one": one[first[which]].tolist(), "two": two[first[which]].tolist()}
            kinds = len(first)
        f = np.zeros(kinds, np.int64)
        np.add.at(f, number, counts)
        which = np.flatnonzero(f >= least)
        ids = np.full(kinds, GAP, np.int64)
        ids[which] = (int(sent["bucket"][0].as_py()) << 32) + np.arange(len(which))
        made = keys(which)
        rows = [{"id": i, "f": c} | {k: v[at] for k, v in made.items()} for at, (i, c) in enumerate(zip(ids[which].tolist(), f[which].tolist(), strict=True))]
        ends = np.cumsum(sizes)
        for block, base, low, high in zip(sent["block"].to_pylist(), sent["base"].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            own = ids[number[low:high]]
            at = np.flatnonzero(own >= 0)
            if len(at):
                rows.append({"block": block, "numbers": packed(at + base, "<i4"), "names": packed(own[at])})
        return pa.Table.from_batches([_rows(NAMED, rows)])

    return named


def _pairing(buckets: int, last: bool):
    """A block and its names -> its pairs of neighbours that both have one, as numbers of the block, and the pairs by bucket."""

    def paired(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return pa.Table.from_batches([_rows(SENT, [])])
        ids = unpacked(block["ids"][0].as_py(), "<i4")
        local, name = (np.concatenate([unpacked(x, t) for x in answers[c].to_pylist()]) for c, t in (("numbers", "<i4"), ("names", "<i8")))
        order = np.argsort(local)
        local, name = local[order], name[order]
        place = np.full(max(ids.max(initial=GAP), local[-1]) + 2, GAP, np.int64)
        place[local] = np.arange(len(local))
        now = place[ids]  # a gap, at -1, finds the last place, which no name has
        both = (now[:-1] >= 0) & (now[1:] >= 0)
        codes, number, counts = np.unique(now[:-1][both] * len(local) + now[1:][both], return_inverse=True, return_counts=True)
        one, two = name[codes // len(local)], name[codes % len(local)]
        bucket = (mix(one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((two, one, bucket))
        one, two, bucket, counts = one[order], two[order], bucket[order], counts[order]
        number_of = block["block"][0].as_py()
        rows = []
        if not last:
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            new = np.full(len(both), GAP, np.int32)
            new[both] = rank[number]
            there = np.concatenate([[False], new >= 0, [False]])
            new[~(there[:-2] | there[2:])] = GAP  # a pair without neighbours begins no longer phrase
            kept = np.ones(len(new), bool)
            kept[:-1] = (new[:-1] >= 0) | (new[1:] >= 0)  # one gap is as good as many
            rows.append({"block": number_of, "ids": packed(new[kept], "<i4")})
        for b, low, high in _stretches(bucket):
            rows.append({"block": number_of, "bucket": b, "base": low, "one": packed(one[low:high]), "two": packed(two[low:high]), "counts": packed(counts[low:high])})
        return pa.Table.from_batches([_rows(SENT, rows)])

    return paired


def named_levels(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, words_a_block: int = WORDS_A_BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of the frequent phrases of 1, 2, ... words, and `lang`, `n`: all words of a language.

    Words: id, word (a word, a blank, its language), f. Phrases: id, `one` and `two` (names of their first and last words but one), f."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(word_blocks(df, text, lang, words_a_block), "phrase-words")
    totals = materialize(held.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    levels = []
    for k in range(1, longest + 1):
        sent = held.filter("bucket is not null").select("block", "bucket", "base", "words", "one", "two", "counts")
        named = materialize(sent.groupBy("bucket").applyInArrow(_naming(least), NAMED_SCHEMA), f"phrase-names-{k}")
        levels.append(named.filter("id is not null").select("id", *(["word"] if k == 1 else ["one", "two"]), "f"))
        if k < longest:
            answers = named.filter("block is not null").select(F.col("block").alias("of"), "numbers", "names")
            positions = held.filter("ids is not null").select("block", "ids")
            new = materialize(positions.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_pairing(buckets, k + 1 == longest), SENT_SCHEMA), f"phrase-pairs-{k + 1}")
            drop_table(held)
            held = new
    drop_table(held)
    return levels, totals


def frequent_phrases(levels: list[DataFrame]) -> list[DataFrame]:
    """For each length: id, lang, phrase, f, `heads` and `tails` (counts of its first and of its last 1, 2, ... words)."""
    word = F.split(F.decode("word", "utf-8"), " ", 2)
    out = [levels[0].select("id", word[1].alias("lang"), word[0].alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for k, level in enumerate(levels[1:], 2):
        before = out[-1]
        one = before.select(F.col("id").alias("one"), "lang", F.col("phrase").alias("begin"), "heads")
        two = before.select(F.col("id").alias("two"), F.substring_index("phrase", " ", -1).alias("last"), "tails")
        own = F.array("f")
        joined = level.join(small(one), "one").join(small(two), "two")
        out.append(materialize(joined.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "f", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails")), f"phrases-{k}"))
    return out


def scored(phrases: DataFrame, k: int) -> DataFrame:
    """Phrases of k words with `n` at their weakest cut: a, l, r, score. Products are decimals of 38 digits, so exact."""
    a, n = (F.col("f") * 1000).cast("decimal(19,0)"), F.col("n").cast("decimal(18,0)")

    def cut(i: int):
        l, r = F.get("heads", F.lit(i - 1)), F.get("tails", F.lit(k - i - 1))
        score = F.call_function("div", a * n, l.cast("decimal(19,0)") * r.cast("decimal(18,0)"))
        return F.struct(score.alias("score"), F.lit(i).alias("k"), l.alias("l"), r.alias("r"))

    cuts = F.array(*[cut(i) for i in range(1, k)])
    return phrases.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, words_a_block: int = WORDS_A_BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of phrases that lie within no longer one as frequent; all of them if `top` is None."""
    levels, totals = named_levels(df, text, lang, least, longest, words_a_block)
    phrases, kept = frequent_phrases(levels), None
    for k in range(2, longest + 1):
        now = phrases[k - 1]
        if k < longest:
            parents = [levels[k].select(F.col(c).alias("id"), F.col("f").alias("above")) for c in ("one", "two")]
            above = materialize(parents[0].unionAll(parents[1]).groupBy("id").agg(F.max("above").alias("above")), "phrases-above")
            now = now.join(small(above), "id", "left").filter("above is null or above < f")
        made = scored(now.join(small(totals), "lang"), k)
        kept = made if kept is None else kept.unionAll(made)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = materialize(kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), "phrases-scored")
    if top is not None:  # the best of each part first, so that no task sorts a whole language
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {
    "op12_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)) GROUP BY lang, k, phrase),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase AND 100 * i.f >= 100 * c.f),
cuts AS (
  SELECT lang, phrase, k, f, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT u.lang, u.phrase, u.f AS a, h.f AS l, t.f AS r, n, j, (1000::HUGEINT * u.f * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts u JOIN g h ON h.lang = u.lang AND h.phrase = u.head JOIN g t ON t.lang = u.lang AND t.phrase = u.tail JOIN total ON total.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b ANTI JOIN dropped USING (lang, phrase)
QUALIFY rank <= 2000""",
}
