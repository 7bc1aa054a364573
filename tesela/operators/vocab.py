"""Vocabulary: tokens as rows, counts, summaries, ranks and groups.

Rows carry their order (`doc_id`, `pos`); ties go to the alphabetically first term. Corpus-wide ranks are taken over ranges
of the aggregated vocabulary, never over tokens or in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators.ranges import running


def token_rows(df: DataFrame, split: Column, key: str = "doc_id", name: str = "token") -> DataFrame:
    """One row a token: key, pos, token."""
    return df.select(key, F.posexplode(split).alias("pos", name))


def word_rows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lower-case words of the text in their order among all tokens: key, pos, term."""
    rows = token_rows(df, T.tokens(F.col(text)), key)
    return rows.filter(T.is_word(F.col("token"))).select(key, "pos", F.lower("token").alias("term"))


def sentence_rows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(T.sentences(F.col(text))).alias("sent_id", "sentence"))


def term_counts(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`term`, `c`, and the columns in `by`."""
    return words.groupBy(*(by or []), "term").agg(F.count(F.lit(1)).alias("c"))


def term_frequencies(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, `tf`."""
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """term, `df`."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens, types, type-token ratio (0 where empty) and types that occur once, of `term`, `c`."""
    return counts.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("types"),
        F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum("c")), F.lit(0.0)).alias("ttr"),
        F.count_if(F.col("c") == 1).alias("hapax"),
    )


def collisions(counts: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    """Types that a transformation makes one: `form`, `members` in order, their number and occurrences; groups of two or more."""
    groups = counts.groupBy(form(F.col("term")).alias("form")).agg(F.array_sort(F.collect_set("term")).alias("members"), F.sum("c").alias("c"))
    return groups.filter(F.size("members") > 1).withColumn("n", F.size("members").cast("long"))


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """Adds `rank` from 1 by falling frequency, over ranges of the vocabulary."""
    return running(counts, [F.desc("c"), "term"])


def coverage(counts: DataFrame) -> DataFrame:
    """Adds `rank` and the share of all tokens that the terms up to each rank cover."""
    ranked = running(counts, [F.desc("c"), "term"], {"upto": F.col("c")})
    total = counts.agg(F.sum("c").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("covered", F.col("upto") / F.col("total")).drop("upto", "total")


def zipf(counts: DataFrame, ranks: int = 5000) -> DataFrame:
    """Slope and intercept of log10 frequency over log10 rank among the first ranks."""
    top = counts.orderBy(F.desc("c"), "term").limit(ranks).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "term")))
    return top.agg(F.regr_slope(F.log10("c"), F.log10("rank")).alias("slope"), F.regr_intercept(F.log10("c"), F.log10("rank")).alias("intercept"), F.count(F.lit(1)).alias("ranks"))


def integer_vocabulary(counts: DataFrame, first: int = 2) -> DataFrame:
    """`term`, `id`: ids from `first` by falling frequency (0 pads, 1 stands for unknown words)."""
    return frequency_ranks(counts).select("term", "c", (F.col("rank") + first - 1).alias("id"))


def encode(words: DataFrame, vocabulary: DataFrame, key: str = "doc_id", size: int | None = None) -> DataFrame:
    """key, `ids` in order; unknown words and ids above `size` become 1."""
    known = F.coalesce(F.when(F.col("id") <= size, F.col("id")) if size else F.col("id"), F.lit(1)).cast("long")
    rows = words.join(vocabulary.select("term", "id"), "term", "left").select(key, "pos", known.alias("id"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def decode(ids: DataFrame, vocabulary: DataFrame, key: str = "doc_id", unknown: str = "<oov>") -> DataFrame:
    """key, `text`: terms of ids in order, padding left out."""
    rows = ids.select(key, F.posexplode("ids").alias("pos", "id")).filter("id <> 0").join(vocabulary.select("id", "term"), "id", "left")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("term", F.lit(unknown)).alias("t")))), lambda x: x["t"]), " ").alias("text"))


def encode_rows(docs: DataFrame, terms: list[str], key: str = "doc_id", words: str = "words", first: int = 2) -> DataFrame:
    """`encode` of rows (key, array of words) under a vocabulary of a fixed size, its terms by rank: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = pc.fill_null(pc.add(pc.index_in(lists.flatten(), value_set=pa.array(terms, pa.string())).cast(pa.int64()), first), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum(np.diff(lists.offsets.to_numpy(), prepend=lists.offsets[0].as_py())), pa.int32()), ids)], [key, "ids"])

    return docs.filter(F.size(words) > 0).select(key, words).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<long>")


def decode_rows(ids: DataFrame, terms: list[str], key: str = "doc_id", unknown: str = "<oov>", first: int = 2) -> DataFrame:
    """`decode` of encoded rows under a vocabulary of a fixed size: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([None, *[unknown] * (first - 1), *terms], pa.string())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            kept, lengths = flat != 0, np.diff(lists.offsets.to_numpy())
            sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
            flat = flat[kept]
            words = names.take(pa.array(np.where(flat < len(names), flat, 1)))
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(rows, " ")], [key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {ids.schema[key].dataType.simpleString()}, text string")


def without(words: DataFrame, stop: list[str]) -> DataFrame:
    """Words that are not in a list, whatever their case."""
    return words.filter(~F.lower("term").isin(*stop)) if stop else words


def stopword_audit(counts: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Of each list: its size, its words that occur, the share of tokens it removes, the types that are left."""
    rows = [(name, word) for name, words in sorted(lists.items()) for word in sorted(set(words))]
    spark = counts.sparkSession
    entries = spark.createDataFrame(rows, "list string, stop string")
    sizes = entries.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    total = counts.agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("types"))
    hits = entries.join(counts, F.col("stop") == F.col("term")).groupBy("list").agg(F.count(F.lit(1)).alias("present"), F.sum("c").alias("removed"))
    return sizes.join(hits, "list", "left").crossJoin(F.broadcast(total)).select(
        "list",
        "size",
        F.coalesce("present", F.lit(0)).alias("present"),
        (F.coalesce("removed", F.lit(0)) / F.col("all")).alias("removed_share"),
        (F.col("types") - F.coalesce("present", F.lit(0))).alias("types_left"),
    )


def pruned(frequencies: DataFrame, documents: int, least: float = 1, most: float = 1.0) -> DataFrame:
    """Terms within document-frequency bounds; an int is a number of documents, a float a share of them."""
    low = least if isinstance(least, int) else least * documents
    high = most if isinstance(most, int) else most * documents
    return frequencies.filter((F.col("df") >= low) & (F.col("df") <= high))


def case_fusion(words: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Capitalized forms used mostly as names that a lower-case common word is spelt like. Needs `token`, `is_name`."""
    forms = words.groupBy("token").agg(F.count_if("is_name").alias("names"), F.count_if(~F.col("is_name")).alias("commons"))
    upper = forms.filter(F.col("token").rlike(r"^\p{Lu}") & (F.col("names") >= least) & (F.col("names") / (F.col("names") + F.col("commons")) >= share))
    lower = forms.filter((F.col("token") == F.lower("token")) & (F.col("commons") >= least)).select(F.col("token").alias("common"), F.col("commons").alias("common_uses"))
    return upper.join(lower, F.lower("token") == F.col("common")).select("token", "names", "common", "common_uses")
