"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

1. language_id: documents whose language cannot be told (no letters) go.
2. line_dedup: repeated chunks of lines go, and documents of which nothing is left.
3. jaccard_join: of each group of near duplicates the document with the smallest id stays.
4. mix_sources: whole and partial repetitions bring the sources to their target weights; a repetition is a row.
5. pack: pieces of sequences of at most 2048 tokens.

All stages but the last return the columns of `documents`; `n_chars` follows the text.

Defined results: a null text, and one without letters, goes in the first stage; a null language, source or id is kept; rows that
are equal in id and text are treated alike in every stage; of texts that tie as near duplicates the smallest id stays; a very
long text is read whole; an empty table makes no rows in any stage; extra columns are handed on up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import jaccard_join, language, line_dedup, mixing, packing
from tesela.llm.common import materialize


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with `n_chars` counted anew."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(docs)
    return _counted(left.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trigram models, word shingles and byte pairs have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
