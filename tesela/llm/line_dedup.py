"""Line dedup by content-defined chunks, in DataFrame functions alone.

A rolling hash over the hashes of `window` successive lines ends a chunk where it is divisible by `divisor`, so a passage
of lines is cut alike wherever it stands. A line of `long_words` words or more is a passage by itself: it always begins and
ends a chunk, whatever stands beside it. Chunks that occur more than once in the whole corpus are found by their hashes,
compared byte by byte, and removed but for the first occurrence (smallest key, then position). A chunk takes part if it
has two lines or more, or is such a long line, and is not blank.

Only narrow rows are shuffled to find repeated hashes; texts of chunks are shuffled where their hash is repeated.

Defined results: a null text stays null; an empty text has one empty line, which is kept; a document whose lines are all
removed keeps an empty text; rows equal in key and text are one document, all treated alike; an empty table makes no
rows; input columns named like an output column are replaced by it, all others are handed on whatever their names. A very
long text is one row; its chunks are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import SPACED_WORD, col, materialize, others, small, table

WINDOW, DIVISOR, LONG_WORDS = 2, 4, 50
MADE = ["n_lines", "removed_lines", "removed_chunks"]


def _long(line: Column, long_words: int) -> Column:
    """Whether a line has that many words; no more of it is read than these, and short lines not at all."""
    words = F.regexp_like(line, F.lit(rf"^(?:{SPACED_WORD}){{{long_words}}}".replace("]*", "]*+").replace("]+", "]++")))
    return F.when(F.length(line) >= 2 * long_words - 1, words).otherwise(F.lit(False))


def chunk_lines(text: Column, window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """The text's chunks of lines: array of arrays of lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long").alias("h"), _long(x, long_words).alias("long")))
    return F.transform(F.array(F.struct(lines.alias("l"), hashed.alias("h"))), lambda both: _chunks(both["l"], both["h"], window, divisor))[0]


def _chunks(lines: Column, hashed: Column, window: int, divisor: int) -> Column:
    def rolling(i: Column) -> Column:
        return sum((F.when(i >= back, F.get(hashed, i - back)["h"]).otherwise(F.lit(0)) * 31**back for back in range(window)), F.lit(0))

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.get(hashed, i)["long"] | F.get(hashed, i - 1)["long"] | (rolling(i - 1) % divisor == 0))
    return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at)))[0]


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The input with the text that is left, and `n_lines`, `removed_lines`, `removed_chunks`."""
    mark = F.xxhash64(col(text)).alias("__mark")
    chunked = df.select(col(key).alias("__key"), mark, F.posexplode(chunk_lines(col(text), window, divisor, long_words)).alias("__at", "__lines"))
    chunked = chunked.select("__key", "__mark", "__at", F.size("__lines").alias("__n"), F.array_join("__lines", "\n").alias("__text"))
    eligible = chunked.filter(((F.col("__n") >= 2) | _long(F.col("__text"), long_words)) & F.col("__text").rlike(r"[^\x20\x09-\x0D]")).withColumn("__hash", F.xxhash64("__text"))
    repeated = materialize(eligible.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__hash").alias("__again")), "line-hashes")
    suspects = materialize(eligible.join(small(repeated), F.col("__hash") == F.col("__again"), "left_semi"), "line-chunks")
    # equal bytes, not only equal hashes: the text is part of the grouping key
    firsts = suspects.groupBy(F.col("__hash").alias("h"), F.col("__text").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("__key").isNotNull().alias("k0"), F.col("__key").alias("k"), F.col("__mark").alias("m"), F.col("__at").alias("a"))).alias("first")).filter("n > 1")
    firsts = materialize(firsts, "line-firsts")  # so that the join below has an exchange on both sides and a hot chunk can be split
    here = F.struct(F.col("__key").isNotNull().alias("k0"), F.col("__key").alias("k"), F.col("__mark").alias("m"), F.col("__at").alias("a"))
    doomed = suspects.join(firsts, (F.col("__hash") == F.col("h")) & (F.col("__text") == F.col("t"))).filter(~here.eqNullSafe(F.col("first")))
    removed = materialize(doomed.groupBy(F.col("__key").alias("k"), F.col("__mark").alias("m")).agg(F.array_sort(F.collect_set("__at")).alias("gone")), "line-removed")
    keep = others(df, MADE)
    # the input's columns go in a struct, so that no name of theirs can stand for one made here
    row = df.select(F.struct(*[col(c) for c in keep]).alias("row"), col(key).alias("key"), col(text).alias("text"), F.xxhash64(col(text)).alias("mark"))
    joined = row.join(small(removed, 250_000), F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left")
    pick = lambda which, at: F.flatten(F.transform(which, lambda i: F.get(at, i)))
    both = F.transform(F.array(chunk_lines(F.col("text"), window, divisor, long_words)), lambda at: F.struct(F.array_join(pick(F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col("gone")), at), "\n").alias("left"), F.size(pick(F.col("gone"), at)).alias("lost")))[0]
    joined = joined.withColumn("cut", F.when(F.col("gone").isNotNull(), both))
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("cut.left")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in keep],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("cut.lost"), F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text IS NULL AS nil, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS long FROM l),
r AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 OR long
    OR coalesce(lead(long) OVER (PARTITION BY doc_id ORDER BY i), false) AS ends FROM h),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
t AS (SELECT doc_id, nil, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, nil, chunk),
m AS (
  SELECT *, (n >= 2 OR len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 50) AND regexp_matches(body, '[^\x20\x09-\x0D]') AS part,
    row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) AS nth FROM t)
SELECT doc_id, CASE WHEN nil THEN NULL ELSE coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT (part AND nth > 1)), '') END AS text,
  CASE WHEN nil THEN 0 ELSE sum(n) END::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE part AND nth > 1), 0)::BIGINT AS removed_lines,
  count(*) FILTER (WHERE part AND nth > 1)::BIGINT AS removed_chunks
FROM m GROUP BY doc_id, nil""",
}
