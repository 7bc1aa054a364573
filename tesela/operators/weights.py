"""Term weights and retrieval over long tables (document, term, weight). Nothing is made dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tf_variants(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Five local weights of `tf`: raw, binary, relative, sublinear and of length one."""
    doc = Window.partitionBy(key)
    return tf.select(
        key,
        "term",
        F.col("tf").cast("double").alias("raw"),
        F.lit(1.0).alias("binary"),
        (F.col("tf") / F.greatest(F.sum("tf").over(doc), F.lit(1))).alias("relative"),
        (1 + F.log("tf")).alias("sublinear"),
        (F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(doc))).alias("unit"),
    )


def smooth_idf(df: Column, documents: Column) -> Column:
    return F.log((1 + documents) / (1 + df)) + 1


def bm25_idf(df: Column, documents: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def tfidf(tf: DataFrame, frequencies: DataFrame, documents: Column, sublinear: bool = False, unit: bool = True, key: str = "doc_id") -> DataFrame:
    """key, term, tf, df, idf, weight. `documents` is the number of all documents, those without terms too."""
    local = (1 + F.log("tf")) if sublinear else F.col("tf")
    rows = tf.join(frequencies, "term").withColumn("idf", smooth_idf(F.col("df"), documents)).withColumn("weight", local * F.col("idf"))
    if unit:
        rows = rows.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key))))
    return rows.select(key, "term", "tf", "df", "idf", "weight")


def bm25(tf: DataFrame, frequencies: DataFrame, documents: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """key, term, tf, weight. `mean_length` is over all documents."""
    rows = tf.withColumn("length", F.sum("tf").over(Window.partitionBy(key))).join(frequencies, "term")
    weight = bm25_idf(F.col("df"), documents) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean_length))
    return rows.select(key, "term", "tf", "length", weight.alias("weight"))


def unit_length(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weights.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), norm), F.lit(0.0)))


def top_terms(weights: DataFrame, k: int = 5, key: str = "doc_id", by: str = "weight") -> DataFrame:
    """The k heaviest terms of every document, with their place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "term"))
    return weights.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def scores(queries: DataFrame, documents: DataFrame, key: str = "doc_id", binary: bool = False) -> DataFrame:
    """`query`, key, score: sum over shared terms. Queries are (query, term, weight) of a stated set."""
    weight = F.col("q.weight") if not binary else F.lit(1.0)
    pairs = queries.alias("q").join(documents.alias("d"), F.col("q.term") == F.col("d.term"))
    return pairs.groupBy(F.col("q.query"), F.col(f"d.{key}")).agg(F.sum(weight * F.col("d.weight")).alias("score"))


def ranking(scored: DataFrame, queries: DataFrame, documents: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The first k documents of every query, itself left out: query, key, score, place.

    Documents without a shared term count with score 0; of them only the first by key can matter, so no more are made."""
    first = documents.select(key).distinct().orderBy(key).limit(2 * k + 1)
    none = queries.select("query").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    every = scored.unionByName(none).filter(F.col("query") != F.col(key)).groupBy("query", key).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return every.withColumn("place", place).filter(F.col("place") <= k)


def precision_at(ranked: DataFrame, labels: DataFrame, ks: list[int], key: str = "doc_id", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """`k`, `precision` (of each group in `by`): mean share of the first k documents that have the query's label."""
    mine = labels.select(F.col(key).alias("query"), F.col(label).alias("wanted"))
    hits = ranked.join(mine, "query").join(labels.select(key, label), key)
    by = by or []
    rows = hits.select(*by, "query", "place", F.coalesce((F.col(label) == F.col("wanted")).cast("int"), F.lit(0)).alias("hit"))
    each = rows.select(*by, "query", "hit", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("place"))).alias("k"))
    return each.groupBy(*by, "query", "k").agg((F.sum("hit") / F.col("k")).alias("p")).groupBy(*by, "k").agg(F.avg("p").alias("precision"))
