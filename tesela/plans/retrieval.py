"""Term weights and retrieval over `documents`. Retrieval takes the documents whose id is divisible by 20 as queries."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import bags as B
from tesela.operators import gold as GO
from tesela.operators import vocab as V
from tesela.operators import weights as W
from tesela.plans.fragments import COMMON, FORM, TF, quoted
from tesela.plans.registry import Registry, rounded, table
from tesela.sources.shared import small, written

query = Registry()


class Index:
    """tf, df and corpus scalars of `documents`.

    Texts are dealt by document before they are cut into words, so that counts by (document, term) and everything that is
    done by document needs no further shuffle; document frequencies are written once and, within bounds, broadcast, so that
    the commonest terms, which are in every document, meet in no task."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = table(spark, sf_dir, "documents")
        self.tf = V.term_frequencies(V.word_rows(self.docs.select("doc_id", "text").repartition("doc_id")))
        self.n = self.docs.agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def df(self) -> DataFrame:
        return small(written(V.document_frequencies(self.tf), "document-frequencies"))

    def weighed(self, **how) -> DataFrame:
        n = self.n.first()["n"]
        return W.tfidf(self.tf, self.df, F.lit(n), **how)

    def bm25(self, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        n = self.n.first()["n"]
        total = self.tf.agg(F.sum("tf")).first()[0] or 0
        return W.bm25(self.tf, self.df, F.lit(n), F.lit(total / max(1, n)), k1, b)


class Bags:
    """`documents` as blocks of term counts, with document frequencies and the numbers of documents and words."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = True):
        words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
        self.docs = table(spark, sf_dir, "documents")
        self.blocks = B.blocks(self.docs.select("doc_id", words.alias("words")), keep=keep)

    @cached_property
    def n(self) -> int:
        return self.docs.count()  # a document without words counts, too

    @cached_property
    def df(self) -> DataFrame:
        return small(written(B.document_frequencies(self.blocks), "bag-frequencies"))

    @property
    def words(self) -> int:
        lengths = B.each(self.blocks, lambda block: pa.table({"n": pa.array([int(B.entries(block)[2].sum())], pa.int64())}), "n long")
        return lengths.agg(F.sum("n")).first()[0] or 0

    def asked(self, items: DataFrame, key: str, text: str) -> DataFrame:
        """query, term, weight (count times idf) of texts, without the commonest words; written."""
        terms = items.select(key, F.explode(T.found(F.col(text), T.WORD)).alias("t")).select(key, F.lower("t").alias("term"))
        counts = V.without(terms, list(COMMON)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).join(self.df, "term")
        return written(counts.select(F.col(key).alias("query"), "term", (F.col("tf") * W.smooth_idf(F.col("df"), F.lit(self.n))).alias("weight")), "asked")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        return B.search(self.blocks, self.df, self.n, self.words, asked, k)


WEIGHTS = TF + """,
w0 AS (SELECT doc_id, term, tf, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM tf JOIN df USING (term), nd),
w AS (SELECT doc_id, term, tf, df, idf, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""

BM25 = TF + """,
dl AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY doc_id),
al AS (SELECT (SELECT sum(length) FROM dl) / n AS mean FROM nd),
bm AS (SELECT doc_id, term, tf, length, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) AS weight
  FROM tf JOIN dl USING (doc_id) JOIN df USING (term), nd, al)"""


@query("tfidf_top_terms", f"""WITH {WEIGHTS}, r AS (SELECT doc_id, term, tf, df, weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS place FROM w)
SELECT doc_id, term, tf, df, round(weight, 6) AS weight, place FROM r WHERE place <= 5""")
def tfidf_top_terms(spark, sf_dir):
    """The five heaviest terms of every document under smoothed TF-IDF."""
    bags = Bags(spark, sf_dir)
    return B.top_terms(bags.blocks, bags.n, 5).select("doc_id", "term", "tf", "df", rounded(F.col("weight")).alias("weight"), "place")


@query("tf_variants", f"""WITH {TF}
SELECT doc_id, count(*) AS terms, round(sum(tf::DOUBLE), 6) AS raw, round(sum(1.0), 6)::DOUBLE AS "binary", round(sum(tf / l), 6) AS "relative", round(sum(1 + ln(tf)), 6) AS sublinear, round(sum(tf / sqrt(q)), 6) AS unit
FROM (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS l, sum(tf * tf) OVER (PARTITION BY doc_id) AS q FROM tf) GROUP BY doc_id""")
def tf_variants(spark, sf_dir):
    return B.tf_variant_sums(Bags(spark, sf_dir, keep=False).blocks).select("doc_id", "terms", *[rounded(F.col(c)).alias(c) for c in B.LOCAL])


@query("tf_variant_top_documents", f"""WITH {TF}, t AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5),
v AS (SELECT doc_id, term, tf::DOUBLE AS raw, tf / sum(tf) OVER (PARTITION BY doc_id) AS "relative", 1 + ln(tf) AS sublinear, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS unit FROM tf),
u AS (UNPIVOT (SELECT * FROM v WHERE term IN (SELECT term FROM t)) ON raw, "relative", sublinear, unit INTO NAME variant VALUE weight),
r AS (SELECT variant, term, doc_id, weight, row_number() OVER (PARTITION BY variant, term ORDER BY round(weight, 9) DESC, doc_id) AS place FROM u)
SELECT variant, term, doc_id, round(weight, 6) AS weight, place FROM r WHERE place <= 3""")
def tf_variant_top_documents(spark, sf_dir):
    """The first three documents of the five commonest terms under four local weights."""
    blocks = Bags(spark, sf_dir, keep=False).blocks
    common = [r["term"] for r in B.term_totals(blocks).orderBy(F.desc("c"), "term").limit(5).collect()]
    long = B.tf_variants(blocks, common).unpivot(["doc_id", "term"], ["raw", "relative", "sublinear", "unit"], "variant", "weight")
    place = F.row_number().over(Window.partitionBy("variant", "term").orderBy(F.desc(F.round("weight", 9)), "doc_id"))
    return long.withColumn("place", place.cast("long")).filter("place <= 3").select("variant", "term", "doc_id", rounded(F.col("weight")).alias("weight"), "place")


@query("bm25_weights", f"""WITH {BM25} SELECT doc_id, term, tf, length::BIGINT AS length, round(weight, 6) AS weight FROM bm""")
def bm25_weights(spark, sf_dir):
    bags = Bags(spark, sf_dir)
    return B.bm25_weights(bags.blocks, bags.n, bags.words).withColumn("weight", rounded(F.col("weight")))


#: Terms in more than this share of documents are left out of retrieval, as a vocabulary crop does; at 1 none are.
MOST = 1.0

RANK = """ranked AS (
  SELECT q.doc_id AS query, d.doc_id, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(coalesce(s.score, 0), 9) DESC, d.doc_id) AS place
  FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT doc_id FROM v)) q JOIN documents d ON q.doc_id <> d.doc_id
  LEFT JOIN s ON s.query = q.doc_id AND s.doc_id = d.doc_id QUALIFY place <= 13),
hits AS (SELECT query, place, (a.lang = b.lang)::INT AS hit FROM ranked JOIN documents a ON a.doc_id = query JOIN documents b ON b.doc_id = ranked.doc_id)"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """All documents and those whose id is divisible by 20 as weighable blocks, and the number of all."""
    bags = Bags(spark, sf_dir)
    frequencies = small(written(V.pruned(bags.df, bags.n, 1, MOST), "kept-frequencies"))
    words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
    asked = B.blocks(bags.docs.filter(F.col("doc_id") % 20 == 0).select("doc_id", words.alias("words")))
    return B.weighable(bags.blocks, frequencies), B.weighable(asked, frequencies), bags.n


CONFIGS = {"raw dot": ("tf::DOUBLE", False), "raw cosine": ("tf::DOUBLE", True), "tfidf": ("tf * idf", True), "sublinear": ("(1 + ln(tf)) * idf", True)}


@query("precision_at_k", "WITH " + TF + f""",
x AS (SELECT doc_id, term, tf, ln((1 + n) / (1 + df)) + 1 AS idf FROM tf JOIN df USING (term), nd WHERE df <= {MOST} * n),
""" + ",\n".join(
    f"""c{i} AS (WITH v0 AS (SELECT doc_id, term, {w} AS weight FROM x), v AS (SELECT doc_id, term, {'weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id))' if unit else 'weight'} AS weight FROM v0),
  s AS (SELECT q.doc_id AS query, d.doc_id, sum(q.weight * d.weight) AS score FROM v q JOIN v d USING (term) WHERE q.doc_id % 20 = 0 GROUP BY ALL), {RANK}
  SELECT '{name}' AS config, k, avg(p) AS precision FROM (SELECT query, k, sum(hit) / k AS p FROM hits, (VALUES (1), (3), (5), (10), (13)) t(k) WHERE place <= k GROUP BY query, k) GROUP BY k)"""
    for i, (name, (w, unit)) in enumerate(CONFIGS.items())
) + "\nSELECT config, k, round(precision, 6) AS precision FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(CONFIGS))) + ")")
def precision_at_k(spark, sf_dir):
    """Precision of neighbours' language at five depths under four weightings: the grid and the curve in one."""
    bags, asked, n = _searched(spark, sf_dir)
    idf = lambda df: np.log((1 + n) / (1 + df)) + 1
    ways = {
        "raw dot": (lambda tf, df, length: tf, False, False),
        "raw cosine": (lambda tf, df, length: tf, True, False),
        "tfidf": (lambda tf, df, length: tf * idf(df), True, False),
        "sublinear": (lambda tf, df, length: (1 + np.log(tf)) * idf(df), True, False),
    }
    ranked = B.neighbours(bags, asked, ways, 13)
    return W.precision_at(ranked, table(spark, sf_dir, "documents"), [1, 3, 5, 10, 13], label="lang", by=["config"]).select("config", "k", rounded(F.col("precision")).alias("precision"))


@query("bm25_precision_by_b", "WITH " + TF + f""",
dl AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY doc_id), al AS (SELECT (SELECT sum(length) FROM dl) / n AS mean FROM nd),
""" + ",\n".join(
    f"""c{i} AS (WITH v AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - {b} + {b} * length / mean)) AS weight FROM tf JOIN dl USING (doc_id) JOIN df USING (term), nd, al WHERE df <= {MOST} * n),
  s AS (SELECT q.doc_id AS query, d.doc_id, sum(d.weight) AS score FROM v q JOIN v d USING (term) WHERE q.doc_id % 20 = 0 GROUP BY ALL), {RANK}
  SELECT {b}::DOUBLE AS b, avg(p) AS precision FROM (SELECT query, sum(hit) / 5 AS p FROM hits WHERE place <= 5 GROUP BY query))"""
    for i, b in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))
) + "\nSELECT b, round(precision, 6) AS precision FROM (" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(5)) + ")")
def bm25_precision_by_b(spark, sf_dir):
    """Precision at five of BM25, the query's terms without weights, by the length parameter."""
    bags, asked, n = _searched(spark, sf_dir)
    lengths = B.each(bags, lambda block: pa.table({"n": pa.array([int(B.entries(block)[2].sum())], pa.int64())}), "n long")
    mean = (lengths.agg(F.sum("n")).first()[0] or 0) / max(1, n)
    way = lambda b: lambda tf, df, length: np.log(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - b + b * length / mean))
    ranked = B.neighbours(bags, asked, {str(b): (way(b), False, True) for b in (0.0, 0.25, 0.5, 0.75, 1.0)}, 13)
    p = W.precision_at(ranked, table(spark, sf_dir, "documents"), [5], label="lang", by=["config"])
    return p.select(F.col("config").cast("double").alias("b"), rounded(F.col("precision")).alias("precision"))


@query("chance_precision", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total FROM c)
SELECT round(sum(n * (n - 1)) / max(total * (total - 1)), 6) AS chance FROM c, t""")
def chance_precision(spark, sf_dir):
    """The precision of a random order: the share of pairs with one label."""
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(rounded(F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))


@query("weight_check", f"""WITH {TF}, o AS (SELECT term, log(2.718281828459045, 1 + n) - log(2.718281828459045, 1 + df) + 1 AS idf FROM df, nd) SELECT round(max(abs(o.idf - (ln((1 + n) / (1 + df)) + 1))), 6) AS largest, count(*) AS terms FROM o JOIN df USING (term), nd""")
def weight_check(spark, sf_dir):
    """Largest difference of two ways to the same idf, term by term."""
    bags = Bags(spark, sf_dir, keep=False)
    n = F.lit(bags.n)
    other = F.log(1 + n) - F.log(1 + F.col("df")) + 1
    return B.document_frequencies(bags.blocks).agg(rounded(F.max(F.abs(other - W.smooth_idf(F.col("df"), n)))).alias("largest"), F.count(F.lit(1)).alias("terms"))


@query("free_text_search", f"""WITH {WEIGHTS}, qt AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '\\p{{L}}+(?:[-'']\\p{{L}}+)*'))) AS term FROM benchmark),
q0 AS (SELECT item_id, term, count(*) AS tf FROM qt WHERE term NOT IN ({quoted(COMMON)}) GROUP BY ALL),
q AS (SELECT item_id, term, tf * idf AS weight FROM q0 JOIN (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, nd) USING (term)),
s AS (SELECT item_id, doc_id, sum(q.weight * w.weight) AS score FROM q JOIN w USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s)
SELECT item_id, doc_id, round(score, 6) AS score, place FROM r WHERE place <= 3""")
def free_text_search(spark, sf_dir):
    """Every benchmark text as a query: its three best documents by TF-IDF."""
    bags = Bags(spark, sf_dir)
    found = bags.search(bags.asked(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text"), 3)
    return found.filter("method = 'tfidf'").select(F.col("query").alias("item_id"), "doc_id", rounded(F.col("score")).alias("score"), "place")


#: Questions and answers out of the benchmark texts: the first half of the words asks; the second half, or its last eight words, answers.
ITEMS = """it0 AS (SELECT item_id, list_filter(regexp_split_to_array(replace(text, '|', ' '), '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS question, array_to_string(w[(len(w) + 1) // 2 + 1:], ' ') AS a1, array_to_string(w[greatest((len(w) + 1) // 2, len(w) - 8) + 1:], ' ') AS a2 FROM it0)"""

_HELD = ITEMS + ", forms AS (SELECT DISTINCT item_id, f FROM (SELECT item_id, " + FORM.format("unnest([a1, a2])") + " AS f FROM items) WHERE f <> ''), texts AS (SELECT doc_id, ' ' || " + FORM.format("text") + " || ' ' AS t FROM documents), held AS (SELECT DISTINCT item_id, doc_id FROM forms JOIN texts ON contains(t, ' ' || f || ' '))"

_ASKED = f"""qt AS (SELECT item_id, lower(unnest(regexp_extract_all(question, '\\p{{L}}+(?:[-'']\\p{{L}}+)*'))) AS term FROM items), q0 AS (SELECT item_id, term, count(*) AS tf FROM qt WHERE term NOT IN ({quoted(COMMON)}) GROUP BY ALL),
qw AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS weight FROM q0 JOIN df USING (term), nd)"""

_FOUND = f"""WITH {BM25}, {WEIGHTS.removeprefix(TF).lstrip(',')}, {_HELD}, {_ASKED},
sc AS (SELECT 'tfidf' AS method, item_id, doc_id, sum(q.weight * w.weight) AS score FROM qw q JOIN w USING (term) GROUP BY ALL UNION ALL SELECT 'bm25', item_id, doc_id, sum(bm.weight) FROM q0 JOIN bm USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY method, item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM sc QUALIFY place <= 5)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, question, answers (two forms parted by a bar)."""
    words = T.blank_tokens(F.regexp_replace("text", r"\|", " "))
    half = F.ceil(F.size("w") / 2).cast("int")
    part = lambda low, n: F.array_join(F.slice("w", low + 1, n), " ")
    rows = table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", words.alias("w")).withColumn("half", half)
    last = F.greatest(F.col("half"), F.size("w") - 8)
    return rows.select("item_id", part(F.lit(0), F.col("half")).alias("question"), F.concat_ws("|", part(F.col("half"), F.size("w")), part(last, F.size("w"))).alias("answers"))


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, sf_dir)
    return items, GO.holders(items, table(spark, sf_dir, "documents").select("doc_id", "text"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, the documents that hold their answers, and the first five by each method, written."""
    items, held = _held(spark, sf_dir)
    bags = Bags(spark, sf_dir)
    return items, held, written(bags.search(bags.asked(items, "item_id", "question"), 5).withColumnRenamed("query", "item_id"), "gold-ranked")


@query("answer_holders", f"WITH {_HELD} SELECT * FROM held")
def answer_holders(spark, sf_dir):
    """Which documents hold which answer, in either of its forms."""
    return _held(spark, sf_dir)[1]


@query("orphan_items", f"WITH {_HELD} SELECT item_id, question FROM items ANTI JOIN held USING (item_id)")
def orphan_items(spark, sf_dir):
    """Items whose answer no document holds."""
    items, held = _held(spark, sf_dir)
    return GO.orphans(items, held).select("item_id", "question")


@query("answer_hits", _FOUND + """, x AS (SELECT method, item_id, min(place) AS place FROM ranked JOIN held USING (item_id, doc_id) GROUP BY ALL)
SELECT method, k, round(avg(coalesce((place <= k)::INT, 0)), 6) AS hit, count(*) AS items FROM (SELECT DISTINCT item_id FROM held) CROSS JOIN (SELECT unnest(['tfidf', 'bm25']) AS method) CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS k) LEFT JOIN x USING (method, item_id) GROUP BY ALL""")
def answer_hits(spark, sf_dir):
    """How often a document that holds the answer is among the first 1, 2, 3 and 5, by method."""
    _, held, ranked = _found(spark, sf_dir)
    return GO.hit_rates(ranked, held, [1, 2, 3, 5], ["method"]).withColumn("hit", rounded(F.col("hit")))


@query("best_scores_by_answer", _FOUND + """, m AS (SELECT method, item_id, max(score) AS score FROM ranked GROUP BY ALL)
SELECT method, item_id IN (SELECT item_id FROM held) AS answerable, round(avg(coalesce(score, 0)), 6) AS score, count(*) AS items FROM items CROSS JOIN (SELECT unnest(['tfidf', 'bm25']) AS method) LEFT JOIN m USING (method, item_id) GROUP BY ALL""")
def best_scores_by_answer(spark, sf_dir):
    """Mean best score of items with and without an answer in the documents, by method."""
    items, held, ranked = _found(spark, sf_dir)
    return GO.best_scores(ranked, held, items, ["method"]).withColumn("score", rounded(F.col("score")))


@query("length_bias", f"""WITH {TF}, dl AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY doc_id),
t AS (SELECT term FROM df WHERE term NOT IN ({quoted(COMMON)}) ORDER BY df DESC, term LIMIT 3),
s AS (SELECT doc_id, length, sum(tf) AS raw, sum(tf / length) AS rel FROM tf JOIN dl USING (doc_id) WHERE term IN (SELECT term FROM t) GROUP BY ALL)
SELECT round(corr(length, raw), 6) AS raw_corr, round(corr(length, rel), 6) AS relative_corr,
  (SELECT median(length) FROM (SELECT length FROM s ORDER BY raw DESC, doc_id LIMIT 10)) AS raw_top, (SELECT median(length) FROM (SELECT length FROM s ORDER BY round(rel, 9) DESC, doc_id LIMIT 10)) AS relative_top FROM s""")
def length_bias(spark, sf_dir):
    """How the scores of a fixed three-term query follow document length, raw and by length."""
    blocks = Bags(spark, sf_dir, keep=False).blocks
    asked = B.document_frequencies(blocks).filter(~F.col("term").isin(*COMMON)).orderBy(F.desc("df"), "term").limit(3)
    rows = B.tf_variants(blocks, [r["term"] for r in asked.collect()])
    s = written(rows.groupBy("doc_id", "length").agg(F.sum("raw").cast("long").alias("raw"), F.sum("relative").alias("rel")), "length-scores")
    tops = [s.orderBy(F.desc(by), "doc_id").limit(10).agg(F.median("length").alias(name)) for by, name in ((F.col("raw"), "raw_top"), (F.round("rel", 9), "relative_top"))]
    whole = s.agg(rounded(F.corr("length", "raw")).alias("raw_corr"), rounded(F.corr("length", "rel")).alias("relative_corr"))
    return whole.crossJoin(tops[0]).crossJoin(tops[1])


@query("ranking_overlap", f"""WITH {WEIGHTS}, r AS (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS b FROM w)
SELECT round(avg(shared), 6) AS shared, round(avg(changed), 6) AS changed_first FROM (SELECT doc_id, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10 AS shared, max(CASE WHEN b = 1 AND a > 1 THEN 1 ELSE 0 END) AS changed FROM r GROUP BY doc_id)""")
def ranking_overlap(spark, sf_dir):
    """Mean overlap of the first ten terms by count and by TF-IDF, and how often the first one changes."""
    bags = Bags(spark, sf_dir)
    each = B.rank_overlap(bags.blocks, bags.n)
    return each.agg(rounded(F.avg("shared")).alias("shared"), rounded(F.avg("changed")).alias("changed_first"))


@query("term_ranks", f"""WITH {WEIGHTS} SELECT doc_id, term, tf, df, round(idf, 6) AS idf, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS by_count, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS by_weight, rank() OVER (PARTITION BY doc_id ORDER BY tf DESC) AS min_rank FROM w""")
def term_ranks(spark, sf_dir):
    """Every term of every document with its ranks by count and by weight."""
    bags = Bags(spark, sf_dir)
    ranks = B.term_ranks(bags.blocks, bags.n)
    return ranks.withColumns({c: rounded(F.col(c)) for c in ("idf", "weight")})


QUERIES, ORACLES = query.queries, query.oracles
