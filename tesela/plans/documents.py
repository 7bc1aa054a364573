"""Summaries of documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import bags as B
from tesela.operators import pairs as P
from tesela.operators import summary as S
from tesela.operators import vectors as X
from tesela.operators import vocab as V
from tesela.plans.fragments import COMMON, COUNTS, SENT, TF, TOK, quoted
from tesela.plans.registry import Registry, rounded, table
from tesela.sources.shared import small, written

query = Registry()
STOP = frozenset(COMMON)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


#: Bags of sentences, their idf inside the document and their weights.
BAGS = SENT + r""",
st AS (SELECT doc_id, sent_id, lower(unnest(regexp_extract_all(sentence, '\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*'))) AS term FROM sent),
bag AS (SELECT doc_id, sent_id, term, count(*) AS c FROM st WHERE term NOT IN (""" + quoted(COMMON) + r""") GROUP BY ALL),
ns AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
sidf AS (SELECT doc_id, term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM bag JOIN ns USING (doc_id) GROUP BY doc_id, term),
sw0 AS (SELECT doc_id, sent_id, term, c, idf, (1 + ln(c)) * idf AS w FROM bag JOIN sidf USING (doc_id, term)),
sw AS (SELECT doc_id, sent_id, term, c, idf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent_id)) AS w, c * idf / sqrt(sum(c * c * idf * idf) OVER (PARTITION BY doc_id, sent_id)) AS lw FROM sw0)"""


@query("sentence_counts", f"WITH {SENT} SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM sent GROUP BY doc_id")
def sentence_counts(spark, sf_dir):
    s = V.sentence_rows(_docs(spark, sf_dir))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.char_length("sentence")).cast("long").alias("chars"))


@query("lead_summary", f"WITH {SENT} SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary FROM sent WHERE sent_id < 3 GROUP BY doc_id")
def lead_summary(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).filter(F.size(s) > 0).select("doc_id", F.array_join(F.slice(s, 1, 3), " ").alias("summary"))


@query("position_length_summary", f"""WITH {SENT}, l AS (SELECT doc_id, sent_id, len(regexp_extract_all(sentence, '\\p{{L}}+|\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*'))::DOUBLE AS n FROM sent),
m AS (SELECT *, CASE WHEN median(n) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE median(n) OVER (PARTITION BY doc_id) END AS med FROM l),
s AS (SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.7 / (1 + sent_id) + 0.3 * exp(-abs(n - med) / med), 9) DESC, sent_id) AS place FROM m)
SELECT doc_id, list(sent_id::INT ORDER BY sent_id) AS picks FROM s WHERE place <= 3 GROUP BY doc_id""")
def position_length_summary(spark, sf_dir):
    return S.summaries(_docs(spark, sf_dir), ["position+length"], stop=STOP).select("doc_id", "picks")


@query("lexrank_edges", f"""WITH {BAGS} SELECT a.doc_id, a.sent_id::INT AS i, b.sent_id::INT AS j, round(sum(a.lw * b.lw), 6) AS w FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_id < b.sent_id
GROUP BY ALL HAVING sum(a.lw * b.lw) > 0.1""")
def lexrank_edges(spark, sf_dir):
    """Sentence pairs whose idf-weighted cosine exceeds 0.1."""
    return S.sentence_edges(_docs(spark, sf_dir), "idf", 0.1, STOP).withColumn("w", rounded(F.col("w")))


@query("sentence_similarity", f"""WITH {BAGS}, e AS (SELECT a.doc_id, a.sent_id AS i, b.sent_id AS j, sum(a.w * b.w) AS w FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_id < b.sent_id GROUP BY ALL)
SELECT doc_id, count(*) AS pairs, round(sum(w), 4) AS total, round(max(w), 6) AS closest FROM e WHERE w > 1e-9 GROUP BY doc_id""")
def sentence_similarity(spark, sf_dir):
    """Similar sentence pairs of every document under TF-IDF inside it."""
    e = S.sentence_edges(_docs(spark, sf_dir), "tfidf", 1e-9, STOP)
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("w"), 4).alias("total"), rounded(F.max("w")).alias("closest"))


@query("key_terms", f"""WITH {BAGS}, t AS (SELECT doc_id, term, sum(w) AS w FROM sw GROUP BY ALL), r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS place FROM t)
SELECT doc_id, place::INT AS place, term FROM r WHERE place <= 10""")
def key_terms(spark, sf_dir):
    return S.key_terms(_docs(spark, sf_dir), 10, STOP)


@query("summaries")
def summaries(spark, sf_dir):
    """Picks and measures of all selectors on every document."""
    return S.summaries(_docs(spark, sf_dir), list(S.SELECTORS), stop=STOP).drop("summary")


@query("summary_comparison")
def summary_comparison(spark, sf_dir):
    """Selectors compared: mean measures, and ROUGE against the first three sentences."""
    made = S.summaries(_docs(spark, sf_dir), [m for m in S.SELECTORS if m != "lead-1"], stop=STOP)
    leads = made.filter("method = 'lead-3'").select("doc_id", F.col("summary").alias("lead"))
    both = made.join(leads, "doc_id")
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("documents"), *[rounded(F.avg(c)).alias(c) for c in ("compression", "redundancy", "term_coverage")], rounded(F.avg(S.rouge_n(F.col("summary"), F.col("lead"))["f"])).alias("rouge_1"), rounded(F.avg(S.rouge_n(F.col("summary"), F.col("lead"), 2)["f"])).alias("rouge_2"), rounded(F.avg(S.rouge_l(F.col("summary"), F.col("lead")))).alias("rouge_l"))


_TURNS = r"""p AS (SELECT a.conv_id, a.turn, a.text AS cand, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
ct AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(cand, '\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*'), lambda x: lower(x))) AS w, generate_subscripts(regexp_extract_all(cand, '\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*'), 1) AS i FROM p),
rt AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(ref, '\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*'), lambda x: lower(x))) AS w, generate_subscripts(regexp_extract_all(ref, '\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*'), 1) AS i FROM p)"""


def _rouge_sql(n: int) -> str:
    gram = "w" if n == 1 else "w || ' ' || lead(w) OVER (PARTITION BY conv_id, turn ORDER BY i)"
    return f"""cg{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, {gram} AS g FROM ct) WHERE g IS NOT NULL GROUP BY ALL), rg{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, {gram} AS g FROM rt) WHERE g IS NOT NULL GROUP BY ALL),
f{n} AS (SELECT conv_id, turn, CASE WHEN coalesce(h, 0) = 0 THEN 0 ELSE 2.0 * h / (a + b) END AS f FROM (SELECT conv_id, turn FROM p)
  LEFT JOIN (SELECT conv_id, turn, sum(c) AS a FROM cg{n} GROUP BY ALL) USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, sum(c) AS b FROM rg{n} GROUP BY ALL) USING (conv_id, turn)
  LEFT JOIN (SELECT x.conv_id, x.turn, sum(least(x.c, y.c)) AS h FROM cg{n} x JOIN rg{n} y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.g = y.g GROUP BY ALL) USING (conv_id, turn))"""


@query("rouge_turns", f"WITH {_TURNS}, {_rouge_sql(1)}, {_rouge_sql(2)} SELECT f1.conv_id, f1.turn, round(f1.f, 6)::DOUBLE AS rouge_1, round(f2.f, 6)::DOUBLE AS rouge_2 FROM f1 JOIN f2 USING (conv_id, turn)")
def rouge_turns(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 of every conversation turn against the next."""
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    p = t.select("conv_id", "turn", F.col("text").alias("cand")).join(nxt, ["conv_id", "turn"])
    return p.select("conv_id", "turn", rounded(S.rouge_n(F.col("cand"), F.col("ref"), 1)["f"]).alias("rouge_1"), rounded(S.rouge_n(F.col("cand"), F.col("ref"), 2)["f"]).alias("rouge_2"))


@query("rouge_l_turns")
def rouge_l_turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    p = t.select("conv_id", "turn", F.col("text").alias("cand")).join(nxt, ["conv_id", "turn"])
    return p.select("conv_id", "turn", rounded(S.rouge_l(F.col("cand"), F.col("ref"))).alias("rouge_l"))


@query("entity_coverage", f"""WITH {SENT}, d AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{5,}}'))) AS names FROM documents), s AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary FROM sent WHERE sent_id < 3 GROUP BY doc_id)
SELECT doc_id, len(names) AS names, CASE WHEN len(names) > 0 THEN round(len(list_filter(names, lambda x: contains(lower(summary), lower(x)))) / len(names), 6) END AS coverage FROM d JOIN s USING (doc_id)""")
def entity_coverage(spark, sf_dir):
    """Share of a document's capitalized long words that its first three sentences name."""
    s = T.sentences(F.col("text"))
    d = _docs(spark, sf_dir).filter(F.size(s) > 0).select("doc_id", F.array_distinct(T.found(F.col("text"), r"\p{Lu}\p{Ll}{5,}")).alias("names"), F.array_join(F.slice(s, 1, 3), " ").alias("summary"))
    return d.select("doc_id", F.size("names").cast("long").alias("names"), rounded(S.entity_coverage(F.col("summary"), F.col("names"))).alias("coverage"))


# ---- vectors

#: Vectors of the commonest words: the word of rank r has the vector of that id.
WORDVEC = COUNTS + """,
wv AS (SELECT term, embedding::DOUBLE[] AS v FROM (SELECT term, row_number() OVER (ORDER BY c DESC, term) - 1 AS r FROM counts) JOIN embeddings ON r = vec_id)"""


def _word_vectors(spark: SparkSession, sf_dir: str, counts: DataFrame, plain: bool = False) -> DataFrame:
    """term, `vector`: as doubles, or `plain` as they are stored, which takes less room."""
    vector = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("vector"))
    top = V.frequency_ranks(counts).select("term", (F.col("rank") - 1).alias("vec_id"))
    return top.join(vectors, "vec_id").select("term", "vector")


@query("pair_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", rounded(X.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("minmax_cosine", """WITH c AS (SELECT a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, label, round((c - min(c) OVER (PARTITION BY label)) / (max(c) OVER (PARTITION BY label) - min(c) OVER (PARTITION BY label)), 6) AS scaled FROM c""")
def minmax_cosine(spark, sf_dir):
    """Cosines rescaled to 0 and 1 within each label."""
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = e.join(nxt, "vec_id").select("vec_id", "label", X.cosine(F.col("embedding"), F.col("other")).alias("c"))
    return c.select("vec_id", "label", rounded(X.minmax(F.col("c"), ["label"])).alias("scaled"))


_NEAR = """n AS (SELECT q.vec_id AS query, d.vec_id, q.label = d.label AS hit, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) DESC, d.vec_id) AS place FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"""


@query("nearest_vectors", f"WITH {_NEAR} SELECT query, vec_id, round(cosine, 6) AS cosine, place FROM n WHERE place <= 5")
def nearest_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return X.nearest(e.filter(F.col("vec_id") % 20 == 0), e, 5).withColumn("cosine", rounded(F.col("cosine")))


@query("vector_precision", f"WITH {_NEAR} SELECT label, round(avg(p), 6) AS precision, count(*) AS queries FROM (SELECT query, avg(hit::INT) AS p FROM n WHERE place <= 5 GROUP BY query) x JOIN embeddings e ON e.vec_id = x.query GROUP BY label")
def vector_precision(spark, sf_dir):
    """Share of the five nearest vectors with the query's label, by label."""
    e = table(spark, sf_dir, "embeddings")
    near = X.nearest(e.filter(F.col("vec_id") % 20 == 0), e, 5)
    labels = e.select("vec_id", "label")
    rows = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("wanted")), "query")
    each = rows.groupBy("query", "wanted").agg(F.avg((F.col("label") == F.col("wanted")).cast("int")).alias("p"))
    return each.groupBy(F.col("wanted").alias("label")).agg(rounded(F.avg("p")).alias("precision"), F.count(F.lit(1)).alias("queries"))


@query("vector_coverage", f"WITH {WORDVEC} SELECT doc_id, round(avg((v IS NOT NULL)::INT), 6) AS covered FROM word LEFT JOIN wv USING (term) GROUP BY doc_id")
def vector_coverage(spark, sf_dir):
    words = V.word_rows(_docs(spark, sf_dir))
    known = _word_vectors(spark, sf_dir, V.term_counts(words)).select("term", F.lit(1).alias("known"))
    return words.join(known, "term", "left").groupBy("doc_id").agg(rounded(F.avg(F.coalesce("known", F.lit(0)))).alias("covered"))


def _mean_sql(weight: str) -> str:
    return f"""WITH {WORDVEC}, total AS (SELECT sum(c) AS t FROM counts), x AS (SELECT doc_id, {weight} AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM word JOIN counts USING (term) JOIN wv USING (term), total),
m AS (SELECT doc_id, i, sum(w * x) / sum(w) AS x FROM x GROUP BY doc_id, i)
SELECT d.doc_id, coalesce(round(sqrt(sum(x * x)), 6), 0) AS norm, coalesce(round(sum(x) FILTER (WHERE i = 1), 6), 0) AS first FROM (SELECT DISTINCT doc_id FROM word) d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id"""


def _means(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
    blocks = B.blocks(_docs(spark, sf_dir).select("doc_id", words.alias("words")))
    counts = written(B.term_totals(blocks).select("term", "c"), "mean-counts")
    vectors = _word_vectors(spark, sf_dir, counts, plain=True)
    known = vectors.join(X.sif_weights(counts), "term") if weighted else vectors.withColumn("weight", F.lit(1.0))
    return B.mean_vectors(blocks, small(written(known, "known-vectors")), 64)


@query("mean_vectors", _mean_sql("1.0"))
def mean_vectors(spark, sf_dir):
    v = _means(spark, sf_dir, False)
    return v.select("doc_id", rounded(F.sqrt(X.dot(F.col("vector"), F.col("vector")))).alias("norm"), rounded(F.col("vector")[0]).alias("first"))


@query("sif_vectors", _mean_sql("0.001 / (0.001 + c / t)"))
def sif_vectors(spark, sf_dir):
    """Means weighted by smooth inverse frequency."""
    v = _means(spark, sf_dir, True)
    return v.select("doc_id", rounded(F.sqrt(X.dot(F.col("vector"), F.col("vector")))).alias("norm"), rounded(F.col("vector")[0]).alias("first"))


@query("sif_without_direction")
def sif_without_direction(spark, sf_dir):
    """The same without their first principal direction: lengths before and after."""
    v = written(_means(spark, sf_dir, True), "sif-vectors")
    left = X.without_directions(v, X.principal_directions(v, 64))
    return left.select("doc_id", rounded(F.sqrt(X.dot(F.col("vector"), F.col("vector")))).alias("norm"))


@query("sparse_pair_cosine", f"""WITH {BAGS}, a AS (SELECT doc_id, term, w FROM sw WHERE sent_id = 0), b AS (SELECT doc_id, term, w FROM sw WHERE sent_id = 1)
SELECT doc_id, round(coalesce(sum(a.w * b.w), 0), 6) AS cosine FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) d JOIN a USING (doc_id) LEFT JOIN b USING (doc_id, term) GROUP BY doc_id""")
def sparse_pair_cosine(spark, sf_dir):
    """Cosine of the first two sentences of every document, over sparse weights."""
    sentences = F.transform(T.sentences(F.col("text")), lambda x: T.content_tokens(x, list(COMMON)))
    return S.first_cosines(_docs(spark, sf_dir).select("doc_id", sentences.alias("sentences"))).withColumn("cosine", rounded(F.col("cosine")))


# ---- pairs: turns and the next ones, by who speaks; the gold score is the share of words that both have

_SIDES = "(SELECT p.conv_id || ':' || p.turn || '/' || s.side AS doc_id, s.text FROM (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) p, LATERAL (SELECT unnest(['a', 'b']) AS side, unnest([p.a, p.b]) AS text) s)"

PAIRS = TF + f""",
s{TOK.replace('FROM documents', f'FROM {_SIDES}').replace('FROM tok', 'FROM stok').replace('word AS (', 'sword AS (', 1)},
sw1 AS (SELECT split_part(doc_id, '/', 1) AS pair, split_part(doc_id, '/', 2) AS side, term, count(*) AS tf FROM sword GROUP BY ALL),
pr AS (SELECT a.conv_id || ':' || a.turn AS pair, a.role AS category FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
gl AS (SELECT pr.pair, category, CASE WHEN n = 0 OR n IS NULL THEN 0 ELSE h / n END AS gold FROM pr LEFT JOIN (SELECT pair, count(*) AS n, count(*) FILTER (WHERE k = 2) AS h FROM (SELECT pair, term, count(DISTINCT side) AS k FROM sw1 GROUP BY ALL) GROUP BY pair) x USING (pair)),
mdf AS (SELECT term, sum(df) AS df FROM (SELECT term, df FROM df UNION ALL SELECT term, count(*) FROM sw1 GROUP BY term) GROUP BY term),
nn AS (SELECT (SELECT count(DISTINCT doc_id) FROM tf) + 2 * (SELECT count(*) FROM pr) AS n),
wt AS (SELECT pair, side, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM sw1 JOIN mdf USING (term), nn),
nr AS (SELECT pair, side, sqrt(sum(w * w)) AS l FROM wt GROUP BY ALL),
s1 AS (SELECT pair, coalesce(d / (x.l * y.l), 0) AS similarity FROM pr LEFT JOIN (SELECT a.pair, sum(a.w * b.w) AS d FROM wt a JOIN wt b ON a.pair = b.pair AND a.term = b.term AND a.side = 'a' AND b.side = 'b' GROUP BY a.pair) d USING (pair) LEFT JOIN (SELECT * FROM nr WHERE side = 'a') x USING (pair) LEFT JOIN (SELECT * FROM nr WHERE side = 'b') y USING (pair)),
cc AS (SELECT term, sum(tf) AS c FROM tf GROUP BY term), wv2 AS (SELECT term, embedding::DOUBLE[] AS v FROM (SELECT term, row_number() OVER (ORDER BY c DESC, term) - 1 AS r FROM cc) JOIN embeddings ON r = vec_id),
xx AS (SELECT pair, side, tf AS m, tf * 0.001 / (0.001 + c / (SELECT sum(c) FROM cc)) AS f, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sw1 JOIN wv2 USING (term) JOIN cc USING (term)),
vv AS (SELECT pair, side, i, sum(m * x) / sum(m) AS m, sum(f * x) / sum(f) AS f FROM xx GROUP BY ALL),
s2 AS (SELECT a.pair, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS mean, sum(a.f * b.f) / (sqrt(sum(a.f * a.f)) * sqrt(sum(b.f * b.f))) AS sif FROM vv a JOIN vv b ON a.pair = b.pair AND a.i = b.i AND a.side = 'a' AND b.side = 'b' GROUP BY a.pair),
sims AS (SELECT pair, 'tfidf' AS method, similarity FROM s1 UNION ALL SELECT pair, 'mean', coalesce(mean, 0) FROM pr LEFT JOIN s2 USING (pair) UNION ALL SELECT pair, 'sif', coalesce(sif, 0) FROM pr LEFT JOIN s2 USING (pair)),
er AS (SELECT pair, category, method, similarity, (similarity - min(similarity) OVER (PARTITION BY method)) / (max(similarity) OVER (PARTITION BY method) - min(similarity) OVER (PARTITION BY method)) AS scaled,
  (gold - min(gold) OVER ()) / (max(gold) OVER () - min(gold) OVER ()) AS gold FROM sims JOIN gl USING (pair))"""

def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    p = t.select("conv_id", "turn", F.col("role").alias("category"), F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])
    words = lambda c: F.array_distinct(F.transform(F.filter(T.tokens(F.coalesce(c, F.lit(""))), T.is_word), F.lower))
    share = F.try_divide(F.size(F.array_intersect(words(F.col("a")), words(F.col("b")))), F.size(F.array_union(words(F.col("a")), words(F.col("b")))))
    return written(p.select(F.concat_ws(":", "conv_id", "turn").alias("pair"), "category", F.coalesce(share, F.lit(0.0)).alias("gold"), "a", "b"), "pairs")


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tesela.plans.models import latent as latent_space

    pairs = _pairs(spark, sf_dir)
    corpus = written(V.term_frequencies(V.word_rows(_docs(spark, sf_dir).repartition("doc_id"))), "pair-corpus")
    vectors = written(_word_vectors(spark, sf_dir, corpus.groupBy("term").agg(F.sum("tf").alias("c"))), "pair-vectors")
    return pairs, P.compared(pairs, corpus, vectors, 64, latent_space(spark, sf_dir, 150).terms, 150)


def _plain_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the three representations that SQL can say, too."""
    pairs = _pairs(spark, sf_dir)
    words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
    docs = _docs(spark, sf_dir).select("doc_id", words.alias("words"))
    return P.errors(pairs, P.plain(pairs, docs, lambda counts: _word_vectors(spark, sf_dir, counts, plain=True), 64))


@query("pair_similarities", f"WITH {PAIRS} SELECT pair, category, method, round(similarity, 6) AS similarity, round(gold, 6) AS gold FROM er")
def pair_similarities(spark, sf_dir):
    """Similarity of every pair under the three plain representations."""
    e = _plain_errors(spark, sf_dir)
    return e.select("pair", "category", "method", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("gold")).alias("gold"))


@query("pair_profile", f"WITH {PAIRS} SELECT category, method, count(*) AS n, round(avg(scaled), 6) AS scaled, round(avg(gold), 6) AS gold, round(avg(scaled - gold), 6) AS error FROM er GROUP BY ALL")
def pair_profile(spark, sf_dir):
    """Means of similarity, gold score and signed error by category and method."""
    p = P.profile(_plain_errors(spark, sf_dir))
    return p.select("category", "method", "n", *[rounded(F.col(c)).alias(c) for c in ("scaled", "gold", "error")])


@query("worst_pairs", f"WITH {PAIRS}, w AS (SELECT category, pair, avg(scaled - gold) AS error, any_value(gold) AS gold FROM er GROUP BY ALL) SELECT category, row_number() OVER (PARTITION BY category ORDER BY round(error, 9) DESC, pair) AS place, pair, round(gold, 6) AS gold, round(error, 6) AS error FROM w QUALIFY place <= 5")
def worst_pairs(spark, sf_dir):
    """The five pairs of every category that the methods overrate most."""
    w = P.worst(_plain_errors(spark, sf_dir))
    return w.select("category", "place", "pair", rounded(F.col("gold")).alias("gold"), rounded(F.col("error")).alias("error"))


@query("pair_comparison")
def pair_comparison(spark, sf_dir):
    """All five representations: rank correlation with the gold score, and mean error."""
    from tesela.operators import stats as ST

    pairs, found = _compared(spark, sf_dir)
    e = written(P.errors(pairs, found), "pair-errors")
    rho = ST.spearman(e.select("method", "scaled", "gold"), "scaled", "gold", ["method"])
    return rho.join(e.groupBy("method").agg(F.avg("error").alias("error")), "method").select("method", F.round("rho", 4).alias("rho"), F.round("error", 4).alias("error"), "n")


QUERIES, ORACLES = query.queries, query.oracles
