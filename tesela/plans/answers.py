"""Question answering: conversation turns ask the document whose id is the conversation's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import answers as A
from tesela.operators import vocab as V
from tesela.plans.fragments import COMMON, FORM, SENT, quoted
from tesela.plans.registry import Registry, rounded, table

query = Registry()
_WN = r"\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("turn = 0")
    return t.select(F.col("conv_id").alias("q_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("question"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentence_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("question_types", "SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}'" for k, p in A.TRIGGERS) + " ELSE 'otro' END AS kind FROM (SELECT text FROM conversations UNION ALL SELECT unnest(['¿Quién ganó?', '¿Cuántos años tiene?', '¿En qué año nació?', '¿De qué país es?', '¿Por qué cayó?', '¿Qué pasó?']))) GROUP BY kind")
def question_types(spark, sf_dir):
    own = spark.createDataFrame([(q,) for q in ("¿Quién ganó?", "¿Cuántos años tiene?", "¿En qué año nació?", "¿De qué país es?", "¿Por qué cayó?", "¿Qué pasó?")], "text string")
    asked = table(spark, sf_dir, "conversations").select("text").unionAll(own)
    return asked.groupBy(A.question_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("answer_forms", f"SELECT conv_id, turn, {FORM.format('text')} AS form FROM conversations")
def answer_forms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_form(F.col("text")).alias("form"))


_PAIR = "p AS (SELECT a.conv_id, a.turn, " + FORM.format("a.text") + " AS a, " + FORM.format("b.text") + " AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query("answer_scores", f"""WITH {_PAIR}, x AS (SELECT conv_id, turn, unnest(string_split(a, ' ')) AS w FROM p WHERE a <> ''), y AS (SELECT conv_id, turn, unnest(string_split(b, ' ')) AS w FROM p WHERE b <> ''),
xc AS (SELECT conv_id, turn, w, count(*) AS c FROM x GROUP BY ALL), yc AS (SELECT conv_id, turn, w, count(*) AS c FROM y GROUP BY ALL),
h AS (SELECT conv_id, turn, sum(least(xc.c, yc.c)) AS h FROM xc JOIN yc USING (conv_id, turn, w) GROUP BY ALL),
n AS (SELECT conv_id, turn, sum(c) AS n FROM (SELECT * FROM xc UNION ALL SELECT * FROM yc) GROUP BY ALL)
SELECT conv_id, turn, (a = b)::INT::DOUBLE AS exact, CASE WHEN n IS NULL THEN 1 ELSE round(2 * coalesce(h, 0) / n, 6) END::DOUBLE AS f1 FROM p LEFT JOIN h USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)""")
def answer_scores(spark, sf_dir):
    """Exact match and token F1 of every turn against the next."""
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    p = t.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])
    return p.select("conv_id", "turn", A.exact_match(F.col("a"), F.col("b")).alias("exact"), rounded(A.token_f1(F.col("a"), F.col("b"))).alias("f1"))


@query("alias_scores", "SELECT 100.0::DOUBLE AS exact, 100.0::DOUBLE AS f1, count(*) AS n FROM conversations WHERE turn = 0")
def alias_scores(spark, sf_dir):
    """Scores against references of several forms, averaged in percent: each turn against itself among others."""
    t = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.regexp_replace("text", r"\|", " ").alias("a"))
    refs = F.concat(F.lit("otra respuesta|"), F.col("a"), F.lit(" | x "))
    return t.agg((100 * F.avg(A.best_of(F.col("a"), refs, A.exact_match))).alias("exact"), rounded(100 * F.avg(A.best_of(F.col("a"), refs, A.token_f1))).alias("f1"), F.count(F.lit(1)).alias("n"))


_RETRIEVAL = SENT + f""",
q AS (SELECT conv_id AS q_id, conv_id AS doc_id, text FROM conversations WHERE turn = 0),
st AS (SELECT doc_id, sent_id, lower(unnest(regexp_extract_all(sentence, '{_WN}'))) AS term FROM sent WHERE doc_id IN (SELECT doc_id FROM q)),
bag AS (SELECT doc_id, sent_id, term, count(*) AS c FROM st WHERE term NOT IN ({quoted(COMMON)}) GROUP BY ALL),
ns AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id), ln_ AS (SELECT doc_id, sent_id, sum(c) AS len FROM bag GROUP BY ALL), mn AS (SELECT doc_id, sum(len) / any_value(n) AS mean FROM ln_ JOIN ns USING (doc_id) GROUP BY doc_id),
idf AS (SELECT doc_id, term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS ridf FROM bag JOIN ns USING (doc_id) GROUP BY ALL),
dw AS (SELECT doc_id, sent_id, term, (1 + ln(c)) * idf / sqrt(sum(((1 + ln(c)) * idf) * ((1 + ln(c)) * idf)) OVER (PARTITION BY doc_id, sent_id)) AS w, ridf * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len / mean)) AS bm FROM bag JOIN idf USING (doc_id, term) JOIN ln_ USING (doc_id, sent_id) JOIN mn USING (doc_id)),
qt AS (SELECT q_id, doc_id, term, count(*) AS c FROM (SELECT q_id, doc_id, lower(unnest(regexp_extract_all(text, '{_WN}'))) AS term FROM q) WHERE term NOT IN ({quoted(COMMON)}) GROUP BY ALL),
qw AS (SELECT q_id, doc_id, term, (1 + ln(c)) * idf / sqrt(sum(((1 + ln(c)) * idf) * ((1 + ln(c)) * idf)) OVER (PARTITION BY q_id)) AS qw FROM qt JOIN idf USING (doc_id, term)),
h AS (SELECT q_id, doc_id, sent_id, sum(qw * w) AS tfidf, sum(bm) AS bm FROM qw JOIN dw USING (doc_id, term) GROUP BY ALL),
s AS (SELECT q.q_id, sent.doc_id, sent.sent_id, coalesce(tfidf, 0) AS tfidf, CASE WHEN max(coalesce(bm, 0)) OVER (PARTITION BY q.q_id) > 0 THEN coalesce(bm, 0) / max(coalesce(bm, 0)) OVER (PARTITION BY q.q_id) ELSE 0 END AS bm25 FROM q JOIN sent USING (doc_id) LEFT JOIN h ON h.q_id = q.q_id AND h.doc_id = sent.doc_id AND h.sent_id = sent.sent_id)"""


@query("sentence_retrieval", f"WITH {_RETRIEVAL} SELECT q_id, doc_id, sent_id::INT AS sent_id, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25 FROM s")
def sentence_retrieval(spark, sf_dir):
    """TF-IDF and BM25 of every sentence of the asked document."""
    s = A.sentence_scores(_questions(spark, sf_dir), _sentences(spark, sf_dir), list(COMMON))
    return s.select("q_id", "doc_id", "sent_id", rounded(F.col("tfidf")).alias("tfidf"), rounded(F.col("bm25")).alias("bm25"))


@query("retrieval_agreement", f"""WITH {_RETRIEVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(tfidf, 9) DESC, sent_id) AS a, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 9) DESC, sent_id) AS b FROM s),
f AS (SELECT q_id, min(b) FILTER (WHERE a = 1) AS place FROM r GROUP BY q_id)
SELECT k, round(avg((place <= k)::INT), 6) AS hit FROM f, (VALUES (1), (2), (3), (5)) t(k) GROUP BY k""")
def retrieval_agreement(spark, sf_dir):
    """How often the best sentence by TF-IDF is among the first k by BM25."""
    from pyspark.sql import Window

    s = A.sentence_scores(_questions(spark, sf_dir), _sentences(spark, sf_dir), list(COMMON))
    place = lambda by: F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round(by, 9)), "sent_id"))
    first = s.withColumn("a", place("tfidf")).withColumn("b", place("bm25")).filter("a = 1").select(F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 5)])).alias("k"), "b")
    return first.groupBy("k").agg(rounded(F.avg((F.col("b") <= F.col("k")).cast("int"))).alias("hit"))


@query("answers")
def answers(spark, sf_dir):
    """Answers to the first turn of every conversation from the document of the same id."""
    a = A.answer(_questions(spark, sf_dir), _sentences(spark, sf_dir), list(COMMON))
    return a.select("q_id", "answer", "type", "sent_id", *[rounded(F.col(c)).alias(c) for c in ("retrieval", "extraction", "coverage", "confidence")], "abstained", "reason")


@query("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    """Answers and abstentions by threshold; an answer counts as right if the next turn holds it."""
    a = A.answer(_questions(spark, sf_dir), _sentences(spark, sf_dir), list(COMMON), least=0.0)
    nxt = table(spark, sf_dir, "conversations").filter("turn = 1").select(F.col("conv_id").alias("q_id"), F.col("text").alias("reply"))
    rows = a.join(nxt, "q_id").select("confidence", (F.col("answer") != "") & F.col("reply").contains(F.col("answer")), F.col("reply").rlike(r"\p{L}"))
    rows = rows.toDF("confidence", "right", "answerable").fillna(0.0, ["confidence"])
    return A.threshold_sweep(rows, [i * 0.05 for i in range(14)]).withColumn("threshold", rounded(F.col("threshold")))


QUERIES, ORACLES = query.queries, query.oracles
