"""n-grams, language models and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import language_model as L
from tesela.operators import vocab as V
from tesela.plans.fragments import COMMON, COUNTS, TOK, quoted
from tesela.plans.registry import Registry, rounded, table
from tesela.sources.shared import written

query = Registry()


def _words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
    return table(spark, sf_dir, name).select(key, words.alias("words"))


#: Pairs of successive words of a document.
SEQ = TOK + """,
seq AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM word),
bi AS (SELECT a.doc_id, a.term AS w1, b.term AS w2 FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i = a.i + 1)"""


@query("bigram_counts", f"WITH {SEQ} SELECT w1, w2, count(*) AS c FROM bi GROUP BY ALL")
def bigram_counts(spark, sf_dir):
    return L.ngram_counts(_words(spark, sf_dir), 2).select(F.col("gram")[0].alias("w1"), F.col("gram")[1].alias("w2"), "c")


@query("trigram_top", f"""WITH {SEQ}, tri AS (SELECT a.term AS w1, b.term AS w2, c.term AS w3 FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN seq c ON a.doc_id = c.doc_id AND c.i = a.i + 2)
SELECT w1, w2, w3, count(*) AS c FROM tri GROUP BY ALL ORDER BY c DESC, w1, w2, w3 LIMIT 50""")
def trigram_top(spark, sf_dir):
    g = L.ngram_counts(_words(spark, sf_dir), 3).select(*[F.col("gram")[i].alias(f"w{i + 1}") for i in range(3)], "c")
    return g.orderBy(F.desc("c"), "w1", "w2", "w3").limit(50)


@query("content_bigrams", f"""WITH {SEQ} SELECT w1, w2, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, w1, w2) AS rank FROM bi
WHERE length(w1) >= 3 AND length(w2) >= 3 AND w1 NOT IN ({quoted(COMMON)}) AND w2 NOT IN ({quoted(COMMON)}) GROUP BY w1, w2 ORDER BY c DESC, w1, w2 LIMIT 200""")
def content_bigrams(spark, sf_dir):
    """The first 200 pairs of content words with their rank."""
    g = L.content_grams(L.ngram_counts(_words(spark, sf_dir), 2), list(COMMON)).select(F.col("gram")[0].alias("w1"), F.col("gram")[1].alias("w2"), "c")
    top = g.orderBy(F.desc("c"), "w1", "w2").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "w1", "w2")).cast("long"))


_X = "(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END)"


@query("collocations", f"""WITH {SEQ}, u AS (SELECT term, count(*)::DOUBLE AS n FROM word GROUP BY term), t AS (SELECT sum(n) AS n FROM u),
p AS (SELECT w1, w2, count(*) AS c FROM bi GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT w1, w2, c, a.n AS n1, b.n AS n2, t.n FROM p JOIN u a ON w1 = a.term JOIN u b ON w2 = b.term, t
  WHERE length(w1) >= 3 AND length(w2) >= 3 AND w1 NOT IN ({quoted(COMMON)}) AND w2 NOT IN ({quoted(COMMON)})),
cells AS (SELECT w1, w2, c, n1, n2, n, unnest([c::DOUBLE, n1 - c, n2 - c, n - n1 - n2 + c]) AS o, unnest([n1 * n2 / n, n1 * (n - n2) / n, (n - n1) * n2 / n, (n - n1) * (n - n2) / n]) AS e FROM x)
SELECT w1, w2, c, round(log2(c * n / (n1 * n2)), 6) AS pmi, round(2 * sum({_X}), 4) AS llr FROM cells GROUP BY w1, w2, c, n, n1, n2""")
def collocations(spark, sf_dir):
    return L.collocations(_words(spark, sf_dir), list(COMMON)).select("w1", "w2", "c", rounded(F.col("pmi")).alias("pmi"), F.round("llr", 4).alias("llr"))


@query("collocation_leaders", f"""WITH {SEQ}, u AS (SELECT term, count(*)::DOUBLE AS n FROM word GROUP BY term), t AS (SELECT sum(n) AS n FROM u),
p AS (SELECT w1, w2, count(*) AS c FROM bi GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT w1, w2, c, round(log2(c * t.n / (a.n * b.n)), 6) AS pmi FROM p JOIN u a ON w1 = a.term JOIN u b ON w2 = b.term, t
  WHERE length(w1) >= 3 AND length(w2) >= 3 AND w1 NOT IN ({quoted(COMMON)}) AND w2 NOT IN ({quoted(COMMON)}))
(SELECT 'frequency' AS criterion, * FROM x ORDER BY c DESC, w1, w2 LIMIT 8) UNION ALL (SELECT 'pmi', * FROM x ORDER BY pmi DESC, w1, w2 LIMIT 8)""")
def collocation_leaders(spark, sf_dir):
    """The eight most frequent pairs and the eight of highest mutual information, one below the other."""
    x = L.collocations(_words(spark, sf_dir), list(COMMON)).select("w1", "w2", "c", rounded(F.col("pmi")).alias("pmi"))
    tops = [x.orderBy(F.desc(by), "w1", "w2").limit(8).select(F.lit(name).alias("criterion"), "*") for name, by in (("frequency", "c"), ("pmi", "pmi"))]
    return tops[0].unionByName(tops[1])


#: The words of all documents as one list, by id and place.
FLAT = TOK + """,
flat AS (SELECT term AS w1, lead(term) OVER o AS w2, lead(term, 2) OVER o AS w3 FROM word WINDOW o AS (ORDER BY doc_id, pos))"""

_CONTENT = "length({0}) >= 3 AND {0} NOT IN (" + quoted(COMMON) + ")"


def _flat(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return L.flat_documents(_words(spark, sf_dir), n, ["doc_id"])


@query("flat_collocations", f"""WITH {FLAT}, u AS (SELECT term, count(*)::DOUBLE AS n FROM word GROUP BY term), t AS (SELECT sum(n) AS n FROM u),
p AS (SELECT w1, w2, count(*) AS c FROM flat WHERE w2 IS NOT NULL AND {_CONTENT.format('w1')} AND {_CONTENT.format('w2')} GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT w1, w2, c, a.n AS n1, b.n AS n2, t.n FROM p JOIN u a ON w1 = a.term JOIN u b ON w2 = b.term, t),
cells AS (SELECT w1, w2, c, n1, n2, n, unnest([c::DOUBLE, n1 - c, n2 - c, n - n1 - n2 + c]) AS o, unnest([n1 * n2 / n, n1 * (n - n2) / n, (n - n1) * n2 / n, (n - n1) * (n - n2) / n]) AS e FROM x)
SELECT w1, w2, c, round(log2(c * n / (n1 * n2)), 6) AS pmi, round(2 * sum({_X}), 4) AS llr FROM cells GROUP BY w1, w2, c, n, n1, n2""")
def flat_collocations(spark, sf_dir):
    """Pairs over all documents as one list of words, those across two documents too."""
    docs = _flat(spark, sf_dir, 2)
    return L.collocations(docs, list(COMMON), runs="run").select("w1", "w2", "c", rounded(F.col("pmi")).alias("pmi"), F.round("llr", 4).alias("llr"))


_TRIGRAMS = FLAT + f""", u AS (SELECT term, count(*)::DOUBLE AS n FROM word GROUP BY term), t AS (SELECT sum(n) AS n FROM u),
g2 AS (SELECT w1 AS a, w2 AS b, count(*)::DOUBLE AS n FROM flat WHERE w2 IS NOT NULL GROUP BY ALL), g13 AS (SELECT w1 AS a, w3 AS b, count(*)::DOUBLE AS n FROM flat WHERE w3 IS NOT NULL GROUP BY ALL),
p AS (SELECT w1, w2, w3, count(*) AS c FROM flat WHERE w3 IS NOT NULL AND {' AND '.join(_CONTENT.format(w) for w in ('w1', 'w2', 'w3'))} GROUP BY ALL HAVING count(*) >= 5),
x AS (SELECT p.*, x1.n AS n1, x2.n AS n2, x3.n AS n3, a.n AS n12, b.n AS n23, d.n AS n13, t.n FROM p JOIN u x1 ON w1 = x1.term JOIN u x2 ON w2 = x2.term JOIN u x3 ON w3 = x3.term
  JOIN g2 a ON a.a = w1 AND a.b = w2 JOIN g2 b ON b.a = w2 AND b.b = w3 JOIN g13 d ON d.a = w1 AND d.b = w3, t),
cells AS (SELECT x.*, unnest([c, n12 - c, n13 - c, n23 - c, n1 - n12 - n13 + c, n2 - n12 - n23 + c, n3 - n13 - n23 + c, n - n1 - n2 - n3 + n12 + n13 + n23 - c]) AS o,
  unnest([n1 * n2 * n3, n1 * n2 * (n - n3), n1 * (n - n2) * n3, (n - n1) * n2 * n3, n1 * (n - n2) * (n - n3), (n - n1) * n2 * (n - n3), (n - n1) * (n - n2) * n3, (n - n1) * (n - n2) * (n - n3)]) / (n * n) AS e FROM (SELECT * REPLACE (c::DOUBLE AS c) FROM x) x),
tri AS (SELECT w1, w2, w3, c::BIGINT AS c, round(log2(c * n * n / (n1 * n2 * n3)), 6) AS pmi, round(2 * sum({_X}), 4) AS llr FROM cells GROUP BY w1, w2, w3, c, n, n1, n2, n3)"""


def _trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.trigram_collocations(_flat(spark, sf_dir, 3), list(COMMON), runs="run")
    return t.select("w1", "w2", "w3", "c", rounded(F.col("pmi")).alias("pmi"), F.round("llr", 4).alias("llr"))


@query("trigram_collocations", f"WITH {_TRIGRAMS} SELECT * FROM tri")
def trigram_collocations(spark, sf_dir):
    """Triples of content words seen five times over all documents as one list, with both measures."""
    return _trigrams(spark, sf_dir)


@query("trigram_leaders", f"WITH {_TRIGRAMS} " + " UNION ALL ".join(f"(SELECT '{name}' AS criterion, * FROM tri ORDER BY {by} DESC, w1, w2, w3 LIMIT 8)" for name, by in (("frequency", "c"), ("pmi", "pmi"), ("likelihood", "llr"))))
def trigram_leaders(spark, sf_dir):
    """The eight first triples by frequency, by mutual information and by likelihood."""
    x = written(_trigrams(spark, sf_dir), "trigram-scores")
    tops = [x.orderBy(F.desc(by), "w1", "w2", "w3").limit(8).select(F.lit(name).alias("criterion"), "*") for name, by in (("frequency", "c"), ("pmi", "pmi"), ("likelihood", "llr"))]
    return tops[0].unionAll(tops[1]).unionAll(tops[2])


#: A tenth of the documents validates; the draw is a digest of the id.
VALID = "('0x' || substr(md5('split:' || doc_id), 1, 4))::INT % 10 = 0"


def _validates(key: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col(key).cast("string"))), 1, 4), 16, 10).cast("int") % 10 == 0


def _split(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    return docs.filter(~_validates(key)), docs.filter(_validates(key))


def _lm_sql(n: int) -> str:
    """Predictions of order n with their contexts as strings."""
    lags = " || ' ' || ".join(f"coalesce(lag(term, {j}) OVER w, '<inicio>')" for j in range(n - 1, 0, -1))
    return f"""e{n} AS (SELECT doc_id, term, i FROM seq UNION ALL SELECT d.doc_id, '<fin>', coalesce(max(i), 0) + 1 FROM documents d LEFT JOIN seq USING (doc_id) GROUP BY d.doc_id),
g{n} AS (SELECT doc_id, {lags} AS ctx, term AS w, {VALID} AS valid FROM e{n} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c{n} AS (SELECT ctx, w, count(*) AS c FROM g{n} WHERE NOT valid GROUP BY ALL), t{n} AS (SELECT ctx, sum(c) AS t FROM c{n} GROUP BY ctx)"""


@query("ngram_perplexity", f"WITH {SEQ}, v AS (SELECT count(DISTINCT term) + 1 AS v FROM seq WHERE NOT ({VALID})), " + ", ".join(_lm_sql(n) for n in (2, 3)) + ", grid AS (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS k) "
       + " UNION ALL ".join(f"SELECT {n} AS n, part, k, round(pow(2, -sum(log2((coalesce(c, 0) + k) / (coalesce(t, 0) + k * v))) / count(*)), 4) AS perplexity, count(*) AS predictions FROM (SELECT CASE WHEN valid THEN 'validation' ELSE 'training' END AS part, ctx, w FROM g{n}) LEFT JOIN c{n} USING (ctx, w) LEFT JOIN t{n} USING (ctx), v, grid GROUP BY part, k" for n in (2, 3)))
def ngram_perplexity(spark, sf_dir):
    """Perplexity of bigram and trigram models at three smoothings, on training and validation documents."""
    parted = _words(spark, sf_dir).select(F.when(_validates(), "validation").otherwise("training").alias("part"), "words")
    out = None
    for n in (2, 3):
        p = L.split_perplexity(parted, n, [0.01, 0.1, 1.0], "part", "training").select(F.lit(n).alias("n"), "part", "k", F.round("perplexity", 4).alias("perplexity"), "predictions")
        out = p if out is None else out.unionAll(p)
    return out


@query("context_histogram", f"WITH {SEQ}, " + ", ".join(_lm_sql(n) for n in (2, 3)) + " " + " UNION ALL ".join(f"SELECT {n} AS n, words, count(*) AS contexts FROM (SELECT ctx, count(*) AS words FROM c{n} GROUP BY ctx) GROUP BY words" for n in (2, 3)))
def context_histogram(spark, sf_dir):
    """How many contexts have how many different continuations."""
    train, _ = _split(_words(spark, sf_dir))
    parts = [L.context_sizes(train, n).groupBy("words").agg(F.count(F.lit(1)).alias("contexts")).select(F.lit(n).alias("n"), "words", "contexts") for n in (2, 3)]
    return parts[0].unionAll(parts[1])


@query("continuations", f"WITH {SEQ}, v AS (SELECT count(DISTINCT term) + 1 AS v FROM seq WHERE NOT ({VALID})), {_lm_sql(2)}, " + f"""p AS (SELECT ctx AS context, w AS word, (c + 0.1) / (t + 0.1 * v) AS p FROM c2 JOIN t2 USING (ctx), v WHERE w <> '<oov>')
SELECT context, word, round(p / sum(p) OVER (PARTITION BY context), 6) AS p FROM p""")
def continuations(spark, sf_dir):
    """Smoothed shares of the seen continuations of every word."""
    train, _ = _split(_words(spark, sf_dir))
    c = L.Model(train, 2).continuations(0.1, ["<oov>"])
    return c.select(F.col("context")[0].alias("context"), "word", rounded(F.col("p")).alias("p"))


@query("greedy_texts", f"WITH RECURSIVE {SEQ}, {_lm_sql(2)}, best AS (SELECT ctx, w FROM (SELECT ctx, w, row_number() OVER (PARTITION BY ctx ORDER BY c DESC, w) AS place FROM c2 WHERE w <> '<oov>') WHERE place = 1)," + """
gen(id, last, words, done, step) AS (
  SELECT id, word, word, false, 0 FROM (VALUES (1, 'the'), (2, 'de'), (3, 'und'), (4, 'zzzz')) s(id, word)
  UNION ALL
  SELECT g.id, CASE WHEN done OR nxt = '<fin>' THEN last ELSE nxt END, CASE WHEN done OR nxt = '<fin>' THEN words ELSE words || ' ' || nxt END, done OR nxt = '<fin>', step + 1
  FROM (SELECT gen.*, coalesce(b.w, r.w) AS nxt FROM gen LEFT JOIN best b ON b.ctx = gen.last, (SELECT w FROM best WHERE ctx = '<inicio>') r WHERE step < 8) g)
SELECT id, words AS text, done FROM gen WHERE step = 8""")
def greedy_texts(spark, sf_dir):
    """Texts from four seeds by the likeliest next word; an unseen word starts over."""
    train, _ = _split(_words(spark, sf_dir))
    seeds = spark.createDataFrame([(1, ["the"]), (2, ["de"]), (3, ["und"]), (4, ["zzzz"])], "id int, words array<string>")
    return L.generate_greedy(L.Model(train, 2), seeds, 8).select("id", F.array_join("words", " ").alias("text"), "done")


@query("sampled_continuations")
def sampled_continuations(spark, sf_dir):
    """A seeded draw after every word of a bigram model, at temperature 0.8 among the first ten."""
    train, _ = _split(_words(spark, sf_dir))
    return L.sample_continuations(L.Model(train, 2).continuations(0.1, ["<oov>"]), 0.8, 10, seed=42)


#: The grid of strategies, and how many words each adds.
STRATEGIES = [L.Strategy("greedy", greedy=True), L.Strategy("temperature 0.5", temperature=0.5), L.Strategy("temperature 1.0"), L.Strategy("temperature 1.5", temperature=1.5), L.Strategy("top 10", temperature=0.8, top_k=10), L.Strategy("top 50", top_k=50)]
STEPS = 12


def _strategy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split(_words(spark, sf_dir))
    seeds = _words(spark, sf_dir, "benchmark", "item_id").filter(F.size("words") > 0).select(F.col("item_id").alias("id"), F.slice("words", 1, 1).alias("words"))
    return L.generate(L.Model(train, 2), seeds, STRATEGIES, STEPS, seed=42)


_GRID = ", ".join(f"('{x.name}', {str(x.greedy).lower()}, {float(x.temperature)}::DOUBLE, {x.top_k or 'NULL'}::INT)" for x in STRATEGIES)

_TEXTS = f"""WITH RECURSIVE {SEQ}, v AS (SELECT count(DISTINCT term) + 1 AS v FROM seq WHERE NOT ({VALID})), {_lm_sql(2)},
p0 AS (SELECT ctx, w, (c + 0.1) / (t + 0.1 * v) AS p FROM c2 JOIN t2 USING (ctx), v WHERE w <> '<oov>'), p1 AS (SELECT ctx, w, p / sum(p) OVER (PARTITION BY ctx) AS p FROM p0),
cont AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(p, 12) DESC, w) AS place FROM p1), known AS (SELECT DISTINCT ctx AS k FROM cont),
b AS (SELECT item_id, regexp_extract_all(text, '\\p{{L}}+(?:[-'']\\p{{L}}+)*|<[A-Z]+>') AS l FROM benchmark), seeds AS (SELECT item_id AS id, lower(l[1]) AS w FROM b WHERE len(l) > 0),
grid(strategy, greedy, temperature, top_k) AS (VALUES {_GRID}),
gen AS (
  SELECT strategy, greedy, temperature, top_k, id, w AS last, w AS words, false AS done, 0 AS step FROM seeds, grid
  UNION ALL
  SELECT strategy, greedy, temperature, top_k, id, nxt, CASE WHEN done OR coalesce(nxt, '<fin>') = '<fin>' THEN words ELSE words || ' ' || nxt END, done OR coalesce(nxt, '<fin>') = '<fin>', step + 1
  FROM (SELECT g.strategy, g.greedy, g.temperature, g.top_k, g.id, g.words, g.done, g.step, arg_min(c.w, {{'k': CASE WHEN g.greedy THEN c.place ELSE -(ln(greatest(c.p, 1e-12)) / greatest(g.temperature, 1e-6)
      - ln(-ln((('0x' || substr(md5('42:' || g.strategy || ':' || g.id || ':' || g.step || ':' || c.w), 1, 8))::BIGINT + 0.5) / 4294967296.0))) END, 'w': c.w}}) AS nxt
    FROM (SELECT gen.*, coalesce(k, '<inicio>') AS ctx FROM gen LEFT JOIN known ON k = last WHERE step < {STEPS}) g LEFT JOIN cont c ON c.ctx = g.ctx AND (g.top_k IS NULL OR c.place <= g.top_k) AND NOT g.done
    GROUP BY g.strategy, g.greedy, g.temperature, g.top_k, g.id, g.words, g.done, g.step)),
texts AS (SELECT strategy, id, words, done FROM gen WHERE step = {STEPS})"""


@query("strategy_texts", _TEXTS + " SELECT strategy, id, words AS text, done FROM texts")
def strategy_texts(spark, sf_dir):
    """Texts from the first word of every benchmark item, by strategy."""
    return _strategy_texts(spark, sf_dir).select("strategy", "id", F.array_join("words", " ").alias("text"), "done")


@query("strategy_diversity", _TEXTS + """, l AS (SELECT strategy, id, done, string_split(words, ' ') AS l FROM texts),
u1 AS (SELECT strategy, unnest(l) AS g FROM l), u2 AS (SELECT strategy, l[i] || ' ' || l[i + 1] AS g FROM (SELECT strategy, l, unnest(range(1, len(l))) AS i FROM l)),
u3 AS (SELECT strategy, id, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT strategy, id, l, unnest(range(1, len(l) - 1)) AS i FROM l)),
r AS (SELECT strategy, sum(n - d) / sum(n) AS r FROM (SELECT strategy, id, count(*) AS n, count(DISTINCT g) AS d FROM u3 GROUP BY ALL) GROUP BY strategy)
SELECT strategy, (SELECT round(count(DISTINCT g) / count(*), 6) FROM u1 WHERE u1.strategy = l.strategy) AS distinct_1, (SELECT round(count(DISTINCT g) / count(*), 6) FROM u2 WHERE u2.strategy = l.strategy) AS distinct_2,
  round(coalesce(max(r), 0), 6) AS repeated_3, round(avg(len(l)), 6) AS mean_length, count(*) AS texts, count(*) FILTER (WHERE done) AS finished FROM l LEFT JOIN r USING (strategy) GROUP BY strategy""")
def strategy_diversity(spark, sf_dir):
    """Diversity, repetition and finished texts of each strategy."""
    texts = written(_strategy_texts(spark, sf_dir), "strategy-texts")
    d = L.diversity(texts, ["strategy"]).join(texts.groupBy("strategy").agg(F.count(F.lit(1)).alias("texts"), F.count_if("done").alias("finished")), "strategy")
    return d.select("strategy", *[rounded(F.col(c)).alias(c) for c in ("distinct_1", "distinct_2", "repeated_3", "mean_length")], "texts", "finished")


@query("oov_coverage", f"""WITH {COUNTS}, v AS (SELECT term FROM counts ORDER BY c DESC, term LIMIT 5000),
a AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '\\p{{L}}+(?:[-'']\\p{{L}}+)*'))) AS term FROM benchmark)
SELECT item_id, count(*) AS words, count(*) FILTER (WHERE v.term IS NULL) AS oov, round(count(*) FILTER (WHERE v.term IS NULL) / count(*), 6) AS share FROM a LEFT JOIN v USING (term) GROUP BY item_id""")
def oov_coverage(spark, sf_dir):
    """Words of the benchmark texts outside the 5000 commonest of the documents."""
    known = V.term_counts(V.word_rows(table(spark, sf_dir, "documents"))).orderBy(F.desc("c"), "term").limit(5000).select("term", F.lit(True).alias("known"))
    a = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.found(F.col("text"), T.WORD)).alias("t")).select("item_id", F.lower("t").alias("term"))
    rows = a.join(known, "term", "left")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("known").isNull()).alias("oov"), rounded(F.count_if(F.col("known").isNull()) / F.count(F.lit(1))).alias("share"))


@query("oov_replaced", f"""WITH {COUNTS}, v AS (SELECT term, true AS known FROM counts ORDER BY c DESC, term LIMIT 5000)
SELECT doc_id, md5(string_agg(CASE WHEN known THEN term ELSE '<oov>' END, ' ' ORDER BY pos)) AS digest, count(*) FILTER (WHERE known IS NULL) AS replaced FROM word LEFT JOIN v USING (term) GROUP BY doc_id""")
def oov_replaced(spark, sf_dir):
    """Documents with rare words replaced, as digests."""
    words = V.word_rows(table(spark, sf_dir, "documents"))
    known = V.term_counts(words).orderBy(F.desc("c"), "term").limit(5000).select("term", F.lit(True).alias("known"))
    rows = words.join(known, "term", "left").select("doc_id", "known", F.struct("pos", F.when(F.col("known"), F.col("term")).otherwise("<oov>").alias("w")).alias("s"))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["w"]), " ")).alias("digest"), F.count_if(F.col("known").isNull()).alias("replaced"))


@query("diversity_by_role", r"""WITH t AS (SELECT conv_id, turn, role, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '\p{L}+(?:[''’-]\p{L}+)*') AS l FROM conversations)),
n AS (SELECT conv_id, turn, role, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM t WINDOW x AS (PARTITION BY conv_id, turn, role ORDER BY i)),
g AS (SELECT role, conv_id, turn, count(*) AS c, count(DISTINCT (w, w2, w3)) AS d FROM n WHERE w3 IS NOT NULL GROUP BY ALL),
l AS (SELECT role, avg(len(regexp_extract_all(lower(text), '\p{L}+(?:[''’-]\p{L}+)*'))) AS mean_length FROM conversations GROUP BY role)
SELECT n.role, round(count(DISTINCT w) / count(*), 6) AS distinct_1, round(count(DISTINCT (w, w2)) FILTER (WHERE w2 IS NOT NULL) / count(*) FILTER (WHERE w2 IS NOT NULL), 6) AS distinct_2,
  (SELECT round(sum(c - d) / sum(c), 6) FROM g WHERE g.role = n.role) AS repeated_3, max(round(mean_length, 6)) AS mean_length FROM n JOIN l ON l.role = n.role GROUP BY n.role""")
def diversity_by_role(spark, sf_dir):
    """Diversity and repetition of what each role says."""
    docs = table(spark, sf_dir, "conversations").select("role", T.joined_words(F.col("text")).alias("words"))
    d = L.diversity(docs, ["role"])
    return d.select("role", *[rounded(F.col(c)).alias(c) for c in ("distinct_1", "distinct_2", "repeated_3", "mean_length")])


@query("training_pairs", f"""WITH {COUNTS}, v AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) + 1 AS id FROM counts), e AS (SELECT doc_id, pos, id FROM word JOIN v USING (term)),
p AS (SELECT doc_id, pos, list(id) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS context, id AS target FROM e)
SELECT count(*) AS pairs, sum(len(context))::BIGINT AS context_ids, sum(target)::BIGINT AS targets, sum(context[1])::BIGINT AS oldest FROM p WHERE len(context) > 0""")
def training_pairs(spark, sf_dir):
    """Up to twelve earlier ids and the next one, for every word: totals of the training pairs."""
    words = V.word_rows(table(spark, sf_dir, "documents"))
    ids = words.join(V.integer_vocabulary(V.term_counts(words)).select("term", "id"), "term")
    context = F.collect_list("id").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-12, -1))
    p = ids.select(context.alias("context"), F.col("id").alias("target")).filter(F.size("context") > 0)
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size("context")).cast("long").alias("context_ids"), F.sum("target").alias("targets"), F.sum(F.col("context")[0]).alias("oldest"))


QUERIES, ORACLES = query.queries, query.oracles
