"""Vocabulary reports over `documents`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import bags as B
from tesela.operators import vocab as V
from tesela.plans.fragments import COMMON, COUNTS, TF, TOK, quoted
from tesela.plans.registry import Registry, rounded, table

query = Registry()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_counts(V.word_rows(_docs(spark, sf_dir)))


@query("vocab_summary", f"""WITH {COUNTS}
SELECT sum(c)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(c), 6) AS ttr, count(*) FILTER (WHERE c = 1) AS hapax FROM counts""")
def vocab_summary(spark, sf_dir):
    return V.summary(_counts(spark, sf_dir)).withColumn("ttr", rounded(F.col("ttr")))


@query("vocab_summary_by_lang", f"""WITH {TOK}, counts AS (SELECT lang, term, count(*) AS c FROM word JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, sum(c)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(c), 6) AS ttr, count(*) FILTER (WHERE c = 1) AS hapax FROM counts GROUP BY lang""")
def vocab_summary_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).filter(T.is_word(F.col("token"))).select("lang", F.lower("token").alias("term"))
    return V.summary(V.term_counts(rows, ["lang"]), ["lang"]).withColumn("ttr", rounded(F.col("ttr")))


@query("token_kinds", f"""WITH {TOK}
SELECT CASE WHEN regexp_full_match(token, '<[A-Z]+>') THEN 'marker' WHEN regexp_matches(token, '^\\p{{L}}') THEN 'word' WHEN regexp_matches(token, '^\\p{{Nd}}') THEN 'number' ELSE 'sign' END AS kind,
  count(*) AS tokens, count(DISTINCT token) AS types FROM tok GROUP BY kind""")
def token_kinds(spark, sf_dir):
    rows = V.token_rows(_docs(spark, sf_dir), T.tokens(F.col("text")))
    t = F.col("token")
    kind = F.when(t.rlike(f"^{T.MARKER}$"), "marker").when(t.rlike(r"^\p{L}"), "word").when(t.rlike(r"^\p{Nd}"), "number").otherwise("sign")
    return rows.groupBy(kind.alias("kind"), "token").agg(F.count(F.lit(1)).alias("c")).groupBy("kind").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"))


@query("blank_tokens", r"""WITH b AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS t FROM documents)
SELECT count(*) AS tokens, count(DISTINCT t) AS types, count(*) FILTER (WHERE regexp_matches(t, '[^\p{L}]')) AS with_signs FROM b""")
def blank_tokens(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode(T.blank_tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return rows.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(F.when(F.col("t").rlike(r"[^\p{L}]"), F.col("c"))), F.lit(0)).alias("with_signs"))


@query("stage_ladder", f"""WITH {TOK},
blank AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS t FROM documents),
lowered AS (SELECT lower(token) AS t FROM tok),
kept AS (SELECT t FROM lowered WHERE regexp_matches(t, '^[\\p{{L}}\\p{{Nd}}]')),
numbered AS (SELECT CASE WHEN regexp_matches(t, '^\\p{{Nd}}') THEN '<NUM>' ELSE t END AS t FROM kept),
stages AS (SELECT 0 AS stage, t FROM blank UNION ALL SELECT 1, token FROM tok UNION ALL SELECT 2, t FROM lowered UNION ALL SELECT 3, t FROM kept UNION ALL SELECT 4, t FROM numbered),
sizes AS (SELECT stage, count(*) AS tokens, count(DISTINCT t) AS types FROM stages GROUP BY stage)
SELECT stage, tokens, types, round(1 - types / lag(types) OVER (ORDER BY stage), 6) AS step, round(1 - types / first_value(types) OVER (ORDER BY stage), 6) AS total FROM sizes""")
def stage_ladder(spark, sf_dir):
    """Tokens and types after each step of normalization, with the reduction of types."""
    docs = _docs(spark, sf_dir)
    count = F.count(F.lit(1)).alias("c")
    # the later steps map types to types, so they work on the counted vocabulary of the step before
    blank = docs.select(F.explode(T.blank_tokens(F.col("text"))).alias("t")).groupBy("t").agg(count)
    cut = docs.select(F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("t").agg(count)
    again = lambda counts, t: counts.groupBy(t.alias("t")).agg(F.sum("c").alias("c"))
    low = again(cut, F.lower("t"))
    kept = low.filter(F.col("t").rlike(r"^[\p{L}\p{Nd}]"))
    numbered = again(kept, F.when(F.col("t").rlike(r"^\p{Nd}"), "<NUM>").otherwise(F.col("t")))
    size = lambda i, counts: counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).select(F.lit(i).alias("stage"), "tokens", "types")
    sizes = reduce(DataFrame.unionAll, [size(i, c) for i, c in enumerate((blank, cut, low, kept, numbered))])
    by = Window.orderBy("stage")
    return sizes.select("stage", "tokens", "types", rounded(1 - F.col("types") / F.lag("types").over(by)).alias("step"), rounded(1 - F.col("types") / F.first("types").over(by)).alias("total"))


@query("zipf_slope", f"""WITH {COUNTS}, r AS (SELECT c, row_number() OVER (ORDER BY c DESC, term) AS rank FROM counts)
SELECT round(regr_slope(log10(c), log10(rank)), 6) AS slope, round(regr_intercept(log10(c), log10(rank)), 6) AS intercept, count(*) AS ranks FROM r WHERE rank <= 5000""")
def zipf_slope(spark, sf_dir):
    return V.zipf(_counts(spark, sf_dir)).select(rounded(F.col("slope")).alias("slope"), rounded(F.col("intercept")).alias("intercept"), "ranks")


@query("coverage_curve", f"""WITH {COUNTS}, r AS (
  SELECT row_number() OVER (ORDER BY c DESC, term) AS rank, sum(c) OVER (ORDER BY c DESC, term ROWS UNBOUNDED PRECEDING) / sum(c) OVER () AS covered FROM counts)
SELECT rank, round(covered, 6) AS covered FROM r WHERE rank IN (1, 10, 50, 100, 500, 1000, 5000)""")
def coverage_curve(spark, sf_dir):
    return V.coverage(_counts(spark, sf_dir)).filter(F.col("rank").isin(1, 10, 50, 100, 500, 1000, 5000)).select("rank", rounded(F.col("covered")).alias("covered"))


@query("word_cloud_terms", f"""WITH {COUNTS} SELECT term, c FROM counts WHERE term NOT IN ({quoted(COMMON)}) ORDER BY c DESC, term LIMIT 160""")
def word_cloud_terms(spark, sf_dir):
    """The 160 most frequent terms: the data behind a word cloud."""
    return V.without(_counts(spark, sf_dir), list(COMMON)).orderBy(F.desc("c"), "term").limit(160)


@query("stopword_audit", f"""WITH {COUNTS},
lists AS (SELECT 'negations' AS list, unnest([{quoted(T.NEGATIONS)}]) AS stop UNION ALL SELECT 'common', unnest([{quoted(COMMON)}]) UNION ALL SELECT 'articles', unnest([{quoted(T.ARTICLES)}])),
total AS (SELECT sum(c) AS every, count(*) AS types FROM counts)
SELECT list, count(*) AS size, count(term) AS present, round(coalesce(sum(c), 0) / max(every), 6) AS removed_share, max(types) - count(term) AS types_left
FROM lists LEFT JOIN counts ON stop = term, total GROUP BY list""")
def stopword_audit(spark, sf_dir):
    audit = V.stopword_audit(_counts(spark, sf_dir), {"negations": list(T.NEGATIONS), "common": list(COMMON), "articles": list(T.ARTICLES)})
    return audit.withColumn("removed_share", rounded(F.col("removed_share")))


@query("stopword_ranks", f"""WITH {COUNTS}, r AS (SELECT term, c, row_number() OVER (ORDER BY c DESC, term) AS rank FROM counts)
SELECT term, c, rank FROM r WHERE rank <= 300 AND term IN ({quoted(COMMON)})""")
def stopword_ranks(spark, sf_dir):
    return V.frequency_ranks(_counts(spark, sf_dir).orderBy(F.desc("c"), "term").limit(300)).filter(F.col("term").isin(*COMMON)).select("term", "c", "rank")


@query("foreign_stopwords")
def foreign_stopwords(spark, sf_dir):
    """English stop words of Spark's list that occur in Spanish documents, by frequency."""
    from tesela.plans.fragments import stop_words

    spanish = table(spark, sf_dir, "documents").filter("lang = 'es'")
    stop = spark.createDataFrame([(w,) for w in stop_words("english")], "term string")
    return V.term_counts(V.word_rows(spanish)).join(F.broadcast(stop), "term", "left_semi").orderBy(F.desc("c"), "term")


@query("full_stopword_lists")
def full_stopword_lists(spark, sf_dir):
    """Spark's four lists, and the Spanish one without its negations, held against the corpus."""
    from tesela.plans.fragments import LANGUAGES, stop_words

    lists = {name: stop_words(name) for name in LANGUAGES}
    lists["spanish without negations"] = [w for w in lists["spanish"] if w not in T.NEGATIONS]
    return V.stopword_audit(_counts(spark, sf_dir), lists)


@query("negation_pairs", f"""WITH pairs AS (SELECT * FROM (VALUES (1, 'no es cierto'), (2, 'es cierto'), (3, 'sin duda'), (4, 'con duda'), (5, 'nunca y nada')) v(id, phrase)),
lists AS (SELECT * FROM (VALUES ('all', ['es', 'y', 'con', 'no', 'sin', 'nunca', 'nada']), ('without negations', ['es', 'y', 'con']), ('none', []::VARCHAR[])) l(list, stop)),
t AS (SELECT id, list, stop, unnest(string_split(phrase, ' ')) AS w, generate_subscripts(string_split(phrase, ' '), 1) AS i FROM pairs, lists)
SELECT id, list, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT list_contains(stop, w)), '') AS kept FROM t GROUP BY id, list""")
def negation_pairs(spark, sf_dir):
    """What is left of small phrases under three stop word lists: `array_except` takes the negations off a list."""
    pairs = spark.createDataFrame([(1, "no es cierto"), (2, "es cierto"), (3, "sin duda"), (4, "con duda"), (5, "nunca y nada")], "id int, phrase string")
    full = F.array(*[F.lit(x) for x in ("es", "y", "con", "no", "sin", "nunca", "nada")])
    lists = F.array(
        F.struct(F.lit("all").alias("list"), full.alias("stop")),
        F.struct(F.lit("without negations").alias("list"), F.array_except(full, F.array(*[F.lit(x) for x in T.NEGATIONS])).alias("stop")),
        F.struct(F.lit("none").alias("list"), F.array().cast("array<string>").alias("stop")),
    )
    rows = pairs.select("id", T.blank_tokens(F.col("phrase")).alias("w"), F.explode(lists).alias("l"))
    return rows.select("id", "l.list", F.array_join(F.filter("w", lambda x: ~F.array_contains(F.col("l.stop"), x)), " ").alias("kept"))


@query("diacritic_collisions", f"""WITH {COUNTS}
SELECT translate(term, '{T.MARKED}ñ', '{T.PLAIN}n') AS form, list_sort(list(term)) AS members, sum(c)::BIGINT AS c, count(*) AS n FROM counts GROUP BY form HAVING count(*) > 1""")
def diacritic_collisions(spark, sf_dir):
    return V.collisions(_counts(spark, sf_dir), lambda w: T.plain_letters(w, keep_enye=False))


@query("diacritic_collisions_keep_enye", f"""WITH {COUNTS}
SELECT translate(term, '{T.MARKED}', '{T.PLAIN}') AS form, list_sort(list(term)) AS members, sum(c)::BIGINT AS c, count(*) AS n FROM counts GROUP BY form HAVING count(*) > 1""")
def diacritic_collisions_keep_enye(spark, sf_dir):
    return V.collisions(_counts(spark, sf_dir), T.plain_letters)


@query("diacritic_fusions", f"""WITH {TOK}, forms AS (
  SELECT translate(term, '{T.MARKED}', '{T.PLAIN}') AS form, term, lang, count(*) AS n FROM word JOIN documents USING (doc_id) GROUP BY ALL),
words AS (SELECT form, term, sum(n)::BIGINT AS c, arg_max(lang, (n, -ascii(lang))) AS main FROM forms GROUP BY form, term),
groups AS (SELECT form, count(*) AS members, sum(c)::BIGINT AS c, max(c) AS largest, count(DISTINCT main) FILTER (WHERE c >= 5) AS uses FROM words GROUP BY form HAVING count(*) > 1)
SELECT CASE WHEN uses > 1 THEN 'lost distinction' ELSE 'spelling variant' END AS kind, count(*) AS groups, sum(members)::BIGINT AS members, sum(largest)::BIGINT AS dominant, sum(c - largest)::BIGINT AS absorbed FROM groups GROUP BY kind""")
def diacritic_fusions(spark, sf_dir):
    """Fused words, classed by whether frequent members have different main languages; dominant and absorbed uses."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).filter(T.is_word(F.col("token"))).select("lang", F.lower("token").alias("term"))
    forms = rows.groupBy("term", "lang").agg(F.count(F.lit(1)).alias("n"))
    words = forms.groupBy(T.plain_letters(F.col("term")).alias("form"), "term").agg(F.sum("n").alias("c"), F.max_by("lang", F.struct("n", -F.ascii("lang"))).alias("main"))
    groups = words.groupBy("form").agg(F.count(F.lit(1)).alias("members"), F.sum("c").alias("c"), F.max("c").alias("largest"), F.count_distinct(F.when(F.col("c") >= 5, F.col("main"))).alias("uses")).filter("members > 1")
    kind = F.when(F.col("uses") > 1, "lost distinction").otherwise("spelling variant")
    return groups.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members"), F.sum("largest").alias("dominant"), F.sum(F.col("c") - F.col("largest")).alias("absorbed"))


@query("decomposed_documents", "SELECT count(*) FILTER (WHERE text <> nfc_normalize(text)) AS decomposed, count(*) AS documents FROM documents")
def decomposed_documents(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count_if(F.col("text") != T.normal_form(F.col("text"))).alias("decomposed"), F.count(F.lit(1)).alias("documents"))


@query("without_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def without_accents(spark, sf_dir):
    """All marks taken off, as a digest of the text."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.without_accents(F.col("text"), keep_enye=False)).alias("plain"))


@query("noise_markers")
def noise_markers(spark, sf_dir):
    """How often each marker stands in the marked text of the conversations and documents."""
    texts = table(spark, sf_dir, "conversations").select("text").unionAll(_docs(spark, sf_dir).select("text"))
    marked = texts.select(F.explode(T.found(T.mark_noise(F.col("text")), T.MARKER)).alias("marker"))
    return marked.groupBy("marker").agg(F.count(F.lit(1)).alias("c"))


@query("email_documents", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+')) AS emails FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+')")
def email_documents(spark, sf_dir):
    mails = F.size(T.found(F.col("text"), r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", mails.alias("emails")).filter("emails > 0")


@query("squeezed_lengths", "SELECT doc_id, length(" + "".join("regexp_replace(" for _ in "aeiounst") + "text" + "".join(f", '{c}{{3,}}', '{c}', 'g')" for c in "aeiounst") + ") AS chars FROM documents")
def squeezed_lengths(spark, sf_dir):
    """Characters left when runs of eight common letters are squeezed one by one."""
    out = F.col("text")
    for c in "aeiounst":
        out = F.regexp_replace(out, c + "{3,}", c)
    return _docs(spark, sf_dir).select("doc_id", F.char_length(out).cast("long").alias("chars"))


@query("squeeze_effect")
def squeeze_effect(spark, sf_dir):
    """Documents that squeezing repeated letters changes, and characters it takes away."""
    done = _docs(spark, sf_dir).select((F.char_length("text") - F.char_length(T.squeeze(F.col("text")))).cast("long").alias("lost"))
    return done.agg(F.count_if(F.col("lost") > 0).alias("changed"), F.sum("lost").alias("lost"), F.count(F.lit(1)).alias("documents"))


@query("normalized_vocabulary")
def normalized_vocabulary(spark, sf_dir):
    """Vocabulary of the whole normalization chain under four settings."""
    text = F.col("text")
    settings = {"default": {}, "no accents": {"accents": False}, "numbers kept": {"numbers": False, "words_only": False}, "case kept": {"lower": False}}
    variants = F.array(*[F.struct(F.lit(name).alias("setting"), T.normalized(text, **how).alias("tokens")) for name, how in settings.items()])
    rows = _docs(spark, sf_dir).select(F.explode(variants).alias("v")).select("v.setting", F.explode("v.tokens").alias("term"))
    return V.summary(V.term_counts(rows, ["setting"]), ["setting"]).withColumn("ttr", rounded(F.col("ttr")))


@query("agency_noise", """WITH t AS (SELECT text, regexp_replace(text, '^.{0,120}?\\((?:EFE[\\p{L}\\p{N}_]*|AFP|AP|Reuters)\\)\\s*\\.?\\s*-?\\s*', '') AS cut FROM documents)
SELECT count(*) FILTER (WHERE text <> cut) AS headed, sum(length(text) - length(cut))::BIGINT AS chars FROM t""")
def agency_noise(spark, sf_dir):
    """Documents with a news agency's header and the characters it takes."""
    t = _docs(spark, sf_dir).select("text", T.without_agency(F.col("text")).alias("cut"))
    return t.agg(F.count_if(F.col("text") != F.col("cut")).alias("headed"), F.sum(F.char_length("text") - F.char_length("cut")).cast("long").alias("chars"))


@query("keras_tokens", r"""WITH k AS (SELECT unnest(list_filter(string_split(regexp_replace(lower(text), '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]', ' ', 'g'), ' '), lambda x: x <> '')) AS t FROM documents)
SELECT count(*) AS tokens, count(DISTINCT t) AS types, count(DISTINCT t) FILTER (WHERE regexp_matches(t, '[¿¡«»…—]')) AS with_signs FROM k""")
def keras_tokens(spark, sf_dir):
    """Vocabulary under a filter list that misses some signs."""
    rows = _docs(spark, sf_dir).select(F.explode(T.keras_tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return rows.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("t").rlike("[¿¡«»…—]")).alias("with_signs"))


@query("corpus_profile", f"""WITH {TOK}, l AS (SELECT doc_id, count(term) AS n FROM documents LEFT JOIN word USING (doc_id) GROUP BY doc_id)
SELECT count(*) AS documents, sum(n)::BIGINT AS words, median(n) AS median_words, max(n) AS longest, min(n) AS shortest, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS deviation FROM l""")
def corpus_profile(spark, sf_dir):
    n = F.size(F.filter(T.tokens(F.coalesce(F.col("text"), F.lit(""))), T.is_word)).cast("long")
    lengths = _docs(spark, sf_dir).select(n.alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words"), F.median("n").alias("median_words"), F.max("n").alias("longest"), F.min("n").alias("shortest"), rounded(F.avg("n")).alias("mean_words"), rounded(F.stddev_pop("n")).alias("deviation"))


@query("length_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.025), 6) AS low, round(quantile_cont(n_chars, 0.5), 6) AS mid, round(quantile_cont(n_chars, 0.975), 6) AS high FROM documents GROUP BY lang")
def length_percentiles(spark, sf_dir):
    p = table(spark, sf_dir, "documents").groupBy("lang").agg(F.percentile("n_chars", [0.025, 0.5, 0.975]).alias("p"))
    return p.select("lang", *[rounded(F.col("p")[i]).alias(c) for i, c in enumerate(("low", "mid", "high"))])


@query("length_bins", """SELECT CASE WHEN n_chars < 500 THEN '[0,500)' WHEN n_chars < 2000 THEN '[500,2000)' ELSE '[2000,)' END AS bin,
  CASE WHEN n_chars <= 500 THEN '(0,500]' WHEN n_chars <= 2000 THEN '(500,2000]' ELSE '(2000,]' END AS right_bin, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL""")
def length_bins(spark, sf_dir):
    """Binned means; bins closed on the left and on the right differ at their edges."""
    n = F.col("n_chars")
    left = F.when(n < 500, "[0,500)").when(n < 2000, "[500,2000)").otherwise("[2000,)")
    right = F.when(n <= 500, "(0,500]").when(n <= 2000, "(500,2000]").otherwise("(2000,]")
    return table(spark, sf_dir, "documents").groupBy(left.alias("bin"), right.alias("right_bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(n)).alias("mean"))


@query("integer_vocabulary", f"""WITH {COUNTS} SELECT term, c, row_number() OVER (ORDER BY c DESC, term) + 1 AS id FROM counts""")
def integer_vocabulary(spark, sf_dir):
    return V.integer_vocabulary(_counts(spark, sf_dir))


def _first_terms(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, list[str]]:
    """Documents as arrays of words, and the terms whose ids (from 2) are at most `size`, by rank."""
    words = F.transform(F.filter(T.tokens(F.col("text")), T.is_word), F.lower)
    docs = _docs(spark, sf_dir).select("doc_id", words.alias("words"))
    top = B.term_totals(B.blocks(docs, keep=False)).orderBy(F.desc("c"), "term").limit(size - 1)  # a fixed number of terms
    return docs, [r["term"] for r in top.collect()]


@query("encoded_documents", f"""WITH {COUNTS}, v AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) + 1 AS id FROM counts)
SELECT doc_id, list(CASE WHEN id <= 1000 THEN id ELSE 1 END ORDER BY pos) AS ids FROM word JOIN v USING (term) GROUP BY doc_id""")
def encoded_documents(spark, sf_dir):
    docs, terms = _first_terms(spark, sf_dir, 1000)
    return V.encode_rows(docs, terms)


@query("decoded_documents", f"""WITH {COUNTS}, v AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) + 1 AS id FROM counts)
SELECT doc_id, string_agg(CASE WHEN id <= 1000 THEN term ELSE '<oov>' END, ' ' ORDER BY pos) AS text FROM word JOIN v USING (term) GROUP BY doc_id""")
def decoded_documents(spark, sf_dir):
    """Encoded and decoded again: words outside the vocabulary's first 1000 come back as <oov>."""
    docs, terms = _first_terms(spark, sf_dir, 1000)
    return V.decode_rows(V.encode_rows(docs, terms), terms)


@query("padded_sequences", f"""WITH {COUNTS}, v AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) + 1 AS id FROM counts),
e AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM word JOIN v USING (term) GROUP BY doc_id)
SELECT doc_id, list_concat(list_transform(range(greatest(0, 64 - len(ids))), lambda x: 0::BIGINT), ids[greatest(1, len(ids) - 63):]) AS last64,
  list_concat(list_transform(range(greatest(0, 64 - len(ids))), lambda x: 0::BIGINT), ids[1:64]) AS first64 FROM e""")
def padded_sequences(spark, sf_dir):
    words = V.word_rows(_docs(spark, sf_dir))
    e = V.encode(words, V.integer_vocabulary(V.term_counts(words)))
    return e.select("doc_id", T.pad_left(F.col("ids"), 64).alias("last64"), T.cut_right(F.col("ids"), 64).alias("first64"))


@query("name_fusion", f"""WITH {TOK}, f AS (
  SELECT token, count(*) FILTER (WHERE pos > 0 AND regexp_matches(token, '^\\p{{Lu}}')) AS names, count(*) FILTER (WHERE NOT (pos > 0 AND regexp_matches(token, '^\\p{{Lu}}'))) AS commons
  FROM tok WHERE regexp_matches(token, '^\\p{{L}}') GROUP BY token),
g AS MATERIALIZED (SELECT *, lower(token) AS low FROM f),
u AS MATERIALIZED (SELECT * FROM g WHERE regexp_matches(token, '^\\p{{Lu}}') AND names >= 3 AND names / (names + commons) >= 0.6),
l AS MATERIALIZED (SELECT token AS common, commons AS common_uses FROM g WHERE token = low AND commons >= 3)
SELECT token, names, common, common_uses FROM u JOIN l ON low = common""")
def name_fusion(spark, sf_dir):
    """Names that lower case makes one with common words; here a capital inside the text marks a name."""
    rows = V.token_rows(_docs(spark, sf_dir), T.tokens(F.col("text"))).filter(F.col("token").rlike(r"^\p{L}"))
    return V.case_fusion(rows.select("token", ((F.col("pos") > 0) & F.col("token").rlike(r"^\p{Lu}")).alias("is_name")))


@query("name_usage", f"""WITH {TOK}, f AS (
  SELECT lower(token) AS form, pos > 0 AND regexp_matches(token, '^\\p{{Lu}}') AS is_name FROM tok WHERE regexp_matches(token, '^\\p{{L}}')),
g AS (SELECT form, count(*) FILTER (WHERE is_name) AS names, count(*) FILTER (WHERE NOT is_name) AS commons FROM f GROUP BY form)
SELECT round(sum(names) FILTER (WHERE commons > 0) / sum(names), 6) AS hit_share, sum(names)::BIGINT AS names, sum(commons)::BIGINT AS commons FROM g""")
def name_usage(spark, sf_dir):
    """Share of the names' uses whose form is a common word as well."""
    rows = V.token_rows(_docs(spark, sf_dir), T.tokens(F.col("text"))).filter(F.col("token").rlike(r"^\p{L}"))
    named = (F.col("pos") > 0) & F.col("token").rlike(r"^\p{Lu}")
    forms = rows.groupBy(F.lower("token").alias("form")).agg(F.count_if(named).alias("names"), F.count_if(~named).alias("commons"))
    return forms.agg(rounded(F.sum(F.when(F.col("commons") > 0, F.col("names"))) / F.sum("names")).alias("hit_share"), F.sum("names").alias("names"), F.sum("commons").alias("commons"))


@query("acronyms", f"""WITH {TOK} SELECT token, count(*) AS c FROM tok WHERE token = upper(token) AND token <> lower(token) AND length(token) BETWEEN 2 AND 8 AND regexp_matches(token, '^\\p{{L}}+$') GROUP BY token""")
def acronyms(spark, sf_dir):
    t = F.col("token")
    rows = V.token_rows(_docs(spark, sf_dir), T.tokens(F.col("text")))
    return rows.filter((t == F.upper(t)) & (t != F.lower(t)) & F.char_length(t).between(2, 8) & t.rlike(r"^\p{L}+$")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))


@query("vocab_groups", f"""WITH {TF}, g AS (
  SELECT CASE WHEN term IN ({quoted(COMMON)}) THEN 'stop' WHEN df >= 2 THEN 'shared' ELSE 'once' END AS kind, term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, nd),
c AS (SELECT term, sum(tf) AS c FROM tf GROUP BY term)
SELECT kind, count(*) AS terms, round(avg(df), 6) AS mean_df, round(avg(idf), 6) AS mean_idf, round(sum(c) / (SELECT sum(tf) FROM tf), 6) AS token_share FROM g JOIN c USING (term) GROUP BY kind""")
def vocab_groups(spark, sf_dir):
    from tesela.operators import weights as W

    docs = _docs(spark, sf_dir)
    terms = V.term_frequencies(V.word_rows(docs)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("c"))
    rows = terms.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))
    kind = F.when(F.col("term").isin(*COMMON), "stop").when(F.col("df") >= 2, "shared").otherwise("once")
    groups = rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("terms"), rounded(F.avg("df")).alias("mean_df"), rounded(F.avg(W.smooth_idf(F.col("df"), F.col("n")))).alias("mean_idf"), F.sum("c").alias("c"))
    return groups.select("kind", "terms", "mean_df", "mean_idf", rounded(F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))).alias("token_share"))


@query("idf_extremes", f"""WITH {TF}, r AS (SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM df, nd)
(SELECT * FROM r ORDER BY df DESC, term LIMIT 6) UNION ALL (SELECT * FROM r ORDER BY df, term LIMIT 6)""")
def idf_extremes(spark, sf_dir):
    from tesela.operators import weights as W

    docs = _docs(spark, sf_dir)
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    df = V.document_frequencies(V.term_frequencies(V.word_rows(docs)))
    ends = df.orderBy(F.desc("df"), "term").limit(6).unionAll(df.orderBy("df", "term").limit(6))
    return ends.crossJoin(n).select("term", "df", rounded(W.smooth_idf(F.col("df"), F.col("n"))).alias("idf"))


@query("stopword_df_profile", f"""WITH {TF}, c AS (SELECT term, sum(tf) AS c FROM tf GROUP BY term), r AS (
  SELECT df.term, df, c, ln((1 + n) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY df DESC, df.term) AS rk FROM df JOIN c USING (term), nd)
SELECT median(df) FILTER (WHERE term IN ({quoted(COMMON)})) AS stop_median_df, count(*) FILTER (WHERE term IN ({quoted(COMMON)}) AND df >= 100) AS stop_frequent, count(*) FILTER (WHERE term IN ({quoted(COMMON)}) AND df = 1) AS stop_once,
  round(sum(c) FILTER (WHERE rk <= 20) / sum(c), 6) AS top_share, round(avg(idf) FILTER (WHERE rk <= 20), 6) AS top_idf, round(count(*) FILTER (WHERE c = 1) / count(*), 6) AS hapax_types, round(count(*) FILTER (WHERE c = 1) / sum(c), 6) AS hapax_tokens FROM r""")
def stopword_df_profile(spark, sf_dir):
    from tesela.operators import weights as W

    docs = _docs(spark, sf_dir)
    terms = V.term_frequencies(V.word_rows(docs)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("c"))
    r = terms.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("df"), "term")))
    stop, top, once = F.col("term").isin(*COMMON), F.col("rk") <= 20, F.col("c") == 1
    return r.agg(
        F.median(F.when(stop, F.col("df"))).alias("stop_median_df"),
        F.count_if(stop & (F.col("df") >= 100)).alias("stop_frequent"),
        F.count_if(stop & (F.col("df") == 1)).alias("stop_once"),
        rounded(F.sum(F.when(top, F.col("c"))) / F.sum("c")).alias("top_share"),
        rounded(F.avg(F.when(top, W.smooth_idf(F.col("df"), F.col("n"))))).alias("top_idf"),
        rounded(F.count_if(once) / F.count(F.lit(1))).alias("hapax_types"),
        rounded(F.count_if(once) / F.sum("c")).alias("hapax_tokens"),
    )


@query("pruning_report", f"""WITH {TF}, c AS (SELECT term, df, sum(tf) AS c FROM tf JOIN df USING (term) GROUP BY term, df), s AS (SELECT * FROM (VALUES (1, 1.0), (2, 1.0), (5, 1.0), (1, 0.5), (2, 0.5), (5, 0.1)) v(least, most))
SELECT least, most::DOUBLE AS most, count(*) FILTER (WHERE keep) AS vocabulary, round(count(*) FILTER (WHERE keep) / count(*), 6) AS kept, round(sum(c) FILTER (WHERE keep) / sum(c), 6) AS tokens_kept,
  round(1 - sum(df) FILTER (WHERE keep) / (max(n) * count(*) FILTER (WHERE keep)), 6) AS sparsity
FROM (SELECT *, df >= least AND df <= most * n AS keep FROM c, nd, s) GROUP BY least, most""")
def pruning_report(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    terms = V.term_frequencies(V.word_rows(docs)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("c"))
    bounds = F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("most")) for a, b in ((1, 1.0), (2, 1.0), (5, 1.0), (1, 0.5), (2, 0.5), (5, 0.1))])
    r = terms.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("*", F.explode(bounds).alias("s")).select("*", "s.*")
    keep = (F.col("df") >= F.col("least")) & (F.col("df") <= F.col("most") * F.col("n"))
    return r.groupBy("least", "most").agg(
        F.count_if(keep).alias("vocabulary"),
        rounded(F.count_if(keep) / F.count(F.lit(1))).alias("kept"),
        rounded(F.sum(F.when(keep, F.col("c"))) / F.sum("c")).alias("tokens_kept"),
        rounded(1 - F.sum(F.when(keep, F.col("df"))) / (F.max("n") * F.count_if(keep))).alias("sparsity"),
    )


@query("distinct_lead_documents", """WITH d AS (SELECT doc_id, substr(text, 1, 60) AS lead, row_number() OVER (PARTITION BY substr(text, 1, 60) ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, lead FROM d WHERE nth = 1 ORDER BY doc_id LIMIT 12""")
def distinct_lead_documents(spark, sf_dir):
    """The first twelve documents whose opening differs: first by key in each group of equal openings."""
    docs = _docs(spark, sf_dir)
    leads = docs.select("doc_id", F.substring("text", 1, 60).alias("lead"))
    return leads.groupBy("lead").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(12).select("doc_id", "lead")


@query("prose_documents", r"""WITH s AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '\p{L}')) AS l, text FROM documents)
SELECT doc_id, len(l) AS sentences FROM s WHERE len(l) BETWEEN 8 AND 20 AND NOT regexp_matches(text, '###|%%%')
  AND list_avg(list_transform(l, lambda x: (len(regexp_extract_all(x, '\p{L}+')) < 4)::INT)) < 0.2""")
def prose_documents(spark, sf_dir):
    """Documents of 8 to 20 sentences without junk marks, few of them short."""
    s = _docs(spark, sf_dir).select("doc_id", "text", T.sentences(F.col("text")).alias("l"))
    short = F.size(F.filter("l", lambda x: F.size(T.found(x, r"\p{L}+")) < 4))
    return s.filter(F.size("l").between(8, 20) & ~F.col("text").rlike("###|%%%") & (short / F.size("l") < 0.2)).select("doc_id", F.size("l").cast("long").alias("sentences"))


@query("stem_reduction")
def stem_reduction(spark, sf_dir):
    """Vocabulary of Spanish documents before and after stemming. Each type is stemmed once."""
    from tesela.operators.stems import stem_counts

    counts = V.term_counts(V.word_rows(table(spark, sf_dir, "documents").filter("lang = 'es'")))
    stems = stem_counts(counts)
    before, after = V.summary(counts), V.summary(stems.groupBy(F.col("stem").alias("term")).agg(F.sum("c").alias("c")))
    both = before.withColumn("stage", F.lit("words")).unionByName(after.withColumn("stage", F.lit("stems")))
    return both.withColumn("ttr", rounded(F.col("ttr")))


@query("stem_families")
def stem_families(spark, sf_dir):
    """The twelve largest families of one stem with up to nine members by frequency."""
    from tesela.operators.stems import stem_counts

    counts = V.term_counts(V.word_rows(table(spark, sf_dir, "documents").filter("lang = 'es'")))
    families = stem_counts(counts).groupBy("stem").agg(F.count(F.lit(1)).alias("size"), F.sum("c").alias("c"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("c", "term")), asc=False), 1, 9), lambda x: x["term"]).alias("members"))
    return families.orderBy(F.desc("size"), "stem").limit(12)


QUERIES, ORACLES = query.queries, query.oracles
