"""Gold tables against documents: which documents hold an answer, in any of its forms, and how high they are ranked.

Answers and documents are compared as normal forms, as runs of whole words. The first words of each form (up to PREFIX) are
hashed and meet the documents' runs of as many words by an equi-join; what meets is compared word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.sources.shared import drop, small, written

PREFIX = 5


def normal_words(df: DataFrame, key: str, text: str, name: str = "words") -> DataFrame:
    """key and the words of the text's normal form."""
    return df.select(key, F.filter(F.split(T.answer_form(F.col(text)), " "), lambda x: x != "").alias(name))


def answer_forms(gold: DataFrame, key: str = "item_id", answers: str = "answers") -> DataFrame:
    """key, `form` (words): the different normal forms of an item's answers, parted by a bar; empty ones hold nothing."""
    forms = gold.select(key, F.explode(T.aliases(F.col(answers))).alias("alias"))
    return normal_words(forms.withColumn("__k", F.struct(key)), "__k", "alias", "form").select(F.col(f"__k.{key}").alias(key), "form").filter(F.size("form") > 0).distinct()


def holders(gold: DataFrame, documents: DataFrame, item: str = "item_id", answers: str = "answers", key: str = "doc_id", text: str = "text") -> DataFrame:
    """item, key: the documents that hold an answer, once each."""
    hashed = lambda words, at, n: F.xxhash64(F.array_join(F.slice(words, at, n), " "))
    n = F.least(F.size("form"), F.lit(PREFIX))
    forms = written(answer_forms(gold, item, answers).select(item, "form", n.alias("n"), hashed("form", F.lit(1), n).alias("h")), "gold-forms")
    lengths = sorted(r["n"] for r in forms.select("n").distinct().collect())  # PREFIX numbers at most
    if not lengths:
        return forms.select(item).limit(0).join(documents.select(key).limit(0))
    words = written(normal_words(documents, key, text), "gold-words")
    sizes = F.array(*[F.lit(x) for x in lengths])
    places = words.select(key, "words", F.explode(sizes).alias("n")).filter(F.size("words") >= F.col("n"))
    # a hash of each run in one pass over the words of a document, once for each place that it starts at
    runs = places.select(key, "n", F.explode(T.once(F.col("words"), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - F.col("n") + 1), lambda i: hashed(w, i, F.col("n")))))).alias("h"))
    met = written(runs.join(small(forms.select("n", "h").distinct()), ["n", "h"], "left_semi").join(small(forms), ["n", "h"]).select(key, item, "form"), "gold-met")
    # hashes only propose: the form must stand in the words, from word to word
    whole = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    sure = met.join(words, key).filter(F.contains(whole, F.concat(F.lit(" "), F.array_join("form", " "), F.lit(" "))))
    out = written(sure.select(item, key).distinct(), "gold-holders")
    for done in (forms, words, met):
        drop(done)
    return out


def orphans(gold: DataFrame, held: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose answer no document holds."""
    return gold.join(held.select(item).distinct(), item, "left_anti")


def hit_rates(ranked: DataFrame, held: DataFrame, ks: list[int], by: list[str], item: str = "item_id", key: str = "doc_id") -> DataFrame:
    """by, k, `hit`, `items`: how many of the items that can be answered have a holder among the first k documents.

    `ranked` has by, item, key, place. An item that a method ranks nothing for counts as missed."""
    answerable = held.select(item).distinct()
    methods = ranked.select(*by).distinct()
    first = ranked.join(held, [item, key]).groupBy(*by, item).agg(F.min("place").alias("place"))
    every = answerable.crossJoin(F.broadcast(methods)).join(first, [*by, item], "left")
    rows = every.select(*by, "place", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return rows.groupBy(*by, "k").agg(F.avg(F.coalesce((F.col("place") <= F.col("k")).cast("int"), F.lit(0))).alias("hit"), F.count(F.lit(1)).alias("items"))


def best_scores(ranked: DataFrame, held: DataFrame, items: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """by, `answerable`, `score` (mean best score), `items`: what a method's best score says of whether there is an answer."""
    best = ranked.groupBy(*by, item).agg(F.max("score").alias("score"))
    every = items.select(item).distinct().crossJoin(F.broadcast(ranked.select(*by).distinct())).join(best, [*by, item], "left")
    marked = every.join(held.select(item, F.lit(True).alias("there")).distinct(), item, "left")
    return marked.groupBy(*by, F.coalesce("there", F.lit(False)).alias("answerable")).agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("items"))

