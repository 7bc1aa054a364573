"""Sequence labels: tags, spans, matching, scores and a most-frequent-tag baseline. Rows are (`doc_id`, `sent_id`, `tok_id`, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T

SENT = ["doc_id", "sent_id"]
# Prefixes of positional Spanish tags and their universal classes.
TAGS = {
    "AO": "ADJ", "AQ": "ADJ", "CC": "CCONJ", "CS": "SCONJ", "DA": "DET", "DD": "DET", "DE": "DET", "DI": "DET", "DN": "NUM",
    "DP": "DET", "DT": "DET", "I": "INTJ", "NC": "NOUN", "NP": "PROPN", "P0": "PRON", "PD": "PRON", "PI": "PRON", "PN": "PRON",
    "PP": "PRON", "PR": "PRON", "PT": "PRON", "PX": "PRON", "RG": "ADV", "RN": "ADV", "SP": "ADP", "VA": "AUX", "VM": "VERB",
    "VS": "AUX", "Y": "PROPN", "Z": "NUM",
}
CLASSES = ["NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "ADP", "DET", "PRON", "NUM", "CCONJ", "SCONJ", "PUNCT", "INTJ"]
ENTITIES = ["PER", "ORG", "LOC", "MISC"]
#: Pairs of classes that a tolerant comparison takes as equal, in order.
TOLERATED = [("NOUN", "PROPN"), ("VERB", "AUX"), ("DET", "PRON"), ("ADJ", "NOUN")]


def universal(tag: Column) -> Column:
    """Universal class of a positional tag: signs by F, else by its first two letters, then one, then three; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    by = [F.try_element_at(known, F.substring(tag, 1, n)) for n in (2, 1, 3)]
    return F.when(tag.startswith("F"), "PUNCT").otherwise(F.coalesce(*by))


def spans(tags: DataFrame, tag: str = "iob", by: list[str] = SENT, order: str = "tok_id") -> DataFrame:
    """Spans of an IOB column: `type`, `start`, `end` (exclusive). An I without a B, or of another type, opens a span."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(tag).over(w)
    inside = F.col(tag).startswith("I-") & before.rlike("^[BI]-") & (F.substring(before, 3, 99) == F.substring(tag, 3, 99))
    opens = F.col(tag).rlike("^[BI]-") & ~F.coalesce(inside, F.lit(False))
    rows = tags.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(tag).rlike("^[BI]-"))
    return rows.groupBy(*by, "island").agg(F.min_by(F.substring(tag, 3, 99), order).alias("type"), F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("island")


def score(hits: Column, extra: Column, missed: Column) -> list[Column]:
    """Precision, recall and F1 from counts, 0 where undefined."""
    p = F.coalesce(F.try_divide(hits, F.nullif(hits + extra, F.lit(0))), F.lit(0.0)).cast("double")
    r = F.coalesce(F.try_divide(hits, F.nullif(hits + missed, F.lit(0))), F.lit(0.0)).cast("double")
    f = F.coalesce(F.try_divide(2 * hits, F.nullif(2 * hits + extra + missed, F.lit(0))), F.lit(0.0)).cast("double")
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def matched(gold: DataFrame, found: DataFrame, by: list[str] = SENT, typed: bool = True) -> DataFrame:
    """Spans of either side with `in_gold`, `in_found`; sets for each sentence, exact in place and, if `typed`, type."""
    key = [*by, "start", "end"] + ["type"] * typed
    a = gold.select(*key).distinct().withColumn("in_gold", F.lit(True))
    b = found.select(*key).distinct().withColumn("in_found", F.lit(True))
    return a.join(b, key, "full").fillna(False, ["in_gold", "in_found"])


def counted(both: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and the scores of matched spans."""
    counts = both.groupBy(*(by or [])).agg(
        F.count_if(F.col("in_gold") & F.col("in_found")).alias("tp"), F.count_if(F.col("in_found") & ~F.col("in_gold")).alias("fp"), F.count_if(F.col("in_gold") & ~F.col("in_found")).alias("fn")
    )
    return counts.select(*(by or []), "tp", "fp", "fn", *score(F.col("tp"), F.col("fp"), F.col("fn")))


def error_classes(gold: DataFrame, found: DataFrame, by: list[str] = SENT) -> DataFrame:
    """Missed gold spans with `error`: type, boundary or omission, by the first overlapping found span, and that one."""
    missed = gold.distinct().join(found.select(*by, "start", "end", "type").distinct(), [*by, "start", "end", "type"], "left_anti")
    other = found.select(*[F.col(c).alias(f"f_{c}") for c in by], F.struct("type", "start", "end").alias("f"))
    on = [F.col(c) == F.col(f"f_{c}") for c in by] + [F.col("f.start") < F.col("end"), F.col("f.end") > F.col("start")]
    first = missed.join(other, on, "left").groupBy(*by, "type", "start", "end").agg(F.min("f").alias("f"))
    same = (F.col("f.start") == F.col("start")) & (F.col("f.end") == F.col("end"))
    return first.withColumn("error", F.when(F.col("f").isNull(), "omission").when(same, "type").otherwise("boundary"))


def spurious(gold: DataFrame, found: DataFrame, by: list[str] = SENT) -> DataFrame:
    """Found spans that overlap no gold span."""
    other = gold.select(*[F.col(c).alias(f"g_{c}") for c in by], F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return found.distinct().join(other, [F.col(c) == F.col(f"g_{c}") for c in by] + [F.col("g_start") < F.col("end"), F.col("g_end") > F.col("start")], "left_anti")


class Tagger:
    """The most frequent tag of every word, whatever its case, and of all words for unseen ones; ties go to the first tag."""

    def __init__(self, tokens: DataFrame, word: str = "word", tag: str = "upos"):
        counts = tokens.groupBy(F.lower(word).alias("w"), F.col(tag).alias("t")).agg(F.count(F.lit(1)).alias("c"))
        place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("c"), "t"))
        self.table = counts.withColumn("place", place).filter("place = 1").select("w", F.col("t").alias("best"))
        self.backup = counts.groupBy("t").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "t").limit(1).select(F.col("t").alias("backup"))

    def tag(self, tokens: DataFrame, word: str = "word") -> DataFrame:
        """Adds `predicted` and `known`."""
        rows = tokens.join(self.table, F.lower(word) == F.col("w"), "left").crossJoin(F.broadcast(self.backup))
        return rows.withColumn("predicted", F.coalesce("best", "backup")).withColumn("known", F.col("best").isNotNull()).drop("w", "best", "backup")


def accuracy(rows: DataFrame, by: list[str] | None = None, gold: str = "upos", predicted: str = "predicted") -> DataFrame:
    """tokens, accuracy and the weight of errors (1 - accuracy) * tokens."""
    out = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("tokens"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))
    return out.withColumn("errors", (1 - F.col("accuracy")) * F.col("tokens"))


def confusion(rows: DataFrame, classes: list[str], gold: str = "upos", predicted: str = "predicted") -> DataFrame:
    """Counts of predicted classes for each gold class, in the given order, 0 where none."""
    return rows.groupBy(gold).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def tolerant(rows: DataFrame, gold: str = "upos", predicted: str = "predicted", pairs: list[tuple[str, str]] = TOLERATED) -> DataFrame:
    """Accuracy when pairs of classes count as equal, each alone and one after another: step, name, alone, cumulative."""
    same = F.col(gold) == F.col(predicted)
    steps, running = [], same
    for i, (a, b) in enumerate(pairs):
        near = F.col(gold).isin(a, b) & F.col(predicted).isin(a, b)
        running = running | near
        steps.append(F.struct(F.lit(i + 1).alias("step"), F.lit(f"{a}={b}").alias("name"), (same | near).cast("double").alias("alone"), running.cast("double").alias("cumulative")))
    each = rows.select(F.explode(F.array(*steps)).alias("s")).select("s.*")
    return each.groupBy("step", "name").agg(F.avg("alone").alias("alone"), F.avg("cumulative").alias("cumulative"))


def context(tokens: DataFrame, width: int = 4, word: str = "word", by: list[str] = SENT) -> DataFrame:
    """Adds `around`: the words from `width` before to `width` after."""
    w = Window.partitionBy(*by).orderBy("tok_id").rowsBetween(-width, width)
    return tokens.withColumn("around", F.array_join(F.collect_list(word).over(w), " "))


def lemma_check(gold: DataFrame, tokens: DataFrame) -> DataFrame:
    """Gold rows (`item`, `word`, `lemma`) with the lemma of the word's first use in the item's tokens and whether it agrees.

    `found` is null where the word does not occur; `require_found` makes that an error."""
    first = tokens.groupBy("item", F.lower("word").alias("w")).agg(F.min_by(F.lower("lemma"), "tok_id").alias("found"))
    rows = gold.join(first.withColumnRenamed("item", "i"), (F.col("item") == F.col("i")) & (F.lower("word") == F.col("w")), "left").drop("i", "w")
    return rows.withColumn("right", F.coalesce(F.col("found") == F.col("lemma"), F.lit(False)))


def first_uses(tokens: Column) -> Column:
    """Of an array of structs that begin with `word` and a place: the first of each word, by word."""
    return T.once(F.array_sort(tokens), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["word"] != x["word"])))


def sentence_lemma_check(sentences: DataFrame, gold: Callable[[Column], Column], by: list[str] = SENT) -> DataFrame:
    """`lemma_check` of sentences in rows, without a shuffle: by, `word`, `lemma`, the other fields of `gold`, `found`, `right`.

    `tokens` is an array of structs that begin with `word` (lower case) and `tok_id` and have a `lemma`; `gold` makes the
    gold struct (`word`, `lemma`, ...) of a word's first use."""
    rows = sentences.select(*by, F.explode(first_uses(F.col("tokens"))).alias("use"))
    found = F.lower("use.lemma")
    return rows.select(*by, gold(F.col("use")).alias("g"), found.alias("found")).select(*by, "g.*", "found", F.coalesce(F.col("found") == F.col("g.lemma"), F.lit(False)).alias("right"))


def require_found(checked: DataFrame) -> DataFrame:
    return checked.withColumn("found", F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit("not in its sentence: "), "word")).cast("string")).otherwise(F.col("found")))


def word_vectors_miss(lemmas: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Lemmas that a vector vocabulary lacks, those of several words marked as composite."""
    return lemmas.join(vocabulary.select(F.col("term").alias("lemma")), "lemma", "left_anti").withColumn("composite", F.col("lemma").contains(" "))
