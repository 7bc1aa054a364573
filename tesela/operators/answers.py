"""Question answering over sentences: question types, retrieval inside a document, candidate spans, choice and abstention.

Retrieval is relational. Extraction works on one annotated sentence at a time: parallel arrays of words, universal tags
and entity labels, which any annotator may fill in; `guess_tags` is a stand-in that needs no model."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators.summary import clipped_overlap

# What asks for which type of answer, in order; the first match counts.
TRIGGERS = [
    ("persona", r"qui[eé]n(?:es)?"),
    ("cantidad", r"cu[aá]nt[oa]s?|a cu[aá]nto|qu[eé] precio|qu[eé] porcentaje|cu[aá]l es el n[uú]mero"),
    ("fecha", r"(?:hasta )?cu[aá]ndo|(?:en )?qu[eé] (?:d[ií]a|fecha|a[nñ]o|mes)"),
    ("lugar", r"d[oó]nde|(?:de )?qu[eé] (?:pa[ií]s|ciudad|lugar|aeropuerto)|qu[eé] (?:regi[oó]n|provincia)"),
    ("causa", r"por qu[eé](?: raz[oó]n)?|qu[eé] causa|a qu[eé] se debe"),
]
NUMBER_WORDS = frozenset("un una dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil medio media docena centenar millar".split())
SCALES = frozenset("millones millón millon mil miles billones billón centenar centenares docenas decenas millares".split())
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
DATE = (
    rf"(?:el\s+)?(?:pr[oó]ximo\s+|pasado\s+)?\b\d{{1,2}}\s+de\s+(?:{MONTHS})(?:\s+de\s+(?:19|20)?\d{{2}})?|(?:el\s+)?mes\s+de\s+(?:{MONTHS})(?:\s+de\s+(?:19|20)\d{{2}})?"
    rf"|\b(?:{MONTHS})\s+de\s+(?:19|20)\d{{2}}|\b(?:{MONTHS})\s+(?:pr[oó]ximo|pasado)\b|\b(?:19|20)\d{{2}}\b|\b(?:{MONTHS})\b"
)
CAUSE_LINKS = ["porque", "debido a", "a causa de", "por culpa de", "gracias a", "ya que", "puesto que", "como consecuencia de", "a raíz de", "tras"]
CAUSE_VERBS = ["obligó", "obliga", "provocó", "provoca", "causó", "causa", "impidió", "impide", "ocasionó", "ocasiona", "generó"]
CAUSE_ENDS = [",", ";", ".", "pero", "aunque", "y"]
LEADING = frozenset("pero y aunque sin embargo que sino mientras cuando".split())
BEFORE_NUMBER = frozenset("unos unas casi más menos cerca".split())
NOMINAL = frozenset(["NOUN", "PROPN", "ADJ"])
#: Weights of retrieval, extraction and coverage in the confidence; the least confidence of an answer; sentences tried.
BLEND, LEAST, TRIED = (0.35, 0.35, 0.30), 0.40, 3


def question_type(question: Column) -> Column:
    out = None
    low = F.lower(question)
    for kind, pattern in TRIGGERS:
        hit = low.rlike(rf"(?U)\b(?:{pattern})\b")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("otro")


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words of two signs or more that are no stop words."""
    return F.array_distinct(F.filter(T.content_tokens(text, stop), lambda w: F.char_length(w) > 1))


# ---- scores


def exact_match(predicted: Column, wanted: Column) -> Column:
    return (T.answer_form(predicted) == T.answer_form(wanted)).cast("double")


def token_f1(predicted: Column, wanted: Column) -> Column:
    """F1 of normalized words, each counted as often as both have it; 1 if both are empty."""
    a, b = T.blank_tokens(T.answer_form(predicted)), T.blank_tokens(T.answer_form(wanted))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * clipped_overlap(a, b) / both)


def best_of(predicted: Column, references: Column, metric) -> Column:
    """The best score over the forms of a reference that bars part."""
    return F.array_max(F.transform(T.aliases(references), lambda r: metric(predicted, r)))


# ---- retrieval inside a document


def sentence_scores(questions: DataFrame, sentences: DataFrame, stop: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores of every sentence of a question's document: q_id, doc_id, sent_id, sentence, tfidf, bm25 (rescaled to 1).

    `questions` has (q_id, doc_id, question), `sentences` (doc_id, sent_id, sentence). Question terms that the document
    lacks have idf 0. All tables are partitioned by document."""
    sentences = sentences.join(questions.select("doc_id").distinct(), "doc_id", "left_semi")  # all weights are a document's own
    bag = sentences.select("doc_id", "sent_id", F.explode(T.content_tokens(F.col("sentence"), stop)).alias("term")).groupBy("doc_id", "sent_id", "term").agg(F.count(F.lit(1)).alias("c"))
    n = sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lengths = bag.groupBy("doc_id", "sent_id").agg(F.sum("c").alias("len"))
    mean = lengths.groupBy("doc_id").agg(F.sum("len").alias("total")).join(n, "doc_id").select("doc_id", "n", (F.col("total") / F.col("n")).alias("mean"))
    df = bag.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df")).join(mean, "doc_id")
    idf = df.select("doc_id", "term", "mean", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("ridf"))
    unit = lambda rows, keys: rows.withColumn("w", (1 + F.log("c")) * F.col("idf")).withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys))))
    docs = unit(bag.join(idf, ["doc_id", "term"]), ["doc_id", "sent_id"]).join(lengths, ["doc_id", "sent_id"])
    docs = docs.withColumn("bm", F.col("ridf") * F.col("c") * (k1 + 1) / (F.col("c") + k1 * (1 - b + b * F.col("len") / F.col("mean"))))
    asked = questions.select("q_id", "doc_id", F.explode(T.content_tokens(F.col("question"), stop)).alias("term")).groupBy("q_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    asked = unit(asked.join(idf.select("doc_id", "term", "idf"), ["doc_id", "term"]), ["q_id", "doc_id"]).select("q_id", "doc_id", "term", F.col("w").alias("qw"))
    hits = asked.join(docs, ["doc_id", "term"]).groupBy("q_id", "doc_id", "sent_id").agg(F.sum(F.col("qw") * F.col("w")).alias("tfidf"), F.sum("bm").alias("bm25"))
    every = questions.select("q_id", "doc_id").join(sentences, "doc_id").join(hits, ["q_id", "doc_id", "sent_id"], "left").fillna(0.0, ["tfidf", "bm25"])
    top = F.max("bm25").over(Window.partitionBy("q_id", "doc_id"))
    return every.withColumn("bm25", F.when(top > 0, F.col("bm25") / top).otherwise(0.0))


def ranked_sentences(scored: DataFrame, by: str = "tfidf", k: int = TRIED) -> DataFrame:
    """The first k sentences of every question; ties go to the first sentence."""
    place = F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy(F.desc(F.round(by, 9)), "sent_id"))
    return scored.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


# ---- candidate spans in one sentence


class Tokens(NamedTuple):
    words: list[str]
    tags: list[str]
    entities: list[str]  # IOB-free: the label of each token, or ""


_TOKEN = regex.compile(r"\p{L}+(?:[-']\p{L}+)*|\p{Nd}+(?:[.,]\p{Nd}+)*|[^\s\p{L}\p{N}_]")
_DETERMINERS = frozenset("el la los las un una unos unas este esta su sus the a an le les der die das".split())


def guess_tags(sentence: str) -> Tokens:
    """Words with tags from their shape alone: numbers, signs, determiners, capitals inside the sentence."""
    words = _TOKEN.findall(sentence)
    tags, entities = [], []
    for i, w in enumerate(words):
        low = w.lower()
        name = i > 0 and w[:1].isupper()
        tags.append("PUNCT" if not w[0].isalnum() else "NUM" if w[0].isdigit() or low in NUMBER_WORDS - {"un", "una"} else "DET" if low in _DETERMINERS else "ADP" if len(w) <= 2 else "PROPN" if name else "NOUN" if len(w) > 3 else "OTHER")
        entities.append("PER" if name else "")
    return Tokens(words, tags, entities)


def _runs(inside: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, x in enumerate([*inside, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            out.append((start, i))
            start = None
    return out


def entity_spans(t: Tokens, labels: set[str]) -> list[tuple[int, int]]:
    return [(a, b) for label in labels for a, b in _runs([e == label for e in t.entities])]


def nominal_spans(t: Tokens) -> list[tuple[int, int]]:
    """Runs of nouns, names and adjectives that a noun or name opens, with a determiner before them."""
    out = []
    for a, b in _runs([x in NOMINAL for x in t.tags]):
        led = a > 0 and t.tags[a - 1] == "DET"
        first = a if led else next((i for i in range(a, b) if t.tags[i] in ("NOUN", "PROPN")), None)
        if first is not None:
            out.append((a - 1 if led else first, b))
    return out


#: What goes on a quantity, in letters of `_letters`; an adjective only near its start.
_MORE, ADJECTIVES_UPTO = regex.compile(r"(?:[sn%pa]|(?<=s)d(?=.))*"), 3


def _letters(t: Tokens) -> str:
    """A letter for each token: scale word, noun or number, adjective, "por" of "por ciento", "de" or "por", sign, or none of these."""
    low = [w.lower() for w in t.words]
    out = []
    for w, tag, after in zip(low, t.tags, [*low[1:], ""], strict=True):
        kinds = {"s": w in SCALES, "n": tag in ("NOUN", "PROPN", "NUM"), "%": w == "%", "a": tag == "ADJ", "p": w == "por" and after == "ciento", "d": w in ("de", "por")}
        out.append(next((k for k, holds in kinds.items() if holds), "."))
    return "".join(out)


def _is_number(t: Tokens, i: int) -> bool:
    """Whether a token is a numeral; "un" before a noun that is no scale word is an article."""
    w, after = t.words[i].lower(), i + 1 < len(t.words)
    article = w in ("un", "una") and t.tags[i] in ("DET", "PRON") and after and t.tags[i + 1] == "NOUN" and t.words[i + 1].lower() not in SCALES
    return not article and (w[:1].isdigit() or t.tags[i] == "NUM" or w in NUMBER_WORDS)


def quantity_spans(t: Tokens) -> list[tuple[int, int]]:
    """A numeral with a modifier before it and the unit after it; "de" and "por" are crossed only behind a scale word."""
    letters, out, done = _letters(t), [], 0
    for i in range(len(t.words)):
        if i < done or not _is_number(t, i):
            continue
        start = i - (i > 0 and t.words[i - 1].lower() in BEFORE_NUMBER)
        done = _MORE.match(letters, i + 1).end()
        far = letters.find("a", max(i + 1, start + ADJECTIVES_UPTO + 1), done)
        done = far if far >= 0 else done
        out.append((start, done))
    return out


def _laid_out(t: Tokens) -> tuple[str, list[int]]:
    """The words with one blank between, and where each starts."""
    return " ".join(t.words), [0, *itertools.accumulate(len(w) + 1 for w in t.words)][: len(t.words)]


def _touched(t: Tokens, starts: list[int], begin: int, end: int) -> tuple[int, int]:
    """The tokens that a stretch of the laid out words touches."""
    return bisect_right(starts, begin) - 1, bisect_left(starts, end)


def date_spans(t: Tokens) -> list[tuple[int, int]]:
    """Tokens that matches of the date pattern touch."""
    text, starts = _laid_out(t)
    return [_touched(t, starts, m.start(), m.end()) for m in regex.finditer(DATE, text, regex.IGNORECASE) if m.end() > m.start()]


def _either(words: Iterable[str]) -> str:
    return "(?:" + "|".join(regex.escape(w) for w in words) + r")(?!\S)"


#: Words up to a cut, two at least, behind each causal link; and the words since a sign, up to eight, before a causative verb.
_BEHIND = {link: regex.compile(rf"(?<!\S){_either([link])} (\S+(?: (?!{_either(CAUSE_ENDS)})\S+)+)") for link in CAUSE_LINKS}
_BEFORE = [regex.compile(rf" {_either([verb])}") for verb in CAUSE_VERBS]
_SUBJECT = regex.compile(r"(?<!\S)(?:(?![,;.:] )\S+ )+$")
_LEADING = regex.compile(rf"(?:{_either(LEADING)} )*")
SUBJECT_WORDS = 8


def cause_spans(t: Tokens) -> list[tuple[int, int]]:
    """What follows a causal link up to a cut, or the short subject before a causative verb; it must hold a noun."""
    text, starts = _laid_out(t)
    low = text.lower()
    if len(low) != len(text):  # a letter that has a longer lower case: offsets would differ
        low = text
    found = [m.span(1) for rule in _BEHIND.values() for m in rule.finditer(low, overlapped=True)]
    subjects = [_SUBJECT.search(low, 0, m.start() + 1) for rule in _BEFORE if (m := rule.search(low))]
    found += [m.span() for m in subjects if m and m[0].count(" ") <= SUBJECT_WORDS]
    spans = []
    for begin, end in found:
        after = _LEADING.match(low, begin, end).end()
        spans.append(_touched(t, starts, after if after < end else begin, end))
    return [(a, b) for a, b in spans if not {"NOUN", "PROPN"}.isdisjoint(t.tags[a:b])]


def candidates(t: Tokens, kind: str) -> list[tuple[int, int]]:
    """Spans for a type of question, falling back as the type allows."""
    if kind == "persona":
        return entity_spans(t, {"PER", "PERSON"}) or nominal_spans(t)
    if kind == "lugar":
        return entity_spans(t, {"LOC", "GPE"}) or entity_spans(t, {"ORG", "MISC"}) or nominal_spans(t)
    return {"cantidad": quantity_spans, "fecha": date_spans, "causa": cause_spans}.get(kind, nominal_spans)(t)


def choose(t: Tokens, spans: list[tuple[int, int]], asked: set[str], stop: frozenset[str]) -> tuple[tuple[int, int] | None, float]:
    """The span nearest to the question's words, each counted by its nearest use, and how sure that is.

    Spans of words that the question has itself count only if there are no others."""
    if not spans:
        return None, 0.0
    low = [w.lower() for w in t.words]
    own = [{w for w in low[a:b] if len(w) > 1 and w not in stop and w[0].isalnum()} for a, b in spans]
    stale = np.array([bool(words) and words <= asked for words in own])
    used = sorted(asked.intersection(low))
    near = np.zeros(len(spans))
    middle = np.array(spans, float).mean(axis=1)
    for word in used:
        places = np.array([i for i, w in enumerate(low) if w == word])
        near += 1 / (1 + np.abs(middle[:, None] - places).min(axis=1))
    best = int(np.where(stale & ~stale.all(), -1.0, near).argmax())
    return spans[best], float(min(1.0, 2 * near[best] / max(1, len(used))))


ANSWER = "answer string, type string, sent_id int, sentence string, retrieval double, extraction double, coverage double, confidence double, abstained boolean, reason string"


def answer(questions: DataFrame, sentences: DataFrame, stop: list[str], by: str = "tfidf", least: float = LEAST, annotate=guess_tags) -> DataFrame:
    """An answer for every question of a document, or an abstention: q_id and the fields of ANSWER.

    The first sentences by retrieval are tried; the surest combination wins, the earlier-ranked one on ties."""
    scored = ranked_sentences(sentence_scores(questions, sentences, stop), by)
    rows = scored.join(questions.select("q_id", "question"), "q_id").select(
        "q_id", "place", F.col("sent_id").cast("int").alias("sent_id"), "sentence", F.col(by).alias("score"), question_type(F.col("question")).alias("kind"), content_words(F.col("question"), stop).alias("asked"), content_words(F.col("sentence"), stop).alias("own")
    )
    banned = frozenset(stop)

    @F.pandas_udf("answer string, extraction double")
    def extract(sentence: pd.Series, kind: pd.Series, asked: pd.Series) -> pd.DataFrame:
        out = []
        for s, k, words in zip(sentence, kind, asked, strict=True):
            t = annotate(s)
            span, sure = choose(t, candidates(t, k), set(words), banned)
            out.append((" ".join(t.words[span[0] : span[1]]).strip(" ,.;:«»\"'()") if span else None, sure))
        return pd.DataFrame(out, columns=["answer", "extraction"])

    coverage = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "own")) / F.size("asked")).otherwise(0.0)
    rows = rows.withColumn("x", extract("sentence", "kind", "asked")).withColumn("coverage", coverage)
    blend = BLEND[0] * F.col("score") + BLEND[1] * F.col("x.extraction") + BLEND[2] * F.col("coverage")
    rows = rows.withColumn("confidence", F.when(F.col("x.answer").isNull(), 0.0).otherwise(blend))
    best = rows.groupBy("q_id").agg(F.max_by(F.struct("x", "kind", "sent_id", "sentence", "score", "coverage", "confidence"), F.struct(F.round("confidence", 9).alias("c"), -F.col("place"))).alias("b"))
    empty = F.coalesce(F.col("b.x.answer"), F.lit("")) == ""
    unsure = F.col("b.confidence") < least
    found = best.select(
        "q_id",
        F.when(empty | unsure, "").otherwise(F.col("b.x.answer")).alias("answer"), F.col("b.kind").alias("type"), "b.sent_id", "b.sentence", F.col("b.score").alias("retrieval"),
        F.col("b.x.extraction").alias("extraction"), "b.coverage", "b.confidence", (empty | unsure).alias("abstained"),
        F.when(empty, F.concat(F.lit("no candidate of type "), F.col("b.kind"))).when(unsure, "confidence below the threshold").otherwise("").alias("reason"),
    )
    none = questions.select("q_id", question_type(F.col("question")).alias("k")).join(found, "q_id", "left")
    return none.withColumn("reason", F.when(F.col("abstained").isNull(), "empty document").otherwise(F.col("reason"))).withColumn("type", F.coalesce("type", "k")).withColumn("abstained", F.coalesce("abstained", F.lit(True))).withColumn("answer", F.coalesce("answer", F.lit(""))).drop("k")


def threshold_sweep(answers: DataFrame, steps: list[float]) -> DataFrame:
    """Answered, right and wrongly abstained counts by threshold, after the fact. Needs confidence, right, answerable."""
    rows = answers.select("confidence", "right", "answerable", F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("threshold"))
    given = F.col("confidence") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(given).alias("answered"), F.count_if(given & F.col("right")).alias("right"), F.count_if(~given & ~F.col("answerable")).alias("right_abstentions"), F.count_if(~given & F.col("answerable")).alias("wrong_abstentions"))


def error_kind(abstained: Column, answerable: Column, exact: Column, f1: Column, found_sentence: Column) -> Column:
    """Labels of answers, the first that holds."""
    return (
        F.when(~answerable & abstained, "right abstention").when(~answerable, "answered without need").when(abstained, "abstained wrongly").when(exact == 1, "right")
        .when(f1 > 0, "wrong bounds").when(~found_sentence, "wrong sentence").otherwise("wrong span")
    )
