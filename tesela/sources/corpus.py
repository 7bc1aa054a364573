"""Sources and sinks: annotated corpora, gold tables, stop word lists, annotators, and what is written.

Schemas are declared; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators.ranges import running
from tesela.sources.shared import written

TOKENS = "doc_id long, sent_id int, tok_id int, word string, pos string, iob string"
ANNOTATED = "doc_id long, sent_id int, tok_id int, word string, lemma string, upos string, head_id int, dep string, entity string"
# Schemas of the gold tables.
GOLD = {
    "lemmas": "oracion string, palabra string, lema string, fenomeno string",
    "similarity": "categoria string, frase1 string, frase2 string, similitud double",
    "topics": "id_doc int, tema string",
    "questions": "id_doc int, tipo string, pregunta string, respuestas string",
    "translations": "id int, categoria string, es string, en string",
    "generations": "id_doc int, tarea string, estrategia string, prompt string, salida string",
}


def is_header(words: Column) -> Column:
    """Whether a sentence opens a news item: a bracket among its first ten words and an agency word among the first fifteen."""
    return F.array_contains(F.slice(words, 1, 10), "(") & F.exists(F.slice(words, 1, 15), lambda w: w.startswith("EFE"))


def read_conll(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Token table of files with `word pos iob` lines and empty lines between sentences, cut into documents at headers.

    Files count in the given order, and a file is read in as many splits as Spark makes of it: lines are ordered by file,
    split and place. Sentences and documents are numbered by running sums over ranges of lines and of sentences."""
    rows = None
    for part, path in enumerate(paths):
        place = [F.lit(part).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        lines = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("line"), "value")
        rows = lines if rows is None else rows.unionAll(lines)
    order = ["part", "file", "block", "line"]
    blank = F.trim("value") == ""
    rows = running(rows.withColumn("blank", blank), order, {"sent": F.col("blank").cast("int")}, rank="line_no").filter("not blank")
    words = rows.select("part", "file", "sent", "line_no", F.split(F.trim("value"), r"\s+").alias("f")).select("part", "file", "sent", F.struct("line_no", F.col("f")[0].alias("word"), F.col("f")[1].alias("pos"), F.element_at("f", -1).alias("iob")).alias("t"))
    tokens = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["word"].alias("word"), x["pos"].alias("pos"), x["iob"].alias("iob")))
    sents = words.groupBy("part", "file", "sent").agg(tokens.alias("tokens")).withColumn("opens", is_header(F.transform("tokens", lambda x: x["word"])))
    by = ["part", "file", "sent"]
    numbered = written(running(sents, by, {"opened": F.col("opens").cast("long")}), "sentences")
    first = numbered.filter("rank = 1").select(F.col("opens").cast("long").alias("first"))  # one row: whether a header opens the first document
    docs = numbered.crossJoin(F.broadcast(first)).withColumn("doc_id", F.col("opened") - F.col("first"))
    docs = docs.withColumn("sent_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")) - 1)
    return docs.select("doc_id", "sent_id", F.posexplode("tokens").alias("tok_id", "t")).select("doc_id", "sent_id", "tok_id", "t.word", "t.pos", "t.iob")


def document_table(tokens: DataFrame) -> DataFrame:
    """Documents with counts and running text of a token table."""
    sents = tokens.groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("tok_id", "word"))), lambda x: x["word"]).alias("words"))
    texts = sents.select("doc_id", "sent_id", F.size("words").alias("n"), T.detokenized(F.col("words")).alias("text"))
    return texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "text"))), lambda x: x["text"]), " ").alias("text"))


def read_gold(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A gold table from CSV with quoted cells of several lines; missing references are empty."""
    df = spark.read.csv(path, schema=GOLD[kind], header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True)
    return df.na.fill({"respuestas": ""}) if kind == "questions" else df


def stop_words(language: str = "spanish", keep: tuple[str, ...] = ()) -> list[str]:
    """Spark's list for a language, less the words to keep (negations, say)."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(set(StopWordsRemover.loadDefaultStopWords(language)) - set(keep))


def annotate(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple]]]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Annotated tokens of every text. `load` runs once for each worker and returns a function from a batch of texts to
    tuples (word, lemma, upos, head, dep, entity) of each; any model can stand behind it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(k, 0, i, *t) for k, tokens in zip(batch[key], model(batch[text].fillna("").tolist()), strict=True) for i, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "tok_id", "word", "lemma", "upos", "head_id", "dep", "entity"])

    return df.select(key, text).mapInPandas(run, ANNOTATED)


def aligned(gold: DataFrame, predicted: DataFrame, columns: list[str]) -> DataFrame:
    """Gold tokens with predicted columns (prefixed `p_`) of the same place; by key, never by order."""
    by = ["doc_id", "sent_id", "tok_id"]
    return gold.join(predicted.select(*by, *[F.col(c).alias(f"p_{c}") for c in columns]), by)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Rows (name, key, value) as JSON lines, signs outside ASCII kept."""
    df.write.mode("overwrite").json(path)
