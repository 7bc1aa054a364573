"""Dependency trees as edge tables: (`doc_id`, `sent_id`, `tok_id`, `head_id`, `dep`, `upos`, `word`); a root points to itself.

A sentence may come as one row, its tokens in arrays: what climbs a tree then never leaves the row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = ["doc_id", "sent_id"]


def in_rows(edges: DataFrame, columns: list[str], by: list[str] = SENT) -> DataFrame:
    """A row for each sentence: `by`, `tok_id` and the columns as arrays, in the order of `tok_id`."""
    rows = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tok_id", *columns))).alias("__t"))
    return rows.select(*by, *[F.col(f"__t.{c}").alias(c) for c in ("tok_id", *columns)])


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of lists, and the elements."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def head_places(row: np.ndarray, tok: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where each token's head stands among the tokens of all rows (each row in order), -1 where it is none of them."""
    if not len(tok):
        return np.zeros(0, np.int64)
    low, span = min(tok.min(), head.min()), max(tok.max(), head.max()) - min(tok.min(), head.min()) + 1
    known, asked = row * span + tok - low, row * span + head - low
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _climbed(batch: pa.RecordBatch, most: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, `tok_id` and depth of every token. Pointers double in each round."""
    row, toks = lists(batch.column("tok_id"))
    tok, head = toks.to_numpy().astype(np.int64), lists(batch.column("head_id"))[1].to_numpy().astype(np.int64)
    up, depth, reach = head_places(row, tok, head), (tok != head).astype(np.int64), 1
    while reach < most:
        there = up >= 0
        depth[there] = np.minimum(depth[there] + depth[up[there]], most)
        up[there] = np.where(up[up[there]] >= 0, up[up[there]], -1)
        reach *= 2
    return row, toks, np.minimum(depth, most)


def depths(edges: DataFrame, by: list[str] = SENT, most: int = 100) -> DataFrame:
    """Edges from every token to its root, `most` at most: by, tok_id, depth."""
    rows = in_rows(edges, ["head_id"], by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, toks, depth = _climbed(batch, most)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in by], toks, pa.array(depth.astype(np.int32))], [*by, "tok_id", "depth"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "tok_id")) + ", depth int")


def tree_depths(edges: DataFrame, by: list[str] = SENT) -> DataFrame:
    return sentence_depths(in_rows(edges, ["head_id"], by), by)


def sentence_depths(rows: DataFrame, by: list[str] = SENT, most: int = 100) -> DataFrame:
    """by, `depth` of the tree and `tokens` of sentences in rows (by, `tok_id`, `head_id`), without a shuffle; empty ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, depth = _climbed(batch, most)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            deepest = np.maximum.reduceat(depth, first) if len(first) else depth
            kept = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(kept) for c in by], pa.array(deepest.astype(np.int32)), pa.array(np.diff(first, append=len(row)).astype(np.int64))], [*by, "depth", "tokens"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*by, "tok_id", "head_id").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", depth int, tokens long")


def children(edges: DataFrame, by: list[str] = SENT) -> DataFrame:
    """Every token with its head's word and its children in order."""
    head = edges.select(*by, F.col("tok_id").alias("head_id"), F.col("word").alias("head_word"))
    below = edges.filter("head_id <> tok_id").groupBy(*by, F.col("head_id").alias("tok_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "word"))), lambda x: x["word"]).alias("children"))
    return edges.join(head, [*by, "head_id"]).join(below, [*by, "tok_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def relations(edges: DataFrame) -> DataFrame:
    """Relations with their count, share and most frequent word (ties to the first word)."""
    counts = edges.groupBy("dep", F.lower("word").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("dep").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "w")))[0]["w"].alias("example"))
    return best.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("all")))).select("dep", "n", (F.col("n") / F.col("all")).alias("share"), "example")


def triples(edges: DataFrame, by: list[str] = SENT, nominal: tuple[str, ...] = ("NOUN", "PROPN", "PRON")) -> DataFrame:
    """Verbs with their first nominal subject and first nominal object: by, verb, subject, object."""
    parts = edges.filter(F.col("upos").isin(*nominal) & F.col("dep").isin("nsubj", "obj"))
    firsts = parts.groupBy(*by, F.col("head_id").alias("tok_id")).agg(
        F.min_by(F.when(F.col("dep") == "nsubj", F.col("word")), F.when(F.col("dep") == "nsubj", F.col("tok_id"))).alias("subject"),
        F.min_by(F.when(F.col("dep") == "obj", F.col("word")), F.when(F.col("dep") == "obj", F.col("tok_id"))).alias("object"),
    )
    verbs = edges.filter("upos = 'VERB'").select(*by, "tok_id", F.col("word").alias("verb"))
    return verbs.join(firsts, [*by, "tok_id"]).filter("subject is not null and object is not null")
