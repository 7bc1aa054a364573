"""Lists of lemmas and of sentences from annotated tokens (`doc_id`, `sent_id`, `tok_id`, `word`, `lemma`, `upos`, `tag`), stems held against
word groups, and where prepositional phrases attach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.operators.trees import head_places, in_rows, lists
from tesela.sources.shared import drop, written

SENT = ["doc_id", "sent_id"]
#: Classes that carry a topic, and tags of signs that stand in tables.
THEMATIC, TABLE_TAGS = ("NOUN", "PROPN", "ADJ"), ("Fz", "Fh")


def _is_word(c: Column) -> Column:
    return c.rlike(r"^\p{L}+(?:[-']\p{L}+)*$")


def lemma_terms(tokens: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Terms of the tokens in order: lower-case lemmas of words, those of several words parted; `stop` leaves out words and
    parts alike. doc_id, sent_id, tok_id, part, term."""
    kept = tokens.filter(_is_word(F.col("word")))
    kept = kept.filter(~F.lower("word").isin(*stop)) if stop else kept
    parts = kept.select(*SENT, "tok_id", F.posexplode(F.split(F.trim(F.lower("lemma")), r"\s+")).alias("part", "term")).filter(_is_word(F.col("term")))
    return parts.filter(~F.col("term").isin(*stop)) if stop else parts


def content_lemmas(tokens: DataFrame, stop: list[str]) -> DataFrame:
    """doc_id, `lemmas` in order: of words that are no stop words; documents without any have an empty list."""
    kept = F.when(_is_word(F.col("word")) & ~F.lower("word").isin(*stop), F.struct("sent_id", "tok_id", F.lower("lemma").alias("l")))
    return tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["l"]).alias("lemmas"))


def thematic_lemmas(tokens: DataFrame, stop: list[str], longer: int = 2, classes: tuple[str, ...] = THEMATIC) -> DataFrame:
    """Tokens of topical classes whose lemma is no stop word and longer than that, with the lemma in lower case as `term`."""
    rows = tokens.withColumn("term", F.lower("lemma"))
    return rows.filter(F.col("upos").isin(*classes) & ~F.col("term").isin(*stop) & (F.char_length("term") > longer))


def sentences(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, `words` and `tags` in order."""
    rows = tokens.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("tok_id", "word", "tag"))).alias("t"))
    return rows.select(*SENT, F.transform("t", lambda x: x["word"]).alias("words"), F.transform("t", lambda x: x["tag"]).alias("tags"))


def of_length(sents: DataFrame, low: int = 3, high: int = 80) -> DataFrame:
    return sents.filter(F.size("words").between(low, high))


def prose(sents: DataFrame, low: int = 10, high: int = 22, agency: str = "EFE", verb: str = "VM") -> DataFrame:
    """Sentences that are prose: of some length, without an agency's name or signs of tables, with a full verb."""
    return of_length(sents, low, high).filter(
        ~F.exists("words", lambda w: w.startswith(agency)) & F.exists("tags", lambda t: t.startswith(verb)) & ~F.exists("tags", lambda t: t.isin(*TABLE_TAGS))
    )


def examples(sents: DataFrame, reserve: DataFrame, beginnings: list[str]) -> DataFrame:
    """For each beginning the first sentence that has it, else the first of the reserve: beginning, doc_id, sent_id, text, `found`."""
    text = F.array_join("words", " ")
    first = lambda df: df.agg(F.min(F.struct(*SENT, text.alias("text"))).alias("s"))
    asked = sents.sparkSession.createDataFrame([(b,) for b in beginnings], "beginning string")
    hits = sents.withColumn("text", text).join(F.broadcast(asked), F.expr("startswith(text, beginning)")).groupBy("beginning").agg(F.min(F.struct(*SENT, "text")).alias("hit"))
    rows = asked.join(hits, "beginning", "left").crossJoin(first(reserve))
    return rows.select("beginning", F.coalesce("hit", "s").alias("x"), F.col("hit").isNotNull().alias("found")).select("beginning", "x.*", "found")


def removed_by_class(tokens: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Of each list and class the tokens that it removes and their share: list, upos, removed, tokens, share."""
    counts = tokens.groupBy("upos", F.lower("word").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    names = F.array(*[F.struct(F.lit(name).alias("list"), F.col("w").isin(*words).alias("gone")) for name, words in sorted(lists.items())])
    rows = counts.select("upos", "c", F.explode(names).alias("x")).select("upos", "c", "x.*")
    return rows.groupBy("list", "upos").agg(F.sum(F.when(F.col("gone"), F.col("c")).otherwise(0)).alias("removed"), F.sum("c").alias("tokens")).withColumn("share", F.col("removed") / F.col("tokens"))


def lemma_groups(checked: DataFrame, by: Column) -> DataFrame:
    """`group`, right, n, accuracy of lemma checks (`right`) by a grouping of their phenomena."""
    return checked.groupBy(by.alias("group")).agg(F.count_if("right").alias("right"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.col("right") / F.col("n"))


# ---- stems against word groups


def stemming_indices(words: DataFrame) -> DataFrame:
    """Under- and over-stemming of a stemmer (Paice 1994) from distinct rows (group, word, stem): one row with `words`, `under`, `over`, `weight`.

    Pairs of words in one group that get different stems, against all pairs of a group; pairs in different groups that get
    one stem, against all pairs of different groups. Both come from counts by (group, stem): a class of n has n (n - 1) / 2
    pairs, so no pairs are made."""
    cells = words.select("group", "word", "stem").distinct().groupBy("group", "stem").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("words"))
    by = lambda name: cells.groupBy(name).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"of_{name}"))
    row = both.crossJoin(by("group")).crossJoin(by("stem"))
    under = F.try_divide(F.col("of_group") - F.col("both"), F.col("of_group"))
    over = F.try_divide(F.col("of_stem") - F.col("both"), pairs(F.col("words")) - F.col("of_group"))
    return row.select(F.coalesce("words", F.lit(0)).alias("words"), F.coalesce(under, F.lit(0.0)).alias("under"), F.coalesce(over, F.lit(0.0)).alias("over")).withColumn("weight", F.try_divide("over", "under"))


def stemming_probes(words: DataFrame) -> DataFrame:
    """group, `words`, `stems`, and in how many other groups its stems stand, for every group."""
    rows = words.select("group", "word", "stem").distinct()
    shared = rows.groupBy("stem").agg(F.count_distinct("group").alias("groups"))
    return rows.join(shared, "stem").groupBy("group").agg(F.count_distinct("word").alias("words"), F.count_distinct("stem").alias("stems"), F.count_distinct(F.when(F.col("groups") > 1, F.col("stem"))).alias("shared"))


# ---- where prepositional phrases attach


def ancestors(edges: DataFrame, most: int = 128, by: list[str] = SENT) -> DataFrame:
    """by, tok_id, `above`, `distance`: every token with all that stand above it, up to its root.

    Chains double in each round: those known, and those of the token that stands at their end. So a depth d takes log2 d joins."""
    step = edges.filter("head_id <> tok_id").select(*by, "tok_id", F.col("head_id").alias("above"))
    chains, jump, reach = written(step.withColumn("distance", F.lit(1)), "chains"), written(step, "jumps"), 1
    while reach < most and jump.limit(1).count():
        end = jump.select(*by, "tok_id", F.col("above").alias("end"))
        onward = chains.select(*by, F.col("tok_id").alias("end"), "above", (F.col("distance") + reach).alias("distance"))
        grown = written(chains.unionAll(end.join(onward, [*by, "end"]).select(*by, "tok_id", "above", "distance")), "chains")
        far = written(end.join(jump.select(*by, F.col("tok_id").alias("end"), "above"), [*by, "end"]).select(*by, "tok_id", "above"), "jumps")
        drop(chains)
        drop(jump)
        chains, jump, reach = grown, far, 2 * reach
    return chains


def attachments(edges: DataFrame, expected: DataFrame, most: int = 128, by: list[str] = SENT) -> DataFrame:
    """Prepositional phrases against where they should attach: by, tok_id, preposition, word, head_word, expected, right, distance.

    A phrase is a token with a dependent of relation `case`, the first of which is its preposition. `expected` has by,
    tok_id, `expected` (a word; null where the sentence is ambiguous). `right` compares the head; `distance` tells how far up
    the chain of heads the expected word stands (null: not above the phrase at all)."""
    rows = edges.select(*by, "tok_id", "word", "head_id", "dep").join(expected.select(*by, "tok_id", "expected", F.lit(True).alias("asked")), [*by, "tok_id"], "left")
    return sentence_attachments(in_rows(rows, ["word", "head_id", "dep", "expected", "asked"], by), most, by)


def sentence_attachments(rows: DataFrame, most: int = 128, by: list[str] = SENT) -> DataFrame:
    """`attachments` of sentences in rows, without a shuffle: by and the arrays `tok_id` (rising), `word`, `head_id`, `dep`,
    `expected`, `asked` (true where there is an expected word, be it null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, toks = lists(batch.column("tok_id"))
            head, words, wanted = (batch.column(c).flatten() for c in ("head_id", "word", "expected"))
            up = head_places(row, toks.to_numpy().astype(np.int64), head.to_numpy().astype(np.int64))
            codes = pa.concat_arrays([words, wanted]).dictionary_encode().indices.fill_null(-1).to_numpy()
            word, sought = codes[: len(row)], codes[len(row) :]
            case = np.flatnonzero(batch.column("dep").flatten().to_numpy(zero_copy_only=False) == "case")
            case = case[up[case] >= 0]
            phrase, first = np.unique(up[case], return_index=True)  # tokens are in order: the first dependent of each
            asked = batch.column("asked").flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            kept = asked[phrase] & (up[phrase] >= 0)
            phrase, preposition = phrase[kept], case[first[kept]]
            distance, above, step = np.zeros(len(phrase), np.int64), phrase.copy(), 0
            open_ = np.flatnonzero(sought[phrase] >= 0)
            while len(open_) and step < most:
                step += 1
                nxt = up[above[open_]]
                open_, nxt = open_[(nxt >= 0) & (nxt != above[open_])], nxt[(nxt >= 0) & (nxt != above[open_])]
                above[open_] = nxt
                met = word[nxt] == sought[phrase[open_]]
                distance[open_[met]] = step
                open_ = open_[~met]
            take = lambda values, at: values.take(pa.array(at))
            heads = up[phrase]
            right = pa.array(word[heads] == sought[phrase], mask=(word[heads] < 0) | (sought[phrase] < 0))
            columns = [take(toks, phrase), take(words, preposition), take(words, phrase), take(words, heads), take(wanted, phrase), right, pa.array(distance.astype(np.int32), mask=distance == 0)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row[phrase])) for c in by], *columns], [*by, "tok_id", "preposition", "word", "head_word", "expected", "right", "distance"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by) + f", tok_id {kinds['tok_id'].elementType.simpleString()}, preposition string, word string, head_word string, expected string, right boolean, distance int"
    return rows.select(*by, "tok_id", "word", "head_id", "dep", "expected", "asked").mapInArrow(run, schema)


# ---- lines for language models


def generation_lines(sents: DataFrame, least: int = 8, first: int = 2, most: int = 30, without: str = "=====") -> DataFrame:
    """doc_id, place, `line`: the first sentences of every document that are long enough and hold no rule, cut to some words."""
    rows = sents.filter((F.size("words") >= least) & ~F.exists("words", lambda w: w.contains(without)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")).cast("long")
    return rows.withColumn("place", place).filter(F.col("place") <= first).select("doc_id", "place", F.array_join(F.slice("words", 1, most), " ").alias("line"))
