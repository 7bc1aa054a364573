"""Language identification as inference of a mixture.

A document's character trigrams are taken as drawn from a mixture of languages. Expectation-maximisation estimates the
proportions; of the nested sets of its likeliest languages the one with the best penalised likelihood is kept, and the
largest proportion in it names the language. All documents of a batch are solved together in NumPy.

The model is the smoothed distribution of hashed trigrams in each language's labelled documents: at most `sample` of them
for each language, picked by a hash of the key, whole texts; a table of `GRAMS` rows, whatever the input.

Defined results: a null text, or one without a letter, is `und` with score 0 and no languages, and so is every text where
nothing is labelled; a document with a null key is held out of learning; ties go to the first language by code point;
rows of one key are predicted each; other columns are never read, and those named like an output column are replaced. A very
long text is counted whole, as a slice of its own. The distinct labels, with a row of `GRAMS` counts each, must fit in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.llm.common import col, others, release, small_batches, table

GRAMS = 1 << 16
SAMPLE, SMOOTH, ROUNDS, PENALTY = 3_000, 0.5, 6, 12.0
SLICE_CHARS = 1 << 18
MADE = ["lang_pred", "score", "languages", "shares"]
_lookup: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is none."""
    if not _lookup:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x30000):  # planes above hold no letters but ideographs of plane 3, taken as they are
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        out[0x30000:0x32400] = np.arange(0x30000, 0x32400)
        _lookup.append(out)
    return _lookup[0]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, trigram and count of every distinct trigram of every text, by text."""
    data = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    low = _letters()[data]
    low = np.concatenate([[0], low, [0]]).astype(np.uint64)  # a blank before the first and after the last letter
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0)  # runs of other signs are one blank
    at = np.flatnonzero(keep)
    c = low[at]
    mid = np.flatnonzero(c[1:-1] > 0) + 1
    gram = c[mid - 1] * np.uint64(0x9E3779B97F4A7C15) + c[mid] * np.uint64(0xC2B2AE3D27D4EB4F) + c[mid + 1] * np.uint64(0x165667B19E3779F9)
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    owner = np.searchsorted(ends, at[mid] - 1, side="right").astype(np.uint64)
    both, n = np.unique(owner * np.uint64(GRAMS) + gram, return_counts=True)
    return (both // GRAMS).astype(np.int64), (both % GRAMS).astype(np.int64), n


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Languages in order of code point and the probability of each trigram in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        seen = counts + SMOOTH
        self.share = (seen / seen.sum(axis=0, keepdims=True)).astype(np.float64) if languages else counts

    def _mixture(self, p: np.ndarray, n: np.ndarray, starts: np.ndarray, size: np.ndarray, of: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after some rounds from `weight`, and the log-likelihood under them."""
        for _ in range(rounds):
            part = p * weight[of]
            part *= (n / part.sum(axis=1))[:, None]
            weight = np.add.reduceat(part, starts, axis=0) / size[:, None]
        return weight, np.add.reduceat(n * np.log((p * weight[of]).sum(axis=1)), starts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """Language, score, chosen languages and their proportions of every text."""
        clean = [t or "" for t in texts]
        return [x for a, b in _slices(clean) for x in self._predict(clean[a:b])]

    def _predict(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        out: list = [("und", 0.0, [], [])] * len(texts)
        owner, gram, n = _counts(texts)
        if not len(owner) or not self.languages:
            return out
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        known = owner[starts]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
        p, n = self.share[gram], n.astype(np.float64)
        size = np.add.reduceat(n, starts)
        every = np.full((len(starts), len(self.languages)), 1.0 / len(self.languages))
        full, _ = self._mixture(p, n, starts, size, of, every, ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        best = chosen = None
        for k in range(1, len(self.languages) + 1):
            weight = np.zeros_like(full)
            np.put_along_axis(weight, order[:, :k], np.take_along_axis(full, order[:, :k], axis=1) + 1e-6, axis=1)
            weight /= weight.sum(axis=1, keepdims=True)
            weight, fit = self._mixture(p, n, starts, size, of, weight, ROUNDS if k > 1 else 0)
            fit = fit - PENALTY * 0.5 * (k - 1) * np.log(size + 1)
            if best is None:
                best, chosen = fit, weight
            else:
                better = fit > best
                best, chosen = np.where(better, fit, best), np.where(better[:, None], weight, chosen)
        top = chosen.argmax(axis=1)
        for row, text in enumerate(known.tolist()):
            have = [i for i in np.argsort(-chosen[row], kind="stable").tolist() if chosen[row, i] > 0]
            out[text] = (self.languages[top[row]], float(min(1.0, chosen[row, top[row]])), [self.languages[i] for i in have], [float(chosen[row, i]) for i in have])
        return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % 4 == 2, F.lit(True))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from the labelled documents that are not held out, about `sample` at most of each language."""
    small_batches(df.sparkSession)
    usable = df.select(col(key).alias("key"), col(text).alias("text"), col(label).alias("label")).filter(col("label").isNotNull() & col("text").isNotNull() & ~held_out(col("key")))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not sizes:
        return Model([], np.zeros((GRAMS, 0)))
    draw = F.pmod(F.xxhash64(F.lit("language"), "key"), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    languages = sorted(sizes)
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), GRAMS), np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in _slices(texts):
                owner, gram, n = _counts(texts[a:b])
                np.add.at(total, (labels[a:b][owner], gram), n)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(total[lang, gram])], names=["l", "g", "n"])

    found = usable.filter(draw < share[col("label")]).select("text", "label").mapInArrow(count, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    counts = np.zeros((GRAMS, len(languages)))
    cells = found.toArrow()  # GRAMS rows for each language at most
    counts[cells["g"].to_numpy(), cells["l"].to_numpy()] = cells["n"].to_numpy()
    return Model(languages, counts)


def identify(df: DataFrame, model: Model, text: str = "text", hand_on: list[str] | None = None) -> DataFrame:
    """The columns `hand_on` (all) of every row, with `lang_pred`, `score`, `languages` and `shares`."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = hand_on if hand_on is not None else others(df, MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(batch.column(0).to_pylist())
            lang, score, languages, shares = ([x[i] for x in found] for i in range(4))
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*kept, *MADE])
        release()

    schema = T.StructType([*[df.schema[c] for c in kept], *T.StructType.fromDDL("lang_pred string, score double, languages array<string>, shares array<double>")])
    return df.select(col(text).alias("__text"), *map(col, kept)).mapInArrow(run, schema)


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows whose language can be told, with the columns of the input; null texts and those without a letter go.

    Where nothing could be learned, the text alone decides: a model of one language without a name finds the letters."""
    model = fit(df, key, text, label)
    model = model if model.languages else Model([""], np.zeros((GRAMS, 1)))
    return identify(df, model, text).filter("lang_pred <> 'und'").select(*map(col, others(df, MADE)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")), hand_on=["doc_id"])
    return found.select("doc_id", held_out(col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
