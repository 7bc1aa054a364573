"""Fill-in-middle documents: prefix, suffix and middle in another order, cut at token boundaries.

A text is held as maximal runs of one character class with cumulative counts: of the units (a run of letters is one unit,
any other code point is one) and of the code points. The classes are ASCII letters, and other signs by their width in UTF-8,
so inside a run every unit is as wide as the next. A cut is found by binary search of the run that holds it, and its
byte and its code point by arithmetic within the run; no list of tokens is made. The draws hang on the key alone, so
reruns and any partitioning give the same cuts.

Defined results: a null text counts as empty, and an empty text is `plain` with an empty output; a null key is hashed as
an empty string; texts that hold a marker are plain; rows that are equal in key and text give equal rows; an empty table
makes no rows; input columns named like an output column are replaced by it. Texts are taken in slices of half a MB; a longer
one is a slice of its own, and needs some forty times its bytes (36 measured).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.llm.common import col, others, release, small_batches, table
from tesela.llm.shingles import slices, utf8

SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]

LETTERS, INSIDE = 0, 255
#: Class of a byte: ASCII letters, or the width of the sign that it begins; bytes inside a sign take the class before them.
_CLASS = np.full(256, 1, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTERS
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = INSIDE, 2, 3, 4


class Runs:
    """Runs of the texts of a slice, end to end; a run never spans two texts."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        kind = _CLASS[data]
        for _ in range(3):  # a sign has three bytes at most after its first
            np.copyto(kind[1:], kind[:-1].copy(), where=kind[1:] == INSIDE)
        first = np.diff(kind, prepend=INSIDE) != 0
        first[ends[ends < len(data)]] = True
        self.start = np.flatnonzero(first)
        kind = kind[self.start]
        size = np.diff(self.start, append=len(data))
        self.width = np.where(kind == LETTERS, size, kind)  # bytes of a unit
        self.signs = np.where(kind == LETTERS, size, 1)  # code points of a unit
        units = size // np.maximum(self.width, 1)
        self.units = np.concatenate([[0], np.cumsum(units)])
        self.chars = np.concatenate([[0], np.cumsum(units * self.signs)])
        self.base = self.units[np.searchsorted(self.start, ends)]  # units before each text
        self.ends = ends

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point of cuts after so many units, all counted from the slice's start."""
        if not len(self.start):
            return np.zeros_like(at), np.zeros_like(at)
        run = np.minimum(np.searchsorted(self.units, at, side="right") - 1, len(self.start) - 1)
        within = at - self.units[run]
        return self.start[run] + within * self.width[run], self.chars[run] + within * self.signs[run]


def draws(key: str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that hang on the key and the seed alone."""
    found = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
    return tuple(int(found[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(keys: list[str | None], texts: list[bytes], seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> list[tuple]:
    """n, form, prefix_chars, middle_chars and output of each text of a slice."""
    runs = Runs(texts)
    n = np.diff(runs.base)
    drawn = np.array([draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1) + runs.base[:-1, None]
    byte, char = runs.cut(cuts)
    opening = runs.cut(runs.base[:-1])[1]
    out = []
    for i, text in enumerate(texts):
        if not text or drawn[i, 2] % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            out.append((int(n[i]), "plain", None, None, text))
            continue
        a, b = (byte[i] - runs.ends[i]).tolist()
        before, middle, after = text[:a], text[a:b], text[b:]
        spm = drawn[i, 3] % 100 < spm_below
        ordered = (SUFFIX, after, PREFIX, before) if spm else (PREFIX, before, SUFFIX, after)
        out.append((int(n[i]), "spm" if spm else "psm", int(char[i, 0] - opening[i]), int(char[i, 1] - char[i, 0]), b"".join((*ordered, MIDDLE, middle))))
    return out


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """The input with `n`, `form`, `prefix_chars`, `middle_chars` and the text in its new order as `output`. No shuffle."""
    small_batches(df.sparkSession)
    keep = others(df, MADE)
    rows = df.select(F.struct(*[col(c) for c in keep]).alias("row"), col(key).cast("string").alias("key"), col(text).alias("text"))
    kinds = dict(zip(MADE, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), utf8(batch.column(2))
            for a, b in slices(texts):
                made = zip(*transformed(keys[a:b], texts[a:b], seed, plain_from, spm_below), strict=True)
                arrays = [pa.array(x, kind) for x, kind in zip(made, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays[:-1], arrays[-1].cast(pa.string())], ["row", *MADE])
        release()

    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in MADE]])
    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *MADE)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker can begin inside a part and end in the marker after it, so parts are exact."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))).otherwise(F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS c2,
    ('0x' || h[17:24])::BIGINT % 100 AS d3, ('0x' || h[25:32])::BIGINT % 100 AS d4 FROM t),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
      WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(c1, c2)], '') AS p, array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(tokens[greatest(c1, c2) + 1:], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f""",
}
