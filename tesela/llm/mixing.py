"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

A source's target is its weight's share of the budget, but at most `max_epochs` times its size; what a capped source
gives up goes to the others by weight until none is above. Sorted by cap over weight, the water level is the first one
that the next source's cap reaches, so no rounds are needed. A target is whole repetitions of every document and a
fractional one: each source is dealt into blocks of bounded size by a seeded hash, and a block hands out its share of the
fraction to its documents in seeded order, the last of them in part, so the words taken equal the rounded target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0; repeated rows of an id are rows of their own, in the order of their sizes, and as many of them are taken as the
plan says; an empty table makes no rows; input columns named like an output column are replaced by it. A very long text is
a row like any other; a partial repetition of it is its start up to the end of the last word taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.llm.common import SPACED_WORD, col, materialize, small, table, words_in

WEIGHTS = (5, 2, 1)
BUDGET, MAX_EPOCHS, BLOCK_ROWS, SEED = 1.5, 2, 5_000, "mix"
MADE = ["size", "source_size", "target", "whole", "extra", "taken"]


def _draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """`source_size`, `weight` -> adds `target`. One row a source; the budget is a share of all sizes."""
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (budget * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    filled = sources.withColumn("cap", F.col("source_size") * max_epochs).withColumn("all", F.sum("source_size").over(everything)).withColumn("level", level)
    # the first level that its own source's cap is not below is the water level; without one, all sources are capped
    water = F.first(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), ignorenulls=True).over(everything)
    return filled.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(water, F.lit(float("inf"))))).drop("cap", "all", "level")


def sources_of(sized: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """One row a source: rank by code point with null last, rows, words and weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("rank", rank).withColumn("weight", weight)


def plan_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, block_rows: int = BLOCK_ROWS, seed: str = SEED) -> DataFrame:
    """One row a document: key, source, `size`, `source_size`, `target`, `whole` repetitions, `extra` words, `taken`."""
    sized = materialize(df.select(col(key).alias("key"), col(source).alias("source"), words_in(col(text)).alias("size")), "mix-sizes")
    plan = materialize(water_fill(sources_of(sized, weights), budget, max_epochs), "mix-plan")
    plan = plan.select(
        F.col("source").alias("s"), "rank", "source_size", "target",
        F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long").alias("whole"),
        F.ceil(F.col("rows") / F.lit(block_rows)).cast("long").alias("blocks"),
    ).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    draw = _draw(F.col("key"), seed)
    dealt = sized.join(small(plan, 100_000), F.col("source").eqNullSafe(F.col("s"))).withColumn("draw", draw).withColumn("block", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    block = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda words: F.floor(F.coalesce(F.try_divide(words.cast("double"), F.col("source_size")), F.lit(0.0)) * F.col("rest"))
    blocks = dealt.groupBy("rank", "block", "source_size", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(block))
    blocks = blocks.select(F.col("rank").alias("r"), F.col("block").alias("b"), (share(F.col("upto")) - share(F.col("upto") - F.col("words"))).alias("quota"))
    before = Window.partitionBy("rank", "block").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.coalesce(F.sum("size").over(before), F.lit(0)))).cast("long")
    taken = dealt.join(blocks, (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b"))).withColumn("extra", extra)
    return taken.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds `__nth`, from 0 among the rows that are equal in `by`: counts by the writing task first, so no task needs them all."""
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "mix-repeated")
    of = [F.col(c) for c in by]
    task = F.shiftright("__row", 33)
    counts = rows.groupBy(*of, task.alias("__task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*of).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[c.alias(f"b{i}") for i, c in enumerate(of)], F.col("__task").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = rows.select("__row", *by, task.alias("__task")).withColumn("place", F.row_number().over(Window.partitionBy(*by, "__task").orderBy("__row")) - 1)
    met = [F.col(c).eqNullSafe(F.col(f"b{i}")) for i, c in enumerate(by)]
    nth = places.join(bases, [*met, F.col("__task") == F.col("t")]).select(F.col("__row").alias("r"), (F.col("base") + F.col("place")).alias("__nth"))
    return rows.join(nth, F.col("__row") == F.col("r")).drop("r")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed table itself, with the columns of the input: a row for each whole repetition of a document, and one with
    its first `extra` words, as they stand in the text, where the fraction takes a part of it."""
    keep = df.columns
    plan = plan_mix(df, key, text, source, **how)
    # rows of one key, source and size stand together in the seeded order: the first `full` are taken whole, the next in part
    plan = plan.groupBy(col(key).alias("k"), col(source).alias("s"), F.col("size").alias("n")).agg(
        F.max("whole").alias("whole"), F.min("extra").alias("least"), F.max("extra").alias("most"), F.count(F.when(F.col("extra") == F.col("size"), 1)).alias("full"),
        F.coalesce(F.max(F.when(F.col("extra") < F.col("size"), F.col("extra"))), F.lit(0)).alias("part"))
    plan = materialize(plan.filter("whole > 0 or most > 0"), "mix-taken")
    rows = df.select(F.struct(*map(col, keep)).alias("row"), col(key).alias("key"), col(source).alias("source"), words_in(col(text)).alias("size"))
    rows = rows.join(small(plan), F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))).drop("k", "s", "n")
    even = rows.filter("least = most").select("row", "size", "whole", F.col("least").alias("extra"))
    if plan.filter("least < most").limit(1).count():
        nth = F.col("__nth")
        odd = _numbered(rows.filter("least < most"), ["key", "source", "size"])
        even = even.unionAll(odd.select("row", "size", "whole", F.when(nth < F.col("full"), F.col("size")).when(nth == F.col("full"), F.col("part")).otherwise(F.lit(0)).cast("long")))
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("whole").cast("int")), F.when(F.col("extra") > 0, F.array(F.col("extra"))).otherwise(F.array().cast("array<bigint>")))
    parted = even.withColumn("part", F.explode(parts))
    given = F.col(f"row.`{text}`")
    words = F.regexp_extract_all(given, F.lit(SPACED_WORD), F.lit(0))  # with the white space before each, so they join to the text's start
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array_join(F.slice(words, 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), "")).otherwise(given)
    return parted.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in keep])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "whole", "extra")


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLES = {
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, source_size * 2 AS cap FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
water AS (SELECT arg_min(level, (cap::DOUBLE / w, rk)) AS level FROM levels WHERE level <= cap::DOUBLE / w),
plan AS (
  SELECT l.source, l.rk, l.source_size, l.n, least(cap::DOUBLE, w * coalesce(water.level, 'infinity'::DOUBLE)) AS target
  FROM levels l LEFT JOIN water ON true),
whole AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole, ceil(n / 5000.0)::BIGINT AS blocks FROM plan),
rest AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM whole),
dealt AS (
  SELECT s.*, r.rk, r.source_size, r.target, r.whole, r.rest, md5('mix:' || doc_id) AS draw,
    ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT % r.blocks AS block
  FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source),
blocks AS (
  SELECT rk, block, source_size, rest, sum(size)::BIGINT AS words, (sum(sum(size)) OVER (PARTITION BY rk ORDER BY block))::BIGINT AS upto
  FROM dealt GROUP BY rk, block, source_size, rest),
quotas AS (
  SELECT rk, block, CASE WHEN source_size = 0 THEN 0 ELSE floor(upto::DOUBLE / source_size * rest) - floor((upto - words)::DOUBLE / source_size * rest) END::BIGINT AS quota FROM blocks),
extra AS (
  SELECT d.*, greatest(0, least(size, quota - coalesce(sum(size) OVER (PARTITION BY d.rk, d.block ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS extra
  FROM dealt d JOIN quotas q ON d.rk = q.rk AND d.block = q.block)
SELECT doc_id, size, source_size, target, whole * size + extra AS taken, whole, extra FROM extra""",
}
