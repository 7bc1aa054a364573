"""Ranks, running sums and neighbours over one order of all rows, range by range.

A window without a partition sorts everything in one task. Here the rows are dealt to ranges of the order and written, so
that the ranges stay as they are; each range is numbered by itself, and what lies before or after it comes from a table of
one row for each range. That table has as many rows as there are shuffle partitions, however many rows are ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.sources.shared import written

RANGE = "__range"


def ranged(df: DataFrame, order: list[str | Column], label: str = "ranges") -> DataFrame:
    """The rows, written, with the number of their range: all rows of a range come before those of the next."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()), label)


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column] | None = None, rank: str | None = "rank") -> DataFrame:
    """Adds `rank` (from 1) and the sums of the values up to each row, its own included; `order` must be total."""
    sums = sums or {}
    rows = ranged(df.withColumns({f"__{name}": value for name, value in sums.items()}), order)
    totals = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(f"__{name}").alias(f"__all_{name}") for name in sums])
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = totals.select(RANGE, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in totals.columns[1:]])
    upto = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), RANGE)
    made = [(F.col(f"__all_{name}_before") + F.sum(f"__{name}").over(upto)).alias(name) for name in sums]
    if rank:
        made.append((F.col("__rows_before") + F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))).cast("long").alias(rank))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums and c != rank], *made)


def following(df: DataFrame, order: list[str | Column], values: str, n: int, name: str = "next") -> DataFrame:
    """Adds the first n elements of the arrays that follow each row's, end to end; rows with empty arrays go.

    A range hands its first elements to the ranges before it."""
    head = F.slice(values, 1, n)
    rows = ranged(df.filter(F.size(values) > 0), order)
    by = Window.partitionBy(RANGE).orderBy(*order)
    none = F.array().cast(df.schema[values].dataType)
    # every row has an element at least, so n rows are enough
    ahead = lambda w, value: [F.coalesce(F.lead(value, i).over(w), none) for i in range(1, n + 1)]
    firsts = rows.select(RANGE, head.alias("__head"), F.row_number().over(by).alias("__at")).filter(F.col("__at") <= n)
    heads = firsts.groupBy(RANGE).agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__head"))), lambda x: x["__head"])), 1, n).alias("__head"))
    after = heads.select(RANGE, F.concat(*ahead(Window.orderBy(RANGE), F.col("__head"))).alias("__after"))  # over one row for each range
    out = rows.withColumn("__near", F.concat(*ahead(by, head))).join(F.broadcast(after), RANGE)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.slice(F.concat("__near", "__after"), 1, n).alias(name))
