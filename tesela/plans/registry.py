"""How queries are registered: a name, a function of (spark, sf_dir) and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = run
            if sql:
                self.oracles[name] = sql
            return run

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes as fewer splits than there are cores is dealt out first, so that small files use them all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rounded(value: Column, digits: int = 6) -> Column:
    """A double compared at so many digits: sums of doubles depend on their order."""
    return F.round(value.cast("double"), digits)
