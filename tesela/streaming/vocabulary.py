"""Vocabulary counts of a stream of texts, updated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions import text as T


def word_counts(stream: DataFrame, text: str = "text", time: str | None = None, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """term, c; with `time`, by windows of event time that close `late` after their end."""
    words = stream.select(*([time] if time else []), F.explode(T.tokens(F.col(text))).alias("t")).filter(T.is_word(F.col("t")))
    if not time:
        return words.groupBy(F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("c"))
    by = F.window(time, window)
    counts = words.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(by.alias("w"), F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "term", "c")


def event_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their summed value by window and kind."""
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def run_once(result: DataFrame, folder: str) -> DataFrame:
    """Takes in all there is, in as many batches as the source makes, and stops; the whole result as it then stands.

    Every batch writes the result as Parquet to a folder of its own, so none of it passes through the driver."""
    done: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batches/{number}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    result.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = result.sparkSession
    return spark.read.schema(result.schema).parquet(done[-1]) if done else spark.createDataFrame([], result.schema)
