"""Streaming folds of the corpus counters: counts that add up over files as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """Touching pairs within tokens; works on a static and on a streaming DataFrame."""
    tokens = pages.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("[^ \n]+"), F.lit(0))).alias("tok")).filter(F.length("tok") >= 2)
    pairs = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("tok") - 1), lambda i: F.col("tok").substr(i, F.lit(2)))).alias("g"))
    return pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def windowed_events(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events by window and type; later ones than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def fold(spark, source: str, schema, sink: str, checkpoint: str, make=pair_counts) -> DataFrame:
    """Reads what a folder has, one file at a time, and keeps the running counts; the result is read back from the sink."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{number}")

    run = make(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    return spark.read.parquet(f"{sink}/{last}")
