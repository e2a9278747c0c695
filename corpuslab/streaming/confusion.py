"""Evaluation counts kept up to date by a stream of predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import shared_dir
from corpuslab.streaming.sources import parquet_stream


def confusion_counts(stream: DataFrame) -> DataFrame:
    """Mergeable state of the metrics: a count per run and cell. Works on streams and on tables alike."""
    return stream.filter("y_pred is not null").groupBy("experiment", "seed", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def daily_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Predictions per run and day; a day is final once the stream is ``late`` past it, and later rows are left out."""
    w = stream.withWatermark("logged_at", late).groupBy(F.window("logged_at", "1 day").alias("w"), "experiment", "seed")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "experiment", "seed", "n")


def deduplicated(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The first of repeated rows within the watermark."""
    return stream.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["experiment", "seed", "test_idx"])


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run a query over all that is available and return its result. In complete mode the last batch holds all; in append and
    update mode each batch is added."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    out = f"{root}/out"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        write = "overwrite" if mode == "complete" else "append"
        q = df.writeStream.foreachBatch(lambda b, i: b.write.mode(write).parquet(out)).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def confusion_of_stream(spark: SparkSession, path: str) -> DataFrame:
    return run_to_table(confusion_counts(parquet_stream(spark, path)), "complete")
