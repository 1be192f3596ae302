"""The call log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def call_stream(spark: SparkSession, directory: str, schema, form: str = "parquet") -> DataFrame:
    """Calls as they are appended to the files of a folder: ``json`` as the engine's own log, or ``parquet``."""
    return spark.readStream.schema(schema).format(form).load(directory)


def windowed_usage(calls: DataFrame, late: str = "4 days", length: str = "1 hour") -> DataFrame:
    """Calls and tokens by kind in event-time windows; a call that is logged twice counts once."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["call_id"])
    return once.groupBy(F.window("ts", length), "kind").agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


def pending(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """For ``foreachBatch``: what of a micro-batch isn't done yet."""
    return batch.join(done.select(key), key, "left_anti")
