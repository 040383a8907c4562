"""Event-time latency windows as a stream, and the same windows over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latency_windows(trace: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum of latency for each hook and window; rows later than ``late`` are left out of a stream."""
    seen = trace.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", late) if trace.isStreaming else trace
    return seen.groupBy(F.window("recorded_at", width).alias("w"), "hook").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 4).alias("total"), F.max("latency_ms").alias("most")
    ).select(F.col("w.start").alias("began"), "hook", "n", "total", "most")


def run_once(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything that a stream has to give just now, written to ``out`` and read back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
