"""Structured Streaming around the batch operators: files of quote rows scored as they come, attempts summed by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from premia.engine import PricingEngine
from premia.operators.validate import split_valid


def score_stream(spark: SparkSession, engine: PricingEngine, source: str, schema: StructType, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Scores Parquet files that appear in `source` once each; rows outside the domain go to `rejected` with reasons."""

    def batch(rows: DataFrame, number: int) -> None:
        fine, bad = split_valid(rows, engine.parts.domain)
        engine.predict(fine, strict=False).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempts_by_window(attempts: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, outcome, n, latency_ms for windows of occurred_at (a timestamp); later rows than `late` are dropped."""
    windows = attempts.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", length).alias("w"), "outcome")
    return windows.agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_ms")).select("w.start", "outcome", "n", "latency_ms")
