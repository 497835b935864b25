"""Live usage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(requests: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Requests per key and day; rows later than the watermark are dropped."""
    return (requests.withWatermark("ts", lateness)
            .groupBy("key_id", F.window("ts", "1 day")).agg(F.count("*").alias("requests"))
            .select("key_id", F.to_date("window.start").alias("day"), "requests"))


def count_usage(requests: DataFrame, path: str, checkpoint: str, lateness: str = "1 day",
                trigger: dict | None = None) -> StreamingQuery:
    """Writes every changed count per batch; a repeated batch replaces its own output."""

    def record(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (daily_counts(requests, lateness).writeStream.outputMode("update")
            .foreachBatch(record).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last count written per key and day; counts only grow."""
    return spark.read.parquet(path).groupBy("key_id", "day").agg(F.max("requests").alias("requests"))
