"""Structured Streaming forms of view counts, ingest and item dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read(spark: SparkSession, path: str, like: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """A stream over the Parquet files that arrive under ``path``, with the schema of what is there."""
    schema = spark.read.parquet(like or path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_views(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Views per announcement and day, final once the watermark has passed the day."""
    ts = F.col("ts").cast("timestamp")
    return (
        events.withColumn("ts", ts).withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "notice_id").agg(F.count(F.lit(1)).alias("views"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "notice_id", "views")
    )


def distinct_items(items: DataFrame, key: str = "url", late: str = "30 days") -> DataFrame:
    """The first item of each key within the watermark; state of older keys goes."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def finished(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run over everything that is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def appended(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write the stream's results as Parquet under ``path`` and read them back."""
    finished(rows.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def upserted(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Totals per key: each micro-batch writes the keys that it changed, and the last of each key is the result.

    A micro-batch that is run again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    finished(rows.writeStream.outputMode("update").foreachBatch(write), checkpoint)
    others = [c for c in rows.columns if c not in keys]
    changes = rows.sparkSession.read.parquet(path)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*rows.columns)
