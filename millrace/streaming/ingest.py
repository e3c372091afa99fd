"""Structured Streaming extension: windowed counts, deduplicating ingest into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import relational


def event_stream(spark: SparkSession, folder: str, schema: str, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", kind, "n")


def deduplicated(events: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_into(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], newest: str) -> StreamingQuery:
    """Keep ``folder/<version>`` the table of newest rows by key: each batch writes the next version.

    A batch that is run again writes the same version again, so the result does not depend on retries.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = relational.prefer(batch, keys, [F.desc(newest)])
        if number:
            old = batch.sparkSession.read.parquet(f"{folder}/{number - 1}")
            rows = relational.prefer(old.unionByName(rows), keys, [F.desc(newest)])
        rows.write.mode("overwrite").parquet(f"{folder}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
