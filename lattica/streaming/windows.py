"""Windows over event time, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, step: str | None = None, late: str | None = None) -> DataFrame:
    """event_type, start, n and total of each window; ``late`` sets the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    window = F.window("ts", length, step) if step else F.window("ts", length)
    return events.groupBy("event_type", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def stream_of(spark, sf_dir: str, files_each: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def resample_batches(values: list[str], targets: DataFrame, keys: list[str], write):
    """A ``foreachBatch`` function that resamples each micro-batch of steps onto ``targets`` and hands it to ``write``."""
    from ..operators.temporal import resample

    def each(batch: DataFrame, epoch: int) -> None:
        write(resample(batch, values, targets, keys), epoch)

    return each
