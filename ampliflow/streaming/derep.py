"""Dereplication over a stream of reads: the one step that is associative, so late files only add to counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_dereplicate(reads: DataFrame) -> DataFrame:
    """Running counts per marker, sample and sequence of a streaming reads(marker, sample, seq, abundance); for update mode."""
    return reads.groupBy("marker", "sample", F.md5(F.upper("seq")).alias("md5")).agg(F.sum("abundance").alias("abundance"))


def windowed_arrivals(reads: DataFrame, time: str = "ts", watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Reads and distinct batches per sample and arrival window; rows later than the watermark are left out."""
    return reads.withWatermark(time, watermark).groupBy(F.window(time, window).alias("w"), "sample").agg(F.sum("abundance").alias("abundance"), F.count(F.lit(1)).alias("batches"))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drains an available-now stream into a memory table, for bounded inputs and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
