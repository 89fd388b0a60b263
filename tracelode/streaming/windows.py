"""Streaming over append-only logs: windowed counts with a watermark, deduplication, and running alerts.

State is bounded by the watermark; results go to Parquet through Spark's exactly-once file sink or foreachBatch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelode.session import shared_dir


def parquet_stream(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """A stream of the Parquet files of one name in a folder, with the schema of those there now."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def windowed(stream: DataFrame, time: str, late: str, width: str, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates per tumbling window and group; rows later than ``late`` behind the newest are dropped."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
    return grouped.agg(*(c.alias(n) for n, c in aggs.items())).select(F.col("w.start").alias("start"), *by, *aggs)


def once(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is there and return the result as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tracelode/stream-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/table")

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
