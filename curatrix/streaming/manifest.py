"""Incremental manifests (an extension): first sightings of a key in a stream, late copies dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_path


def incremental(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream that is read once: first rows of each type and user, gathered into a table, then counted by type."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders; a pattern keeps it to the one table
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else sf_dir + "/events.parquet*")
    seen = incremental(stream.select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts")), ["event_type", "user_id"], "ts", "3650 days")
    base = shared_path(spark, "stream")
    q = seen.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(seen.schema).parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_first"), F.min("ts").cast("timestamp_ntz").alias("first_seen"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
