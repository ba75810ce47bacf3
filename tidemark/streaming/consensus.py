"""Windowed consensus over a stream of quotes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(quotes: DataFrame, time: str, market: str, source: str, value: str, every: str, late: str) -> DataFrame:
    """Per market and window: quotes, distinct-ish sources and mean value; works on batches and on streams."""
    t = quotes.where(F.col(value).isNotNull())
    if quotes.isStreaming:
        t = t.withWatermark(time, late)
    g = t.groupBy(F.window(time, every).alias("w"), market)
    return g.agg(F.count("*").alias("n"), F.min(source).alias("first_source"), F.max(source).alias("last_source"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("start"), market, "n", "first_source", "last_source", "mean_value")


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and gives its result."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream's query gives for the files there are now, as a Parquet table in the folder that the cluster shares.

    Each batch writes the whole result of its own number; the last one counts, so a batch that runs again changes nothing.
    """
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/{n}")).start()
    q.awaitTermination()
    last = q.lastProgress
    return spark.read.parquet(f"{path}/out/{last['batchId']}") if last else spark.createDataFrame([], stream.schema)
