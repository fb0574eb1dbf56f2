"""Structured Streaming: an incremental learner, audit ingest without repeats, and windowed counts with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.sources.store import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


STATE = "user_id long, n long, total double"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def merge_counts(batch: DataFrame, number: int, folder: str) -> None:
    """Batch ``number`` on top of the state after the one before, as a version of its own.

    It depends on nothing but the folder, so a batch that is repeated, in this process or after a restart, gives the same
    version again.
    """
    new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    if number:
        new = batch.sparkSession.read.schema(STATE).parquet(f"{folder}/state-{number - 1}").unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new.write.mode("overwrite").parquet(f"{folder}/state-{number}")


def learn_counts(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """user_id, n and total of all events so far: state is a table that each micro-batch is merged into.

    ``folder`` keeps state and checkpoint; with the same one a later run goes on where the last one ended. Without, a new
    one is taken.
    """
    base = folder or f"{shared_dir(spark)}/clinspark-learner-{uuid.uuid4().hex}"
    run = event_stream(spark, sf_dir).writeStream.foreachBatch(lambda batch, number: merge_counts(batch, number, base)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = -1
    while _exists(spark, f"{base}/state-{last + 1}"):
        last += 1
    out = spark.read.schema(STATE).parquet(f"{base}/state-{last}") if last >= 0 else spark.createDataFrame([], STATE)
    return out.withColumn("total", F.round("total", 4))


def audit_ingest(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """An append-only stream without repeated keys inside the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
