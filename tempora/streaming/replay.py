"""Journal streams: idempotent ingest, rolling counts, running counters, and the items to score again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def ingest(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Lines once each, by key, however late they come: all keys are kept as state (in RocksDB, see replay), as no watermark drops any."""
    return stream.dropDuplicates([key])


def rolling(stream: DataFrame, group: str, time: str = "ts", window: str = "90 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts by group over sliding windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window, step).alias("w"), group).count().select(group, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "count")


def counters(stream: DataFrame, key: str) -> DataFrame:
    """Running totals by key; a late event changes its key's totals whenever it comes."""
    return stream.groupBy(key).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))


def touched(batch: DataFrame, item: str = "item") -> DataFrame:
    """Items of a micro-batch: their whole history is computed again, as a late event may move every later cycle."""
    return batch.select(item).where(F.col(item).isNotNull()).distinct()


def _run(writer, checkpoint: str, spark: SparkSession) -> None:
    """Runs what is available to an end, with the state on the executors' disks."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Appends what is available to a Parquet table by file sink; the written table, read again."""
    spark = stream.sparkSession
    _run(stream.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append"), f"{folder}/checkpoint", spark)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def replay_changes(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Writes the rows that each micro-batch changes to Parquet, a folder a batch, so that a batch run again replaces its own; the last row of each key."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    _run(stream.writeStream.foreachBatch(put).outputMode("update"), f"{folder}/checkpoint", spark)
    names = stream.columns
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/table")
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), "batch").alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) for c in names])


def rescore(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Scores, one row a key, kept up to date: each micro-batch joins the history, and the keys it touches are scored again from all of theirs.

    Both the lines and the new scores of a batch are a folder of their own, so that a batch run again replaces its own; of
    each key the scores of the last batch count. The history is read once a batch; lines without a key score nothing.
    """
    spark = stream.sparkSession
    numbered = StructType([*stream.schema.fields, StructField("batch", LongType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/history/batch={number}")
        history = batch.sparkSession.read.schema(numbered).parquet(f"{folder}/history").where(F.col("batch") <= number)
        again = touched(history.where(F.col("batch") == number), key).withColumnRenamed(key, "_touched")
        rows = history.join(again, F.col(key) == F.col("_touched"), "left_semi").drop("batch")
        score(rows).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    _run(stream.writeStream.foreachBatch(put).outputMode("append"), f"{folder}/checkpoint", spark)
    schema = score(spark.createDataFrame([], stream.schema)).schema
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/table")
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*schema.names), "batch").alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) for c in schema.names])
