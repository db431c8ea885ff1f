"""Streams over the events table, read as files and run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import stored
from ..streaming import replay
from .registry import query


def _folder(spark):
    """A new folder for a stream's table and checkpoint, beside the written tables."""
    return stored(spark.range(1, numPartitions=1), "stream").inputFiles()[0].rsplit("/", 1)[0] + f"-{uuid.uuid4().hex}"


def _stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    files = stored(events.repartitionByRange(8, "ts"), "micro-batches")
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 4).parquet(files.inputFiles()[0].rsplit("/", 1)[0])


@query("stream_counters", "SELECT user_id, count(*) AS events, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id")
def _(spark, d):
    out = replay.replay_changes(replay.counters(_stream(spark, d), "user_id"), "user_id", _folder(spark))
    return out.select("user_id", "events", F.unix_micros("last_ts").alias("last_us"))


@query("stream_replay", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, d):
    once = replay.ingest(_stream(spark, d).select("event_id", "ts"))
    return replay.replay(once, _folder(spark)).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_rescore", "SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT date_trunc('day', ts)) AS days FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def _(spark, d):
    """What each user's whole history gives, computed again for the users that a micro-batch touches."""

    def score(rows):
        return rows.groupBy("user_id").agg(
            F.count("*").alias("events"),
            F.unix_micros(F.min("ts")).alias("first_us"),
            F.unix_micros(F.max("ts")).alias("last_us"),
            F.count_distinct(F.date_trunc("day", "ts")).alias("days"),
        )

    return replay.rescore(_stream(spark, d).select("event_id", "user_id", "ts"), "user_id", score, _folder(spark))
