"""Streams keep every line, whatever the order of the files, and write their results to files."""

import glob

from pyspark.sql import functions as F

from tempora.plans import registry
from tempora.streaming import replay

registry.load()
LINE = "event_id long, ts timestamp, user_id long"


def arriving(spark, path, *batches):
    """A stream of one file a trigger; the modification times are the order of the batches."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "event_id long, day int, user_id long")
        stamped = frame.select("event_id", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), "user_id")
        stamped.coalesce(1).write.mode("append").parquet(path)
    assert len(glob.glob(f"{path}/*.parquet")) == len(batches)
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(path)


OLD = [(k, k, k % 3) for k in range(20)]
NEW = [(100 + k, 300 + k, k % 3) for k in range(20)]


def test_ingest_keeps_lines_behind_the_newest(spark, tmp_path):
    stream = arriving(spark, str(tmp_path / "in"), NEW, NEW[:5] + OLD, OLD + NEW)
    got = replay.replay(replay.ingest(stream), str(tmp_path / "out"))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(k for k, *_ in OLD + NEW)
    assert glob.glob(str(tmp_path / "out/table/*.parquet"))


def test_counters_are_written_and_last_wins(spark, tmp_path):
    stream = arriving(spark, str(tmp_path / "in"), NEW, OLD, [(500, 1, 7), (501, 2, None)])
    got = replay.replay_changes(replay.counters(stream, "user_id"), "user_id", str(tmp_path / "out"))
    want = {u: sum(x == u for *_, x in OLD + NEW) for u in range(3)} | {7: 1, None: 1}
    assert {r["user_id"]: r["events"] for r in got.collect()} == want
    assert len(glob.glob(str(tmp_path / "out/table/batch=*"))) == 3


def test_no_stream_ends_in_the_driver(spark):
    before = {t.name for t in spark.catalog.listTables()}
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert registry.QUERIES["stream_replay"](spark, "/root/testdata/sf0.001").first()[:] == (n, n)
    assert registry.QUERIES["stream_counters"](spark, "/root/testdata/sf0.001").agg(F.sum("events")).first()[0] == n
    assert {t.name for t in spark.catalog.listTables()} == before
