"""Saved models, the score sink, promotion, and scores that follow a stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempora.operators import ml
from tempora.sources import saved
from tempora.streaming import replay

from .test_streaming import NEW, OLD, arriving


def test_models_score_the_same_after_a_reload(spark, tmp_path):
    rows = spark.range(200).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("type_category"),
        *[(F.col("id") % m).cast("double").alias(c) for c, m in zip(ml.SCRAP_NUMERIC, (7, 11, 3, 5), strict=True)],
        (F.col("id") % 2 == 0).alias("has_prior_repaired"),
        (F.col("id") % 3 == 0).alias("has_repeat_failure"),
        (F.col("id") % 7 > 4).cast("int").alias("is_scrap"),
        F.col("id").alias("k"),
    )
    models = ml.fit_scrap(rows)
    folder = f"file://{tmp_path}/saved"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        saved.load_models(spark, folder, ["linear"], StructType.fromDDL("known array<string>"))
    for _ in range(2):  # a second save replaces the first
        saved.save_models(folder, {"linear": models[0], "forest": models[1]}, rows.agg(F.sort_array(F.collect_set("type_category")).alias("known")))
    held, frozen = saved.load_models(spark, folder, ["linear", "forest"], StructType.fromDDL("known array<string>"))
    assert frozen.first()["known"] == ["t0", "t1", "t2"]
    scores = [ml.score_scrap(m, rows).orderBy("k").select("scrap_raw").collect() for m in (models, (held["linear"], held["forest"]))]
    assert scores[0] == scores[1]


def test_score_sink_keeps_every_value(spark, tmp_path):
    folder = f"file://{tmp_path}/scores"
    schema = "item string, p double, as_of date"
    first = spark.createDataFrame([("a,b", 0.1 + 0.2, "1"), ("", None, "1"), (None, 1e-300, "1"), (' x"y\n\\z ', 2.0, "1")], "item string, p double, d string")
    first = first.select("item", "p", F.lit("2024-01-01").cast("date").alias("as_of"))
    later = first.limit(1).withColumn("as_of", F.lit("2024-02-01").cast("date"))
    for table in (first, later, later):  # again for one date: the other stays, nothing doubles
        saved.save_scores(table, folder)
    got = saved.load_scores(spark, folder, StructType.fromDDL(schema))
    assert got.columns == ["item", "p", "as_of"]
    assert sorted(map(str, got.collect())) == sorted(map(str, first.unionByName(later).collect()))


def test_promotion_needs_both_not_to_fall(spark):
    rows = spark.createDataFrame([(k, float(k), -float(k), int(k >= 8)) for k in range(10)], "k long, good double, bad double, y int")
    good, bad = (ml.measured(rows, "k", 30.0, 2.0, c, "y") for c in ("good", "bad"))
    assert good == {"average_precision": 1.0, "recall_at_capacity": 1.0} and bad["recall_at_capacity"] == 0.0
    assert ml.promoted(good, bad) and ml.promoted(good, good) and ml.promoted(bad, None) and ml.promoted(bad, good, forced=True)
    assert not ml.promoted(bad, good) and not ml.promoted({**good, "recall_at_capacity": 0.9}, good)
    none = rows.where("y = 0")
    assert ml.measured(none, "k", 30.0, 2.0, "good", "y") == {"average_precision": 0.0, "recall_at_capacity": 0.0}
    assert ml.survival_promoted({30: 0.1, 90: 0.2}, {30: 0.1, 90: 0.3}) and not ml.survival_promoted({30: 0.2, 90: 0.2}, {30: 0.1, 90: 0.3})


def test_scores_follow_the_stream(spark, tmp_path):
    def score(rows):
        return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))

    lines = [NEW, OLD[:7], [(900, 1, None), (901, 2, 77)], OLD[7:]]
    stream = arriving(spark, str(tmp_path / "in"), *lines)
    got = replay.rescore(stream, "user_id", score, str(tmp_path / "out"))
    every = spark.read.schema(stream.schema).parquet(str(tmp_path / "in"))
    assert sorted(map(str, got.collect())) == sorted(map(str, score(every.where("user_id IS NOT NULL")).collect()))
    # a batch writes the keys that it touches and no others
    assert spark.read.parquet(str(tmp_path / "out/table")).groupBy("user_id").count().where("user_id = 77").first()["count"] == 1
