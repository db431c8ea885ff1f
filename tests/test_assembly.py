"""Assembly and assessment agree with each other and keep parts without scrap score or advisory."""

from pyspark.sql import functions as F

from tempora.operators import assembly


def _table(spark):
    failure = spark.createDataFrame([("A", 0.3, "HIGH", 0.9), ("B", 0.2, "MEDIUM", 0.9), ("C", 0.1, "LOW", 0.1)], "item string, failure_probability double, failure_level string, score double")
    scrap = spark.createDataFrame([("A", 0.5, "HIGH"), ("C", 0.1, "LOW")], "item string, scrap_probability double, scrap_level string")
    advisory = spark.createDataFrame([("B", 10.0, 2.0, 3.0)], "item string, median_days double, medium_days double, high_days double")
    return assembly.assembled(failure, scrap, advisory, spark.createDataFrame([("A", "P")], "item string, place string"))


def test_assembled_and_assessed(spark):
    t = _table(spark)
    rows = {r["item"]: r for r in t.collect()}
    assert [(k, rows[k]["rank"], rows[k]["priority"], rows[k]["death_risk"]) for k in "ABC"] == [("A", 1, "CRITICAL", 0.15), ("B", 2, "MEDIUM", None), ("C", 3, "LOW", 0.01)]
    asked = spark.createDataFrame([(" a ",), ("b",), ("x",), ("known",), ("A",)], "item string")
    known = t.select("item").unionByName(spark.createDataFrame([("KNOWN",)], "item string"))
    factors = t.select("item", F.array(F.lit("F")).alias("factors"))
    notes = t.select("item", F.array().cast("array<string>").alias("caveats"))
    got = {r["item"]: r for r in assembly.assessed(asked, known, t, factors, notes).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"A": "SCORED", "B": "SCORED", "X": "NOT_FOUND", "KNOWN": "NOT_SCORABLE"}
    assert got["A"]["failure"]["rank"] == 1 and got["A"]["survival"] is None and got["B"]["scrap"] is None and got["X"]["decision"] is None
    assert got["B"]["survival"]["median_days"] == 10.0 and got["A"]["factors"] == ["F"]


def test_ensembles_and_monitoring_of_nothing(spark):
    empty = spark.createDataFrame([], "item_type string, scrap_probability double, scrap_level string")
    r = assembly.scrap_monitoring(empty, empty).first()
    assert (r["scored"], r["mean_probability"], r["high"], r["unknown_type_share"]) == (0, None, 0, 0.0)
    one = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert [r["highest"] for r in assembly.ensembles(one, "a", "b").orderBy("a").collect()] == [1.0, 3.0]
