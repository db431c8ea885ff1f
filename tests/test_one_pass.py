"""Features of many observations: one shuffle by item, look-ups beside it, names and the journal once."""

import re

from pyspark.sql import functions as F

from tempora.functions import expr as X
from tempora.operators import features, silver
from tempora.plans.feature_queries import Layers
from tempora.sources.journal import Journal

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_features_deal_the_observations_once(spark):
    x = Layers(spark, DIR)
    obs = x.observed.where("pmod(xxhash64(cycle_id), 7) = 0")
    rows = features.past(obs, x.op)
    assert len(re.findall(r"Exchange hashpartitioning\(_k", plan(rows))) == 1
    old = features.interval_trend(features.history(obs, x.op), x.op)
    assert sorted(map(str, rows.select(*sorted(rows.columns)).collect())) == sorted(map(str, old.select(*sorted(rows.columns)).collect()))
    every = plan(features.all_features(obs, x.op, x.cycles, x.episodes))
    assert "SortMergeJoin" not in every and len(re.findall(r"Exchange hashpartitioning\(", every)) == 2  # earlier cycles and the pass itself, both by item


def test_the_journal_is_made_once(spark):
    j = Journal(spark, DIR)
    j.item_journey()
    assert "Window" in plan(j.item_journey())
    sem = silver.semantic(j)
    assert "Window" not in plan(j.item_journey()) and j.item_journey().count() == sem.count()
    assert "Window" in plan(Journal(spark, DIR).item_journey())


def test_cleaning_is_that_of_the_expression_alone(spark):
    texts = ["", " ", "a", " a  b ", "\ta b", "a\tb", "a \n b", "a\x0bb\x0c\x0cc\r", "x\r\ny", " a  b", "ä  ß", None, "A B C"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", X.clean(F.col("t")).alias("got"), F.nullif(F.upper(F.regexp_replace(F.trim("t"), r"\s+", " ")), F.lit("")).alias("want")).collect():
        assert r["got"] == r["want"], r


def test_what_became_of_failures_is_found_in_one_shuffle(spark):
    from tempora.operators import outcome

    x = Layers(spark, DIR)
    rows = outcome.resolve(x.episodes, x.op, x.cycles)
    assert len(re.findall(r"Exchange hashpartitioning\(", plan(rows))) == 1 and "SortMergeJoin" not in plan(rows)
    assert rows.count() == x.episodes.where("onset_us IS NOT NULL").count() and rows.where("is_labeled").count() > 0
