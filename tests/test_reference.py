"""The queries against their SQL on the smallest tables, and literal rows of the quirks that change results."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.config import DAY
from tempora.functions import expr as X
from tempora.operators import asof, features, observe, serve, silver, survival
from tempora.plans import registry

registry.load()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FEW = "canonical_clients data_boundary failure_onsets cycles terminal_link obs_labels history_counts interval_trend fleet_asof pit_support episode_outcomes landmarks roc_auc average_precision km_curve c_index curve_calibration ranked_list snapshot_diff flagship".split()


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def norm(x):
        x = x[sorted(x.columns)]
        return sorted(tuple("" if pd.isna(v) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in r) for r in x.itertuples(index=False))

    return sorted(a.columns) == sorted(b.columns) and norm(a.astype(object)) == norm(b.astype(object))


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    for c in got.columns:
        if str(want[c].dtype).startswith("float") or str(got[c].dtype).startswith("float"):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert same(got, want)


def test_every_query_is_listed_once():
    assert len(registry.QUERIES) > 75 and set(registry.ORACLES) <= set(registry.QUERIES)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cleaning_keeps_a_leading_tab_as_a_space(spark):
    assert one(spark, X.clean(F.lit("\t a  b "))) == " A B"
    assert one(spark, X.clean(F.lit("   "))) is None
    assert one(spark, X.normalise_id(F.lit("\t a  b "))) == "A B"


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(2.5))) == 2 and one(spark, F.bround(F.lit(3.5))) == 4
    assert one(spark, X.coarse(F.lit(150.0))) == 120 and one(spark, X.coarse(F.lit(119.0))) == 119


def test_survival_at_the_horizon_counts_as_alive(spark):
    assert one(spark, X.definite(F.lit(30.0), F.lit(True), F.lit(30.0))) == 0
    assert one(spark, X.definite(F.lit(20.0), F.lit(True), F.lit(30.0))) == 1
    assert one(spark, X.definite(F.lit(20.0), F.lit(False), F.lit(30.0))) is None


EVENTS = "item string, journey_id long, created_us long, wo_type string, status string, is_onset boolean, place string"


def test_history_knows_no_future_and_counts_the_same_second(spark):
    rows = [("A", 1, 0, "CORRECTIVE", "DISMANTLED", True, "P"), ("A", 2, 14 * DAY, "PREVENTIVE", "DISMANTLED", False, "P"), ("A", 3, 31 * DAY, "CORRECTIVE", "DISMANTLED", True, None)]
    future = [*rows, ("A", 4, 150 * DAY, "CORRECTIVE", "DISMANTLED", True, "Q")]
    obs = spark.createDataFrame([("A", 31 * DAY), ("B", 31 * DAY)], "item string, at_us long")
    a, b = (sorted(features.history(obs, spark.createDataFrame(r, EVENTS)).collect()) for r in (rows, future))
    assert a == b
    assert a[0]["total_prior_events"] == 3 and a[0]["prior_failure_count"] == 2 and a[0]["prior_corrective_30d"] == 1 and a[0]["prior_distinct_places"] == 1
    assert a[0]["days_since_last_corrective"] == 0 and a[1]["total_prior_events"] == 0 and a[1]["days_since_last_corrective"] is None


def test_trend_needs_three_failures_strictly_before(spark):
    rows = [("A", k, t * DAY, "C", "D", True, "P") for k, t in enumerate((0, 10, 40))]
    obs = spark.createDataFrame([("A", 40 * DAY), ("A", 41 * DAY)], "item string, at_us long")
    got = {r["at_us"] // DAY: r for r in features.interval_trend(obs, spark.createDataFrame(rows, EVENTS)).collect()}
    assert not got[40]["has_failure_interval_trend"] and got[40]["failure_interval_trend_ratio"] == 1.0
    assert got[41]["has_failure_interval_trend"] and got[41]["failure_interval_trend_ratio"] == 1.5


def test_onsets_compare_time_and_id(spark):
    ev = "journey_id long, item string, status string, wo_type string, created_us long"
    rows = [(2, "A", "DISMANTLED", "PREVENTIVE", 10), (1, "A", "BROKEN", "X", 10), (3, "A", "INSTALLED", "X", 10), (4, "A", "BROKEN", "X", 11), (5, "B", "DISMANTLED", "PREVENTIVE", None), (6, "B", "BROKEN", "X", 3), (7, "C", "DISMANTLED", "PREVENTIVE", 5), (8, "C", "UNREPAIRABLE", "X", 5), (9, "D", "DISMANTLED", "CORRECTIVE", None)]
    got = {r["journey_id"] for r in silver.with_onsets(spark.createDataFrame(rows, ev)).where("is_onset").collect()}
    assert got == {7, 9}


def test_label_edges(spark):
    cyc = "cycle_id string, item string, installed_us long, end_us long, onset_us long, verified boolean, in_cohort boolean, last_confirmable_us long, data_end_us long"
    rows = [("a", "A", 0, 215 * DAY, None, True, True, 185 * DAY, 215 * DAY), ("b", "B", 181 * DAY, 200 * DAY, 200 * DAY, False, True, 170 * DAY, 215 * DAY)]
    got = observe.grid(spark.createDataFrame(rows, cyc)).collect()
    assert {r["at_us"] // DAY for r in got if r["cycle_id"] == "a" and r["eligible"]} == {0, 30, 60, 90, 120, 150, 180}
    assert [(r["target"], r["eligible"]) for r in got if r["cycle_id"] == "b"] == [(True, True)]
    assert max(r["at_us"] for r in got if r["cycle_id"] == "a") == 210 * DAY


def test_step_lookup_is_one_at_the_first_grid_time(spark):
    c = spark.createDataFrame([("i", 1.0, 0.9), ("i", 30.0, 0.5)], "item string, t double, s double")
    q = spark.createDataFrame([("i", x) for x in (0.0, 1.0, 2.0, 30.0, 99.0)], "item string, q double")
    assert {r["q"]: r["s"] for r in survival.step_lookup(c, q).collect()} == {0.0: 1.0, 1.0: 1.0, 2.0: 0.9, 30.0: 0.5, 99.0: 0.5}
    assert survival.time_at_threshold(c, 0.95).first()["t"] == 1.0


def test_certain_hazard_stays_certain(spark):
    h = spark.createDataFrame([("i", k, x) for k, x in enumerate((0.1, 1.0, 0.2))], "item string, step int, hazard double")
    assert [round(r["risk"], 6) for r in survival.chained(h).orderBy("step").collect()] == [0.1, 1.0, 1.0]


def test_decisions(spark):
    pairs = [(f, s) for f in ("HIGH", "MEDIUM", "LOW") for s in ("HIGH", "MEDIUM", "LOW", None)]
    got = serve.recommended(spark.createDataFrame(pairs, "failure_level string, scrap_level string")).collect()
    assert len(got) == 12 and all(r["priority"] for r in got)
    with pytest.raises(Exception, match="unknown risk level"):
        serve.recommended(spark.createDataFrame([("ODD", None)], "failure_level string, scrap_level string")).collect()


def test_places():
    assert asof.within(30) == (-30 * DAY + 1, 0) and asof.preceding(90) == (-90 * DAY, -1)


def test_geography(spark):
    rows = [("STASIUN JUANDA", -6.1667, 106.8305), ("GUDANG NI", -6.2, 106.8), ("STASIUN X", -6.9932, 110.4203)]
    df = spark.createDataFrame(rows, "name string, lat double, lon double")
    got = {r["name"] for r in df.where(X.public_place(F.col("name")) & X.in_box(F.col("lat"), F.col("lon"))).collect()}
    assert got == {"STASIUN JUANDA"}
