"""Curves of many parts and lifecycles: made and read in a row, not laid out point by point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import cox, evaluate, ml, scoring, survival

HORIZONS = (30, 60, 90, 120)
DAYS = tuple(float(t) for t in [*range(1, 121), *range(180, 1081, 60)])


def model(step: float) -> cox.Cox:
    return cox.Cox((1.0,), DAYS, tuple((step * np.array(DAYS) ** 0.9).tolist()), 0.0)


@pytest.mark.parametrize("tables", [HORIZONS, (30, 90), ()])
def test_a_row_gives_the_detail_of_its_points(spark, tables):
    g = np.random.default_rng(3)
    knots = spark.createDataFrame([(h, float(x), float(min(x * (0.5 + h / 100), 1))) for h in tables for x in np.sort(g.random(6))], survival.KNOTS)
    m = model(0.002)
    rows = spark.createDataFrame([(f"i{k}", [float(v)]) for k, v in enumerate(g.normal(size=40) * 2)], "item string, x array<double>")
    raw = cox.curves(rows, m).withColumn("raw", F.col("s"))
    want = {r["item"]: r for r in survival.detail(survival.calibrated(raw, knots, HORIZONS), HORIZONS).collect()}
    made = survival.detail_by_row(rows.withColumn("r", F.exp(cox.predictor(m))), m.times, m.hazard, survival.held(knots), HORIZONS)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("mapInArrow")[0] and made.columns == list(next(iter(want.values())).asDict())
    got = {r["item"]: r for r in made.collect()}
    assert len(got) == 40
    for k, w in want.items():
        for c in made.columns[1:-1]:
            assert got[k][c] == pytest.approx(w[c], abs=2e-6) if c[:4] in ("raw_", "risk") else got[k][c] == w[c], (k, c)
        assert [p["t"] for p in got[k]["curve"]] == [p["t"] for p in w["curve"]] and np.allclose([p["s"] for p in got[k]["curve"]], [p["s"] for p in w["curve"]])


def test_outcomes_make_the_horizons_alone(spark, monkeypatch):
    grids, real = [], cox.curves
    monkeypatch.setattr(cox, "curves", lambda rows, m, *a: grids.append(m.times) or real(rows, m, *a))
    rows = spark.createDataFrame([(float(k % 7), 20.0 * k, k % 2 == 0) for k in range(1, 12)], "a double, residual_days double, event boolean")
    life = scoring.Survival(ml.fit_encoder(rows, [], ["a"]), model(0.001), spark.createDataFrame([], survival.KNOTS), spark.createDataFrame([], scoring.FACTS))
    got = life.outcomes(rows).collect()
    assert grids == [tuple(map(float, HORIZONS))] and {r["h"] for r in got} == set(HORIZONS)


def test_a_lifecycle_s_risk_needs_no_points(spark):
    m = model(0.003)
    rows = spark.createDataFrame([(f"c{k % 5}", age) for k, age in enumerate([0.0, 0.5, 1.0, 1.5, 29.9, 100.0, 120.0, 170.0, 1080.0, 4000.0])], "cycle_id string, age double")
    x = spark.createDataFrame([(f"c{k}", [k / 2 - 1]) for k in range(4)], "cycle_id string, x array<double>")
    want = evaluate.conditioned_rows(rows, cox.curves(x, m), "cycle_id", "age", 30.0).collect()
    met = rows.join(x.select("cycle_id", F.exp(cox.predictor(m)).alias("r")), "cycle_id")
    got = {(r["cycle_id"], r["age"]): r["risk"] for r in met.withColumn("risk", cox.within(m, F.col("r"), F.col("age"), 30.0)).collect()}
    assert len(want) == 8 and got == pytest.approx({(r["cycle_id"], r["age"]): r["risk"] for r in want}, abs=1e-8)


def test_counted_periods_fit_the_same_hazards(spark):
    g = np.random.default_rng(5)
    rows = spark.createDataFrame([(float(a), int(i), int(g.random() < 0.1 + 0.1 * i + 0.002 * a)) for a, i in zip(g.integers(0, 20, 3000), g.integers(0, 4, 3000), strict=True)], "age double, interval int, y int")
    counted = rows.groupBy("age", "interval", "y").agg(F.count("*").cast("double").alias("weight"))
    asked = rows.select("age", "interval").distinct()
    p = [{(r["age"], r["interval"]): r["p"] for r in ml.probability(m.transform(asked), "p").collect()} for m in (ml.fit_hazard(rows, ["age"]), ml.fit_hazard(counted, ["age"], "weight"))]
    assert counted.count() < 200 and p[0] == pytest.approx(p[1], abs=1e-9)
