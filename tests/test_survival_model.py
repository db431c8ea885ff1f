"""Proportional hazards against a brute-force likelihood; calibration tables; conditional curves."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tempora.operators import cox, metrics, ml, survival


def brute_fit(t, e, x):
    """Newton's method on the Breslow likelihood, every risk set by itself."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        grad, info, value, w = np.zeros(len(beta)), np.zeros((len(beta),) * 2), 0.0, np.exp(x @ beta)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            s0, s1, s2 = w[at].sum(), w[at] @ x[at], (x[at] * w[at, None]).T @ x[at]
            value += x[i] @ beta - np.log(s0)
            grad += x[i] - s1 / s0
            info += s2 / s0 - np.outer(s1, s1) / s0**2
        move = np.linalg.solve(info, grad)
        if np.abs(move).max() < 1e-10:
            break
        beta = beta + move
    return beta, value


def sample(n, seed=1, ties=15):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 3))
    life, follow = g.exponential(np.exp(-x @ [0.8, -0.5, 0.0]) * 8), g.exponential(10, n)
    t, e = np.ceil(np.minimum(life, follow)), life <= follow
    t[: n // 3] = np.minimum(t[: n // 3], ties) if ties else t[: n // 3]
    t[: n // 5] = 4.0  # a fifth of all rows at one time
    return t, e, x


def table(spark, t, e, x):
    return spark.createDataFrame([(float(a), bool(b), v.tolist()) for a, b, v in zip(t, e, x, strict=True)], "t double, event boolean, x array<double>").repartition(3)


@pytest.mark.parametrize("rows", [7, 50, 100_000])
def test_cox_is_the_maximum_of_the_likelihood(spark, rows, monkeypatch):
    t, e, x = sample(400)
    real = cox.laid
    monkeypatch.setattr(cox, "BLOCK_ROWS", rows)
    blocks = []
    monkeypatch.setattr(cox, "laid", lambda *a: blocks.append(b := real(*a)) or b)
    grid = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    model = cox.fit(table(spark, t, e, x), grid, l2=0.0)
    beta, value = brute_fit(t, e, x)
    assert np.allclose(model.beta, beta, atol=1e-6) and abs(model.value - value) < 1e-6
    w = np.exp(x @ beta)
    want = [sum(1 / w[t >= t[i]].sum() for i in np.flatnonzero(e & (t <= q))) for q in grid]
    assert np.allclose(model.hazard, want, atol=1e-6)
    assert cox.loaded(cox.saved(model, spark)) == model


def test_cox_of_rows_that_say_nothing(spark):
    schema = "t double, event boolean, x array<double>"
    assert cox.fit(spark.createDataFrame([], schema), [1.0]).hazard == (0.0,)
    rows = spark.createDataFrame([(1.0, False, [1.0]), (2.0, None, [1.0]), (None, True, [1.0]), (3.0, True, None), (3.0, True, [None]), (4.0, False, [2.0])], schema)
    model = cox.fit(rows, [1.0, 5.0])
    assert model.beta == (0.0,) and model.hazard == (0.0, 0.0)
    same = spark.createDataFrame([(float(k), True, [1.0, 1.0]) for k in range(9)], schema)
    assert np.allclose(cox.fit(same, [1.0]).beta, 0)


def test_cox_orders_better_than_one_column(spark):
    t, e, x = sample(3000, 2, 0)
    c = []
    for cols in (slice(0, 1), slice(0, 3)):
        rows = table(spark, t, e, x[:, cols])
        model = cox.fit(rows, [1.0, 5.0, 20.0])
        scored = rows.select(F.col("t").alias("duration_days"), "event", cox.predictor(model).alias("risk"))
        c.append(metrics.c_index(scored).first()["c_index"])
    assert c[1] > c[0] + 0.03


def test_curves_of_cox(spark):
    model = cox.Cox((1.0, -1.0), (1.0, 2.0), (0.1, 0.3), 0.0)
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 1.0]), ("c", [1e9, 0.0])], "item string, x array<double>")
    got = {(r["item"], r["t"]): r["s"] for r in cox.curves(rows, model).collect()}
    assert abs(got["a", 1.0] - np.exp(-0.1)) < 1e-12 and abs(got["b", 2.0] - np.exp(-0.3 * np.e)) < 1e-12 and got["c", 2.0] == 0


def brute_line(x, xs, ys):
    return float(np.interp(x, xs, ys))


def test_ten_thousand_knots_do_not_grow_the_plan(spark):
    xs = np.linspace(0, 1, 10_000) ** 2
    knots = spark.createDataFrame([(h, float(x), float(y)) for h in (30, 60) for x, y in zip(xs, np.sqrt(xs) / (1 + h / 60), strict=True)], "h int, x double, y double")
    g = np.random.default_rng(3)
    curves = spark.createDataFrame([(i, float(t), float(s)) for i in range(300) for t, s in zip((10, 30, 45, 60, 90), sorted(g.random(5), reverse=True), strict=True)] + [(1000, 30.0, 1.0), (1001, 30.0, 0.0), (1002, 30.0, None)], "item int, t double, s double")
    out = survival.calibrated(curves, knots, (30, 60))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {(r["item"], r["t"]): r["s"] for r in out.collect()}
    line = {h: np.sqrt(xs) / (1 + h / 60) for h in (30, 60)}
    for i in range(300):
        low = 0.0
        for r in sorted((r for r in curves.where(F.col("item") == i).collect()), key=lambda r: r["t"]) if i < 12 else []:
            x, part = 1 - r["s"], min(max((r["t"] - 30) / 30, 0), 1)
            low = max(low, brute_line(x, xs, line[30]) * (1 - part) + brute_line(x, xs, line[60]) * part)
            assert abs(got[i, r["t"]] - (1 - low)) < 1e-9
    assert got[1000, 30.0] == 1 and abs(got[1001, 30.0] - (1 - 1 / 1.5)) < 1e-12 and got[1002, 30.0] is None


def test_the_table_gives_what_the_fitted_model_gives(spark):
    g = np.random.default_rng(4)
    score = g.random(500)
    rows = spark.createDataFrame([(float(s), int(g.random() < s**2)) for s in score] + [(None, 1)], "score double, y int")
    knots = ml.isotonic(rows.where("score IS NOT NULL"), "score", "y")
    got = {r["score"]: r["p"] for r in ml.calibrate(rows, knots, "score", "p").collect()}
    data = rows.where("score IS NOT NULL").select(F.col("score").alias("features"), F.col("y").cast("double").alias("label"))
    want = {r["features"]: r["prediction"] for r in IsotonicRegression().fit(data).transform(data).collect()}
    assert got[None] is None and all(abs(got[s] - p) < 1e-9 for s, p in want.items())
    assert ml.calibrate(rows, knots.where("false"), "score", "p").where("p <> score").count() == 0


def test_detail_of_a_curve(spark):
    rows = [("a", float(t), float(np.exp(-0.004 * t)), float(np.exp(-0.002 * t))) for t in [*range(1, 121), *range(180, 1081, 60)]] + [("b", 1.0, 1.0, 1.0), ("b", 400.0, 0.9, 0.95)]
    got = {r["item"]: r for r in survival.detail(spark.createDataFrame(rows, "item string, t double, s double, raw double"), (30, 60, 90, 120)).collect()}
    a, b = got["a"], got["b"]
    assert (a["s90"], a["medium"], a["high"], a["median"]) == (27.0, 41.0, 72.0, 180.0)
    assert abs(a["risk_30"] - (1 - np.exp(-0.12))) < 1e-6 and abs(a["raw_90"] - (1 - np.exp(-0.18))) < 1e-6
    assert [p["t"] for p in a["curve"]] == list(range(0, 1081, 30)) and a["curve"][0]["s"] == 1 and a["curve"][5]["s"] == a["curve"][4]["s"]
    assert b["median"] is None and b["s90"] == 400.0 and b["risk_120"] == 0 and b["curve"][-1]["t"] == 390


def test_conditioned_curves(spark):
    curves = spark.createDataFrame([("a", float(t), float(1 - t / 200)) for t in range(10, 201, 10)] + [("z", 10.0, 0.0)], "item string, t double, s double")
    ages = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("a", 100.0), ("z", 50.0)], "item string, age double")
    got = {(r["item"], r["age"], r["h"]): r["risk"] for r in survival.conditioned(curves, ages, (30, 100)).collect()}
    assert len(got) == 6 and abs(got["a", 0.0, 30] - 0.15) < 1e-12 and abs(got["a", 100.0, 30] - 0.3) < 1e-12 and got["a", 100.0, 100] == 1 and got["z", 50.0, 30] == 1


def test_ids_get_what_all_parts_get_and_windows_run_over_them_alone(spark):
    """Curves of a few ids equal those of all parts; events are cut to the ids below every window."""
    from tempora.plans import survival_queries as S

    x = S.Marks(spark, "/root/testdata/sf0.001")
    every = x.now()
    some = every.select("item").orderBy("item").limit(3)
    ids = spark.createDataFrame([(r["item"],) for r in some.collect()] + [("nobody",)], "item string")
    mine = x.now(ids)
    assert sorted(map(str, mine.collect())) == sorted(map(str, every.join(some, "item", "left_semi").select(*mine.columns).collect()))
    plan = mine._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(line) if c.isalpha()), 0) for line in plan]
    for i, line in enumerate(plan):
        if line.lstrip(" :+-").startswith("Window ["):
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert any("LeftSemi" in x for x in plan[i:below]), line[:200]
    rows = S.landmark_rows(x)
    model = S.trained(x, rows)
    all_ = {r["item"]: r for r in model.detail(every).collect()}
    few = {r["item"]: r for r in model.detail(mine).collect()}
    assert len(few) == 3 and all(all_[k] == r for k, r in few.items())
    for r in all_.values():
        assert r["risk_30"] <= r["risk_60"] <= r["risk_90"] <= r["risk_120"]
        known = [v for v in (r["s90"], r["medium"], r["high"], r["median"]) if v is not None]
        assert known == sorted(known)
        s = [p["s"] for p in r["curve"]]
        assert s == sorted(s, reverse=True)
