"""Borrowed rows and landmark populations against plain Python."""

import random
import re

import pytest

from tempora.operators import evaluate, survival

CURVE = "c string, t double, s double"


def value(points, q):
    points = sorted(points)
    if q <= max(points[0][0], 0):
        return 1.0
    return [s for t, s in points if t <= q][-1]


def test_conditioned_rows_equal_a_look_up_each(spark):
    rnd = random.Random(5)
    curves = {}
    for c in "ABC":
        times, s, points = sorted(rnd.sample(range(1, 60), 8)), 1.0, []
        for t in times:
            s *= rnd.random()
            points.append((float(t), s))
        curves[c] = points
    curves["B"].append((99.0, 0.0))
    rows = [(i, rnd.choice("AABCD"), float(rnd.randrange(0, 110))) for i in range(300)] + [(900, None, 3.0), (901, "A", None), (902, "A", curves["A"][0][0]), (903, "A", curves["A"][0][0])]
    got = evaluate.conditioned_rows(spark.createDataFrame(rows, "k long, c string, age double"), spark.createDataFrame([(c, *p) for c, ps in curves.items() for p in ps], CURVE), "c", "age", 30.0)
    found = {r["k"]: r["risk"] for r in got.collect()}
    want = {}
    for k, c, age in rows:
        if c in curves and age is not None:
            now, then = value(curves[c], age), value(curves[c], age + 30)
            want[k] = 1.0 if now <= 1e-9 else min(max(1 - then / now, 0), 1)
    assert got.count() == len(found) and found == pytest.approx(want, abs=1e-8)


def test_only_the_points_of_a_curve_share_a_window(spark):
    rows = spark.createDataFrame([(k, "A", float(k)) for k in range(50)], "k long, c string, age double")
    plan = evaluate.conditioned_rows(rows, spark.createDataFrame([("A", 1.0, 0.5)], CURVE), "c", "age", 30.0)._jdf.queryExecution().toString()
    assert set(re.findall(r"(\w+)\([^()]*\) windowspecdefinition\(_c", plan)) == {"row_number"}


def test_curves_by_group_are_those_of_each_group(spark):
    rows = [(g, float(1 + k * 7 % 11), k % 3 > 0) for g in "AB" for k in range(20 + (g == "B"))] + [(None, 3.0, True)]
    df = spark.createDataFrame(rows, "g string, duration_days double, event boolean")
    got = {(r["g"], r["t"]): r["s"] for r in evaluate.kaplan_meier_by(df, "g").collect()}
    for g in "AB":
        alone = {(g, r["t"]): r["s"] for r in survival.kaplan_meier(df.where(f"g = '{g}'")).collect()}
        assert {k: v for k, v in got.items() if k[0] == g} == pytest.approx(alone, abs=1e-12)
    assert all(k[0] for k in got)


def test_populations_equal_counting_every_pair(spark):
    rnd = random.Random(9)
    marks = [(rnd.choice(["TRAIN", "TEST"]), rnd.choice(["INSTALL", "ANCHOR"]), float(rnd.randrange(1, 100)), rnd.random() < 0.6, rnd.randrange(10) / 10) for _ in range(120)]
    rows = spark.createDataFrame([(*m, m[4] / 2) for m in marks], "split string, source string, residual_days double, event boolean, s_30 double, s_90 double")
    censor = spark.createDataFrame([(float(t), 1 - t / 120) for t in range(1, 101)], "t double, s double")
    got = {(r["split"], r["population"]): r for r in evaluate.populations(rows, censor, (30, 90)).collect()}
    assert len(got) == 4
    weight = lambda t: 1 - t / 120
    for (split, name), r in got.items():
        of = [m for m in marks if m[0] == split and (name == "ALL" or m[1] == "INSTALL")]
        better = lambda a, b: (a[4] < b[4]) + (a[4] == b[4]) / 2
        pairs = [(a, b) for a in of if a[3] for b in of if b[2] > a[2] or (b[2] == a[2] and not b[3])]
        assert r["rows"] == len(of) and r["c_index"] == pytest.approx(sum(better(*p) for p in pairs) / len(pairs))
        tau = max(m[2] for m in of) * 0.99
        w = [(better(a, b), weight(a[2]) ** -2) for a, b in pairs if a[2] < tau]
        assert r["uno_c"] == pytest.approx(sum(x * y for x, y in w) / sum(y for _, y in w))
        loss = lambda m, h: (m[4] / (1 + (h == 90))) ** 2 / weight(m[2]) if m[3] and m[2] <= h else (1 - m[4] / (1 + (h == 90))) ** 2 / weight(h) if m[2] > h else 0.0
        briers = [sum(loss(m, h) for m in of) / len(of) for h in (30, 90)]
        assert [r["brier_30"], r["brier_90"]] == pytest.approx(briers) and r["integrated_brier"] == pytest.approx(sum(briers) / 2)
        cases = [(better(a, b), 1 / weight(a[2])) for a in of if a[3] and a[2] <= 30 for b in of if b[2] > 30]
        assert r["dynamic_auc"] == pytest.approx(sum(x * y for x, y in cases) / sum(y for _, y in cases))
    assert evaluate.populations(rows.where("FALSE"), censor, (30, 90)).count() == 0
