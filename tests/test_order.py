"""Sums along a global order and pair counts, against plain loops."""

import random

from pyspark.sql import functions as F

from tempora.operators import metrics, ml, order, serve


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(7), rng.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g long, v long").repartition(5)
    got = {r["k"]: r["s"] for r in order.sums_before(df, [F.desc("g"), F.asc("k")], {"s": F.col("v")}).collect()}
    total, want = 0, {}
    for k, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[k] = total
        total += v
    assert got == want
    assert order.sums_before(df.where("k < 0"), [F.asc("k")], {"s": F.col("v")}).count() == 0


def test_c_index_counts_all_pairs(spark):
    rng = random.Random(2)
    for n, times, risks in ((60, 9, 5), (200, 400, 1000), (1, 3, 3)):
        rows = [(rng.randrange(times), rng.random() < 0.6, float(rng.randrange(risks))) for _ in range(n)]
        got = metrics.c_index(spark.createDataFrame(rows, "duration_days long, event boolean, risk double")).first()
        num = den = 0
        for ta, ea, ra in rows:
            for tb, eb, rb in rows:
                if ea and (tb > ta or (tb == ta and not eb)):
                    den += 1
                    num += 1 if ra > rb else 0.5 if ra == rb else 0
        assert (got["comparable"] or 0) == den
        assert got["c_index"] is None if not den else abs(got["c_index"] - num / den) < 1e-12


def test_ranks_and_folds(spark):
    rows = [(f"i{k:03d}", None if k == 5 else float(k % 4), k % 3 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "item string, score double, y boolean")
    got = {r["item"]: r["rank"] for r in serve.ranked(df).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 61))
    folds = ml.folds(df, "y", [F.col("item")]).groupBy("y", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds if r["y"]} == {4} and {r["count"] for r in folds if not r["y"]} == {8}


def test_capacity_cutoffs_and_platt(spark):
    rows = spark.createDataFrame([(k / 100, k * 86_400_000_000, int(k % 10 == 9 or k > 95)) for k in range(100)], "s double, t long, y int")
    r = ml.capacity_cutoffs(rows, "s", "t", 3.0).first()
    per = 100 / (99 / 30.44)
    assert abs(r["per_month"] - per) < 1e-9 and abs(r["high_share"] - 3 / per) < 1e-12
    assert r["medium"] < r["high"] and sum(k / 100 >= r["high"] for k in range(100)) in (9, 10)
    scaled = ml.platt(rows, ml.fit_platt(rows, "s", "y"), "s", "p").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).first()
    assert abs(scaled["p"] - scaled["y"]) < 0.01
