"""Windows of a group of any size, and exact quantiles, against brute force; no task gets a whole group."""

import random

import numpy as np
from pyspark.sql import functions as F

from tempora.config import DAY
from tempora.operators import asof, audit, features, order

rnd = random.Random(3)


def test_one_group_of_all_rows_at_distinct_microseconds(spark):
    events = [("hot", rnd.randrange(40 * DAY), rnd.choice([1, 2, None])) for _ in range(400)] + [("b", 5, 7), ("b", 5 + DAY, 1), (None, 5, 1), ("hot", None, 1)]
    probes = [("hot", rnd.choice(events[:400])[1] + rnd.choice([0, 0, 1, DAY, 3 * DAY])) for _ in range(150)] + [("b", 5), ("b", 6), ("none", 9), (None, 9)]
    probes = sorted(set(probes), key=str)
    ev, pr = spark.createDataFrame(events, "g string, t long, v int"), spark.createDataFrame(probes, "g string, at long")
    frames = {"all": asof.UPTO, "before": asof.BEFORE, "three": asof.preceding(3), "inside": asof.within(2)}
    out = asof.attach_wide(pr, "at", ev.where("g IS NOT NULL"), "t", "g", {n: (F.col("v"), f) for n, f in frames.items()})
    got = {(r["g"], r["at"]): r for r in out.collect()}
    assert len(got) == len(probes)
    for (g, at), r in got.items():
        mine = [(t, v or 0) for x, t, v in events if g is not None and x == g and t is not None]
        for n, (lo, hi) in frames.items():
            low = -(1 << 62) if lo == asof.LOW else at + lo
            assert r[n] == sum(v for t, v in mine if low <= t <= at + hi), (g, at, n)


def windows(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]


def test_no_window_runs_over_a_group(spark):
    """Frames over the range's own rows, or over one row a range; none is partitioned by the group alone."""
    obs = spark.range(1000).select((F.col("id") * 7919).alias("at_us"), F.lit("hot").alias("model"), F.col("id").alias("cycle_id"), F.lit("t").alias("item_type"))
    cycles = obs.select("model", "item_type", "cycle_id", F.col("at_us").alias("installed_us"), (F.col("at_us") + 5).alias("end_us"), F.lit(True).alias("in_cohort"), F.lit("FAILURE").alias("end_reason"))
    episodes = obs.select("model", "item_type", F.col("at_us").alias("onset_us"), F.lit(True).alias("in_cohort"))
    for df in (features.fleet(obs, cycles, episodes), features.type_density(obs, cycles, episodes), features.support_asof(obs, obs), audit.days_since_group_failure(obs, episodes, "model"), audit.hazard_prior(cycles, "model")):
        found = windows(df)
        assert found and all("windowspecdefinition(_range" in x for x in found), found


def test_last_known(spark):
    rows = spark.createDataFrame([(k, None if k % 7 else k) for k in range(3, 500)], "k int, v int").repartition(5)
    got = {r["k"]: r["o"] for r in order.last_known(rows, ["k"], "v", "o").collect()}
    assert got == {k: (k // 7 * 7 if k >= 7 else None) for k in range(3, 500)}


def test_quantiles(spark):
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    data = {"a": [float(rnd.randrange(50)) for _ in range(333)], "b": [1.0], "c": [3.0, 3.0, 9.0], None: [2.0, 5.0]}
    rows = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("a", None), ("empty", None)], "k string, v double")
    got = {r["k"]: r for r in order.quantiles(rows, "v", shares, "k").collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert np.allclose(got[k]["q"], np.quantile(x, shares)) and got[k]["n"] == len(x)
    every = order.quantiles(rows, "v", shares).collect()
    assert len(every) == 1 and np.allclose(every[0]["q"], np.quantile([v for x in data.values() for v in x], shares))
    none = order.quantiles(rows.where("false"), "v", shares).first()
    assert none["n"] == 0 and none["q"] == [None] * 5
