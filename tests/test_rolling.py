"""Rolling origins learn only from what was known at the cut-off."""

import random

from tempora.config import DAY
from tempora.operators import ml, outcome

SCHEMA = "onset_journey_id long, item string, onset_us long, item_type string, in_cohort boolean, is_labeled boolean, is_scrap int, known_us long, age_total_days double, cycle_age_days double, prior_repaired_count long, prior_failure_count long"


def rows(n=400):
    g = random.Random(2)
    return [(i, f"i{i}", i * DAY, f"t{i % 3}", i % 50 != 7, i % 40 != 3, int(i % 4 == 0), (i + g.randrange(60)) * DAY, float(400 if i % 4 == 0 else g.randrange(200)), 5.0, i % 3, i % 2) for i in range(n)]


def test_an_outcome_that_matures_later_is_not_learned_from(spark):
    data = rows() + [(1000, "late", 10 * DAY, "t1", True, True, 1, 205 * DAY, 1.0, 1.0, 0, 0), (1001, "young", 195 * DAY, "t1", True, True, 1, 196 * DAY, 1.0, 1.0, 0, 0)]
    got = {r["onset_journey_id"] for r in outcome.matured(spark.createDataFrame(data, SCHEMA), 200 * DAY).collect()}
    assert got == {r[0] for r in data if r[4] and r[5] and r[2] <= 170 * DAY and r[7] <= 200 * DAY}
    assert 1000 not in got and 1001 not in got
    later = {r["onset_journey_id"] for r in outcome.matured(spark.createDataFrame(data, SCHEMA), 230 * DAY).collect()}
    assert {1000, 1001} <= later


def test_candidates_on_the_same_later_rows(spark):
    data = rows()
    cuts = [200 * DAY, 300 * DAY, 399 * DAY]
    got = {(r["origin"], r["candidate"]): r for r in ml.rolling_origin(spark.createDataFrame(data, SCHEMA), cuts).collect()}
    assert len(got) == 10
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        later = [r for r in data if r[4] and r[5] and a < r[2] <= b]
        known = [r for r in data if r[4] and r[5] and r[2] <= a - 30 * DAY and r[7] <= a]
        for name in ("prior", "linear", "forest", "boosted", "vote"):
            r = got[k, name]
            assert (r["n"], r["positives"], r["train_rows"]) == (len(later), sum(x[6] for x in later), len(known))
        assert abs(got[k, "prior"]["roc_auc"] - 0.5) < 1e-9 and got[k, "boosted"]["roc_auc"] > 0.99 and got[k, "boosted"]["brier"] < got[k, "prior"]["brier"]
    assert ml.rolling_origin(spark.createDataFrame(data, SCHEMA).where("is_scrap = 0"), cuts).count() == 0
