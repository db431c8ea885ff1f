"""Trained models: no SQL, so rows only; their relational parts have queries of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT
from ..functions import expr as X
from ..functions.tables import looked_up, shared_dir, stored
from ..operators import features, ml, observe, order, outcome, serve, survival
from ..sources import saved
from .feature_queries import Layers
from .registry import query


def _frame(x: Layers):
    """Training rows of the classifier: split, eligible, all features, written once."""
    obs = observe.with_split(x.observed).drop("data_end_us")
    rows = features.classifier_features(features.all_features(obs, x.op, x.cycles, x.episodes))
    return stored(rows.where("eligible AND split IN ('TRAIN', 'VALIDATION', 'TEST')"), "features")


def _classifier(x: Layers):
    rows = _frame(x)
    model = ml.fit_classifier(rows.where("split = 'TRAIN'"))
    validation = stored(ml.probability(model.transform(rows.where("split = 'VALIDATION'"))).select("raw_probability", "target"), "validation")
    return rows, model, ml.isotonic(validation, "raw_probability", "target")


@query("train_failure")
def _(spark, d):
    """Calibrated probabilities of the test rows."""
    rows, model, knots = _classifier(Layers(spark, d))
    test = ml.probability(model.transform(rows.where("split = 'TEST'")))
    return ml.calibrate(test, knots, "raw_probability", "p").select("cycle_id", "at_us", "target", "raw_probability", "p")


@query("batch_scores")
def _(spark, d):
    """Every active part at 30 to 120 days: hazards of four steps chained, banded and ranked by the raw first step."""
    x = Layers(spark, d)
    _, model, knots = _classifier(x)
    support = features.support_totals(x.grid)
    now = features.all_features(observe.active(x.cycles), x.op, x.cycles, x.episodes, support)
    steps = features.classifier_features(features.shifted(now))
    hazards = ml.calibrate(ml.probability(model.transform(steps)), knots, "raw_probability", "hazard")
    risks = survival.chained(hazards.select("item", "step", "raw_probability", "hazard"))
    at = lambda k: F.round(F.max(F.when(F.col("step") == k, F.col("risk"))), 4).alias(f"p{DEFAULT.horizons[k]}")
    wide = risks.groupBy("item").agg(*[at(k) for k in range(4)], F.max(F.when(F.col("step") == 0, F.col("raw_probability"))).alias("score"))
    return serve.ranked(wide.withColumn("failure_level", X.band(F.col("p30"))))


@query("train_scrap")
def _(spark, d):
    """Scrap probabilities of every active part as if it failed now."""
    x = Layers(spark, d)
    resolved = stored(outcome.resolve(x.episodes, x.op, x.cycles), "resolved")
    types = outcome.known_types(resolved)
    models = ml.fit_scrap(stored(outcome.scrap_features(resolved.where("in_cohort AND is_labeled"), types), "scrap"))
    return ml.score_scrap(models, outcome.scrap_features(outcome.current_state(x.op, x.cycles), types)).select("item", "type_category", "scrap_raw")


@query("scrap_scores")
def _(spark, d):
    """Scrap probability and level of every active part: soft votes, scaled and cut off by what the other folds' models gave the training failures."""
    x = Layers(spark, d)
    resolved = stored(outcome.resolve(x.episodes, x.op, x.cycles), "resolved")
    types = outcome.known_types(resolved)
    train = stored(outcome.scrap_features(resolved.where("in_cohort AND is_labeled"), types), "scrap")
    key = [F.xxhash64("onset_journey_id"), F.col("onset_journey_id")]
    votes = stored(ml.out_of_fold(ml.folds(train, "is_scrap", key)), "votes")
    curve = ml.fit_platt(votes, "scrap_raw", "is_scrap")
    cuts = ml.capacity_cutoffs(ml.platt(votes, curve, "scrap_raw", "p"), "p", "onset_us", DEFAULT.scrap_per_month)
    now = outcome.scrap_features(outcome.current_state(x.op, x.cycles), types)
    live = ml.platt(ml.score_scrap(ml.fit_scrap(train), now), curve, "scrap_raw", "scrap_probability")
    p = F.col("scrap_probability")
    level = F.when(p >= F.col("high"), "HIGH").when(p >= F.col("medium"), "MEDIUM").otherwise("LOW")
    return live.crossJoin(F.broadcast(cuts)).select("item", "type_category", "scrap_raw", "scrap_probability", level.alias("scrap_level"))  # one row


@query("scrap_promotion")
def _(spark, d):
    """May models trained on four fifths of the failures in time replace saved ones trained on two fifths? Both score the last fifth, the saved ones with their own known types."""
    x = Layers(spark, d)
    resolved = stored(outcome.resolve(x.episodes, x.op, x.cycles).where("in_cohort AND is_labeled"), "resolved")
    early, late = order.quantiles(resolved, "onset_us", [0.4, 0.8]).first()["q"]
    folder = f"{shared_dir(spark)}/scrap-{uuid.uuid4().hex}"

    def trained(until):
        past = resolved.where(F.col("onset_us") < until)
        types = outcome.known_types(past)
        return ml.fit_scrap(stored(outcome.scrap_features(past, types), "scrap")), types

    (linear, forest), types = trained(early)
    saved.save_models(folder, {"linear": linear, "forest": forest}, types.agg(F.sort_array(F.collect_set("item_type")).alias("known")))
    held, frozen = saved.load_models(spark, folder, ["linear", "forest"], StructType.fromDDL("known array<string>"))
    candidate, newer = trained(late)
    test = resolved.where(F.col("onset_us") >= late)
    days = test.agg(X.days(F.min("onset_us"), F.max("onset_us"))).first()[0] or 0.0
    found = {}
    for name, models, known in (("candidate", candidate, newer), ("incumbent", (held["linear"], held["forest"]), frozen.select(F.explode("known").alias("item_type")))):
        scored = stored(ml.score_scrap(models, outcome.scrap_features(test, known)), "scored")
        found[name] = ml.measured(scored, "onset_journey_id", days, DEFAULT.scrap_per_month, "scrap_raw", "is_scrap")
    values = {f"{name}_{k}": v for name, m in found.items() for k, v in m.items()}
    row = test.agg(F.count("*").alias("test_rows"))
    return row.select("test_rows", *[F.lit(v).cast("double").alias(k) for k, v in values.items()], F.lit(ml.promoted(found["candidate"], found["incumbent"])).alias("promoted"))


@query("rolling_origin")
def _(spark, d):
    """Scrap candidates on two later parts of the failures, each trained on what was known at its cut-off."""
    x = Layers(spark, d)
    resolved = stored(outcome.resolve(x.episodes, x.op, x.cycles), "resolved")
    cuts = order.quantiles(resolved.where("in_cohort AND is_labeled"), "onset_us", [0.5, 0.75, 1.0]).first()["q"]
    return ml.rolling_origin(resolved, [int(c) for c in cuts if c is not None])


@query("train_survival")
def _(spark, d):
    """Median, and times to survival of 0.9, 0.85 and 0.75, of each test landmark's curve."""
    x = Layers(spark, d)
    life = stored(observe.landmarks(observe.lifecycle_outcome(x.cycles), x.op), "landmarks")
    edges = [0, 30, 60, 90, 120, 180, 365, 730]
    rows = life.select("cycle_id", "split", "age", F.col("residual_days").alias("duration_days"), "event")
    # a row says no more than its age, interval and end: equal ones are counted, and a curve is made once for each age
    periods = survival.person_period(rows.where("split = 'TRAIN'"), edges).groupBy("age", "interval", "y").agg(F.count("*").cast("double").alias("weight"))
    model = ml.fit_hazard(stored(periods, "periods"), ["age"], "weight")
    test = stored(rows.where("split = 'TEST'").select("cycle_id", "age"), "test")
    ahead = test.select("age").distinct().select("age", F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(float(b)).alias("t")) for i, b in enumerate(edges[1:])])).alias("e")).select("age", "e.*")
    hazards = ml.probability(model.transform(ahead), "hazard")
    curves = survival.chained(hazards, "age", "interval").select("age", "t", (1 - F.col("risk")).alias("s"))
    times = curves.groupBy(F.col("age").alias("_age")).agg(*[F.min(F.when(F.col("s") <= v, F.col("t"))).alias(n) for n, v in (("median", 0.5), ("s90", 0.9), ("medium", 0.85), ("high", 0.75))])
    met = test.join(looked_up(times, "times"), F.col("age") == F.col("_age"))
    return met.select(F.concat_ws("@", "cycle_id", "age").alias("item"), "median", "s90", "medium", "high")
