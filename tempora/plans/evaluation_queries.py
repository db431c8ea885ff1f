"""Queries that hold survival curves against a classifier's test rows, and all landmarks against those at installation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import expr as X
from ..functions.tables import stored
from ..operators import cox, evaluate, observe, survival
from .feature_queries import GRID, LIFE, MARKS, SPLIT, D, Layers
from .oracle import sql
from .registry import query
from .survival_queries import Marks, hazards, landmark_rows

#: Curves of item types on the training lifecycles, and what the classifier's training rows say of a model.
TYPE_CURVE = {
    "km0": "SELECT item_type AS c, duration_days AS t, count(*) AS n, count(*) FILTER (event) AS hits FROM life WHERE usable AND split = 'TRAIN' AND item_type IS NOT NULL GROUP BY ALL",
    "km1": "SELECT *, sum(n) OVER (PARTITION BY c ORDER BY t DESC) AS at_risk FROM km0",
    "km2": "SELECT c, t, CASE WHEN max(hits / at_risk) OVER w >= 1 THEN 0.0 ELSE exp(sum(CASE WHEN hits < at_risk THEN ln(1 - hits / at_risk) ELSE 0.0 END) OVER w) END AS s, row_number() OVER w AS r FROM km1 WINDOW w AS (PARTITION BY c ORDER BY t)",
}


def value_at(table: str, age: str) -> str:
    """The curve's value at an age: 1 up to its first time."""
    return f"coalesce((SELECT CASE WHEN k.r = 1 AND k.t = {age} OR {age} <= 0 THEN 1.0 ELSE k.s END FROM km2 k WHERE k.c = {table}.item_type AND k.t <= {age} ORDER BY k.t DESC LIMIT 1), 1.0)"


RISK = "round(CASE WHEN now <= 1e-9 THEN 1.0 ELSE least(greatest(1 - later / now, 0.0), 1.0) END, 9)"
BORROWED = GRID | LIFE | TYPE_CURVE | {
    "split": f"SELECT *, {SPLIT} AS part FROM grid WHERE eligible",
    "rate": "SELECT model, avg(target::INT) AS p FROM split WHERE part = 'TRAIN' AND model IS NOT NULL GROUP BY model",
    "test0": "SELECT cycle_id || '@' || CAST(at_us AS VARCHAR) AS k, cycle_id, at_us, age_days, item_type, s.model, target::INT AS target, coalesce(rate.p, (SELECT avg(target::INT) FROM split WHERE part = 'TRAIN'), 0.0) AS classifier FROM split s LEFT JOIN rate ON rate.model = s.model WHERE part = 'TEST' AND item_type IN (SELECT c FROM km2)",
    "test1": f"SELECT *, {value_at('z', 'z.age_days')} AS now, {value_at('z', '(z.age_days + 30)')} AS later FROM test0 z",
    "test": f"SELECT *, {RISK} AS survival FROM test1",
}


def borrowed(x: Layers):
    """Eligible test rows of the classifier with both scores: their item type's curve from the age reached on, and the failure share of their model in training."""
    obs = stored(observe.with_split(x.grid).where("eligible").select("cycle_id", "at_us", "age_days", "item_type", "model", "split", F.col("target").cast("int").alias("target")), "grid")
    train = obs.where("split = 'TRAIN'")
    rate = train.where("model IS NOT NULL").groupBy(F.col("model").alias("_m")).agg(F.avg("target").alias("_p"))
    every = train.agg(F.coalesce(F.avg("target"), F.lit(0.0)).alias("_all"))
    test = obs.where("split = 'TEST'").join(rate, F.col("model") == F.col("_m"), "left").crossJoin(F.broadcast(every))  # one row
    test = test.withColumn("classifier", F.coalesce("_p", "_all")).withColumn("k", F.concat_ws("@", "cycle_id", F.col("at_us").cast("string")))
    lives = observe.lifecycle_outcome(x.cycles).where("usable AND split = 'TRAIN'")
    curves = stored(evaluate.kaplan_meier_by(lives, "item_type"), "curves")
    return evaluate.conditioned_rows(test, curves, "item_type", "age_days", float(DEFAULT.horizon_days), "survival")


@query("borrowed_rows", sql("SELECT cycle_id, at_us, target, classifier, survival FROM test", **BORROWED))
def _(spark, d):
    """Both scores of every borrowed row."""
    return borrowed(Layers(spark, d)).select("cycle_id", "at_us", "target", "classifier", "survival")


def _metrics(score: str) -> str:
    by = f"(SELECT {score} AS s, CAST(sum(target) AS DOUBLE) AS p, CAST(sum(1 - target) AS DOUBLE) AS n FROM test GROUP BY {score})"
    return f"""SELECT '{score}' AS model, (SELECT count(*) FROM test) AS rows,
        (SELECT sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {by})) AS roc_auc,
        (SELECT sum(p * tp / every) / nullif(sum(p), 0) FROM (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS every FROM {by})) AS average_precision,
        (SELECT avg(({score} - target) * ({score} - target)) FROM test) AS brier, count(*) AS capacity, sum(target) / nullif(count(*), 0) AS precision_at_capacity, sum(target) / greatest((SELECT sum(target) FROM test), 1) AS recall_at_capacity
        FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, k) AS place FROM test) WHERE place <= (SELECT greatest(round_even(200 * greatest(floor((max(at_us) - min(at_us)) / {D}) / 30, 1e-9), 0), 1) FROM test)"""


@query("borrowed_metrics", sql(f"{_metrics('survival')} UNION ALL {_metrics('classifier')}", held=True, **BORROWED))
def _(spark, d):
    """Both models in one table of metrics, over the same rows."""
    rows = stored(borrowed(Layers(spark, d)), "borrowed")
    days = rows.agg(F.floor(X.days(F.min("at_us"), F.max("at_us")))).first()[0] or 0
    return evaluate.compared(rows, ["survival", "classifier"], "k", float(days))


def _marked(x: Layers):
    """Landmarks with the type's curve from their age on, at 30 and 90 days, and the censoring curve of the training ones."""
    marks = stored(observe.landmarks(observe.lifecycle_outcome(x.cycles), x.op), "landmark")
    types = x.cycles.select(F.col("cycle_id").alias("_id"), "item_type")
    rows = marks.join(types, F.col("cycle_id") == F.col("_id")).drop("_id")
    curves = stored(evaluate.kaplan_meier_by(observe.lifecycle_outcome(x.cycles).where("usable AND split = 'TRAIN'"), "item_type"), "curves")
    for h in (30, 90):
        rows = evaluate.conditioned_rows(rows, curves, "item_type", "age", float(h), "_risk").withColumn(f"s_{h}", 1 - F.col("_risk")).drop("_risk")
    censor = survival.kaplan_meier(marks.where("split = 'TRAIN'"), "residual_days", censoring=True)
    return rows, stored(censor.select("t", "s"), "censor")


_CELLS = "SELECT residual_days AS t, event, 1 - s_30 AS risk, count(*) AS n FROM @ GROUP BY ALL"


def _native(split: str, population: str) -> str:
    of = f"(SELECT * FROM lm WHERE split = '{split}'{' AND source = 0' * (population == 'INSTALL')})"
    cells = _CELLS.replace("@", of)
    brier = lambda h: f"(SELECT sum(CASE WHEN event AND residual_days <= {h} AND g.s > 0 THEN s_{h} * s_{h} / g.s WHEN residual_days > {h} AND gh > 0 THEN (1 - s_{h}) * (1 - s_{h}) / gh ELSE 0 END) / count(*) FROM {of} LEFT JOIN g ON g.t = residual_days, (SELECT coalesce(min(s), 1.0) AS gh FROM g WHERE t <= {h}))"
    pairs = f"FROM ({cells}) a JOIN ({cells}) b ON a.event AND (b.t > a.t OR (b.t = a.t AND NOT b.event))"
    better = "CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END"
    return f"""SELECT '{split}' AS split, '{population}' AS population, count(*) AS rows, count(*) FILTER (event) AS events,
        (SELECT sum(a.n * b.n * {better}) / sum(a.n * b.n) {pairs}) AS c_index,
        (SELECT sum(a.n * b.n / (g.s * g.s) * {better}) / sum(a.n * b.n / (g.s * g.s)) {pairs} JOIN g ON g.t = a.t AND g.s > 0 WHERE a.t < (SELECT max(residual_days) * 0.99 FROM {of})) AS uno_c,
        {brier(30)} AS brier_30, {brier(90)} AS brier_90, ({brier(30)} + {brier(90)}) / 2 AS integrated_brier,
        (SELECT sum(a.n / g.s * b.n * {better}) / sum(a.n / g.s * b.n) FROM ({cells}) a JOIN g ON g.t = a.t AND g.s > 0 JOIN ({cells}) b ON a.event AND a.t <= 30 AND b.t > 30) AS dynamic_auc FROM {of} HAVING count(*) > 0"""


LANDMARKED = MARKS | TYPE_CURVE | {
    "lm0": "SELECT m.cycle_id, l.item_type, l.split, m.age AS age, m.source, l.duration_days - m.age AS residual_days, l.event FROM mark m JOIN life l USING (cycle_id) WHERE m.age < l.duration_days",
    "lm1": f"SELECT *, {value_at('z', 'z.age')} AS now, {value_at('z', '(z.age + 30)')} AS later, {value_at('z', '(z.age + 90)')} AS later_90 FROM lm0 z WHERE item_type IN (SELECT c FROM km2)",
    "lm": f"SELECT *, 1 - {RISK} AS s_30, 1 - {RISK.replace('later', 'later_90')} AS s_90 FROM lm1",
    "g0": "SELECT residual_days AS t, count(*) FILTER (NOT event) AS hits, sum(count(*)) OVER (ORDER BY residual_days DESC) AS at_risk FROM lm0 WHERE split = 'TRAIN' GROUP BY residual_days",
    "g": "SELECT t, exp(sum(ln(CASE WHEN hits < at_risk THEN 1 - hits / at_risk ELSE 1 END)) OVER (ORDER BY t)) * CASE WHEN max(hits / at_risk) OVER (ORDER BY t) >= 1 THEN 0 ELSE 1 END AS s FROM g0",
}


@query("landmark_populations", sql(" UNION ALL ".join(_native(s, p) for s in ("TRAIN", "VALIDATION", "TEST") for p in ("ALL", "INSTALL")), held=True, **LANDMARKED))
def _(spark, d):
    """Survival metrics of the type's curve by split, on all landmarks and at installation alone."""
    rows, censor = _marked(Layers(spark, d))
    return evaluate.populations(rows, censor, (30, 90)).select("split", "population", "rows", "events", "c_index", "uno_c", "brier_30", "brier_90", "integrated_brier", "dynamic_auc")


@query("operational_eval")
def _(spark, d):
    """Proportional hazards on the 34 columns, one curve a lifecycle from its installation, against the classifier's test rows; beside it the type's curve and the model's failure share."""
    x = Marks(spark, d)
    rows = landmark_rows(x)
    model = hazards(x, rows.where("split = 'TRAIN'"))
    test = borrowed(x).withColumnRenamed("survival", "type_curve")
    ratio = model.ratios(rows.where("age = 0")).select(F.col("cycle_id").alias("_c"), "r")
    met = test.where("age_days IS NOT NULL").join(ratio, F.col("cycle_id") == F.col("_c")).drop("_c")
    met = stored(met.withColumn("hazards", cox.within(model.hazards, F.col("r"), F.col("age_days"), float(DEFAULT.horizon_days))), "borrowed")
    days = met.agg(F.floor(X.days(F.min("at_us"), F.max("at_us")))).first()[0] or 0
    return evaluate.compared(met, ["hazards", "type_curve", "classifier"], "k", float(days))
