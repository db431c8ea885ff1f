"""Survival models held against a classifier's rows, and on all landmarks against those at installation alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.tables import stored
from . import metrics, order, survival


def kaplan_meier_by(rows: DataFrame, by: str, time: str = "duration_days", event: str = "event") -> DataFrame:
    """(by, t, s): a Kaplan-Meier curve of each group. Windows run over distinct durations, which are whole days, however many rows a group has."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by, F.col(time).alias("t")).agg(F.count("*").alias("n"), F.count_if(event).alias("hits"))
    later, before = (Window.partitionBy(by).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.desc("t"), F.asc("t")))
    share = F.col("hits") / F.col("at_risk")
    counts = counts.withColumn("at_risk", F.sum("n").over(later))
    logs = F.sum(F.when(share < 1, F.log1p(-share)).otherwise(0.0)).over(before)
    return counts.select(by, "t", F.when(F.max(share).over(before) >= 1, 0.0).otherwise(F.exp(logs)).alias("s"))


def conditioned_rows(rows: DataFrame, curves: DataFrame, curve: str, ages: str, days: float, risk: str = "risk") -> DataFrame:
    """rows that have a curve, with the probability of failing within `days` of the age that they have reached.

    curves: (curve, t, s), one for a lifecycle or one that many rows share. A curve is 1 up to its first time and flat beyond its
    last. What is looked up lies along the order of (curve, time), so neither a curve's rows nor the curves meet in one task; a row
    whose curve or age is null has no risk and goes. Risks are rounded to nine places, so that equal ones tie however they were summed.
    """
    own = Window.partitionBy("_c").orderBy("_t")  # a curve's points
    points = curves.select(F.col(curve).alias("_c"), F.col("t").cast("double").alias("_t"), F.col("s").cast("double").alias("_s")).where("_c IS NOT NULL")
    points = points.withColumn("_at", F.struct("_c", "_t", "_s", (F.row_number().over(own) == 1).alias("first"))).select("_c", "_t", F.lit(0).alias("_kind"), "_at")
    asked = rows.where(F.col(curve).isNotNull() & F.col(ages).isNotNull()).select(F.col(curve).alias("_c"), F.col(ages).cast("double").alias("_age")).distinct()
    ends = asked.withColumn("_kind", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_t", F.col("_age") + F.when(F.col("_kind") == 2, F.lit(float(days))).otherwise(0.0))
    seen = order.last_known(points.unionByName(ends, allowMissingColumns=True), ["_c", "_t", "_kind", "_age"], "_at", "_last").where("_kind > 0")
    last = F.when(F.col("_last._c") == F.col("_c"), F.col("_last"))
    early = last.isNull() | (F.col("_t") <= 0) | (last["first"] & (last["_t"] == F.col("_t")))
    value = F.when(early, 1.0).otherwise(last["_s"])
    at = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_v")))
    found = seen.withColumn("_v", value).groupBy("_c", "_age").agg(at(1).alias("_now"), at(2).alias("_then"))
    found = found.join(points.select("_c").distinct(), "_c", "left_semi").withColumn(risk, F.round(survival.conditional_risk(F.col("_now"), F.col("_then")), 9))
    return rows.join(found.select("_c", "_age", risk), (F.col(curve) == F.col("_c")) & (F.col(ages).cast("double") == F.col("_age"))).drop("_c", "_age")


def compared(rows: DataFrame, scores: list[str], key: str, window_days: float, cfg: Config = DEFAULT, target: str = "target") -> DataFrame:
    """A row for each score column, over the same rows: ranking, loss, and what the team's capacity would find (model, rows, roc_auc, average_precision, brier, ...)."""
    rows = stored(rows.select(key, target, *scores), "compared")
    one = []
    for s in scores:
        parts = [metrics.roc_auc(rows, s, target), metrics.average_precision(rows, s, target), metrics.brier(rows, s, target), metrics.capacity_topk(rows, key, window_days, cfg.capacity_per_month, cfg.days_per_month, s, target)]
        base = rows.agg(F.lit(s).alias("model"), F.count("*").alias("rows"))
        one.append(reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, base))  # one row each
    return reduce(DataFrame.unionByName, one)


def native(rows: DataFrame, by: list[str], censor: DataFrame, horizons: tuple[int, ...], time: str = "residual_days", event: str = "event") -> DataFrame:
    """A row of survival metrics for each group of landmark rows (by, time, event, s_<h> for each horizon): rows, events, Harrell's and Uno's C of
    the risk at the first horizon, its dynamic AUC, the Brier score at each horizon and their mean over the horizons' span (null for one horizon).

    censor: censoring curve (t, s) of the training rows. All groups share each pass; pairs are counted as in `metrics`, by sums along the risk.
    """
    first, last = horizons[0], horizons[-1]
    rows = stored(rows.select(*by, F.col(time).alias("t"), F.col(event).alias("e"), *[f"s_{h}" for h in horizons], (1 - F.col(f"s_{first}")).alias("risk")), "native")
    cells = rows.groupBy(*by, "t", "e", "risk").agg(F.count("*").cast("double").alias("w"))
    at, bits = order.positions(rows, F.col("t"), F.col("e"))
    placed = stored(cells.join(at.select(F.col("t").alias("_t"), F.col("e").alias("_e"), "pos"), (F.col("t") == F.col("_t")) & (F.col("e") == F.col("_e"))).drop("_t", "_e"), "placed")
    share = lambda pairs, name: pairs.select(*by, F.try_divide("concordant", "comparable").alias(name))
    harrell = share(order.concordance(placed.where("e"), placed, bits, by), "c_index")
    g = censor.select(F.col("t").alias("_gt"), F.col("s").alias("_g"))
    limit = rows.groupBy(*by).agg((F.max("t") * 0.99).alias("_tau"))
    early = placed.where("e").join(F.broadcast(limit), by).where("t < _tau").join(g.where("_g > 0"), F.col("t") == F.col("_gt"))  # a row a group
    uno = share(order.concordance(early.select(*by, "pos", "risk", (F.col("w") / (F.col("_g") * F.col("_g"))).alias("w")), placed, bits, by), "uno_c")
    ends = censor.agg(*[F.coalesce(F.min(F.when(F.col("t") <= h, F.col("s"))), F.lit(1.0)).alias(f"_g{h}") for h in horizons])
    keyed = stored(rows.join(g, F.col("t") == F.col("_gt"), "left").crossJoin(F.broadcast(ends)), "keyed")  # one row
    square = lambda x: F.pow(x, F.lit(2))

    def loss(h: int):
        gone = F.when(F.col("e") & (F.col("t") <= h) & (F.col("_g") > 0), square(F.col(f"s_{h}")) / F.col("_g"))
        return gone.when((F.col("t") > h) & (F.col(f"_g{h}") > 0), square(1 - F.col(f"s_{h}")) / F.col(f"_g{h}")).otherwise(0.0)

    sums = keyed.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("e").alias("events"), *[(F.sum(loss(h)) / F.count("*")).alias(f"brier_{h}") for h in horizons])
    area = sum(((b - a) * (F.col(f"brier_{a}") + F.col(f"brier_{b}")) / 2 for a, b in zip(horizons, horizons[1:], strict=False)), F.lit(0.0))
    sums = sums.withColumn("integrated_brier", F.try_divide(area, F.lit(float(last - first))))
    case = F.col("e") & (F.col("t") <= first) & (F.col("_g") > 0)
    risks = keyed.groupBy(*by, "risk").agg(F.sum(F.when(case, 1 / F.col("_g")).otherwise(0.0)).alias("_w"), F.count_if(F.col("t") > first).alias("_n"))
    along = order.sums_before(risks, [F.col(c) for c in (*by, "risk")], {"_below": F.col("_n")})
    auc = along.groupBy(*by).agg(F.try_divide(F.sum(F.col("_w") * (F.col("_below") + F.col("_n") / 2)) - F.min("_below") * F.sum("_w"), F.sum("_w") * F.sum("_n")).alias("dynamic_auc"))
    return reduce(lambda a, b: a.join(F.broadcast(b), by, "left"), (harrell, uno, auc), sums)  # a row a group


def populations(rows: DataFrame, censor: DataFrame, horizons: tuple[int, ...], time: str = "residual_days", event: str = "event") -> DataFrame:
    """`native` of each split, on all landmarks and on those at installation alone (population ALL, INSTALL)."""
    names = F.when(F.col("source") == "INSTALL", F.array(F.lit("ALL"), F.lit("INSTALL"))).otherwise(F.array(F.lit("ALL")))
    return native(rows.withColumn("population", F.explode(names)), ["split", "population"], censor, horizons, time, event)
