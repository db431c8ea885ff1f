"""Evaluation metrics as aggregations; ties are treated exactly and nothing is collected. Without rows of a class that a metric needs it is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from . import order


def _by_score(rows: DataFrame, score: str, target: str) -> DataFrame:
    """Distinct scores with positives and negatives: the windows run over these."""
    return rows.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.sum(1 - F.col(target).cast("long")).alias("_n"))


def roc_auc(rows: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    by = order.sums_before(_by_score(rows, score, target), [F.asc("_s")], {"_below": F.col("_n")})
    return by.agg(F.try_divide(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def average_precision(rows: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Step sum over distinct scores, highest first."""
    by = order.sums_before(_by_score(rows, score, target), [F.desc("_s")], {"_tp": F.col("_p"), "_all": F.col("_p") + F.col("_n")})
    tp, every = F.col("_tp") + F.col("_p"), F.col("_all") + F.col("_p") + F.col("_n")
    return by.agg(F.try_divide(F.sum(F.col("_p") * tp / every), F.sum("_p")).alias("average_precision"))


def brier(rows: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(score) - F.col(target).cast("double"), F.lit(2))).alias("brier"))


def capacity_topk(rows: DataFrame, key: str, window_days: float, per_month: float, days_per_month: float = 30.0, score: str = "score", target: str = "target") -> DataFrame:
    """Precision and recall among the k best, k being the team's capacity for the window; ties go to the smaller key."""
    k = max(round(per_month * max(window_days / days_per_month, 1e-9)), 1)
    top = rows.orderBy(F.desc(score), key).limit(k).agg(F.count("*").alias("capacity"), F.sum(F.col(target).cast("long")).alias("hits"))
    every = rows.agg(F.sum(F.col(target).cast("long")).alias("positives"))
    both = top.crossJoin(F.broadcast(every))  # one row each
    return both.select("capacity", F.try_divide("hits", "capacity").alias("precision_at_capacity"), (F.col("hits") / F.greatest("positives", F.lit(1))).alias("recall_at_capacity"))


def confusion(rows: DataFrame, threshold: float, score: str = "score", target: str = "target") -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(target).cast("boolean")
    c = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return c.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "balanced_accuracy": (ratio("tp", "fn") + ratio("tn", "fp")) / 2})


def _placed(rows: DataFrame, time: str, event: str, risk: str) -> tuple[DataFrame, int]:
    """Cells of equal (time, event, risk) with their number of rows and their position in time; bits of the largest position."""
    cells = stored(rows.groupBy(F.col(time).alias("t"), F.col(event).alias("e"), F.col(risk).alias("risk")).agg(F.count("*").cast("double").alias("w")), "cells")
    at, bits = order.positions(cells, F.col("t"), F.col("e"))
    return cells.join(at.select(F.col("t").alias("_t"), F.col("e").alias("_e"), "pos"), (F.col("t") == F.col("_t")) & (F.col("e") == F.col("_e"))).drop("_t", "_e"), bits


def c_index(rows: DataFrame, time: str = "duration_days", event: str = "event", risk: str = "risk") -> DataFrame:
    """Harrell's C on cells of equal (time, event, risk), their pairs counted by sums along the risk."""
    placed, bits = _placed(rows, time, event, risk)
    out = order.concordance(placed.where("e"), placed, bits)
    return out.select(F.try_divide("concordant", "comparable").alias("c_index"), F.col("comparable").cast("long").alias("comparable"))


def brier_at(rows: DataFrame, censor: DataFrame, h: float, time: str = "duration_days", event: str = "event", survival: str = "s") -> DataFrame:
    """IPCW Brier score at h; censor: (t, s) of the censoring distribution."""
    g = censor.select(F.col("t").alias("_gt"), F.col("s").alias("_g"))
    at_h = g.where(F.col("_gt") <= h).agg(F.coalesce(F.min("_g"), F.lit(1.0)).alias("_gh"))
    keyed = rows.join(g, F.col(time) == F.col("_gt"), "left").crossJoin(F.broadcast(at_h))  # one row
    failed = F.col(event) & (F.col(time) <= h)
    loss = F.when(failed & (F.col("_g") > 0), F.pow(F.col(survival), F.lit(2)) / F.col("_g")).when((F.col(time) > h) & (F.col("_gh") > 0), F.pow(1 - F.col(survival), F.lit(2)) / F.col("_gh")).otherwise(0.0)
    return keyed.agg((F.sum(loss) / F.count("*")).alias("brier"))


def uno_c(rows: DataFrame, censor: DataFrame, share: float = 0.99, time: str = "duration_days", event: str = "event", risk: str = "risk") -> DataFrame:
    """Uno's C: Harrell's pairs, each weighted by 1 / G(t)^2 at the earlier failure, which lies before `share` of the longest time."""
    placed, bits = _placed(rows, time, event, risk)
    limit = rows.agg((F.max(time) * share).alias("_tau"))
    g = censor.where("s > 0").select(F.col("t").alias("_gt"), F.col("s").alias("_g"))
    a = placed.where("e").crossJoin(F.broadcast(limit)).where("t < _tau").join(g, F.col("t") == F.col("_gt"))  # one row
    out = order.concordance(a.select("pos", "risk", (F.col("w") / (F.col("_g") * F.col("_g"))).alias("w")), placed, bits)
    return out.select(F.try_divide("concordant", "comparable").alias("uno_c"))


def brier_by_horizon(rows: DataFrame, censor: DataFrame, curve: DataFrame, horizons: tuple[int, ...], time: str = "duration_days", event: str = "event") -> DataFrame:
    """(h, brier): the IPCW Brier score of one survival curve (t, s) at several horizons, in one pass over the rows."""
    spark = rows.sparkSession
    hs = spark.createDataFrame([(float(h),) for h in horizons], "h double")

    def at(steps: DataFrame, name: str) -> DataFrame:
        """The step function's value at each horizon, 1 before its first step."""
        found = hs.join(steps.select(F.col("t").alias("_t"), F.col("s").alias("_s")), F.col("_t") <= F.col("h"), "left")
        return found.groupBy("h").agg(F.coalesce(F.max_by("_s", "_t"), F.lit(1.0)).alias(name))

    table = at(curve, "_sh").join(at(censor, "_gh"), "h")
    g = censor.select(F.col("t").alias("_gt"), F.col("s").alias("_g"))
    keyed = rows.select(F.col(time).alias("_d"), F.col(event).alias("_e")).groupBy("_d", "_e").agg(F.count("*").alias("_n")).join(g, F.col("_d") == F.col("_gt"), "left").crossJoin(F.broadcast(table))  # a row a horizon
    failed = F.col("_e") & (F.col("_d") <= F.col("h"))
    loss = F.when(failed & (F.col("_g") > 0), F.pow(F.col("_sh"), F.lit(2)) / F.col("_g")).when((F.col("_d") > F.col("h")) & (F.col("_gh") > 0), F.pow(1 - F.col("_sh"), F.lit(2)) / F.col("_gh")).otherwise(0.0)
    return keyed.groupBy("h").agg((F.sum(loss * F.col("_n")) / F.sum("_n")).alias("brier"))


def integrated(scores: DataFrame, at: str = "h", value: str = "brier") -> DataFrame:
    """Trapezoids over the horizons (a few rows), divided by their span."""
    return scores.agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("x"), F.col(value).alias("y")))).alias("_p")).select(
        (F.aggregate(F.sequence(F.lit(1), F.size("_p") - 1), F.lit(0.0), lambda a, i: a + (F.get("_p", i)["x"] - F.get("_p", i - 1)["x"]) * (F.get("_p", i)["y"] + F.get("_p", i - 1)["y"]) / 2) / (F.element_at("_p", -1)["x"] - F.element_at("_p", 1)["x"])).alias(f"integrated_{value}")
    )


def dynamic_auc(rows: DataFrame, censor: DataFrame, h: float, time: str = "duration_days", event: str = "event", risk: str = "risk") -> DataFrame:
    """Cumulative/dynamic AUC at h: cases failed by h, weighted 1 / G(t), against controls that outlive it; sums by distinct risk."""
    g = censor.where("s > 0").select(F.col("t").alias("_gt"), F.col("s").alias("_g"))
    keyed = rows.join(g, F.col(time) == F.col("_gt"), "left")
    case = F.col(event) & (F.col(time) <= h) & F.col("_g").isNotNull()
    by = keyed.groupBy(F.col(risk).alias("_r")).agg(F.sum(F.when(case, 1 / F.col("_g")).otherwise(0.0)).alias("_w"), F.count_if(F.col(time) > h).alias("_c"))
    by = order.sums_before(by, [F.asc("_r")], {"_below": F.col("_c")})
    return by.agg((F.sum(F.col("_w") * (F.col("_below") + F.col("_c") / 2)) / (F.sum("_w") * F.sum("_c"))).alias("dynamic_auc"))


def usable_horizons(train: DataFrame, evaluated: DataFrame, horizons: tuple[int, ...], time: str = "duration_days") -> DataFrame:
    """Horizons strictly between the shortest evaluated time and the smaller of both longest times."""
    hs = train.sparkSession.createDataFrame([(float(h),) for h in horizons], "h double")
    span = evaluated.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).crossJoin(F.broadcast(train.agg(F.max(time).alias("_tr"))))  # one row each
    return hs.crossJoin(F.broadcast(span)).where((F.col("h") > F.col("_lo")) & (F.col("h") < F.least("_hi", "_tr"))).select("h")


def bootstrap_ci(rows: DataFrame, key: str, draws: int = 200, seed: int = 42, time: str = "duration_days", event: str = "event", risk: str = "risk") -> DataFrame:
    """95 % interval of Harrell's C by Poisson weights from a seeded hash of (key, draw): the same at any partitioning. Each draw works on cells, as c_index does."""
    u = (F.pmod(F.xxhash64(key, "draw", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    limits, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        limits.append(total)
        p /= k + 1
    weight = sum(((u > x).cast("int") for x in limits[1:]), (u > limits[0]).cast("int"))
    many = rows.select(key, F.col(time).alias("t"), F.col(event).alias("e"), F.col(risk).alias("risk"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight)
    cells = many.where("w > 0").groupBy("draw", "t", "e", "risk").agg(F.sum("w").cast("double").alias("w"))
    at, bits = order.positions(rows, F.col(time), F.col(event))
    placed = stored(cells.join(at.select(F.col("t").alias("_t"), F.col("e").alias("_e"), "pos"), (F.col("t") == F.col("_t")) & (F.col("e") == F.col("_e"))).drop("_t", "_e"), "draws")
    c = order.concordance(placed.where("e"), placed, bits, ["draw"]).select(F.try_divide("concordant", "comparable").alias("c"))
    return c.agg(F.percentile("c", F.lit(0.025)).alias("low"), F.percentile("c", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))


def reliability(rows: DataFrame, key: str, buckets: int = 5, score: str = "score", target: str = "target") -> DataFrame:
    """Mean score and observed share by bucket of the score's quantiles; equal scores stay together, so no row order matters."""
    cuts = order.quantiles(rows, score, [i / buckets for i in range(1, buckets)]).select(F.col("q").alias("_cuts"))
    b = F.size(F.filter("_cuts", lambda c: F.col(score) > c)) + 1
    return rows.crossJoin(F.broadcast(cuts)).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(target).cast("double")).alias("observed"))  # one row


def median_error(rows: DataFrame, median: str = "median", actual: str = "actual") -> DataFrame:
    d = F.col(median) - F.col(actual)
    return rows.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg((d > 0).cast("double")).alias("over_share"), F.avg(F.col(median).isNull().cast("double")).alias("null_share"))
