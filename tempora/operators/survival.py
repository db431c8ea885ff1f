"""Curves in long form (item, t, s): look-ups, thresholds, calibration, Kaplan-Meier, discrete-time hazards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import definite
from ..functions.tables import stored
from . import order

GONE = 1e-9
#: Calibration tables: knots of each horizon.
KNOTS = "h int, x double, y double"


def step_lookup(curves: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (item, q) with s: the value at the last grid time <= q; 1 at or before the first one; flat beyond the last."""
    w = Window.partitionBy("item").orderBy("t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("item")
    both = curves.select("item", "t", "s", F.lit(0).alias("_p")).unionByName(asked.select("item", F.col("q").alias("t"), F.lit(1).alias("_p")), allowMissingColumns=True)
    out = both.withColumn("_s", F.last("s", ignorenulls=True).over(w)).withColumn("_t0", F.min(F.when(F.col("_p") == 0, F.col("t"))).over(first))
    return out.where("_p = 1").select("item", F.col("t").alias("q"), F.when(F.col("t") <= F.greatest("_t0", F.lit(0.0)), 1.0).otherwise(F.col("_s")).alias("s")).distinct()


def conditional_risk(now: Column, later: Column) -> Column:
    """Failure until later, given survival until now; certain where nothing survives."""
    return F.when(now <= GONE, 1.0).otherwise(F.least(F.greatest(1 - later / now, F.lit(0.0)), F.lit(1.0)))


def time_at_threshold(curves: DataFrame, threshold: float) -> DataFrame:
    """First grid time with s at or below the threshold, else null."""
    return curves.groupBy("item").agg(F.min(F.when(F.col("s") <= threshold, F.col("t"))).alias("t"))


def monotone(risks: DataFrame, key: str = "item", at: str = "h", value: str = "risk") -> DataFrame:
    """Risk never falls with the horizon."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return risks.withColumn(value, F.max(value).over(w))


def chained(hazards: DataFrame, key: str = "item", step: str = "step", hazard: str = "hazard") -> DataFrame:
    """Risk by each step from the hazards up to it; one hazard of 1 makes it certain."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col(hazard) < 1, F.log1p(-F.col(hazard))).otherwise(0.0)).over(w)
    return hazards.withColumn("risk", F.when(F.max(hazard).over(w) >= 1, 1.0).otherwise(1 - F.exp(logs)))


def sampled(curves: DataFrame, step: int = 30, limit: int = 1080) -> DataFrame:
    """The curve every `step` days up to the smaller of its end and the limit."""
    ends = curves.groupBy("item").agg(F.least(F.max("t"), F.lit(float(limit))).alias("_end"))
    asked = ends.select("item", F.explode(F.sequence(F.lit(0), F.floor("_end").cast("int"), F.lit(step))).alias("q")).withColumn("q", F.col("q").cast("double"))
    return step_lookup(curves, asked)


def through_knots(asked: DataFrame, knots: DataFrame) -> DataFrame:
    """Distinct (h, x, y): each asked (h, x) on the broken line through its table's knots (h, x, y), flat outside.

    A sorted range look-up: neither a plan nor a task grows with the number of knots. A table without knots gives y = x, a null x a null y.
    """
    w = Window.partitionBy("h").orderBy("x")  # a table's knots: as many as its fit keeps
    edges = knots.select("h", F.col("x").cast("double").alias("x"), F.lit(0).alias("_kind"), F.struct("h", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).alias("_at"))
    probes = asked.where("x IS NOT NULL").select("h", F.col("x").cast("double").alias("x")).distinct().withColumn("_kind", F.lit(1))
    seen = order.last_known(edges.unionByName(probes, allowMissingColumns=True), ["h", "x", "_kind"], "_at", "_last").where("_kind = 1")
    first = knots.groupBy(F.col("h").alias("_fh")).agg(F.min_by("y", "x").alias("_first"))
    last = F.when(F.col("_last.h") == F.col("h"), F.col("_last"))
    inside = last["y"] + (F.col("x") - last["x"]) * ((last["y1"] - last["y"]) / (last["x1"] - last["x"]))
    y = F.when(last.isNull(), F.coalesce("_first", "x")).when(last["x1"].isNull(), last["y"]).otherwise(inside)
    return seen.join(F.broadcast(first), F.col("h") == F.col("_fh"), "left").select("h", "x", y.alias("y"))  # a row a table


def calibrated(curves: DataFrame, knots: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Risk 1 - s through the table of each horizon, blended linearly between neighbouring horizons, flat outside, never falling.

    curves: (item, t, s, ...); knots: (h, x, y), a table for each of the horizons.
    """
    hs = sorted(horizons)
    lo, hi, part = F.lit(hs[0]), F.lit(hs[0]), F.lit(0.0)
    for a, b in zip(hs, hs[1:], strict=False):
        inside = F.col("t") > a
        lo, hi, part = F.when(inside, a).otherwise(lo), F.when(inside, b).otherwise(hi), F.when(inside, (F.col("t") - a) / (b - a)).otherwise(part)
    rows = curves.withColumns({"_x": 1 - F.col("s"), "_lo": F.when(F.col("t") > hs[-1], hs[-1]).otherwise(lo), "_hi": F.when(F.col("t") > hs[-1], hs[-1]).otherwise(hi), "_part": F.when(F.col("t") > hs[-1], 0.0).otherwise(part)})
    asked = rows.select(F.explode(F.array("_lo", "_hi")).alias("h"), F.col("_x").alias("x"))
    found = stored(through_knots(asked, knots), "calibration")
    for side in ("_lo", "_hi"):
        of = found.select(F.col("h").alias("_h"), F.col("x").alias("_fx"), F.col("y").alias(f"_y{side}"))
        rows = rows.join(of, (F.col(side) == F.col("_h")) & (F.col("_x") == F.col("_fx")), "left").drop("_h", "_fx")
    rows = rows.withColumn("risk", F.col("_y_lo") * (1 - F.col("_part")) + F.col("_y_hi") * F.col("_part"))
    return monotone(rows, "item", "t").withColumn("s", 1 - F.col("risk")).drop("risk", "_x", "_lo", "_hi", "_part", "_y_lo", "_y_hi")


def kaplan_meier(rows: DataFrame, time: str = "duration_days", event: str = "event", censoring: bool = False) -> DataFrame:
    """(t, at_risk, events, s) at each distinct time; with `censoring`, of the censoring times instead.

    Grouped to distinct times first; what is known along those comes from sums over sorted ranges.
    """
    hit = ~F.col(event) if censoring else F.col(event)
    by = rows.groupBy(F.col(time).alias("t")).agg(F.count("*").alias("n"), F.count_if(hit).alias("events"))
    by = order.sums_before(by, [F.desc("t")], {"_later": F.col("n")}).withColumn("at_risk", F.col("_later") + F.col("n"))
    share = F.col("events") / F.col("at_risk")
    logs, gone = F.when(share < 1, F.log1p(-share)).otherwise(0.0), (share >= 1).cast("int")
    by = order.sums_before(by, [F.asc("t")], {"_logs": logs, "_gone": gone})
    s = F.when(F.col("_gone") + gone > 0, 0.0).otherwise(F.exp(F.col("_logs") + logs))
    return by.select("t", "at_risk", "events", s.alias("s"))


def person_period(rows: DataFrame, edges: list[int]) -> DataFrame:
    """A row for each interval that a lifecycle enters, with y: did it end by failure in it. Fits a discrete-time hazard."""
    spans = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    out = rows.withColumn("_i", F.explode(spans)).where(F.col("duration_days") > F.col("_i.lo"))
    y = (F.col("event") & (F.col("duration_days") <= F.col("_i.hi"))).cast("int")
    # an interval in which a lifecycle was censored says nothing
    out = out.where(F.col("event") | (F.col("duration_days") >= F.col("_i.hi")))
    return out.select("*", F.col("_i.interval").alias("interval"), F.col("_i.hi").alias("t"), y.alias("y")).drop("_i")


def outcomes_at(curves: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(h, risk, y) of curves (t, s, duration, event): the raw risk at each horizon and what is known to have happened by then; unknown ones go."""
    rows = curves.where(F.col("t").isin(*map(float, horizons)))
    return rows.select(F.col("t").cast("int").alias("h"), (1 - F.col("s")).alias("risk"), definite(F.col("duration"), F.col("event"), F.col("t")).alias("y")).where("y IS NOT NULL")


def conditioned(curves: DataFrame, ages: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(item, age, h, risk): failure within h days of an age that a curve's item has reached (ages: item, age)."""
    asked = ages.select("item", F.col("age").cast("double").alias("age")).distinct().withColumn("h", F.explode(F.array(F.lit(0), *map(F.lit, horizons))))
    points = asked.withColumn("q", F.col("age") + F.col("h"))
    found = step_lookup(curves, points.select("item", "q").distinct()).select(F.col("item").alias("_i"), F.col("q").alias("_q"), "s")
    met = points.join(found, (F.col("item") == F.col("_i")) & (F.col("q") == F.col("_q")))
    start = F.max(F.when(F.col("h") == 0, F.col("s"))).over(Window.partitionBy("item", "age"))
    return met.withColumn("risk", conditional_risk(start, F.col("s"))).where("h > 0").select("item", "age", "h", "risk")


THRESHOLDS = {"median": 0.5, "s90": 0.9, "medium": 0.85, "high": 0.75}


def detail(curves: DataFrame, horizons: tuple[int, ...], step: int = 30, limit: int = 1080) -> DataFrame:
    """A row for each item of curves (item, t, s, raw): raw and calibrated risk at each horizon, the times at which the
    calibrated curve comes down to each threshold (null where it does not), and the curve every `step` days.

    A curve has as many points as the model's grid, so an item's points fit in a row.
    """
    points = curves.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("t", "s", "raw"))).alias("c"))
    at = lambda q, v: F.coalesce(F.try_element_at(F.filter("c", lambda p: p["t"] <= q), F.lit(-1))[v], F.lit(1.0))
    first = lambda v: F.try_element_at(F.filter("c", lambda p: p["s"] <= v), F.lit(1))["t"]
    days = F.sequence(F.lit(0), F.least(F.element_at("c", -1)["t"], F.lit(float(limit))).cast("int"), F.lit(step))
    sampled_ = F.transform(days, lambda q: F.struct(q.alias("t"), at(q, "s").alias("s")))
    risks = {f"{name}_{h}": F.round(1 - at(F.lit(h), v), 6) for h in horizons for name, v in (("raw", "raw"), ("risk", "s"))}
    return points.select("item", *[c.alias(n) for n, c in risks.items()], *[first(v).alias(n) for n, v in THRESHOLDS.items()], sampled_.alias("curve"))


#: Knots of calibration tables that a task holds.
HELD_KNOTS = 1_000_000


def held(knots: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """Each table's knots (x, y) by rising x, or none where all are too many to hold."""
    if knots.count() > HELD_KNOTS:
        return None
    of = knots.select("h", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).toArrow()
    h, x, y = (of.column(c).to_numpy() for c in "hxy")
    order = np.lexsort((x, h))
    return {int(k): (x[order][h[order] == k], y[order][h[order] == k]) for k in np.unique(h)}


def on_line(x: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """through_knots for values that are held."""
    if table is None:
        return x
    xs, ys = table
    at = np.searchsorted(xs, x, side="right") - 1
    low = np.clip(at, 0, max(len(xs) - 2, 0))
    slope = np.append(np.diff(ys) / np.diff(xs), 0.0)[low]
    return np.where(at < 0, ys[0], np.where(at >= len(xs) - 1, ys[-1], ys[low] + (x - xs[low]) * slope))


def detail_by_row(rows: DataFrame, times: tuple[float, ...], hazard: tuple[float, ...], knots: dict[int, tuple[np.ndarray, np.ndarray]], horizons: tuple[int, ...], step: int = 30, limit: int = 1080) -> DataFrame:
    """`detail` of the calibrated curves exp(-hazard r) of rows (item, r), one row an item: a curve is made, calibrated and read within its own row."""
    t, base, hs = np.array(times), np.array(hazard), sorted(horizons)
    at = np.clip(np.searchsorted(hs, t, side="left") - 1, 0, max(len(hs) - 2, 0))
    beyond = np.minimum(at + 1, len(hs) - 1)
    lo, hi = np.array(hs)[at], np.array(hs)[beyond]
    part = np.clip((t - lo) / np.maximum(hi - lo, 1), 0.0, 1.0)
    last = lambda q: np.searchsorted(t, q, side="right")  # noqa: E731, the place after the last time up to q
    days = np.arange(0, int(min(t[-1], limit)) + 1, step)
    names = [f"{n}_{h}" for h in horizons for n in ("raw", "risk")]
    schema = f"item string, {', '.join(f'{n} double' for n in [*names, *THRESHOLDS])}, curve array<struct<t: int, s: double>>"

    def run(batches):
        for b in batches:
            r = b.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(r), 4096):
                raw = np.exp(-base[None, :] * r[k : k + 4096, None])
                n, y = len(raw), {h: on_line(1 - raw, knots.get(h)) for h in hs}
                risk = np.empty_like(raw)
                for j in range(len(t)):
                    risk[:, j] = y[lo[j]][:, j] * (1 - part[j]) + y[hi[j]][:, j] * part[j]
                s = 1 - np.maximum.accumulate(risk, axis=1)
                # a place before the first time has survival 1
                raw1, s1 = (np.hstack([np.ones((n, 1)), v]) for v in (raw, s))
                found = [pa.array(1 - v[:, last(h)]) for h in horizons for v in (raw1, s1)]
                for v in THRESHOLDS.values():
                    below = s <= v
                    found.append(pa.array(t[below.argmax(axis=1)], mask=~below.any(axis=1)))
                points = pa.StructArray.from_arrays([pa.array(np.tile(days, n).astype(np.int32)), pa.array(s1[:, last(days)].ravel())], ["t", "s"])
                curve = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(days)), points)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 4096), *found, curve], ["item", *names, *THRESHOLDS, "curve"])

    return rows.select("item", "r").mapInArrow(run, schema).withColumns({n: F.round(n, 6) for n in names})


def day_calibration(curves: DataFrame, lives: DataFrame, days: list[int]) -> DataFrame:
    """(day, known, predicted, alive): mean predicted survival of the lives whose state at a day is known, and the share of them alive then.

    lives: (item, duration, event), of items with a curve. One that was censored before a day is not known there. What changes the sums, a curve's steps and the
    ends of lives, is summed along time once: no row meets a day.
    """
    own = Window.partitionBy("item").orderBy("t")
    steps = curves.select("item", F.col("t").cast("double").alias("t"), (F.coalesce(F.lag("s").over(own), F.lit(1.0)) - F.col("s")).alias("down"), (F.row_number().over(own) == 1).alias("first"))
    ends = lives.select(F.col("item").alias("_i"), F.col("duration").cast("double").alias("end"), F.col("event").cast("boolean").alias("event"))
    met = steps.join(ends, F.col("item") == F.col("_i"))
    # a curve is 1 up to its first time, which is why that step counts after its day; censored lives leave after their end
    late = F.col("first").cast("int")
    counts = F.col("event") | (F.struct("t", late.alias("k")) <= F.struct(F.col("end").alias("t"), F.lit(0).alias("k")))
    met = met.where(counts)
    zero = F.lit(0.0)
    downs = met.select("t", (2 * late).alias("kind"), (-F.col("down")).alias("ds"), zero.alias("dk"), zero.alias("da"))
    left = met.groupBy("_i").agg(F.sum("down").alias("gone"))
    out = ends.join(left.withColumnRenamed("_i", "_l"), F.col("_i") == F.col("_l"), "left").where("end IS NOT NULL")
    rest = 1 - F.coalesce("gone", zero)
    gone = out.select(F.col("end").alias("t"), F.lit(2).alias("kind"), F.when(F.col("event"), zero).otherwise(-rest).alias("ds"), F.when(F.col("event"), zero).otherwise(-1.0).alias("dk"), F.lit(-1.0).alias("da"))
    moves = downs.unionByName(gone).groupBy("t", "kind").agg(*[F.sum(c).alias(c) for c in ("ds", "dk", "da")])
    asked = curves.sparkSession.createDataFrame([(float(d),) for d in days], "t double").select("t", F.lit(1).alias("kind"))
    seen = order.sums_before(moves.unionByName(asked, allowMissingColumns=True), [F.col("t"), F.col("kind")], {f"_{c}": F.coalesce(c, zero) for c in ("ds", "dk", "da")}).where("kind = 1")
    every = curves.select(F.col("item").alias("_c")).distinct().join(ends.where("end IS NOT NULL"), F.col("_c") == F.col("_i")).agg(F.count("*").alias("n"))
    known = F.col("n") + F.col("_dk")
    return seen.crossJoin(F.broadcast(every)).select(F.col("t").cast("int").alias("day"), F.round(known).cast("long").alias("known"), F.try_divide(F.col("n") + F.col("_ds"), known).alias("predicted"), F.try_divide(F.col("n") + F.col("_da"), known).alias("alive"))  # one row
