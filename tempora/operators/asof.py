"""The point-in-time primitive: observations and events in one stream by key, range frames over microseconds.

One shuffle by key serves any number of observation times and frames; nothing is joined by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY
from ..functions.tables import looked_up
from . import order

LOW = Window.unboundedPreceding
#: Frames relative to an observation at t: up to t, and strictly before t.
UPTO, BEFORE = (LOW, 0), (LOW, -1)


def within(days: int) -> tuple[int, int]:
    """(t - days, t]"""
    return -days * DAY + 1, 0


def preceding(days: int) -> tuple[int, int]:
    """[t - days, t)"""
    return -days * DAY, -1


def attach(probes: DataFrame, at: str, events: DataFrame, time: str, key: str, measures: dict[str, tuple[str, Column | None, tuple[int, int]]]) -> DataFrame:
    """probes with one column for each measure: (kind, expression over events, frame).

    Kinds: sum, count (of true), max, min, last (latest non-null by time). Empty sums and counts are 0, the rest null.
    Probes with a null key or time get empty frames.
    """
    values = {name: expr for name, (_, expr, _) in measures.items()}
    ev = events.where(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_p"), *[(F.lit(1) if e is None else e).alias(f"_v_{n}") for n, e in values.items()])
    pr = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_p"), *probes.columns)
    both = ev.unionByName(pr, allowMissingColumns=True)
    return both.select("_p", *probes.columns, *framed(measures)).where("_p = 1").drop("_p")


def framed(measures: dict[str, tuple[str, Column | None, tuple[int, int]]]) -> list[Column]:
    """The measures over a stream of events and probes by _k and _t, an event's value in _v_<name>."""
    out = []
    for n, (kind, _, (lo, hi)) in measures.items():
        w = Window.partitionBy("_k").orderBy("_t").rangeBetween(lo, hi)
        v = F.col(f"_v_{n}")
        if kind == "count":
            v = F.coalesce(F.sum(v.cast("int")).over(w), F.lit(0)).cast("long")
        elif kind == "sum":
            v = F.coalesce(F.sum(v).over(w), F.lit(0))
        elif kind == "last":
            v = F.max(F.when(v.isNotNull(), F.struct("_t", v.alias("v")))).over(w)["v"]
        else:
            v = {"max": F.max, "min": F.min}[kind](v).over(w)
        out.append(v.alias(n))
    return out


def attach_wide(probes: DataFrame, at: str, events: DataFrame, time: str, key: str, measures: dict[str, tuple[Column, tuple[int, int]]]) -> DataFrame:
    """Distinct probes (key, at) with one sum of an event column for each measure (expression, frame), for keys that may hold most rows.

    Sums run along the global order of (key, time), laid out by ranges; a frame is the difference of the sums at its
    two ends. No key, however large, is in one task.
    """
    bounds = sorted({b for _, frame in measures.values() for b in ((frame[0], -1), (frame[1], 1))})
    names = {n: f"_s{i}" for i, n in enumerate(measures)}
    ev = events.where(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), *[e.alias(names[n]) for n, (e, _) in measures.items()])
    # an end lies before the events of its time, or after them; a frame without a start begins with the key
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(-(1 << 62)).cast("long") if off == LOW else F.col(at) + F.lit(off)).alias("t"), F.lit(side).alias("side")) for i, (off, side) in enumerate(bounds)])
    pr = probes.where(F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_a"), F.explode(ends).alias("_e")).select("_k", "_a", F.col("_e.i").alias("_i"), F.col("_e.t").alias("_t"), F.col("_e.side").alias("_side"))
    both = ev.unionByName(pr, allowMissingColumns=True)
    seen = order.sums_before(both, [F.col(c) for c in ("_k", "_t", "_side")], {f"_c{s}": F.coalesce(s, F.lit(0)) for s in names.values()}).where("_i IS NOT NULL")
    # the sums up to each end side by side
    upto = lambda s, b: F.max(F.when(F.col("_i") == bounds.index(b), F.col(f"_c{s}")))
    found = seen.groupBy("_k", "_a").agg(*[(upto(names[n], (hi, 1)) - upto(names[n], (lo, -1))).alias(n) for n, (_, (lo, hi)) in measures.items()])
    out = probes.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_a")), "left").drop("_k", "_a")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in measures})


def group_density(probes: DataFrame, at: str, group: Column, failures: DataFrame, failure_group: Column, failure_time: str, units: DataFrame, unit_group: Column, installed: str, ended: str, windows: dict[str, int], size: str) -> DataFrame:
    """Failures in [t - w, t) and units in place at t, for each distinct (group, time) of the probes.

    A group may hold most of the rows, so events are first summed by (group, time) and probes made distinct; sums along
    all groups' order then give the frames, and a join by (group, time) brings the values back.
    """
    stream = failures.select(failure_group.alias("_g"), F.col(failure_time).alias("_t"), F.lit(1).alias("_f"), F.lit(0).alias("_u"))
    stream = stream.unionByName(units.select(unit_group.alias("_g"), F.explode(F.array(F.struct(F.col(installed).alias("_t"), F.lit(1).alias("_u")), F.struct(F.col(ended).alias("_t"), F.lit(-1).alias("_u")))).alias("s")).select("_g", "s._t", F.lit(0).alias("_f"), "s._u"))
    stream = stream.where("_t IS NOT NULL AND _g IS NOT NULL").groupBy("_g", "_t").agg(F.sum("_f").alias("_f"), F.sum("_u").alias("_u"))
    asked = probes.select(group.alias("_g"), F.col(at).alias("_t")).distinct()
    measures = {n: (F.col("_f"), preceding(w)) for n, w in windows.items()} | {size: (F.col("_u"), BEFORE)}
    found = attach_wide(asked, "_t", stream, "_t", "_g", measures)
    found = looked_up(found.select(F.col("_g").alias("_fg"), F.col("_t").alias("_ft"), *windows, F.greatest(F.col(size), F.lit(0)).alias(size)), "density")
    out = probes.withColumn("_pg", group).join(found, F.col("_pg").eqNullSafe(F.col("_fg")) & (F.col(at) == F.col("_ft")), "left").drop("_pg", "_fg", "_ft")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in [*windows, size]})
