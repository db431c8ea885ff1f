"""Sums along a global order without a window over one partition: ranges sorted in parallel, totals of earlier ranges added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of its column over all rows strictly earlier in the order, which must be total.

    The ranges are written with their number, so a lost executor cannot move rows between them. Their totals, a row a range,
    are all that meets in one place.
    """
    names = list(sums)
    ranged = rows.withColumns({f"_v{i}": sums[n] for i, n in enumerate(names)}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ordered")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    offsets = totals.select(F.col("_range").alias("_range2"), *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_range2"))  # a row a range: at most spark.sql.shuffle.partitions
    out = out.withColumns({n: F.coalesce(F.sum(f"_v{i}").over(own), F.lit(0)) + F.col(f"_o{i}") for i, n in enumerate(names)})
    return out.drop("_range", "_range2", *[f"_{k}{i}" for k in "vo" for i in range(len(names))])


def last_known(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """rows with, as `out`, the last non-null `value` at or before each row along the ascending order of the columns, which must be total.

    Ranges are written as in sums_before; of each range only its last value is carried on, so no group of rows and no
    table of values is in one place.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ordered")
    ends = ranged.where(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ranged.select("_range").distinct().join(ends, "_range", "left")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(F.col("_range").alias("_range2"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.join(F.broadcast(carried), F.col("_range") == F.col("_range2"))  # a row a range
    return met.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(own), "_carry")).drop("_range", "_range2", "_carry")


def quantiles(rows: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """One row (for each `by`): q, the exact quantiles, linear between neighbours, and n, the non-null values. Without values no row for a `by`, else nulls.

    Ranks come from sums over the sorted distinct values, so no task holds them all.
    """
    own = [by] if by else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    seen = sums_before(counts, [F.col(c) for c in (*own, "_x")], {"_b": F.col("_n")})
    totals = seen.groupBy(*[F.col(c).alias("_by") for c in own]).agg(F.sum("_n").alias("_all"), F.min("_b").alias("_from"))
    met = seen.join(totals, F.col(by).eqNullSafe(F.col("_by"))) if by else seen.crossJoin(F.broadcast(totals))  # one row
    at = F.col("_b") - F.col("_from")
    holds = lambda k: (at <= k) & (k < at + F.col("_n"))
    place = [F.lit(q) * (F.col("_all") - 1) for q in shares]
    ends = [(F.floor(p), F.ceil(p)) for p in place]
    met = met.where(F.greatest(*[holds(k) for e in ends for k in e], F.lit(False)))  # two rows a quantile
    found = met.groupBy(*own).agg(F.max("_all").alias("n"), *[F.max(F.when(holds(k), F.col("_x").cast("double"))).alias(f"_{side}{i}") for i, e in enumerate(ends) for side, k in zip("lh", e, strict=True)])
    part = [F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for q in shares]
    q = F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * x for i, x in enumerate(part)])
    return found.select(*own, q.alias("q"), F.coalesce("n", F.lit(0)).alias("n"))


def concordance(a: DataFrame, b: DataFrame, levels: int, by: list[str] | None = None) -> DataFrame:
    """Weighted pairs of a (pos, risk, w) with every b (pos, risk, w) of a larger position: `comparable` and `concordant`, equal risks half.

    Two positions first differ in one bit. For each bit, a's rows with 0 there meet b's rows with 1 there among those whose
    higher bits agree, and sums along the risk count their pairs: rows times bits instead of pairs, and no group in one task.
    """
    by = by or []
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(levels, 1) - 1))).alias("_bit")

    def dealt(rows: DataFrame, side: int, name: str, other: str) -> DataFrame:
        rows = rows.select(*by, "pos", "risk", "w", bits).where(F.expr("shiftright(pos, _bit)").bitwiseAND(F.lit(1)) == side)
        return rows.select(*by, "_bit", F.expr("shiftright(pos, _bit + 1)").alias("_block"), "risk", F.col("w").alias(name), F.lit(0.0).alias(other))

    group = [*by, "_bit", "_block"]
    cells = dealt(a, 0, "_a", "_b").unionByName(dealt(b, 1, "_b", "_a")).groupBy(*group, "risk").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    seen = sums_before(cells, [F.col(c) for c in (*group, "risk")], {"_lower": F.col("_b")})
    # sums never fall along the order, so the smallest one of a group is what lies before it
    part = seen.groupBy(*group).agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.sum(F.col("_a") * (F.col("_lower") + F.col("_b") / 2)).alias("_c"), F.min("_lower").alias("_from"))
    return part.groupBy(*by).agg(F.sum(F.col("_sa") * F.col("_sb")).alias("comparable"), F.sum(F.col("_c") - F.col("_sa") * F.col("_from")).alias("concordant"))


def positions(rows: DataFrame, time: Column, event: Column) -> tuple[DataFrame, int]:
    """(t, e, pos) of each distinct time, failures before censored rows of the same time, and the bits of the largest position."""
    at = rows.select(time.alias("t"), event.alias("e")).distinct()
    out = sums_before(at, [F.col("t"), F.desc("e")], {"pos": F.lit(1)})
    out = stored(out.select("t", "e", F.col("pos").cast("long").alias("pos")), "positions")
    return out, max(int(out.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]).bit_length(), 1)
