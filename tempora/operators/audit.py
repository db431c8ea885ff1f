"""Checks on layers and snapshots: audits, category reports, look-ups, sinks that are read back, places on the map."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAY
from ..functions import expr as X
from ..functions.tables import shared_dir
from ..sources.saved import CSV
from . import asof, order
from .asof import BEFORE


def interval_join(episodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """(onset_journey_id, cycle_id): cycles whose time, both ends included, holds the onset. Equal items first, so no range is joined across items."""
    c = cycles.select("cycle_id", F.col("item").alias("_i"), "installed_us", "end_us")
    return episodes.join(c, (F.col("item") == F.col("_i")) & F.col("onset_us").between(F.col("installed_us"), F.col("end_us"))).select("onset_journey_id", "cycle_id")


def snapshot_lookup(rows: DataFrame, snapshot: DataFrame, group: str) -> DataFrame:
    """rows with failures, units and rate of their group in a snapshot; a group that is missing or null has 0."""
    s = snapshot.select(F.col(group).alias("_g"), "failures", "units", "rate")
    out = rows.join(s, F.col(group) == F.col("_g"), "left").drop("_g")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("failures", "units")} | {"rate": F.coalesce("rate", F.lit(0.0))})


def threshold_report(totals: DataFrame, seen: DataFrame, category: str, least: int) -> DataFrame:
    """How many categories are kept, merged for want of support, and unseen in the totals."""
    t = totals.select(F.col(category).alias("_c"), "support")
    new = seen.select(F.col(category).alias("_s")).where("_s IS NOT NULL").distinct().join(t, F.col("_s") == F.col("_c"), "left_anti").agg(F.count("*").alias("unseen"))
    return t.agg(F.count_if(F.col("support") >= least).alias("kept"), F.count_if(F.col("support") < least).alias("merged")).crossJoin(F.broadcast(new))  # one row each


def lifecycle_audit(cycles: DataFrame) -> DataFrame:
    """Counts of what keeps cycles out of the cohort, and of rows that should not be."""
    reason = lambda r: F.count_if(F.col("end_reason") == r)
    return cycles.agg(
        F.count("*").alias("cycles"), F.count_if("in_cohort").alias("cohort"), F.count_if(~F.col("verified")).alias("unverified"), F.count_if(F.col("installed_us") >= F.col("end_us")).alias("without_duration"),
        reason("FAILURE").alias("failed"), reason("REINSTALL_WITHOUT_RECORDED_FAILURE").alias("reinstalled"), reason("RIGHT_CENSORED_AT_DATA_END").alias("censored"),
        F.count_if(F.col("end_us") > F.col("data_end_us")).alias("beyond_data_end"), (F.count("*") - F.count_distinct("cycle_id")).alias("repeated_ids"),
    )


def mid_cycle_events(cycles: DataFrame, op: DataFrame) -> DataFrame:
    """(has_events, cycles): cohort cycles with and without operational events strictly within them."""
    c = cycles.where("in_cohort").select("cycle_id", "item", "installed_us", "end_us")
    e = op.select(F.col("item").alias("_i"), "created_us")
    held = c.join(e, (F.col("item") == F.col("_i")) & (F.col("created_us") > F.col("installed_us")) & (F.col("created_us") < F.col("end_us"))).select("cycle_id").distinct()
    flagged = c.join(held.withColumn("_h", F.lit(True)), "cycle_id", "left")
    return flagged.groupBy(F.coalesce("_h", F.lit(False)).alias("has_events")).agg(F.count("*").alias("cycles"))


def category_overlap(a: DataFrame, b: DataFrame, category: str) -> DataFrame:
    """Number of categories of either side and of both."""
    x, y = (d.select(F.col(category).alias("c")).where("c IS NOT NULL").distinct() for d in (a, b))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(x, "left_n").crossJoin(F.broadcast(n(y, "right_n"))).crossJoin(F.broadcast(n(x.intersect(y), "both_n")))  # one row each


def population_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only, each as often as it is there more."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("side", F.lit("LEFT_ONLY")).unionByName(y.exceptAll(x).withColumn("side", F.lit("RIGHT_ONLY")))


def days_since_group_failure(obs: DataFrame, episodes: DataFrame, group: str) -> DataFrame:
    """obs with the days since the group's last failure strictly before; null without one. Groups may hold most rows: both sides are made distinct first."""
    asked = obs.select(group, "at_us").where(F.col(group).isNotNull()).distinct()
    failed = episodes.where(F.col("in_cohort")).select(group, "onset_us").distinct()
    points = asked.select(F.col(group).alias("_g"), F.col("at_us").alias("_a"), F.lit(0).alias("_side"))
    points = points.unionByName(failed.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col("onset_us").alias("_a"), F.lit(1).alias("_side"), F.struct(F.col(group).alias("g"), F.col("onset_us").alias("t")).alias("_at")), allowMissingColumns=True)
    found = order.last_known(points, ["_g", "_a", "_side"], "_at", "_before").where("_side = 0")
    found = found.select("_g", "_a", F.when(F.col("_before.g") == F.col("_g"), F.col("_before.t")).alias("_last"))
    out = obs.join(found, (F.col(group) == F.col("_g")) & (F.col("at_us") == F.col("_a")), "left")
    return out.withColumn("days_since_group_failure", X.days(F.col("_last"), F.col("at_us"))).drop("_g", "_a", "_last")


def hazard_prior(cycles: DataFrame, group: str) -> DataFrame:
    """Cohort cycles with failures a day lived among the group's lifecycles that had ended before this one began."""
    c = cycles.where("in_cohort")
    ended = c.where(F.col(group).isNotNull()).groupBy(group, "end_us").agg(F.count_if(F.col("end_reason") == "FAILURE").alias("_f"), F.sum(F.floor((F.col("end_us") - F.col("installed_us")) / F.lit(DAY))).alias("_d"))
    asked = c.select(group, "installed_us").where(F.col(group).isNotNull()).distinct()
    found = asof.attach_wide(asked, "installed_us", ended, "end_us", group, {"_fs": (F.col("_f"), BEFORE), "_ds": (F.col("_d"), BEFORE)})
    found = found.select(F.col(group).alias("_g"), F.col("installed_us").alias("_a"), "_fs", "_ds")
    out = c.join(found, (F.col(group) == F.col("_g")) & (F.col("installed_us") == F.col("_a")), "left")
    return out.withColumn("prior_hazard", F.coalesce("_fs", F.lit(0)) / F.greatest(F.coalesce("_ds", F.lit(0)), F.lit(1))).drop("_g", "_a", "_fs", "_ds")


def target_encoding(train: DataFrame, category: str, strength: float = 50.0) -> DataFrame:
    """(category, encoded): the share of positives, shrunk to the global one by `strength` rows."""
    y = F.col("target").cast("long")
    every = train.agg((F.sum(y) / F.count("*")).alias("_mean"))
    by = train.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    return by.crossJoin(F.broadcast(every)).select(category, ((F.col("_p") + strength * F.col("_mean")) / (F.col("_n") + strength)).alias("encoded"))  # one row


def undersampled(rows: DataFrame, key: str, sixteenths: int) -> DataFrame:
    """All positives, and of the negatives those whose key's digest begins below sixteenths / 16: a sampling operator, the same at any partitioning."""
    return rows.where(F.col("target") | (F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "0123456789abcdefg"[sixteenths]))


def recall_by_slice(rows: DataFrame, by: str, threshold: float) -> DataFrame:
    """Positives of each slice and the share of them at or above the threshold."""
    return rows.where("target").groupBy(by).agg(F.count("*").alias("positives"), F.avg((F.col("score") >= threshold).cast("double")).alias("recall"))


def text_snapshot(snapshot: DataFrame, name: str) -> DataFrame:
    """A snapshot written as CSV and read back by its schema, so that codes with leading zeros stay text."""
    spark = snapshot.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    snapshot.write.options(**CSV).csv(path)
    return spark.read.schema(snapshot.schema).options(**CSV, multiLine=True).csv(path)


def golden(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables in one Parquet folder, partitioned by their tag, read back together."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = None
    for tag, df in tables.items():
        df = df.withColumn("_table", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.partitionBy("_table").parquet(path)
    return spark.read.parquet(path)


def usable_snapshot(stored_snapshot: DataFrame, known: DataFrame, group: str, as_of: DataFrame, boundary: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, same_boundary, covered, usable) for each stored data end (name, data_end_us): a stored snapshot serves if the data's end has not moved and it covers enough of the known groups."""
    k = known.select(F.col(group).alias("_k")).where("_k IS NOT NULL").distinct()
    both = k.join(stored_snapshot.select(F.col(group).alias("_s")).distinct(), F.col("_k") == F.col("_s"), "left").agg((F.count("_s") / F.greatest(F.count("*"), F.lit(1))).alias("covered"))
    same = freshness(as_of, boundary).select("name", (~F.col("moved")).alias("same_boundary"))
    return same.crossJoin(F.broadcast(both)).withColumn("usable", F.col("same_boundary") & (F.col("covered") >= least))  # one row each


def freshness(as_of: DataFrame, boundary: DataFrame) -> DataFrame:
    """(name, was_us, now_us, moved): stored data ends (name, data_end_us) against the end of the live data."""
    now = boundary.select(F.col("data_end_us").alias("now_us"))
    return as_of.select("name", F.col("data_end_us").alias("was_us")).crossJoin(F.broadcast(now)).withColumn("moved", ~F.col("was_us").eqNullSafe(F.col("now_us")))  # one row


def first_valid(candidates: DataFrame) -> DataFrame:
    """(location, lat, lon): of each location's candidates within the box, that of the smallest rank."""
    good = candidates.where(X.in_box(F.col("lat"), F.col("lon")))
    return good.groupBy("location").agg(F.min_by(F.struct("lat", "lon"), F.struct("candidate_rank", "lat", "lon")).alias("p")).select("location", "p.lat", "p.lon")


def location_map(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parts by place with coordinates where a valid candidate is known, the name to look it up by, and whether it is a public place."""
    by = parts.where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("parts"))
    found = by.join(first_valid(candidates).withColumnRenamed("location", "_l"), F.col("place") == F.col("_l"), "left")
    return found.select("place", "parts", "lat", "lon", F.col("lat").isNotNull().alias("resolved"), X.public_place(F.col("place")).alias("is_public"), X.search_name(F.col("place")).alias("search_name"))


def caveats(rows: DataFrame, least: int) -> DataFrame:
    """rows (model, support) with notes on models that are unknown or little known."""
    note = F.when(F.col("model").isNull(), "MODEL_UNKNOWN").when(F.coalesce("support", F.lit(0)) < least, "MODEL_LOW_SUPPORT")
    return rows.withColumn("caveats", F.array_compact(F.array(note)))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, row_count, column_count) of each layer of a batch run."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.lit(name).alias("layer"), F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out
