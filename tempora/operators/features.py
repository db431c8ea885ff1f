"""Point-in-time features; every one is as known at the observation's own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY, DEFAULT, LOW_SUPPORT, UNKNOWN, Config
from ..functions import expr as X
from ..functions.tables import looked_up
from . import asof
from .asof import BEFORE, UPTO, preceding, within

CATEGORICAL = ["part_model_category", "client_category", "installation_age_band"]


def _counts(corrective: Column, failed: Column, new_place: Column, time: Column) -> dict:
    """What an event counts for, and in which frames."""
    return {
        "total_prior_events": ("count", None, UPTO),
        "prior_failure_count": ("count", failed, UPTO),
        "prior_corrective_count": ("count", corrective, UPTO),
        "prior_corrective_30d": ("count", corrective, within(30)),
        "prior_corrective_60d": ("count", corrective, within(60)),
        "prior_corrective_90d": ("count", corrective, within(90)),
        "prior_events_180d": ("count", None, within(180)),
        "prior_failure_365d": ("count", failed, within(365)),
        "prior_distinct_places": ("count", new_place, UPTO),
        "_last_corrective": ("max", F.when(corrective, time), UPTO),
    }


def _since(rows: DataFrame) -> DataFrame:
    return rows.withColumn("days_since_last_corrective", X.days(F.col("_last_corrective"), F.col("at_us"))).drop("_last_corrective")


def history(obs: DataFrame, op: DataFrame) -> DataFrame:
    """Counts, windows, distinct places and the last corrective event, all in one pass by item."""
    corrective = F.coalesce(F.col("wo_type") == "CORRECTIVE", F.lit(False))
    fresh = F.row_number().over(Window.partitionBy("item", "place").orderBy("created_us", "journey_id")) == 1
    events = op.withColumn("_new_place", F.col("place").isNotNull() & fresh)
    return _since(asof.attach(obs, "at_us", events, "created_us", "item", _counts(corrective, F.col("is_onset"), F.col("_new_place"), F.col("created_us"))))


def _trend(rows: DataFrame) -> DataFrame:
    """rows with _f (_n, _gap, _mean) of the last failure before them, as columns."""
    has = F.coalesce(F.col("_f._n") >= 3, F.lit(False))
    mean, last = F.when(has, F.col("_f._mean")).otherwise(0.0), F.when(has, F.col("_f._gap")).otherwise(0.0)
    return rows.withColumns({
        "has_failure_interval_trend": has,
        "log_failure_interval_mean_days": F.log1p(F.greatest(mean, F.lit(0.0))),
        "log_failure_interval_last_days": F.log1p(F.greatest(last, F.lit(0.0))),
        "failure_interval_trend_ratio": F.when(has & (mean > 0), F.greatest(F.least(last / mean, F.lit(10.0)), F.lit(0.0))).otherwise(1.0),
    }).drop("_f")


def interval_trend(obs: DataFrame, op: DataFrame) -> DataFrame:
    """Gaps between failures strictly before the observation; needs three failures."""
    w = Window.partitionBy("item").orderBy("created_us", "journey_id")
    f = op.where("is_onset").withColumn("_gap", X.days(F.lag("created_us").over(w), F.col("created_us"))).withColumn("_n", F.row_number().over(w))
    f = f.withColumn("_mean", F.avg("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # of failures at the same time the last one counts
    f = f.groupBy("item", "created_us").agg(F.max_by(F.struct("_n", "_gap", "_mean"), "journey_id").alias("_f"))
    return _trend(asof.attach(obs, "at_us", f, "created_us", "item", {"_f": ("last", F.col("_f"), BEFORE)}))


def past(obs: DataFrame, op: DataFrame) -> DataFrame:
    """history and interval_trend of obs, whose rows and the events are dealt by item once for both."""
    corrective, failed = F.coalesce(F.col("wo_type") == "CORRECTIVE", F.lit(False)), F.coalesce("is_onset", F.lit(False))
    ev = op.where("created_us IS NOT NULL").select(F.col("item").alias("_k"), F.col("created_us").alias("_t"), F.lit(0).alias("_p"), F.col("journey_id").alias("_j"), F.col("place").alias("_place"), corrective.alias("_corrective"), failed.alias("_failed"))
    pr = obs.select("*", F.col("item").alias("_k"), F.col("at_us").alias("_t"), F.lit(1).alias("_p"), F.lit(False).alias("_failed"))
    both = ev.unionByName(pr, allowMissingColumns=True).repartition("_k")
    places, fails = Window.partitionBy("_k", "_p", "_place").orderBy("_t", "_j"), Window.partitionBy("_k", "_failed").orderBy("_t", "_j")
    both = both.withColumn("_new", F.col("_place").isNotNull() & (F.row_number().over(places) == 1))
    both = both.withColumns({"_gap": F.when(F.col("_failed"), X.days(F.lag("_t").over(fails), F.col("_t"))), "_n": F.row_number().over(fails)})
    both = both.withColumn("_mean", F.avg("_gap").over(fails.rowsBetween(Window.unboundedPreceding, 0)))
    event = F.col("_p") == 0
    measures = _counts(F.col("_corrective"), F.col("_failed"), F.col("_new"), F.col("_t")) | {"_f": ("max", F.when(F.col("_failed"), F.struct("_t", "_j", "_n", "_gap", "_mean")), BEFORE)}
    both = both.select("_k", "_t", "_p", *obs.columns, *[(event if v is None else F.when(event, v)).alias(f"_v_{n}") for n, (_, v, _) in measures.items()])
    return _trend(_since(both.select("_p", *obs.columns, *asof.framed(measures)).where("_p = 1").drop("_p")))


def fleet(obs: DataFrame, cycles: DataFrame, episodes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Failures and units of the observation's model; a null model is a group of its own."""
    g = F.coalesce("model", F.lit(UNKNOWN))
    out = asof.group_density(obs, "at_us", g, episodes.where("in_cohort"), g, "onset_us", cycles.where("in_cohort"), g, "installed_us", "end_us", {"model_failures": cfg.fleet_days}, "model_units")
    return out.withColumn("model_failure_rate_90d", F.col("model_failures") / F.greatest("model_units", F.lit(1)))


def type_density(obs: DataFrame, cycles: DataFrame, episodes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The same by item type, over several windows; null types are dropped from the events."""
    g = F.col("item_type")
    windows = {f"type_failures_{d}d": d for d in cfg.density_days}
    out = asof.group_density(obs, "at_us", g, episodes.where("in_cohort"), g, "onset_us", cycles.where("in_cohort"), g, "installed_us", "end_us", windows, "type_units")
    return out.withColumns({f"item_type_failure_rate_{d}d": F.col(f"type_failures_{d}d") / F.greatest("type_units", F.lit(1)) for d in cfg.density_days})


def fleet_snapshot(cycles: DataFrame, episodes: DataFrame, days: int, group: str = "model") -> DataFrame:
    """The same at the data's end, for each group that is not null: a small table to look up."""
    units = cycles.where(F.col("in_cohort") & F.col(group).isNotNull()).groupBy(group).agg(
        F.max("data_end_us").alias("_end"), F.greatest(F.count_if(F.col("installed_us") < F.col("data_end_us")) - F.count_if(F.col("end_us") < F.col("data_end_us")), F.lit(0)).alias("units")
    )
    end = cycles.agg(F.max("data_end_us").alias("_at"))
    failed = episodes.where(F.col("in_cohort") & F.col(group).isNotNull()).crossJoin(F.broadcast(end))  # one row
    failed = failed.where((F.col("onset_us") < F.col("_at")) & (F.col("onset_us") >= F.col("_at") - F.lit(days * DAY))).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("failures"))
    both = units.join(failed, F.col(group) == F.col("_g"), "full")
    out = both.select(F.coalesce(group, "_g").alias(group), F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("units", F.lit(0)).alias("units"))
    return out.withColumn("rate", F.col("failures") / F.greatest("units", F.lit(1)))


def support_asof(obs: DataFrame, base: DataFrame, category: str = "model", base_time: str = "at_us", name: str = "support") -> DataFrame:
    """Rows of base with the category up to the observation's time; peers count. Pre-summed by (category, time)."""
    sums = base.where(F.col(category).isNotNull()).groupBy(category, base_time).agg(F.count("*").alias("_n"))
    asked = obs.select(category, "at_us").distinct()
    sums = sums.withColumnRenamed(base_time, "_bt")
    found = asof.attach_wide(asked, "at_us", sums, "_bt", category, {name: (F.col("_n"), UPTO)})
    found = looked_up(found.select(F.col(category).alias("_c"), F.col("at_us").alias("_a"), name), "support")
    return obs.join(found, F.col(category).eqNullSafe(F.col("_c")) & (F.col("at_us") == F.col("_a")), "left").drop("_c", "_a")


def support_totals(rows: DataFrame, category: str = "model") -> DataFrame:
    return rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("support"))


def previous_cycles(cycles: DataFrame) -> DataFrame:
    """Physical days before, number of cycles before, lifetimes of confirmed failures before, and how the last one ended."""
    w = Window.partitionBy("item").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lived = X.days(F.col("installed_us"), F.col("end_us"))
    failed = F.when(F.col("end_reason") == "FAILURE", lived)
    return cycles.withColumns({
        "cumulative_prior_days": F.coalesce(F.sum(F.greatest(lived, F.lit(0.0))).over(before), F.lit(0.0)),
        "previous_cycles": (F.row_number().over(w) - 1).cast("long"),
        "confirmed_mean_days": F.avg(failed).over(before),
        "confirmed_last_days": F.last(failed, ignorenulls=True).over(before),
        "previous_end_reason": F.lag("end_reason", 1, "NONE_FIRST_CYCLE").over(w),
    })


def classifier_features(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The 32 model columns in their fixed order, after cycle_id and at_us."""
    month = X.month_of(F.col("at_us"))
    angle = 2 * F.pi() * (month - 1) / 12
    log = lambda c: X.log1p0(F.col(c))
    columns = {
        "part_model_category": X.collapse(F.col("model"), F.col("support"), cfg.model_support, LOW_SUPPORT),
        "client_category": F.coalesce("client", F.lit(UNKNOWN)),
        "installation_age_band": X.age_band(F.coalesce("age_days", F.lit(0.0)), cfg),
        "log_days_since_installation": log("age_days"),
        "log_total_prior_events": log("total_prior_events"),
        "log_prior_failure_count": log("prior_failure_count"),
        "has_prior_failure": X.positive(F.col("prior_failure_count")),
        "log_prior_corrective_count": log("prior_corrective_count"),
        "has_prior_corrective": X.positive(F.col("prior_corrective_count")),
        "log_days_since_last_corrective": log("days_since_last_corrective"),
        "log_prior_distinct_places": log("prior_distinct_places"),
        "log_prior_corrective_30d": log("prior_corrective_30d"),
        "log_prior_failure_365d": log("prior_failure_365d"),
        "log_prior_events_180d": log("prior_events_180d"),
        "log_previous_cycle_lifetime_mean": log("previous_mean_days"),
        "has_previous_cycle": F.coalesce("has_previous", F.lit(False)),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "log_model_failures_90d": log("model_failures"),
        "model_failure_rate_90d": F.coalesce("model_failure_rate_90d", F.lit(0.0)),
        "log_model_fleet_size": log("model_units"),
        "log_cumulative_prior_cycle_days": log("cumulative_prior_days"),
        "log_previous_cycle_count": log("previous_cycles"),
        "has_failure_interval_trend": F.col("has_failure_interval_trend"),
        "log_failure_interval_mean_days": F.col("log_failure_interval_mean_days"),
        "failure_interval_trend_ratio": F.col("failure_interval_trend_ratio"),
        "log_prior_corrective_60d": log("prior_corrective_60d"),
        "log_prior_corrective_90d": log("prior_corrective_90d"),
        "log_item_type_failures_90d": log("type_failures_90d"),
        "item_type_failure_rate_90d": F.coalesce("item_type_failure_rate_90d", F.lit(0.0)),
        "log_item_type_failures_180d": log("type_failures_180d"),
        "item_type_failure_rate_180d": F.coalesce("item_type_failure_rate_180d", F.lit(0.0)),
    }
    keep = [c for c in ("cycle_id", "item", "at_us", "target", "eligible", "split", "step") if c in rows.columns]
    kind = lambda n, c: c if n in CATEGORICAL else c.cast("double")
    return rows.select(*keep, *[kind(n, c).alias(n) for n, c in columns.items()])


NUMERIC = """log_days_since_installation log_total_prior_events log_prior_failure_count has_prior_failure log_prior_corrective_count has_prior_corrective
    log_days_since_last_corrective log_prior_distinct_places log_prior_corrective_30d log_prior_failure_365d log_prior_events_180d log_previous_cycle_lifetime_mean
    has_previous_cycle month_sin month_cos log_model_failures_90d model_failure_rate_90d log_model_fleet_size log_cumulative_prior_cycle_days log_previous_cycle_count
    has_failure_interval_trend log_failure_interval_mean_days failure_interval_trend_ratio log_prior_corrective_60d log_prior_corrective_90d log_item_type_failures_90d
    item_type_failure_rate_90d log_item_type_failures_180d item_type_failure_rate_180d""".split()


def all_features(obs: DataFrame, op: DataFrame, cycles: DataFrame, episodes: DataFrame, support: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """obs with every raw feature. Without `support` (model, support) it is point-in-time over obs itself.

    What is looked up by group and time comes first: obs alone says what is asked, before the pass by item. obs may hold
    the columns of the earlier cycles already.
    """
    rows = type_density(fleet(obs, cycles, episodes, cfg), cycles, episodes, cfg)
    if support is None:
        rows = support_asof(rows, obs)
    else:
        rows = rows.join(looked_up(support.withColumnRenamed("model", "_m"), "support"), F.col("model") == F.col("_m"), "left").drop("_m")
    if "cumulative_prior_days" not in obs.columns:
        rows = rows.join(previous_cycles(cycles).select("cycle_id", "cumulative_prior_days", "previous_cycles"), "cycle_id", "left")
    return past(rows, op)


def shifted(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each horizon step: age and time since the last corrective event move on, nothing new happens."""
    out = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(cfg.horizons) - 1))))
    move = F.col("step") * cfg.step_days
    return out.withColumns({"age_days": F.col("age_days") + move, "days_since_last_corrective": F.col("days_since_last_corrective") + move, "at_us": F.col("at_us") + move * F.lit(DAY)})
