"""Observations, labels, splits, and lifecycle outcomes with their landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY, DEFAULT, Config
from ..functions import expr as X


def year_start(us, add: int = 0):
    return F.unix_micros(F.make_timestamp(F.year(F.timestamp_micros(us)) + add, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def grid(cycles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row every 30 days of each cohort cycle, the last strictly before its end, with label and eligibility."""
    step, horizon = cfg.step_days * DAY, cfg.horizon_days * DAY
    rows = cycles.where("in_cohort AND installed_us < end_us")
    n = F.floor((F.col("end_us") - F.col("installed_us") - 1) / F.lit(step)).cast("long")
    out = rows.withColumn("at_us", F.explode(F.sequence(F.col("installed_us"), F.col("installed_us") + n * F.lit(step), F.lit(step))))
    target = F.coalesce((F.col("onset_us") > F.col("at_us")) & (F.col("onset_us") <= F.col("at_us") + F.lit(horizon)), F.lit(False))
    out = out.withColumn("target", target)
    eligible = F.col("target") | (F.col("verified") & (F.col("at_us") <= F.col("last_confirmable_us")))
    return out.withColumn("eligible", eligible).withColumn("age_days", X.days(F.col("installed_us"), F.col("at_us")))


def active(cycles: DataFrame) -> DataFrame:
    """One row for each part in place at the data's end."""
    rows = cycles.where("in_cohort AND end_reason = 'RIGHT_CENSORED_AT_DATA_END'")
    return rows.withColumn("at_us", F.col("data_end_us")).withColumn("age_days", X.days(F.col("installed_us"), F.col("at_us")))


def with_split(obs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """By time, with an embargo of the horizon between the blocks."""
    at, done = F.col("at_us"), F.col("at_us") + F.lit(cfg.horizon_days * DAY)
    test, validation = year_start(F.col("data_end_us")), year_start(F.col("data_end_us"), -1)
    first = F.unix_micros(F.lit(cfg.first_observation).cast("timestamp"))
    split = F.when(at >= test, "TEST").when((at >= validation) & (done < test), "VALIDATION").when((at >= first) & (done < validation), "TRAIN").when(at < first, "EXCLUDED_TOO_OLD").otherwise("EXCLUDED_EMBARGO")
    return obs.withColumn("split", split)


def lifecycle_outcome(cycles: DataFrame) -> DataFrame:
    """Cohort lifecycles, split by install time, each censored at its own split's cut-off; durations in whole days, half to even."""
    end = F.col("data_end_us")
    test, validation = year_start(end), year_start(end, -1)
    rows = cycles.where("in_cohort AND installed_us < end_us").withColumn("split", F.when(F.col("installed_us") >= test, "TEST").when(F.col("installed_us") >= validation, "VALIDATION").otherwise("TRAIN"))
    cut = F.when(F.col("split") == "TRAIN", validation).when(F.col("split") == "VALIDATION", test).otherwise(end)
    rows = rows.withColumn("cutoff_us", cut)
    event = (F.col("end_reason") == "FAILURE") & (F.col("end_us") <= F.col("cutoff_us"))
    until = F.least("end_us", "cutoff_us")
    rows = rows.withColumn("event", event).withColumn("duration_days", F.greatest(F.bround(X.days(F.col("installed_us"), until)), F.lit(1.0)))
    return rows.withColumn("usable", F.col("event") | F.col("verified") | (F.col("end_us") > F.col("cutoff_us")))


def landmarks(outcome: DataFrame, op: DataFrame, organic: int = 8, anchors: int = 8) -> DataFrame:
    """Age 0, the latest rounded ages of events within the lifecycle, and anchors; equal ages keep the first source of that order."""
    rows = outcome.where("usable").select("cycle_id", "item", "installed_us", "duration_days", "event", "split")
    # events find their lifecycle by the running number of installs, as failures do
    starts = rows.select("item", F.col("installed_us").alias("t"), F.struct("cycle_id", "installed_us", "duration_days").alias("life"))
    seen = op.where("created_us IS NOT NULL").select("item", F.col("created_us").alias("t"))
    w = Window.partitionBy("item").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    both = starts.unionByName(seen, allowMissingColumns=True)
    last = both.withColumn("own", F.max(F.when(F.col("life").isNotNull(), F.struct("t", "life"))).over(w)["life"]).where("life IS NULL AND own IS NOT NULL")
    last = last.select("own.*", "t").where(F.col("t") < F.col("installed_us") + F.bround("duration_days").cast("long") * F.lit(DAY))
    ages = last.select("cycle_id", "duration_days", F.bround((F.col("t") - F.col("installed_us")) / F.lit(float(DAY))).alias("age")).where("age > 0 AND age < duration_days").distinct()
    newest = Window.partitionBy("cycle_id").orderBy(F.desc("age"))
    own = ages.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= organic).select("cycle_id", "age", F.lit(1).alias("source"))
    marks = [90.0, 180.0, 365.0]
    while len(marks) < anchors:
        marks.append(marks[-1] + 365.0)
    fixed = rows.select("cycle_id", "duration_days", F.explode(F.array(*map(F.lit, marks))).alias("age")).where("age < duration_days").select("cycle_id", "age", F.lit(2).alias("source"))
    zero = rows.select("cycle_id", F.lit(0.0).alias("age"), F.lit(0).alias("source"))
    union = zero.unionByName(own).unionByName(fixed).groupBy("cycle_id", "age").agg(F.min("source").alias("source"))
    out = union.join(rows, "cycle_id").where("age < duration_days")
    name = F.element_at(F.array(F.lit("INSTALL"), F.lit("ORGANIC_EVENT"), F.lit("ANCHOR")), F.col("source") + 1)
    return out.select("cycle_id", "item", "split", "age", name.alias("source"), (F.col("installed_us") + F.col("age").cast("long") * F.lit(DAY)).alias("at_us"), (F.col("duration_days") - F.col("age")).alias("residual_days"), "event")
