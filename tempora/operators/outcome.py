"""What became of each failure, and the scrap model's features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BROKEN, DAY, DEFAULT, REPAIRED, UNKNOWN, Config
from ..functions import expr as X
from . import asof

SCRAPPED = ("UNREPAIRABLE", "BROKEN")


def resolve(episodes: DataFrame, op: DataFrame, cycles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Episodes with outcome, reinstallation, counts up to and with the onset, ages, label, and when the label was known.

    Items hold few events, so a window over each item's own rows finds what follows; the verdict may carry the onset's own
    time, and counts only up to the next install or failure.
    """
    status = F.coalesce("status", F.lit(""))
    # kinds in the order in which rows of one (time, id) lie: events, then the failure that asks; installs of cycles have no id
    ev = op.select("item", F.col("created_us").alias("t"), F.col("journey_id").alias("j"), status.alias("status"), "is_onset", F.lit(0).alias("probe"))
    ep = episodes.select("item", F.col("onset_us").alias("t"), F.col("onset_journey_id").alias("j"), F.lit(1).alias("probe"), "onset_us", "onset_journey_id", "item_type", "model", "in_cohort")
    starts = cycles.select("item", F.col("installed_us").alias("t"), F.lit(2).alias("probe"))
    both = ev.unionByName(ep, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True).where("t IS NOT NULL").repartition("item")
    event = F.col("probe") == 0
    onset, repaired = F.coalesce("is_onset", F.lit(False)), F.col("status") == REPAIRED
    # descending: what has been seen is what comes later; a row equal to the onset itself is not after it
    back = Window.partitionBy("item").orderBy(F.desc("t"), F.desc("j"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, -1)
    later = lambda cond: F.last(F.when(event & cond, F.struct("t", "j")), ignorenulls=True).over(back)
    # counts by (time, id): everything strictly earlier, and at the same time up to the onset's id
    order = Window.partitionBy("item").orderBy("t", "j", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda cond: F.sum(F.when(event & cond, 1).otherwise(0)).over(order).cast("long")
    # the first verdict at or after the onset's time: smallest (time, id) among the item's terminal rows from there on
    onward = Window.partitionBy("item").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy("item").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({"next_install": later(F.col("status") == "INSTALLED"), "next_failure": later(onset)})
    out = out.withColumn("_v", F.min(F.when(event & F.col("status").isin(*BROKEN, REPAIRED), F.struct("t", "j", "status"))).over(onward))
    out = out.withColumns({"prior_repaired_count": seen(repaired), "prior_failure_count": seen(onset)})
    out = out.withColumn("_installed", F.max(F.when(F.col("probe") == 2, F.col("t"))).over(upto)).withColumn("first_us", F.min(F.when(event, F.col("t"))).over(Window.partitionBy("item")))
    limit = F.least(F.col("next_install.t"), F.col("next_failure.t"))
    found = out.where("probe = 1").withColumn("_install", F.col("next_install.t")).withColumn("outcome", F.when(limit.isNull() | (F.col("_v.t") <= limit), F.col("_v.status"))).withColumn("was_reinstalled", F.col("_install").isNotNull())
    end = op.agg(F.max("created_us").alias("_end"))
    found = found.crossJoin(F.broadcast(end))  # one row
    scrap = F.coalesce(F.col("outcome").isin(*SCRAPPED), F.lit(False))
    survived = F.coalesce(F.col("outcome") == REPAIRED, F.lit(False)) | F.col("was_reinstalled")
    return found.select(
        "onset_journey_id",
        "item",
        "onset_us",
        "item_type",
        "model",
        "in_cohort",
        "outcome",
        "was_reinstalled",
        F.coalesce("prior_repaired_count", F.lit(0)).alias("prior_repaired_count"),
        F.coalesce("prior_failure_count", F.lit(0)).alias("prior_failure_count"),
        X.days(F.col("first_us"), F.col("onset_us")).alias("age_total_days"),
        X.days(F.col("_installed"), F.col("onset_us")).alias("cycle_age_days"),
        scrap.cast("int").alias("is_scrap"),
        ((scrap | survived) & (F.col("onset_us") <= F.col("_end") - F.lit(cfg.horizon_days * DAY))).alias("is_labeled"),
        F.when(F.col("outcome").isNotNull(), F.col("_v.t")).otherwise(F.col("_install")).alias("known_us"),
    )


def matured(resolved: DataFrame, until: int, cfg: Config = DEFAULT) -> DataFrame:
    """Labelled failures of the cohort as they were known at a time: old enough then, and what became of them seen by then."""
    return resolved.where(F.col("in_cohort") & F.col("is_labeled") & (F.col("onset_us") <= until - cfg.horizon_days * DAY) & (F.col("known_us") <= until))


def asof_install(episodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each failure with the latest install at or before it."""
    out = asof.attach(episodes, "onset_us", cycles.select("item", "installed_us"), "installed_us", "item", {"install_us": ("max", F.col("installed_us"), asof.UPTO)})
    return out.select("onset_journey_id", "item", "onset_us", "install_us")


def install_context(rows: DataFrame, op: DataFrame) -> DataFrame:
    """rows (item, installed_us, ...) with type and place as the install event at that time has them, the first one by id of several; UNKNOWN without."""
    first = op.where("status = 'INSTALLED'").groupBy(F.col("item").alias("_i"), F.col("created_us").alias("_t")).agg(F.min_by(F.struct("item_type", "place"), "journey_id").alias("_e"))
    out = rows.join(first, (F.col("item") == F.col("_i")) & (F.col("installed_us") == F.col("_t")), "left")
    return out.withColumns({"type_at_install": F.coalesce("_e.item_type", F.lit(UNKNOWN)), "place_at_install": F.coalesce("_e.place", F.lit(UNKNOWN))}).drop("_i", "_t", "_e")


def known_types(resolved: DataFrame, least: int = DEFAULT.type_support) -> DataFrame:
    return resolved.where("is_labeled AND item_type IS NOT NULL").groupBy("item_type").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item_type")


def scrap_features(rows: DataFrame, types: DataFrame) -> DataFrame:
    """The seven columns of the scrap model; a type that is not known is low support, a null one too."""
    known = types.select(F.col("item_type").alias("_t"), F.lit(True).alias("_known"))
    rows = rows.join(known, F.col("item_type") == F.col("_t"), "left")
    keep = [c for c in ("onset_journey_id", "item", "onset_us", "is_scrap", "is_labeled") if c in rows.columns]
    return rows.select(
        *keep,
        X.known_or_low(F.col("item_type"), F.col("_known")).alias("type_category"),
        X.log1p0(F.col("age_total_days")).alias("log_age_total_days"),
        X.log1p0(F.col("cycle_age_days")).alias("log_cycle_age_days"),
        X.log1p0(F.col("prior_repaired_count")).alias("log_prior_repaired"),
        X.log1p0(F.col("prior_failure_count")).alias("log_prior_failures"),
        X.positive(F.col("prior_repaired_count")).alias("has_prior_repaired"),
        (F.coalesce("prior_failure_count", F.lit(0)) > 1).alias("has_repeat_failure"),
    )


def current_state(op: DataFrame, cycles: DataFrame) -> DataFrame:
    """Every active part as if it failed now: last known type, first seen, counts, running age."""
    t = F.struct("created_us", "journey_id")
    state = op.groupBy("item").agg(
        F.max_by(F.col("item_type"), F.when(F.col("item_type").isNotNull(), t)).alias("item_type"),
        F.max_by(F.col("place"), F.when(F.col("place").isNotNull(), t)).alias("last_place"),
        F.min("created_us").alias("first_us"),
        F.count_if(F.coalesce(F.col("status") == REPAIRED, F.lit(False))).alias("prior_repaired_count"),
        F.count_if("is_onset").alias("prior_failure_count"),
    )
    act = cycles.where("in_cohort AND end_reason = 'RIGHT_CENSORED_AT_DATA_END'").select("item", "cycle_id", "installed_us", "data_end_us")
    rows = act.join(state, "item", "left")
    return rows.select("item", "cycle_id", "item_type", "last_place", X.days(F.col("first_us"), F.col("data_end_us")).alias("age_total_days"), X.days(F.col("installed_us"), F.col("data_end_us")).alias("cycle_age_days"), "prior_repaired_count", "prior_failure_count")
