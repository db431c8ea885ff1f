"""Queries on item look-ups, audits, snapshots, places and the remaining survival metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.tables import stored
from ..operators import audit, features, metrics, observe, silver, survival
from ..sources.journal import Journal
from .feature_queries import GRID, SPLIT, Layers, _snapshot_sql
from .oracle import DAY, sql
from .registry import query
from .score_queries import KM, LIVES, lives

OP = ["journey_id", "item", "created_us", "status", "is_onset", "place"]


@query("item_set_scan", sql(f"SELECT {', '.join(OP)} FROM op WHERE item IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') FROM supplier)"))
def _(spark, d):
    """Operational events of a set of items (one for each supplier's number): the journal is cut to them before all else."""
    asked = spark.read.parquet(f"{d}/supplier.parquet").select(F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("item"))
    return silver.operational(silver.semantic(Journal(spark, d), only=asked)).select(*OP)


@query("item_scan", sql(f"SELECT {', '.join(OP)} FROM op WHERE item = (SELECT lpad(CAST(max(p_partkey) AS VARCHAR), 7, '0') FROM part)"))
def _(spark, d):
    """Operational events of one item, that of the last part: its predicate is on the derived identifier."""
    asked = spark.read.parquet(f"{d}/part.parquet").agg(F.lpad(F.max("p_partkey").cast("string"), 7, "0").alias("item"))
    return silver.operational(silver.semantic(Journal(spark, d), only=asked)).select(*OP)


@query("cycle_sequence", sql("SELECT cycle_id, CAST(regexp_extract(cycle_id, '[^:]*$') AS INTEGER) AS seq FROM cycle"))
def _(spark, d):
    return Layers(spark, d).cycles.select("cycle_id", F.substring_index("cycle_id", ":", -1).cast("int").alias("seq"))


@query("interval_join", sql("SELECT onset_journey_id, cycle_id FROM episode e JOIN cycle c ON c.item = e.item AND e.onset_us BETWEEN c.installed_us AND c.end_us"))
def _(spark, d):
    x = Layers(spark, d)
    return audit.interval_join(x.episodes, x.cycles)


@query("snapshot_lookup", sql(f"SELECT a.cycle_id, coalesce(failures, 0) AS failures, coalesce(units, 0) AS units, coalesce(rate, 0) AS rate FROM act a LEFT JOIN snap s ON s.model = a.model", **GRID, snap=_snapshot_sql("model", 90).rpartition("\nSELECT")[1].strip() + _snapshot_sql("model", 90).rpartition("\nSELECT")[2]))
def _(spark, d):
    x = Layers(spark, d)
    found = audit.snapshot_lookup(observe.active(x.cycles), features.fleet_snapshot(x.cycles, x.episodes, 90), "model")
    return found.select("cycle_id", "failures", "units", "rate")


@query("snapshot_csv", _snapshot_sql("model", 90))
def _(spark, d):
    x = Layers(spark, d)
    return audit.text_snapshot(features.fleet_snapshot(x.cycles, x.episodes, 90), "fleet")


#: Until when the earlier of the two stored data ends saw events: 1998-01-01.
EARLIER = 883612800000000
ENDS = {"ends": f"SELECT 'now' AS name, data_end_us FROM boundary UNION ALL SELECT 'earlier', max(created_us) FROM op WHERE created_us < {EARLIER}"}


def ends(x: Layers):
    """Data ends as they were stored with a snapshot: of today's events, and of those before a date."""
    early = x.op.where(F.col("created_us") < EARLIER).agg(F.max("created_us").alias("data_end_us"))
    return stored(silver.data_boundary(x.sem).withColumn("name", F.lit("now")).unionByName(early.withColumn("name", F.lit("earlier"))), "as-of")


@query("snapshot_usable", sql("SELECT name, data_end_us = (SELECT data_end_us FROM boundary) AS same_boundary, covered, data_end_us = (SELECT data_end_us FROM boundary) AND covered >= 0.8 AS usable FROM ends, (SELECT count(s.model) / greatest(count(*), 1) AS covered FROM (SELECT DISTINCT model FROM grid WHERE model IS NOT NULL) k LEFT JOIN (SELECT model FROM cycle WHERE in_cohort AND model IS NOT NULL UNION SELECT model FROM episode WHERE in_cohort AND model IS NOT NULL AND onset_us >= (SELECT data_end_us FROM boundary) - 90 * 86400000000 AND onset_us < (SELECT data_end_us FROM boundary)) s ON s.model = k.model)", **GRID, **ENDS))
def _(spark, d):
    x = Layers(spark, d)
    return audit.usable_snapshot(audit.text_snapshot(features.fleet_snapshot(x.cycles, x.episodes, 90), "fleet"), x.grid, "model", ends(x), silver.data_boundary(x.sem))


@query("freshness", sql("SELECT name, data_end_us AS was_us, (SELECT data_end_us FROM boundary) AS now_us, data_end_us <> (SELECT data_end_us FROM boundary) AS moved FROM ends", **ENDS))
def _(spark, d):
    """Has the data's end moved since it was stored?"""
    x = Layers(spark, d)
    return audit.freshness(ends(x), silver.data_boundary(x.sem))


@query("golden_tables", sql("SELECT 'cycle' AS _table, item, cycle_id, CAST(NULL AS BIGINT) AS onset_journey_id FROM cycle UNION ALL SELECT 'episode', item, NULL, onset_journey_id FROM episode", held=True))
def _(spark, d):
    x = Layers(spark, d)
    return audit.golden({"cycle": x.cycles.select("item", "cycle_id"), "episode": x.episodes.select("item", "onset_journey_id")}, "golden").select(F.col("_table").cast("string").alias("_table"), "item", "cycle_id", "onset_journey_id")


@query("batch_counts", sql("SELECT 'cycles' AS layer, count(*) AS row_count, 3 AS column_count FROM cycle UNION ALL SELECT 'active', count(*), 2 FROM act UNION ALL SELECT 'grid', count(*), 2 FROM grid", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    return audit.layer_counts({"cycles": x.cycles.select("cycle_id", "installed_us", "end_us"), "active": observe.active(x.cycles).select("cycle_id", "at_us"), "grid": x.grid.select("cycle_id", "at_us")})


@query("threshold_report", sql("SELECT count(*) FILTER (WHERE n >= 300) AS kept, count(*) FILTER (WHERE n < 300) AS merged, (SELECT count(DISTINCT model) FROM act WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM grid WHERE model IS NOT NULL)) AS unseen FROM (SELECT model, count(*) AS n FROM grid WHERE model IS NOT NULL GROUP BY model)", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    return audit.threshold_report(features.support_totals(x.grid), observe.active(x.cycles), "model", DEFAULT.model_support)


@query("lifecycle_audit", sql("SELECT count(*) AS cycles, count(*) FILTER (WHERE in_cohort) AS cohort, count(*) FILTER (WHERE NOT verified) AS unverified, count(*) FILTER (WHERE installed_us >= end_us) AS without_duration, count(*) FILTER (WHERE end_reason = 'FAILURE') AS failed, count(*) FILTER (WHERE end_reason = 'REINSTALL_WITHOUT_RECORDED_FAILURE') AS reinstalled, count(*) FILTER (WHERE end_reason = 'RIGHT_CENSORED_AT_DATA_END') AS censored, count(*) FILTER (WHERE end_us > data_end_us) AS beyond_data_end, count(*) - count(DISTINCT cycle_id) AS repeated_ids FROM cycle"))
def _(spark, d):
    return audit.lifecycle_audit(Layers(spark, d).cycles)


@query("mid_cycle_events", sql("SELECT has_events, count(*) AS cycles FROM (SELECT EXISTS (SELECT 1 FROM op e WHERE e.item = c.item AND e.created_us > c.installed_us AND e.created_us < c.end_us) AS has_events FROM cycle c WHERE in_cohort) GROUP BY 1"))
def _(spark, d):
    x = Layers(spark, d)
    return audit.mid_cycle_events(x.cycles, x.op)


@query("category_overlap", sql("SELECT (SELECT count(DISTINCT model) FROM act) AS left_n, (SELECT count(DISTINCT model) FROM episode) AS right_n, (SELECT count(*) FROM (SELECT model FROM act WHERE model IS NOT NULL INTERSECT SELECT model FROM episode)) AS both_n", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    return audit.category_overlap(observe.active(x.cycles), x.episodes, "model")


@query("population_difference", sql("SELECT item, 'LEFT_ONLY' AS side FROM (SELECT item FROM act EXCEPT ALL SELECT item FROM episode) UNION ALL SELECT item, 'RIGHT_ONLY' FROM (SELECT item FROM episode EXCEPT ALL SELECT item FROM act)", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    return audit.population_difference(observe.active(x.cycles), x.episodes, "item")


@query("days_since_group_failure", sql(f"SELECT g.cycle_id, g.at_us, (g.at_us - l.last_us) / {DAY}.0 AS days_since_group_failure FROM grid g LEFT JOIN lasts l ON l.model = g.model AND l.at_us = g.at_us", **GRID, lasts="SELECT p.model, p.at_us, max(e.onset_us) AS last_us FROM (SELECT DISTINCT model, at_us FROM grid) p JOIN (SELECT DISTINCT model, onset_us FROM episode WHERE in_cohort) e ON e.model = p.model AND e.onset_us < p.at_us GROUP BY ALL"))
def _(spark, d):
    x = Layers(spark, d)
    return audit.days_since_group_failure(x.grid, x.episodes, "model").select("cycle_id", "at_us", "days_since_group_failure")


@query("hazard_prior", sql(f"SELECT c.cycle_id, (SELECT count(*) FILTER (WHERE p.end_reason = 'FAILURE') FROM cycle p WHERE p.in_cohort AND p.model = c.model AND p.end_us < c.installed_us) / greatest((SELECT coalesce(sum((p.end_us - p.installed_us) // {DAY}), 0) FROM cycle p WHERE p.in_cohort AND p.model = c.model AND p.end_us < c.installed_us), 1) AS prior_hazard FROM cycle c WHERE c.in_cohort"))
def _(spark, d):
    return audit.hazard_prior(Layers(spark, d).cycles, "model").select("cycle_id", "prior_hazard")


TRAIN = GRID | {"tr": f"SELECT * FROM (SELECT *, {SPLIT} AS split FROM grid) WHERE eligible AND split = 'TRAIN'"}


def train(spark, d):
    return observe.with_split(Layers(spark, d).grid).where("eligible AND split = 'TRAIN'")


@query("target_encoding", sql("SELECT model, (sum(target::INT) + 50.0::DOUBLE * (SELECT sum(target::INT) / count(*) FROM tr)) / (count(*) + 50.0::DOUBLE) AS encoded FROM tr WHERE model IS NOT NULL GROUP BY model", **TRAIN))
def _(spark, d):
    return audit.target_encoding(stored(train(spark, d), "train"), "model")


@query("undersampled", sql("SELECT cycle_id, at_us, target FROM tr WHERE target OR substr(md5(cycle_id), 1, 1) < '4'", **TRAIN))
def _(spark, d):
    return audit.undersampled(train(spark, d), "cycle_id", 4).select("cycle_id", "at_us", "target")


@query("recall_by_slice", sql("SELECT item_type, count(*) AS positives, avg(CASE WHEN age_days >= 90 THEN 1.0 ELSE 0.0 END) AS recall FROM tr WHERE target GROUP BY item_type", **TRAIN))
def _(spark, d):
    """Recall by item type, the age in days being the score."""
    return audit.recall_by_slice(train(spark, d).withColumn("score", F.col("age_days")), "item_type", 90.0)


GEO = GRID | {
    "cand": "SELECT 'STASIUN ' || n_name AS location, s_suppkey AS candidate_rank, -7.0 + (s_suppkey % 100) / 50.0 AS lat, 106.0 + (s_suppkey % 150) / 100.0 AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "geo": "SELECT location, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY candidate_rank) AS r FROM cand WHERE lat BETWEEN -6.6 AND -5.8 AND lon BETWEEN 106.23 AND 107.2) WHERE r = 1",
}


@query("location_map", sql("SELECT place, parts, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, lat IS NOT NULL AS resolved, TRUE AS is_public, 'Stasiun ' || trim(substr(place, 9)) AS search_name FROM (SELECT place, count(*) AS parts FROM act WHERE place IS NOT NULL GROUP BY place) LEFT JOIN geo ON location = place", **GEO))
def _(spark, d):
    x = Layers(spark, d)
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    named = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    at = lambda base, m, by: F.lit(base) + F.pmod(F.col("s_suppkey"), F.lit(m)) / F.lit(by)
    candidates = named.select(F.concat(F.lit("STASIUN "), F.col("n_name")).alias("location"), F.col("s_suppkey").alias("candidate_rank"), at(-7.0, 100, 50.0).alias("lat"), at(106.0, 150, 100.0).alias("lon"))
    return audit.location_map(observe.active(x.cycles), candidates)


@query("caveats", sql("SELECT a.cycle_id, CASE WHEN a.model IS NULL THEN 'MODEL_UNKNOWN' WHEN coalesce(n, 0) < 300 THEN 'MODEL_LOW_SUPPORT' ELSE '' END AS caveats FROM act a LEFT JOIN (SELECT model, count(*) AS n FROM grid WHERE model IS NOT NULL GROUP BY model) s ON s.model = a.model", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    totals = features.support_totals(x.grid).withColumnRenamed("model", "_m")
    rows = observe.active(x.cycles).join(totals, F.col("model") == F.col("_m"), "left")
    return audit.caveats(rows, DEFAULT.model_support).select("cycle_id", F.array_join("caveats", ",").alias("caveats"))


CENSOR = LIVES | {"g": KM.replace("@", "NOT event"), "k": KM.replace("@", "event"), "cells": "SELECT duration_days, event, risk, count(*) AS n FROM r GROUP BY ALL"}


@query("uno_c", sql("SELECT sum(a.n * b.n / (g.s * g.s) * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n / (g.s * g.s)) AS uno_c FROM cells a JOIN g ON g.t = a.duration_days AND g.s > 0 JOIN cells b ON b.duration_days > a.duration_days OR (b.duration_days = a.duration_days AND NOT b.event) WHERE a.event AND a.duration_days < (SELECT max(duration_days) * 0.99 FROM r)", **CENSOR))
def _(spark, d):
    r = stored(lives(spark, d), "lives")
    return metrics.uno_c(r, survival.kaplan_meier(r, censoring=True))


BRIER = CENSOR | {
    "hs": "SELECT h, coalesce((SELECT max_by(s, t) FROM k WHERE t <= h), 1.0) AS sh, coalesce((SELECT max_by(s, t) FROM g WHERE t <= h), 1.0) AS gh FROM (SELECT CAST(unnest([30, 60, 90, 120]) AS DOUBLE) AS h)",
    "br": "SELECT h, sum(CASE WHEN r.event AND r.duration_days <= h AND g.s > 0 THEN sh * sh / g.s WHEN r.duration_days > h AND gh > 0 THEN (1 - sh) * (1 - sh) / gh ELSE 0 END) / count(*) AS brier FROM r LEFT JOIN g ON g.t = r.duration_days, hs GROUP BY h",
}


def briers(spark, d):
    r = stored(lives(spark, d), "lives")
    return metrics.brier_by_horizon(r, survival.kaplan_meier(r, censoring=True), survival.kaplan_meier(r), DEFAULT.horizons)


@query("brier_by_horizon", sql("SELECT h, brier FROM br", **BRIER))
def _(spark, d):
    return briers(spark, d)


@query("integrated_brier", sql("SELECT sum((h - ph) * (brier + pb) / 2) / 90.0 AS integrated_brier FROM (SELECT h, brier, lag(h) OVER (ORDER BY h) AS ph, lag(brier) OVER (ORDER BY h) AS pb FROM br)", **BRIER))
def _(spark, d):
    return metrics.integrated(briers(spark, d))


@query("dynamic_auc", sql("SELECT sum(a.n * b.n / g.s * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n / g.s) AS dynamic_auc FROM cells a JOIN g ON g.t = a.duration_days AND g.s > 0 JOIN cells b ON b.duration_days > 90 WHERE a.event AND a.duration_days <= 90", **CENSOR))
def _(spark, d):
    r = stored(lives(spark, d), "lives")
    return metrics.dynamic_auc(r, survival.kaplan_meier(r, censoring=True), 90.0)


@query("usable_horizons", sql("SELECT h FROM (SELECT CAST(unnest([30, 60, 90, 120]) AS DOUBLE) AS h) WHERE h > (SELECT min(duration_days) FROM life WHERE usable AND split = 'TEST') AND h < (SELECT least(max(duration_days) FILTER (WHERE split = 'TRAIN'), max(duration_days) FILTER (WHERE split = 'TEST')) FROM life WHERE usable)", **LIVES))
def _(spark, d):
    life = stored(observe.lifecycle_outcome(Layers(spark, d).cycles).where("usable").select("split", "duration_days"), "lives")
    return metrics.usable_horizons(life.where("split = 'TRAIN'"), life.where("split = 'TEST'"), DEFAULT.horizons)
