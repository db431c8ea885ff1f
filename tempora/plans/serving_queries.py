"""Queries on assembled scores, assessments, monitoring of scrap, folds, ensembles and terminal context."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import shared_dir, stored
from ..operators import assembly, features, silver
from ..sources import saved
from ..sources.journal import Journal
from .feature_queries import Layers
from .oracle import sql
from .registry import ORACLES, query
from .score_queries import SCORED, SERVED, parts, plain, scored

ADVISORY = "SELECT item, CAST(c_custkey % 700 AS DOUBLE) AS median_days, CAST(c_custkey % 300 AS DOUBLE) AS medium_days, CAST(c_custkey % 500 AS DOUBLE) AS high_days FROM p WHERE c_custkey % 4 <> 0"
RANKED = SERVED | {"adv": ADVISORY, "tab": "SELECT w.*, round(failure_probability * scrap_probability, 5) AS death_risk, median_days, medium_days, high_days, row_number() OVER (ORDER BY failure_probability DESC, item) AS rank FROM w LEFT JOIN adv USING (item)"}
COLUMNS = ["rank", "item", "place", "failure_probability", "failure_level", "scrap_probability", "scrap_level", "median_days", "medium_days", "high_days", "priority", "action", "is_replacement_candidate", "death_risk"]


def table(spark, d):
    """The ranked table over deterministic scores of three separate tables."""
    p = parts(spark, d)
    days = lambda m, n: F.pmod("c_custkey", F.lit(m)).cast("double").alias(n)
    failure = p.select("item", "failure_probability", "failure_level", F.col("failure_probability").alias("score"))
    scrap = p.where("scrap_probability IS NOT NULL").select("item", "scrap_probability", "scrap_level")
    advisory = p.where("c_custkey % 4 <> 0").select("item", days(700, "median_days"), days(300, "medium_days"), days(500, "high_days"))
    context = p.select("item", "place", "item_type", "client", "c_custkey")
    return assembly.assembled(failure, scrap, advisory, context)


@query("score_assembly", plain(f"SELECT {', '.join(COLUMNS)} FROM tab", **RANKED))
def _(spark, d):
    return table(spark, d).select(*COLUMNS)


@query("score_sink", plain(f"SELECT {', '.join(COLUMNS)}, DATE '2024-01-31' AS as_of FROM tab", **RANKED))
def _(spark, d):
    """The ranked table written as CSV under its date and read again."""
    t = table(spark, d).select(*COLUMNS, F.lit("2024-01-31").cast("date").alias("as_of"))
    folder = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    saved.save_scores(t, folder)
    return saved.load_scores(spark, folder, t.schema)


@query(
    "assessment",
    plain(
        """SELECT a.item, CASE WHEN a.k % 3 = 0 THEN 'NOT_FOUND' ELSE 'SCORED' END AS status, failure_level, rank, scrap_level, median_days, priority, death_risk,
        CASE WHEN a.k % 3 <> 0 THEN CASE WHEN failure_level = 'LOW' THEN 0 ELSE 1 END + CASE WHEN place IS NULL THEN 0 ELSE 1 END END AS factors, CASE WHEN a.k % 3 <> 0 THEN CASE WHEN scrap_level IS NULL THEN 'SCRAP_UNKNOWN' ELSE '' END END AS caveats
        FROM (SELECT DISTINCT o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'GONE#' || o_custkey ELSE 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS item FROM orders) a LEFT JOIN (SELECT *, upper(item) AS _u FROM tab) t ON t._u = a.item""",
        **RANKED,
    ),
)
def _(spark, d):
    """Assessments of every ordering customer, a third of them under an id that nothing knows."""
    t = stored(table(spark, d).withColumn("item", F.upper("item")), "ranked")
    k = Journal(spark, d).table("orders").select(F.col("o_custkey").alias("k")).distinct()
    asked = k.select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("gone#"), F.col("k").cast("string"))).otherwise(F.concat(F.lit(" customer#"), F.lpad(F.col("k").cast("string"), 9, "0"))).alias("item"))
    factors = t.select("item", F.array_compact(F.array(F.when(F.col("failure_level") != "LOW", "RISK"), F.when(F.col("place").isNotNull(), "PLACE"))).alias("factors"))
    notes = t.select("item", F.array_compact(F.array(F.when(F.col("scrap_level").isNull(), "SCRAP_UNKNOWN"))).alias("caveats"))
    out = assembly.assessed(asked, t, t, factors, notes)
    return out.select("item", "status", "failure.failure_level", "failure.rank", "scrap.scrap_level", "survival.median_days", "decision.priority", "decision.death_risk", F.when(F.col("factors").isNotNull(), F.size("factors")).alias("factors"), F.array_join("caveats", ",").alias("caveats"))


@query("scrap_monitoring", plain("SELECT count(scrap_probability) AS scored, avg(scrap_probability) AS mean_probability, count(*) FILTER (scrap_level = 'HIGH') AS high, count(*) FILTER (scrap_level = 'MEDIUM') AS medium, count(*) FILTER (scrap_level = 'LOW') AS low, avg((item_type NOT IN ('BUILDING', 'MACHINERY'))::INT) AS unknown_type_share FROM v", **SERVED))
def _(spark, d):
    p = parts(spark, d)
    return assembly.scrap_monitoring(p, p.where("item_type IN ('BUILDING', 'MACHINERY')").select("item_type"))


@query(
    "monitoring_bundle",
    plain(
        f"SELECT m.*, high_share, trained_high_share, high_share / trained_high_share AS high_ratio FROM ({ORACLES['score_distribution']}) m, (SELECT avg((failure_level = 'HIGH')::INT) AS high_share FROM v), (SELECT avg((score >= 0.9)::INT) AS trained_high_share FROM s)",
        **SERVED, s=SCORED,
    ),
)
def _(spark, d):
    return assembly.monitoring(parts(spark, d), scored(spark, d).agg(F.avg((F.col("score") >= 0.9).cast("double")).alias("trained_high_share")))


@query("flagged_counts", plain("SELECT count(*) FILTER (score >= 0.9) AS high, count(*) FILTER (score >= 0.7) AS medium, count(score) AS n FROM s", s=SCORED))
def _(spark, d):
    return assembly.flagged(scored(spark, d), {"high": 0.9, "medium": 0.7})


@query("score_ensembles", plain("SELECT k, (score + other) / 2 AS mean, greatest(score, other) AS highest, (percent_rank() OVER (ORDER BY score) + percent_rank() OVER (ORDER BY other)) / 2 AS mean_rank FROM (SELECT *, k % 89 / 89.0 AS other FROM s)", s=SCORED))
def _(spark, d):
    rows = scored(spark, d).withColumn("other", F.col("k") % 89 / 89.0)
    return assembly.ensembles(rows, "score", "other").select("k", "mean", "highest", "mean_rank")


@query("grouped_folds", sql("SELECT cycle_id, item, CAST(CAST('0x' || substr(md5(item), 1, 6) AS BIGINT) % 5 AS INTEGER) AS fold FROM cycle"))
def _(spark, d):
    return assembly.grouped_folds(Layers(spark, d).cycles, "item").select("cycle_id", "item", "fold")


_LOGS = ", ".join(f"ln(1 + greatest(coalesce({c}, 0), 0)) AS log_{c}, {c} IS NOT NULL AS has_{c}" for c in ("confirmed_mean_days", "confirmed_last_days"))


@query("previous_cycle_columns", f"SELECT cycle_id, {_LOGS} FROM ({ORACLES['confirmed_failure_stats']})")
def _(spark, d):
    rows = assembly.previous_cycle_columns(features.previous_cycles(Layers(spark, d).cycles))
    return rows.select("cycle_id", *[f"{p}_{c}" for p in ("log", "has") for c in ("confirmed_mean_days", "confirmed_last_days")])


@query("terminal_context", sql("SELECT cycle_id, coalesce(t.terminal_type, 'UNKNOWN') AS terminal_type, coalesce(t.terminal_model, 'UNKNOWN') AS terminal_model FROM cycle c LEFT JOIN (SELECT item, installed_us, min(terminal_type) AS terminal_type, min(terminal_model) AS terminal_model FROM tl WHERE link_state = 'VALID_POINT_IN_TIME_RELATION' GROUP BY ALL) t ON t.item = c.item AND t.installed_us = c.installed_us", tl=ORACLES["terminal_link"]))
def _(spark, d):
    x = Layers(spark, d)
    return assembly.terminal_context(x.cycles, silver.terminal_links(x.j, x.sem)).select("cycle_id", "terminal_type", "terminal_model")
