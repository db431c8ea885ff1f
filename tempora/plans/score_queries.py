"""Queries on metrics, curves and served scores, over deterministic scores taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import expr as X
from ..operators import features, metrics, ml, observe, order, serve, survival
from ..sources.journal import Journal
from .feature_queries import GRID, HISTORY, LIFE, D, Layers, density
from .oracle import sql
from .registry import query


def plain(select: str, **parts: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + select if parts else select


SCORED = "SELECT o_orderkey AS k, floor(o_totalprice) % 997 / 997.0 AS score, CAST(o_orderstatus = 'F' AS INTEGER) AS target FROM orders"


def scored(spark, d):
    o = Journal(spark, d).table("orders")
    return o.select(F.col("o_orderkey").alias("k"), (F.floor("o_totalprice") % 997 / 997.0).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))


BY = "SELECT score, CAST(sum(target) AS DOUBLE) AS p, CAST(sum(1 - target) AS DOUBLE) AS n FROM s GROUP BY score"


@query("roc_auc", plain("SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS roc_auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)", s=SCORED, b=BY))
def _(spark, d):
    return metrics.roc_auc(scored(spark, d))


@query("average_precision", plain("SELECT sum(p * tp / every) / sum(p) AS average_precision FROM (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p + n) OVER (ORDER BY score DESC) AS every FROM b)", s=SCORED, b=BY))
def _(spark, d):
    return metrics.average_precision(scored(spark, d))


@query("brier", plain("SELECT avg((score - target) * (score - target)) AS brier FROM s", s=SCORED))
def _(spark, d):
    return metrics.brier(scored(spark, d))


@query("capacity_topk", plain("SELECT count(*) AS capacity, sum(target) / count(*) AS precision_at_capacity, sum(target) / (SELECT sum(target) FROM s) AS recall_at_capacity FROM (SELECT * FROM s ORDER BY score DESC, k LIMIT 600)", s=SCORED))
def _(spark, d):
    return metrics.capacity_topk(scored(spark, d), "k", 90.0, DEFAULT.capacity_per_month)


@query(
    "confusion",
    plain("SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM c", s=SCORED, c="SELECT count(*) FILTER (score >= 0.5 AND target = 1) AS tp, count(*) FILTER (score >= 0.5 AND target = 0) AS fp, count(*) FILTER (score < 0.5 AND target = 1) AS fn, count(*) FILTER (score < 0.5 AND target = 0) AS tn FROM s"),
)
def _(spark, d):
    return metrics.confusion(scored(spark, d), 0.5)


@query(
    "reliability_table",
    plain("SELECT CAST(1 + (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT AS INTEGER) AS bucket, count(*) AS n, avg(score) AS predicted, avg(target) AS observed FROM s, q GROUP BY 1", s=SCORED, q="SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM s"),
)
def _(spark, d):
    return metrics.reliability(scored(spark, d), "k")


@query("capacity_cutoffs", plain("SELECT quantile_cont(score, 0.98) AS high, quantile_cont(score, 0.96) AS medium FROM s", s=SCORED))
def _(spark, d):
    return order.quantiles(scored(spark, d), "score", [0.98, 0.96]).select(F.col("q")[0].alias("high"), F.col("q")[1].alias("medium"))


@query("bootstrap_ci")
def _(spark, d):
    rows = observe.lifecycle_outcome(Layers(spark, d).cycles).where("usable")
    return metrics.bootstrap_ci(rows.select("cycle_id", "duration_days", "event", F.col("seq").cast("double").alias("risk")), "cycle_id")


@query("oof_folds", plain("SELECT target, CAST((row_number() OVER (PARTITION BY target ORDER BY k * 7919 % 100003, k) - 1) % 5 AS INTEGER) AS fold, k FROM s", s=SCORED))
def _(spark, d):
    """Stratified folds: a rank within the class in a fixed pseudo-random order, modulo 5."""
    return ml.folds(scored(spark, d), "target", [F.col("k") * 7919 % 100003, F.col("k")]).select("target", "fold", "k")


LIVES = LIFE | {"r": "SELECT duration_days, event, CAST(seq AS DOUBLE) AS risk FROM life WHERE usable"}


def lives(spark, d):
    return observe.lifecycle_outcome(Layers(spark, d).cycles).where("usable").select("duration_days", "event", F.col("seq").cast("double").alias("risk"))


KM = """SELECT t, CAST(at_risk AS BIGINT) AS at_risk, events, exp(sum(ln(CASE WHEN events < at_risk THEN 1 - events / at_risk ELSE 1 END)) OVER (ORDER BY t)) * CASE WHEN max(events / at_risk) OVER (ORDER BY t) >= 1 THEN 0 ELSE 1 END AS s
    FROM (SELECT duration_days AS t, count(*) FILTER (@) AS events, sum(count(*)) OVER (ORDER BY duration_days DESC) AS at_risk FROM r GROUP BY duration_days)"""


@query("km_curve", sql(KM.replace("@", "event"), **LIVES))
def _(spark, d):
    return survival.kaplan_meier(lives(spark, d))


@query("censoring_curve", sql(KM.replace("@", "NOT event"), **LIVES))
def _(spark, d):
    return survival.kaplan_meier(lives(spark, d), censoring=True)


@query(
    "c_index",
    sql("SELECT sum(a.n * b.n * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n) AS c_index, CAST(sum(a.n * b.n) AS BIGINT) AS comparable FROM cells a JOIN cells b ON a.event AND (b.duration_days > a.duration_days OR (b.duration_days = a.duration_days AND NOT b.event))", **LIVES, cells="SELECT duration_days, event, risk, count(*) AS n FROM r GROUP BY ALL"),
)
def _(spark, d):
    return metrics.c_index(lives(spark, d))


@query(
    "brier_ipcw",
    sql(
        "SELECT sum(CASE WHEN r.event AND r.duration_days <= 90 AND g.s > 0 THEN 0.25 / g.s WHEN r.duration_days > 90 AND gh > 0 THEN 0.25 / gh ELSE 0 END) / count(*) AS brier FROM r LEFT JOIN g ON g.t = r.duration_days, (SELECT coalesce(min(s), 1.0) AS gh FROM g WHERE t <= 90)",
        **LIVES, g=KM.replace("@", "NOT event"),
    ),
)
def _(spark, d):
    r = lives(spark, d)
    return metrics.brier_at(r.withColumn("s", F.lit(0.5)), survival.kaplan_meier(r, censoring=True), 90.0)


@query("person_period", sql("SELECT interval, count(*) AS n, CAST(sum(CASE WHEN event AND duration_days <= hi THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM r, (VALUES (0, 0, 30), (1, 30, 60), (2, 60, 90), (3, 90, 180), (4, 180, 365)) v(interval, lo, hi) WHERE duration_days > lo AND (event OR duration_days >= hi) GROUP BY interval", **LIVES))
def _(spark, d):
    return survival.person_period(lives(spark, d), [0, 30, 60, 90, 180, 365]).groupBy("interval").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("failures"))


TIMES = "1, 15, 30, 45, 60, 75, 90, 105, 120, 200"
CURVE = f"SELECT p_partkey AS item, CAST(t AS DOUBLE) AS t, exp(-(0.001 + p_size * 0.0002) * t) AS s FROM part, unnest([{TIMES}]) u(t)"
ASKED = "SELECT p_partkey AS item, CAST(q AS DOUBLE) AS q FROM part, unnest([0, 1, 17, 30, 121, 500]) u(q)"


def curves(spark, d):
    p = Journal(spark, d).table("part")
    grid = F.array(*[F.lit(float(x)) for x in TIMES.split(", ")])
    return p.select(F.col("p_partkey").alias("item"), "p_size", F.explode(grid).alias("t")).select("item", "t", F.exp(-(0.001 + F.col("p_size") * 0.0002) * F.col("t")).alias("s"))


def asked(spark, d):
    return Journal(spark, d).table("part").select(F.col("p_partkey").alias("item"), F.explode(F.array(*[F.lit(float(x)) for x in (0, 1, 17, 30, 121, 500)])).alias("q"))


LOOK = "SELECT a.item, a.q, CASE WHEN a.q <= 1 THEN 1.0 ELSE (SELECT arg_max(s, t) FROM c WHERE c.item = a.item AND c.t <= a.q) END AS s FROM a"


@query("step_lookup", plain(LOOK, c=CURVE, a=ASKED))
def _(spark, d):
    return survival.step_lookup(curves(spark, d), asked(spark, d))


@query("curve_sampling", plain("SELECT p.item, p.q, CASE WHEN p.q <= 1 THEN 1.0 ELSE (SELECT arg_max(s, t) FROM c WHERE c.item = p.item AND c.t <= p.q) END AS s FROM p", c=CURVE, p="SELECT p_partkey AS item, CAST(q AS DOUBLE) AS q FROM part, unnest(range(0, 201, 30)) u(q)"))
def _(spark, d):
    return survival.sampled(curves(spark, d))


@query("conditional_risk", plain("SELECT item, least(greatest(1 - s2 / s1, 0), 1) AS risk FROM (SELECT item, max(s) FILTER (q = 17) AS s1, max(s) FILTER (q = 121) AS s2 FROM l GROUP BY item)", c=CURVE, a=ASKED, l=LOOK))
def _(spark, d):
    looked = survival.step_lookup(curves(spark, d), asked(spark, d))
    both = looked.groupBy("item").agg(F.max(F.when(F.col("q") == 17, F.col("s"))).alias("a"), F.max(F.when(F.col("q") == 121, F.col("s"))).alias("b"))
    return both.select("item", survival.conditional_risk(F.col("a"), F.col("b")).alias("risk"))


@query("time_at_threshold", plain("SELECT item, min(t) FILTER (s <= 0.75) AS t FROM c GROUP BY item", c=CURVE))
def _(spark, d):
    return survival.time_at_threshold(curves(spark, d), 0.75)


@query("cummax_risk", plain("SELECT item, t, max(r) OVER (PARTITION BY item ORDER BY t) AS risk FROM (SELECT item, t, s * (1 - s) AS r FROM c)", c=CURVE))
def _(spark, d):
    return survival.monotone(curves(spark, d).select("item", "t", (F.col("s") * (1 - F.col("s"))).alias("risk")), "item", "t")


@query("hazard_chain", plain("SELECT item, t AS step, 1 - s AS hazard, 1 - exp(sum(ln(s)) OVER (PARTITION BY item ORDER BY t)) AS risk FROM c", c=CURVE))
def _(spark, d):
    return survival.chained(curves(spark, d).select("item", F.col("t").alias("step"), (1 - F.col("s")).alias("hazard")))


TABLES = {30: [(0.0, 0.0), (0.1, 0.02), (0.5, 0.4)], 60: [(0.0, 0.01), (0.2, 0.1), (0.6, 0.7)], 90: [(0.05, 0.03), (0.4, 0.5)], 120: [(0.0, 0.05), (0.7, 0.9)]}


def knots(x: str, table: list[tuple[float, float]]) -> str:
    parts = [f"WHEN {x} <= {table[0][0]} THEN {table[0][1]}"]
    parts += [f"WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE" for (x0, y0), (x1, y1) in zip(table, table[1:], strict=False)]
    return f"CASE {' '.join(parts)} ELSE {table[-1][1]} END"


_at = {h: f"CAST({knots('(1 - s)', t)} AS DOUBLE)" for h, t in TABLES.items()}
_mix = " ".join(f"WHEN t <= {hi} THEN {_at[lo]} * (1 - (t - {lo}) / {hi - lo}) + {_at[hi]} * ((t - {lo}) / {hi - lo})" for lo, hi in ((30, 60), (60, 90), (90, 120)))


@query("curve_calibration", plain(f"SELECT item, t, 1 - max(r) OVER (PARTITION BY item ORDER BY t) AS s FROM (SELECT item, t, CASE WHEN t <= 30 THEN {_at[30]} {_mix} ELSE {_at[120]} END AS r FROM c)", c=CURVE))
def _(spark, d):
    knots = spark.createDataFrame([(h, x, y) for h, table in TABLES.items() for x, y in table], "h int, x double, y double")
    return survival.calibrated(curves(spark, d), knots, tuple(TABLES)).select("item", "t", "s")


@query("median_error", plain("SELECT avg(abs(m - a)) AS mae, avg(m - a) AS bias, avg((m > a)::INT) AS over_share, avg((m IS NULL)::INT) AS null_share FROM (SELECT item, min(t) FILTER (s <= 0.5) AS m, CAST(item % 150 AS DOUBLE) AS a FROM c GROUP BY item)", c=CURVE))
def _(spark, d):
    m = survival.time_at_threshold(curves(spark, d), 0.5).select(F.col("t").alias("median"), (F.col("item") % 150).cast("double").alias("actual"))
    return metrics.median_error(m)


_DAYS = list(range(0, 241, 20))


@query(
    "day_calibration",
    plain(
        """SELECT day, count(y) AS known, avg(CASE WHEN y IS NOT NULL THEN s END) AS predicted, CAST(avg(y) AS DOUBLE) AS alive FROM (
        SELECT d.day, l.item, CASE WHEN l.duration >= d.day THEN 1 WHEN l.event THEN 0 END AS y, CASE WHEN d.day <= (SELECT min(t) FROM c) THEN 1.0 ELSE (SELECT arg_max(c.s, c.t) FROM c WHERE c.item = l.item AND c.t <= d.day) END AS s
        FROM unnest(range(0, 241, 20)) d(day), l) GROUP BY day""",
        c=CURVE,
        l="SELECT DISTINCT item, CAST(item % 190 + 1 AS DOUBLE) AS duration, item % 3 <> 0 AS event FROM c",
    ),
)
def _(spark, d):
    c = curves(spark, d)
    lives = c.select("item").distinct().select("item", (F.col("item") % 190 + 1).cast("double").alias("duration"), (F.col("item") % 3 != 0).alias("event"))
    return survival.day_calibration(c, lives, _DAYS)


@query("monotonicity_violations", plain("SELECT count(*) FILTER (r30 > r60 OR r60 > r90) AS violations, count(*) AS n FROM (SELECT item, max(r) FILTER (t = 30) AS r30, max(r) FILTER (t = 60) AS r60, max(r) FILTER (t = 90) AS r90 FROM (SELECT item, t, s * (1 - s) AS r FROM c) GROUP BY item)", c=CURVE))
def _(spark, d):
    at = lambda h: F.max(F.when(F.col("t") == h, F.col("s") * (1 - F.col("s")))).alias(f"r{h}")
    wide = curves(spark, d).groupBy("item").agg(at(30), at(60), at(90))
    return wide.agg(F.count_if((F.col("r30") > F.col("r60")) | (F.col("r60") > F.col("r90"))).alias("violations"), F.count("*").alias("n"))


PARTS = """SELECT c_name AS item, c_custkey, c_mktsegment AS item_type, c_mktsegment AS client, CASE WHEN c_nationkey % 7 <> 0 THEN 'STASIUN ' || n_name END AS place,
    floor((c_acctbal + 1000) * 4 / 110) / 1000 AS failure_probability, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 100 / 250.0 END AS scrap_probability FROM customer JOIN nation ON n_nationkey = c_nationkey"""
_band = lambda p: f"CASE WHEN {p} >= 0.25 THEN 'HIGH' WHEN {p} >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END"
LEVELS = f"SELECT *, {_band('failure_probability')} AS failure_level, CASE WHEN scrap_probability IS NOT NULL THEN {_band('scrap_probability')} END AS scrap_level FROM p"
DECIDED = """SELECT *, CASE failure_level WHEN 'HIGH' THEN CASE WHEN scrap_level = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END ELSE failure_level END AS priority,
    CASE failure_level WHEN 'HIGH' THEN CASE WHEN scrap_level = 'HIGH' THEN 'INSPECT_AND_PREPARE_REPLACEMENT' ELSE 'PRIORITIZE_INSPECTION' END
        WHEN 'MEDIUM' THEN CASE WHEN scrap_level = 'HIGH' THEN 'SCHEDULE_INSPECTION_AND_REVIEW_STOCK' ELSE 'SCHEDULE_INSPECTION' END ELSE 'MONITOR' END AS action,
    failure_level <> 'LOW' AND coalesce(scrap_level = 'HIGH', FALSE) AS is_replacement_candidate FROM v"""
SERVED = {"p": PARTS, "v": LEVELS, "w": DECIDED}


def parts(spark, d):
    j = Journal(spark, d)
    c = j.table("customer").join(j.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(
        F.col("c_name").alias("item"), "c_custkey", F.col("c_mktsegment").alias("item_type"), F.col("c_mktsegment").alias("client"), F.when(F.col("c_nationkey") % 7 != 0, F.concat(F.lit("STASIUN "), "n_name")).alias("place"),
        (F.floor((F.col("c_acctbal") + 1000) * 4 / 110) / 1000).alias("failure_probability"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 100 / 250.0).alias("scrap_probability"),
    )
    return c.withColumn("failure_level", X.band(F.col("failure_probability"))).withColumn("scrap_level", F.when(F.col("scrap_probability").isNotNull(), X.band(F.col("scrap_probability"))))


def served(spark, d):
    return serve.recommended(parts(spark, d))


@query("risk_bands", plain("SELECT item, failure_level, scrap_level FROM v", **SERVED))
def _(spark, d):
    return parts(spark, d).select("item", "failure_level", "scrap_level")


@query("recommendation", plain("SELECT item, priority, action, is_replacement_candidate FROM w", **SERVED))
def _(spark, d):
    return served(spark, d).select("item", "priority", "action", "is_replacement_candidate")


@query("death_risk", plain("SELECT item, round(failure_probability * scrap_probability, 5) AS death_risk FROM v", **SERVED))
def _(spark, d):
    return serve.death_risk(parts(spark, d)).select("item", "death_risk")


@query("ranked_list", plain("SELECT item, failure_probability, priority, row_number() OVER (ORDER BY failure_probability DESC, item) AS rank FROM w", **SERVED))
def _(spark, d):
    return serve.ranked(served(spark, d), "failure_probability").select("item", "failure_probability", "priority", F.col("rank").cast("long").alias("rank"))


@query("filter_page", plain("SELECT item, rank FROM (SELECT *, row_number() OVER (ORDER BY failure_probability DESC, item) AS rank FROM w) WHERE priority = 'HIGH' AND contains(upper(item), '1') ORDER BY rank LIMIT 20 OFFSET 10", **SERVED))
def _(spark, d):
    r = serve.ranked(served(spark, d), "failure_probability")
    return serve.page(serve.filtered(r, priority="high", part="1"), 10, 20).select("item", F.col("rank").cast("long").alias("rank"))


_TOTAL = "SELECT total, CAST(returned AS INTEGER) AS returned, item, rank FROM (SELECT *, count(*) OVER () AS returned FROM (SELECT *, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (ORDER BY failure_probability DESC, item) AS rank FROM w) WHERE priority = 'HIGH' ORDER BY rank LIMIT 20 OFFSET 10))"


@query("page_total", plain(_TOTAL, **SERVED))
def _(spark, d):
    """A page of the filtered list, each row with the number of rows in the list and on the page."""
    r = serve.ranked(served(spark, d), "failure_probability").select("item", F.col("rank").cast("long").alias("rank"), "priority")
    return serve.page_with_total(r.where("priority = 'HIGH'").drop("priority"), 10, 20).select("total", "returned", F.explode("items").alias("i")).select("total", "returned", "i.item", "i.rank")


_SAYS = """CASE failure_level WHEN 'HIGH' THEN 'Risiko kerusakan tinggi' WHEN 'MEDIUM' THEN 'Risiko kerusakan sedang' ELSE 'Risiko kerusakan rendah' END || CASE
    WHEN scrap_level IS NULL THEN CASE failure_level WHEN 'HIGH' THEN '. Dahulukan pemeriksaan' WHEN 'MEDIUM' THEN '. Jadwalkan pemeriksaan' ELSE '. Cukup dipantau' END || '. Risiko scrap belum bisa dinilai untuk PART ini.'
    WHEN failure_level = 'HIGH' AND scrap_level = 'HIGH' THEN ' dan kecil kemungkinan bisa diperbaiki bila rusak. Periksa lebih awal dan siapkan unit pengganti.'
    WHEN failure_level = 'HIGH' AND scrap_level = 'MEDIUM' THEN '. Dahulukan pemeriksaan, dan cek ketersediaan unit pengganti.'
    WHEN failure_level = 'HIGH' THEN ', tetapi bila rusak umumnya masih bisa diperbaiki. Dahulukan pemeriksaan.'
    WHEN failure_level = 'MEDIUM' AND scrap_level = 'HIGH' THEN ', tetapi bila rusak kecil kemungkinan bisa diperbaiki. Jadwalkan pemeriksaan dan tinjau stok pengganti.'
    WHEN failure_level = 'MEDIUM' THEN '. Jadwalkan pemeriksaan pada siklus terdekat.'
    WHEN scrap_level = 'HIGH' THEN '. Belum perlu tindakan, tetapi bila nanti rusak kemungkinan besar tidak bisa diperbaiki.'
    ELSE '. Cukup dipantau.' END"""


@query("decision_message", plain(f"SELECT item, {_SAYS} AS message FROM w", **SERVED))
def _(spark, d):
    return served(spark, d).select("item", "message")


_level = ", ".join(f"count(*) FILTER (failure_level = '{v}') AS failure_{v.lower()}, count(*) FILTER (scrap_level = '{v}') AS scrap_{v.lower()}" for v in ("HIGH", "MEDIUM", "LOW"))


@query("summary_counts", plain(f"SELECT count(*) AS total, {_level}, count(*) FILTER (is_replacement_candidate) AS candidates, count(*) FILTER (priority = 'CRITICAL') AS critical FROM w", **SERVED))
def _(spark, d):
    return serve.summary(served(spark, d))


@query("location_rollup", plain("SELECT place, count(*) AS parts, count(*) FILTER (failure_level = 'HIGH') AS high, count(*) FILTER (failure_level = 'MEDIUM') AS medium, count(*) FILTER (failure_level = 'LOW') AS low, count(*) FILTER (is_replacement_candidate) AS candidates FROM w WHERE place IS NOT NULL GROUP BY place", **SERVED))
def _(spark, d):
    return serve.by_location(served(spark, d))


@query("facets", plain("SELECT DISTINCT facet, value FROM (SELECT 'item_type' AS facet, item_type AS value FROM w UNION ALL SELECT 'client', client FROM w UNION ALL SELECT 'place', place FROM w UNION ALL SELECT 'priority', priority FROM w) WHERE value IS NOT NULL", **SERVED))
def _(spark, d):
    return serve.facets(served(spark, d))


@query("score_distribution", plain("SELECT min(failure_probability) AS min, quantile_cont(failure_probability, 0.05) AS p05, quantile_cont(failure_probability, 0.25) AS p25, quantile_cont(failure_probability, 0.5) AS p50, quantile_cont(failure_probability, 0.75) AS p75, quantile_cont(failure_probability, 0.95) AS p95, max(failure_probability) AS max, avg(failure_probability) AS mean, count(*) AS n FROM p", p=PARTS))
def _(spark, d):
    return serve.score_distribution(parts(spark, d), "failure_probability")


@query("status_three_way", plain("SELECT DISTINCT 'CUSTOMER#' || k AS item, CASE WHEN k % 3 = 0 THEN 'NOT_FOUND' WHEN k % 3 = 1 THEN 'NOT_SCORABLE' ELSE 'SCORED' END AS status FROM (SELECT o_custkey AS k FROM orders)"))
def _(spark, d):
    o = Journal(spark, d).table("orders").select(F.col("o_custkey").alias("k")).distinct()
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string")).alias("item")
    return serve.statuses(o.select(name(" customer#")), o.where("k % 3 <> 0").select(name("CUSTOMER#")), o.where("k % 3 = 2").select(name("CUSTOMER#")))


@query(
    "snapshot_diff",
    plain(
        """SELECT coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'LEFT_ONLY' WHEN a.item IS NULL THEN 'RIGHT_ONLY' ELSE 'CHANGED' END AS kind, CASE WHEN a.item IS NOT NULL AND b.item IS NOT NULL THEN 'failure_probability' END AS "column",
        CASE WHEN a.item IS NOT NULL AND b.item IS NOT NULL THEN CAST(a.failure_probability AS VARCHAR) END AS left_value, CASE WHEN a.item IS NOT NULL AND b.item IS NOT NULL THEN CAST(b.failure_probability AS VARCHAR) END AS right_value
        FROM (SELECT * FROM p WHERE c_custkey % 11 <> 0) a FULL JOIN (SELECT item, failure_probability + CASE WHEN c_custkey % 5 = 0 THEN 0.001 ELSE 0 END AS failure_probability FROM p WHERE c_custkey % 13 <> 0) b ON a.item = b.item
        WHERE a.item IS NULL OR b.item IS NULL OR abs(a.failure_probability - b.failure_probability) > 1e-9 * greatest(abs(a.failure_probability), abs(b.failure_probability))""",
        p=PARTS,
    ),
)
def _(spark, d):
    p = parts(spark, d)
    moved = p.withColumn("failure_probability", F.col("failure_probability") + F.when(F.col("c_custkey") % 5 == 0, 0.001).otherwise(0.0))
    return serve.snapshot_diff(p.where("c_custkey % 11 <> 0"), moved.where("c_custkey % 13 <> 0"), "item", ["failure_probability", "item_type"])


@query("location_history", sql("SELECT item, place, min(created_us) AS first_us, max(created_us) AS last_us, count(*) AS events FROM op WHERE place IS NOT NULL GROUP BY item, place"))
def _(spark, d):
    return serve.location_history(Layers(spark, d).op)


@query("failure_history", sql("SELECT item, journey_id, created_us, place, CAST(row_number() OVER (PARTITION BY item ORDER BY created_us DESC, journey_id DESC) AS INTEGER) AS newest FROM op WHERE is_onset"))
def _(spark, d):
    return serve.failure_history(Layers(spark, d).op)


DRIFT = ["age_days", "total_prior_events", "prior_failure_count", "days_since_last_corrective"]


@query("drift_summary", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, CAST(median({c}) AS DOUBLE) AS median, avg(({c} IS NULL)::INT) AS missing_share FROM grid JOIN hist USING (cycle_id, at_us)" for c in DRIFT), **GRID, **HISTORY))
def _(spark, d):
    x = Layers(spark, d)
    return serve.drift(features.history(x.grid, x.op), DRIFT)


@query("category_coverage", sql("SELECT count(*) AS n, avg((coalesce(support, 0) < 300)::INT) AS unknown_share, count(DISTINCT a.model) AS active_models, count(DISTINCT a.model) FILTER (coalesce(support, 0) >= 300) AS known_models FROM act a LEFT JOIN (SELECT model, count(*) AS support FROM grid WHERE model IS NOT NULL GROUP BY model) t USING (model)", **GRID))
def _(spark, d):
    x = Layers(spark, d)
    return serve.coverage(observe.active(x.cycles), features.support_totals(x.grid), 300)


@query("risk_factors", sql(f"""SELECT g.cycle_id, g.at_us, 3 + CAST(prior_corrective_30d > 0 AS INT) + CAST(prior_corrective_count > 0 AS INT) + CAST(m.model_failures > 0 AS INT) + CAST(has_previous AS INT) + CAST(prior_distinct_places > 1 AS INT) - 1 AS factors,
    CASE WHEN prior_failure_365d > 0 THEN 'RECENT_FAILURE_HISTORY' WHEN prior_failure_count > 0 THEN 'OLDER_FAILURE_HISTORY' ELSE 'NO_FAILURE_HISTORY' END AS first_code, floor((g.at_us - g.installed_us) / {D}.0) AS age_value
    FROM grid g JOIN hist USING (cycle_id, at_us) JOIN m_found m ON m.g = coalesce(g.model, 'UNKNOWN') AND m.at_us = g.at_us""", **GRID, **HISTORY, **density("m", "coalesce(@.model, 'UNKNOWN')", {"model_failures": 90})))  # fmt: skip
def _(spark, d):
    x = Layers(spark, d)
    rows = serve.risk_factors(features.fleet(features.history(x.grid, x.op), x.cycles, x.episodes))
    age = F.element_at(F.filter("factors", lambda f: f["code"] == "INSTALLATION_AGE"), 1)["value"]
    return rows.select("cycle_id", "at_us", F.size("factors").alias("factors"), F.element_at("factors", 1)["code"].alias("first_code"), age.alias("age_value"))


@query("flagship", sql("""SELECT a.item, a.model, coalesce(f.n, 0) AS failures_365d, CASE WHEN coalesce(f.n, 0) >= 3 THEN 'HIGH' WHEN coalesce(f.n, 0) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, row_number() OVER (ORDER BY coalesce(f.n, 0) DESC, a.item) AS rank
    FROM act a LEFT JOIN (SELECT e.item, count(*) AS n FROM op e, boundary b WHERE e.is_onset AND e.created_us > b.data_end_us - 365 * 86400000000 GROUP BY e.item) f ON f.item = a.item""", **GRID))  # fmt: skip
def flagship(spark, d):
    """Active parts ranked by their failures of the last 365 days."""
    x = Layers(spark, d)
    rows = features.history(observe.active(x.cycles), x.op)
    n = F.col("prior_failure_365d")
    level = F.when(n >= 3, "HIGH").when(n >= 1, "MEDIUM").otherwise("LOW")
    return serve.ranked(rows.withColumn("failures_365d", n), "failures_365d").select("item", "model", "failures_365d", level.alias("level"), F.col("rank").cast("long").alias("rank"))
