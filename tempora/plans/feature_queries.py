"""Queries on observations, point-in-time features, lifecycles and outcomes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import features, observe, outcome, silver
from ..sources.journal import Journal
from .oracle import DAY, l1, sql
from .registry import query


class Layers:
    """The layers of one run: events, cycles and episodes are written once and read by everything above."""

    def __init__(self, spark, d):
        self.j = Journal(spark, d)

    @cached_property
    def sem(self):
        return stored(silver.semantic(self.j), "event")

    @cached_property
    def identity(self):
        return silver.inventory_identity(self.j)

    @property
    def op(self):
        return silver.operational(self.sem)

    @cached_property
    def cycles(self):
        return stored(silver.cycles(self.sem, self.identity), "cycle")

    @cached_property
    def episodes(self):
        return stored(silver.episodes(self.sem, self.identity), "episode")

    @property
    def grid(self):
        return observe.grid(self.cycles)

    @property
    def observed(self):
        """The grid with what its cycles say of earlier ones, and only the columns that features need."""
        return observe.grid(features.previous_cycles(self.cycles)).select("cycle_id", "item", "at_us", "target", "eligible", "data_end_us", "age_days", "model", "client", "item_type", "previous_mean_days", "has_previous", "cumulative_prior_days", "previous_cycles")


def year(us: str, add: int = 0) -> str:
    return f"epoch_us(make_timestamp(year(make_timestamp({us})) + {add}, 1, 1, 0, 0, 0))"


GRID = {
    "grid0": f"SELECT *, unnest(range(0, CAST(floor((end_us - installed_us - 1) / (30 * {DAY})) AS BIGINT) + 1)) AS k FROM cycle WHERE in_cohort AND installed_us < end_us",
    "grid1": f"SELECT *, installed_us + k * 30 * {DAY} AS at_us, coalesce(onset_us > installed_us + k * 30 * {DAY} AND onset_us <= installed_us + (k + 1) * 30 * {DAY}, FALSE) AS target FROM grid0",
    "grid": f"SELECT *, target OR (verified AND at_us <= last_confirmable_us) AS eligible, (at_us - installed_us) / {DAY}.0 AS age_days FROM grid1",
    "act": f"SELECT *, data_end_us AS at_us, (data_end_us - installed_us) / {DAY}.0 AS age_days FROM cycle WHERE in_cohort AND end_reason = 'RIGHT_CENSORED_AT_DATA_END'",
}


@query("obs_grid", sql("SELECT cycle_id, at_us, age_days FROM grid", **GRID))
def _(spark, d):
    return Layers(spark, d).grid.select("cycle_id", "at_us", "age_days")


@query("obs_labels", sql("SELECT cycle_id, at_us, target, eligible FROM grid", **GRID))
def _(spark, d):
    return Layers(spark, d).grid.select("cycle_id", "at_us", "target", "eligible")


SPLIT = f"""CASE WHEN at_us >= {year('data_end_us')} THEN 'TEST' WHEN at_us >= {year('data_end_us', -1)} AND at_us + 30 * {DAY} < {year('data_end_us')} THEN 'VALIDATION'
    WHEN at_us >= 820454400000000 AND at_us + 30 * {DAY} < {year('data_end_us', -1)} THEN 'TRAIN' WHEN at_us < 820454400000000 THEN 'EXCLUDED_TOO_OLD' ELSE 'EXCLUDED_EMBARGO' END"""


@query("obs_split", sql(f"SELECT split, count(*) AS n, count(DISTINCT cycle_id) AS lifecycles, CAST(sum(target::INT) AS BIGINT) AS events FROM (SELECT *, {SPLIT} AS split FROM grid) GROUP BY split", **GRID))
def _(spark, d):
    o = observe.with_split(Layers(spark, d).grid)
    return o.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("cycle_id").alias("lifecycles"), F.sum(F.col("target").cast("long")).alias("events"))


@query("active_snapshot", sql("SELECT cycle_id, item, at_us, age_days FROM act", **GRID))
def _(spark, d):
    return observe.active(Layers(spark, d).cycles).select("cycle_id", "item", "at_us", "age_days")


def count_of(cond: str, low: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond} AND {low}) AS BIGINT)"


ALL, D = "TRUE", DAY
HISTORY = {
    "hist": f"""SELECT g.cycle_id, g.at_us,
        {count_of('e.item IS NOT NULL', ALL)} AS total_prior_events, {count_of('e.is_onset', ALL)} AS prior_failure_count, {count_of("e.wo_type = 'CORRECTIVE'", ALL)} AS prior_corrective_count,
        {count_of("e.wo_type = 'CORRECTIVE'", f'e.created_us > g.at_us - 30 * {D}')} AS prior_corrective_30d, {count_of("e.wo_type = 'CORRECTIVE'", f'e.created_us > g.at_us - 60 * {D}')} AS prior_corrective_60d,
        {count_of("e.wo_type = 'CORRECTIVE'", f'e.created_us > g.at_us - 90 * {D}')} AS prior_corrective_90d, {count_of('e.item IS NOT NULL', f'e.created_us > g.at_us - 180 * {D}')} AS prior_events_180d,
        {count_of('e.is_onset', f'e.created_us > g.at_us - 365 * {D}')} AS prior_failure_365d, count(DISTINCT e.place) AS prior_distinct_places,
        (g.at_us - max(e.created_us) FILTER (WHERE e.wo_type = 'CORRECTIVE')) / {D}.0 AS days_since_last_corrective
        FROM grid g LEFT JOIN op e ON e.item = g.item AND e.created_us <= g.at_us GROUP BY g.cycle_id, g.at_us"""
}


def history(spark, d, *cols):
    x = Layers(spark, d)
    return features.history(x.grid, x.op).select("cycle_id", "at_us", *cols)


for _name, _cols in {
    "history_counts": ("total_prior_events", "prior_failure_count", "prior_corrective_count"),
    "history_windows": ("prior_corrective_30d", "prior_events_180d", "prior_failure_365d"),
    "distinct_places": ("prior_distinct_places",),
    "last_corrective": ("days_since_last_corrective",),
    "corrective_60_90": ("prior_corrective_60d", "prior_corrective_90d"),
}.items():
    query(_name, sql(f"SELECT cycle_id, at_us, {', '.join(_cols)} FROM hist", **GRID, **HISTORY))(lambda spark, d, cols=_cols: history(spark, d, *cols))

TREND = {
    "fail": f"SELECT item, created_us, row_number() OVER w AS n, (created_us - lag(created_us) OVER w) / {D}.0 AS gap FROM op WHERE is_onset WINDOW w AS (PARTITION BY item ORDER BY created_us, journey_id)",
    "fail2": "SELECT *, avg(gap) OVER (PARTITION BY item ORDER BY n ROWS UNBOUNDED PRECEDING) AS mean_gap FROM fail",
    "trend0": "SELECT g.cycle_id, g.item, g.at_us, max(f.n) AS n FROM grid g LEFT JOIN fail2 f ON f.item = g.item AND f.created_us < g.at_us GROUP BY ALL",
    "trend": """SELECT t.cycle_id, t.at_us, coalesce(t.n >= 3, FALSE) AS has_failure_interval_trend, ln(1 + CASE WHEN t.n >= 3 THEN mean_gap ELSE 0 END) AS log_failure_interval_mean_days, ln(1 + CASE WHEN t.n >= 3 THEN gap ELSE 0 END) AS log_failure_interval_last_days,
        CASE WHEN t.n >= 3 AND mean_gap > 0 THEN least(gap / mean_gap, 10) ELSE 1 END AS failure_interval_trend_ratio FROM trend0 t LEFT JOIN fail2 f ON f.item = t.item AND f.n = t.n""",
}


@query("interval_trend", sql("SELECT * FROM trend", **GRID, **TREND))
def _(spark, d):
    x = Layers(spark, d)
    return features.interval_trend(x.grid, x.op).select("cycle_id", "at_us", "has_failure_interval_trend", "log_failure_interval_mean_days", "log_failure_interval_last_days", "failure_interval_trend_ratio")


def density(name: str, key: str, windows: dict[str, int]) -> dict[str, str]:
    """Counts by brute force over distinct (group, time)."""
    fails = ", ".join(f"(SELECT count(*) FROM episode e WHERE e.in_cohort AND {key.replace('@', 'e')} = a.g AND e.onset_us < a.at_us AND e.onset_us >= a.at_us - {w} * {D}) AS {n}" for n, w in windows.items())
    return {
        f"{name}_asked": f"SELECT DISTINCT {key.replace('@', 'o')} AS g, at_us FROM grid o",
        f"{name}_found": f"""SELECT g, at_us, {fails}, greatest((SELECT count(*) FROM cycle y WHERE y.in_cohort AND {key.replace('@', 'y')} = a.g AND y.installed_us < a.at_us) - (SELECT count(*) FROM cycle y WHERE y.in_cohort AND {key.replace('@', 'y')} = a.g AND y.end_us < a.at_us), 0) AS units FROM {name}_asked a""",
    }


@query(
    "fleet_asof",
    sql("SELECT o.cycle_id, o.at_us, f.model_failures, f.units AS model_units, f.model_failures / greatest(f.units, 1) AS model_failure_rate_90d FROM grid o JOIN m_found f ON f.g = coalesce(o.model, 'UNKNOWN') AND f.at_us = o.at_us", **GRID, **density("m", "coalesce(@.model, 'UNKNOWN')", {"model_failures": 90})),
)
def _(spark, d):
    x = Layers(spark, d)
    return features.fleet(x.grid, x.cycles, x.episodes).select("cycle_id", "at_us", "model_failures", "model_units", "model_failure_rate_90d")


@query(
    "type_density",
    sql("SELECT o.cycle_id, o.at_us, f.type_failures_90d, f.type_failures_180d, f.type_failures_90d / greatest(f.units, 1) AS item_type_failure_rate_90d, f.type_failures_180d / greatest(f.units, 1) AS item_type_failure_rate_180d FROM grid o JOIN t_found f ON f.g = o.item_type AND f.at_us = o.at_us", **GRID, **density("t", "@.item_type", {"type_failures_90d": 90, "type_failures_180d": 180})),
)
def _(spark, d):
    x = Layers(spark, d)
    return features.type_density(x.grid, x.cycles, x.episodes).select("cycle_id", "at_us", "type_failures_90d", "type_failures_180d", "item_type_failure_rate_90d", "item_type_failure_rate_180d")


def _snapshot_sql(group: str, days: int) -> str:
    return sql(
        f"""SELECT coalesce(u.g, f.g) AS {group}, coalesce(failures, 0) AS failures, coalesce(units, 0) AS units, coalesce(failures, 0) / greatest(coalesce(units, 0), 1) AS rate FROM
        (SELECT {group} AS g, greatest(count(*) FILTER (WHERE installed_us < data_end_us) - count(*) FILTER (WHERE end_us < data_end_us), 0) AS units FROM cycle WHERE in_cohort AND {group} IS NOT NULL GROUP BY 1) u
        FULL JOIN (SELECT {group} AS g, count(*) AS failures FROM episode, boundary WHERE in_cohort AND {group} IS NOT NULL AND onset_us < data_end_us AND onset_us >= data_end_us - {days} * {D} GROUP BY 1) f ON u.g = f.g"""
    )


@query("fleet_snapshot", _snapshot_sql("model", 90))
def _(spark, d):
    x = Layers(spark, d)
    return features.fleet_snapshot(x.cycles, x.episodes, 90)


@query("density_snapshot", _snapshot_sql("item_type", 180))
def _(spark, d):
    x = Layers(spark, d)
    return features.fleet_snapshot(x.cycles, x.episodes, 180, "item_type")


SUPPORT = {
    "sup_n": "SELECT model, at_us, count(*) AS n FROM grid WHERE model IS NOT NULL GROUP BY ALL",
    "sup": "SELECT model, at_us, CAST(sum(n) OVER (PARTITION BY model ORDER BY at_us) AS BIGINT) AS support FROM sup_n",
}


@query("pit_support", sql("SELECT g.cycle_id, g.at_us, CASE WHEN g.model IS NULL THEN NULL ELSE s.support END AS support FROM grid g LEFT JOIN sup s ON s.model = g.model AND s.at_us = g.at_us", **GRID, **SUPPORT))
def _(spark, d):
    g = Layers(spark, d).grid
    return features.support_asof(g, g).select("cycle_id", "at_us", F.when(F.col("model").isNotNull(), F.col("support")).alias("support"))


@query("support_totals", sql("SELECT model, count(*) AS support FROM grid WHERE model IS NOT NULL GROUP BY model", **GRID))
def _(spark, d):
    return features.support_totals(Layers(spark, d).grid)


@query("rare_category", sql("SELECT cycle_id, at_us, CASE WHEN g.model IS NULL THEN 'UNKNOWN' WHEN coalesce(s.support, 0) < 300 THEN 'LOW_HISTORICAL_SUPPORT' ELSE g.model END AS category FROM grid g LEFT JOIN sup s USING (model, at_us)", **GRID, **SUPPORT))
def _(spark, d):
    from ..functions.expr import collapse

    g = Layers(spark, d).grid
    return features.support_asof(g, g).select("cycle_id", "at_us", collapse(F.col("model"), F.col("support")).alias("category"))


@query("month_cycle", sql("SELECT cycle_id, at_us, sin(2 * pi() * (month(make_timestamp(at_us)) - 1) / 12) AS month_sin, cos(2 * pi() * (month(make_timestamp(at_us)) - 1) / 12) AS month_cos FROM grid", **GRID))
def _(spark, d):
    from ..functions.expr import month_of

    angle = 2 * F.pi() * (month_of(F.col("at_us")) - 1) / 12
    return Layers(spark, d).grid.select("cycle_id", "at_us", F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"))


PREVIOUS = {
    "lived": f"SELECT *, (end_us - installed_us) / {D}.0 AS lived FROM cycle",
    "prev": """SELECT c.cycle_id, c.item, c.seq, coalesce(sum(greatest(p.lived, 0)), 0.0) AS cumulative_prior_days, count(p.seq) AS previous_cycles, avg(p.lived) FILTER (WHERE p.end_reason = 'FAILURE') AS confirmed_mean_days,
        arg_max(p.lived, p.seq) FILTER (WHERE p.end_reason = 'FAILURE') AS confirmed_last_days, coalesce(arg_max(p.end_reason, p.seq), 'NONE_FIRST_CYCLE') AS previous_end_reason
        FROM cycle c LEFT JOIN lived p ON p.item = c.item AND p.seq < c.seq GROUP BY c.cycle_id, c.item, c.seq""",
}


@query("previous_cycle_stats", sql("SELECT cycle_id, previous_mean_days, has_previous FROM cycle"))
def _(spark, d):
    return Layers(spark, d).cycles.select("cycle_id", "previous_mean_days", "has_previous")


@query("confirmed_failure_stats", sql("SELECT cycle_id, confirmed_mean_days, confirmed_last_days, previous_end_reason FROM prev", **PREVIOUS))
def _(spark, d):
    return features.previous_cycles(Layers(spark, d).cycles).select("cycle_id", "confirmed_mean_days", "confirmed_last_days", "previous_end_reason")


@query("cumulative_age", sql("SELECT cycle_id, cumulative_prior_days, previous_cycles FROM prev", **PREVIOUS))
def _(spark, d):
    return features.previous_cycles(Layers(spark, d).cycles).select("cycle_id", "cumulative_prior_days", "previous_cycles")


BANDS = "CASE WHEN age_days < 91 THEN '000_090_DAYS' WHEN age_days < 181 THEN '091_180_DAYS' WHEN age_days < 366 THEN '181_365_DAYS' WHEN age_days < 731 THEN '366_730_DAYS' WHEN age_days < 1461 THEN '731_1460_DAYS' ELSE '1461_PLUS_DAYS' END"
FRAME = f"""SELECT g.cycle_id, g.at_us, g.target, g.eligible, CASE WHEN g.model IS NULL THEN 'UNKNOWN' WHEN coalesce(s.support, 0) < 300 THEN 'LOW_HISTORICAL_SUPPORT' ELSE g.model END AS part_model_category,
    coalesce(client, 'UNKNOWN') AS client_category, {BANDS} AS installation_age_band, {l1('age_days')} AS log_days_since_installation, {l1('total_prior_events')} AS log_total_prior_events, {l1('prior_failure_count')} AS log_prior_failure_count,
    CAST(prior_failure_count > 0 AS DOUBLE) AS has_prior_failure, {l1('prior_corrective_count')} AS log_prior_corrective_count, CAST(prior_corrective_count > 0 AS DOUBLE) AS has_prior_corrective, {l1('days_since_last_corrective')} AS log_days_since_last_corrective,
    {l1('prior_distinct_places')} AS log_prior_distinct_places, {l1('prior_corrective_30d')} AS log_prior_corrective_30d, {l1('prior_failure_365d')} AS log_prior_failure_365d, {l1('prior_events_180d')} AS log_prior_events_180d,
    {l1('previous_mean_days')} AS log_previous_cycle_lifetime_mean, CAST(has_previous AS DOUBLE) AS has_previous_cycle, sin(2 * pi() * (month(make_timestamp(g.at_us)) - 1) / 12) AS month_sin, cos(2 * pi() * (month(make_timestamp(g.at_us)) - 1) / 12) AS month_cos,
    {l1('m.model_failures')} AS log_model_failures_90d, CAST(m.model_failures / greatest(m.units, 1) AS DOUBLE) AS model_failure_rate_90d, {l1('m.units')} AS log_model_fleet_size, {l1('cumulative_prior_days')} AS log_cumulative_prior_cycle_days,
    {l1('previous_cycles')} AS log_previous_cycle_count, CAST(has_failure_interval_trend AS DOUBLE) AS has_failure_interval_trend, log_failure_interval_mean_days, CAST(failure_interval_trend_ratio AS DOUBLE) AS failure_interval_trend_ratio,
    {l1('prior_corrective_60d')} AS log_prior_corrective_60d, {l1('prior_corrective_90d')} AS log_prior_corrective_90d, {l1('t.type_failures_90d')} AS log_item_type_failures_90d, CAST(t.type_failures_90d / greatest(t.units, 1) AS DOUBLE) AS item_type_failure_rate_90d,
    {l1('t.type_failures_180d')} AS log_item_type_failures_180d, CAST(t.type_failures_180d / greatest(t.units, 1) AS DOUBLE) AS item_type_failure_rate_180d
    FROM grid g JOIN hist USING (cycle_id, at_us) JOIN trend USING (cycle_id, at_us) JOIN prev USING (cycle_id) LEFT JOIN sup s ON s.model = g.model AND s.at_us = g.at_us
    JOIN m_found m ON m.g = coalesce(g.model, 'UNKNOWN') AND m.at_us = g.at_us JOIN t_found t ON t.g = g.item_type AND t.at_us = g.at_us"""
EVERY = GRID | HISTORY | TREND | PREVIOUS | SUPPORT | density("m", "coalesce(@.model, 'UNKNOWN')", {"model_failures": 90}) | density("t", "@.item_type", {"type_failures_90d": 90, "type_failures_180d": 180})


@query("feature_frame", sql(FRAME, **EVERY))
def _(spark, d):
    x = Layers(spark, d)
    return features.classifier_features(features.all_features(x.observed, x.op, x.cycles, x.episodes)).drop("item")


LIFE = {
    "life0": f"SELECT *, CASE WHEN installed_us >= {year('data_end_us')} THEN 'TEST' WHEN installed_us >= {year('data_end_us', -1)} THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM cycle WHERE in_cohort AND installed_us < end_us",
    "life1": f"SELECT *, CASE split WHEN 'TRAIN' THEN {year('data_end_us', -1)} WHEN 'VALIDATION' THEN {year('data_end_us')} ELSE data_end_us END AS cutoff_us FROM life0",
    "life": f"SELECT *, end_reason = 'FAILURE' AND end_us <= cutoff_us AS event, greatest(round_even((least(end_us, cutoff_us) - installed_us) / {D}.0, 0), 1.0) AS duration_days, (end_reason = 'FAILURE' AND end_us <= cutoff_us) OR verified OR end_us > cutoff_us AS usable FROM life1",
}


@query("lifecycle_outcome", sql("SELECT cycle_id, split, cutoff_us, event, duration_days, usable FROM life", **LIFE))
def _(spark, d):
    return observe.lifecycle_outcome(Layers(spark, d).cycles).select("cycle_id", "split", "cutoff_us", "event", "duration_days", "usable")


MARKS = LIFE | dict(
    org0=f"SELECT DISTINCT cycle_id, duration_days, round_even((e.created_us - installed_us) / {D}.0, 0) AS age FROM life l JOIN op e ON e.item = l.item AND e.created_us > installed_us AND e.created_us < installed_us + CAST(round_even(duration_days, 0) AS BIGINT) * {D} WHERE usable",
    org="SELECT cycle_id, age FROM (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY age DESC) AS r FROM org0 WHERE age > 0 AND age < duration_days) WHERE r <= 8",
    mark="""SELECT cycle_id, age, min(source) AS source FROM (SELECT cycle_id, 0.0 AS age, 0 AS source FROM life WHERE usable UNION ALL SELECT cycle_id, age, 1 FROM org
        UNION ALL SELECT cycle_id, CAST(a AS DOUBLE), 2 FROM life, unnest([90, 180, 365, 730, 1095, 1460, 1825, 2190]) t(a) WHERE usable AND a < duration_days) GROUP BY cycle_id, age""",
)


@query(
    "landmarks",
    sql(
        f"SELECT cycle_id, l.item, split, age, CASE source WHEN 0 THEN 'INSTALL' WHEN 1 THEN 'ORGANIC_EVENT' ELSE 'ANCHOR' END AS source, installed_us + CAST(age AS BIGINT) * {D} AS at_us, duration_days - age AS residual_days, event FROM mark JOIN life l USING (cycle_id) WHERE age < duration_days",
        **MARKS,
    ),
)
def _(spark, d):
    x = Layers(spark, d)
    return observe.landmarks(observe.lifecycle_outcome(x.cycles), x.op)


OUTCOME = {
    "o1": f"""SELECT e.*, (SELECT min(created_us) FROM op x WHERE x.item = e.item AND x.status = 'INSTALLED' AND (x.created_us > e.onset_us OR (x.created_us = e.onset_us AND x.journey_id > e.onset_journey_id))) AS ins_us,
        (SELECT min(created_us) FROM op x WHERE x.item = e.item AND x.is_onset AND (x.created_us > e.onset_us OR (x.created_us = e.onset_us AND x.journey_id > e.onset_journey_id))) AS fail_us,
        (SELECT count(*) FROM op x WHERE x.item = e.item AND x.status = 'REPAIRED' AND (x.created_us < e.onset_us OR (x.created_us = e.onset_us AND x.journey_id <= e.onset_journey_id))) AS prior_repaired_count,
        (SELECT count(*) FROM op x WHERE x.item = e.item AND x.is_onset AND (x.created_us < e.onset_us OR (x.created_us = e.onset_us AND x.journey_id <= e.onset_journey_id))) AS prior_failure_count,
        (SELECT min(created_us) FROM op x WHERE x.item = e.item) AS first_us, (SELECT max(installed_us) FROM cycle x WHERE x.item = e.item AND x.installed_us <= e.onset_us) AS install_us,
        (SELECT arg_min(x.status, x.ord) FROM op x WHERE x.item = e.item AND x.status IN ('UNREPAIRABLE', 'BROKEN', 'SENDLOG (BROKEN)', 'REPAIRED') AND x.created_us >= e.onset_us) AS v_status,
        (SELECT min(x.created_us) FROM op x WHERE x.item = e.item AND x.status IN ('UNREPAIRABLE', 'BROKEN', 'SENDLOG (BROKEN)', 'REPAIRED') AND x.created_us >= e.onset_us) AS v_us FROM episode e""",
    "o2": "SELECT *, CASE WHEN least(ins_us, fail_us) IS NULL OR v_us <= least(ins_us, fail_us) THEN v_status END AS outcome, ins_us IS NOT NULL AS was_reinstalled FROM o1",
    "o3": f"""SELECT onset_journey_id, item, onset_us, item_type, model, in_cohort, outcome, was_reinstalled, prior_repaired_count, prior_failure_count, (onset_us - first_us) / {D}.0 AS age_total_days, (onset_us - install_us) / {D}.0 AS cycle_age_days,
        CAST(coalesce(outcome IN ('UNREPAIRABLE', 'BROKEN'), FALSE) AS INTEGER) AS is_scrap,
        (coalesce(outcome IN ('UNREPAIRABLE', 'BROKEN'), FALSE) OR coalesce(outcome = 'REPAIRED', FALSE) OR was_reinstalled) AND onset_us <= (SELECT data_end_us FROM boundary) - 30 * {D} AS is_labeled FROM o2""",
}


def resolved(x: Layers):
    return outcome.resolve(x.episodes, x.op, x.cycles)


@query("episode_outcomes", sql("SELECT * FROM o3", **OUTCOME))
def _(spark, d):
    return resolved(Layers(spark, d)).drop("known_us")


@query("asof_install", sql("SELECT onset_journey_id, item, onset_us, install_us FROM o1", **OUTCOME))
def _(spark, d):
    x = Layers(spark, d)
    return outcome.asof_install(x.episodes, x.cycles)


@query(
    "scrap_features",
    sql(
        f"""SELECT onset_journey_id, item, onset_us, is_scrap, is_labeled, CASE WHEN item_type IN (SELECT item_type FROM o3 WHERE is_labeled GROUP BY item_type HAVING count(*) >= 20) THEN item_type ELSE 'LOW_SUPPORT' END AS type_category,
        {l1('age_total_days')} AS log_age_total_days, {l1('cycle_age_days')} AS log_cycle_age_days, {l1('prior_repaired_count')} AS log_prior_repaired, {l1('prior_failure_count')} AS log_prior_failures, prior_repaired_count > 0 AS has_prior_repaired, prior_failure_count > 1 AS has_repeat_failure
        FROM o3 WHERE in_cohort AND onset_us >= 883612800000000""",
        **OUTCOME,
    ),
)
def _(spark, d):
    r = resolved(Layers(spark, d))
    cohort = r.where(F.col("in_cohort") & (F.col("onset_us") >= F.unix_micros(F.lit("1998-01-01").cast("timestamp"))))
    return outcome.scrap_features(cohort, outcome.known_types(r))


@query(
    "current_state",
    sql(
        f"""SELECT a.item, a.cycle_id, (SELECT arg_max(x.item_type, x.ord) FROM op x WHERE x.item = a.item AND x.item_type IS NOT NULL) AS item_type, (SELECT arg_max(x.place, x.ord) FROM op x WHERE x.item = a.item AND x.place IS NOT NULL) AS last_place,
        (a.data_end_us - (SELECT min(created_us) FROM op x WHERE x.item = a.item)) / {D}.0 AS age_total_days, (a.data_end_us - a.installed_us) / {D}.0 AS cycle_age_days,
        (SELECT count(*) FROM op x WHERE x.item = a.item AND x.status = 'REPAIRED') AS prior_repaired_count, (SELECT count(*) FROM op x WHERE x.item = a.item AND x.is_onset) AS prior_failure_count FROM act a""",
        **GRID,
    ),
)
def _(spark, d):
    x = Layers(spark, d)
    return outcome.current_state(x.op, x.cycles)


@query("install_context", sql("SELECT cycle_id, coalesce(item_type, 'UNKNOWN') AS type_at_install, coalesce(place, 'UNKNOWN') AS place_at_install FROM cycle"))
def _(spark, d):
    return Layers(spark, d).cycles.select("cycle_id", F.coalesce("item_type", F.lit("UNKNOWN")).alias("type_at_install"), F.coalesce("place", F.lit("UNKNOWN")).alias("place_at_install"))
