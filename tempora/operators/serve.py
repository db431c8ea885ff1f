"""Score tables: decisions, ranked lists, filters, pages, summaries, roll-ups, monitoring, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import expr as X
from . import order

#: Priority, action and message of each pair of failure and scrap level; no scrap level where the part cannot be judged.
DECISIONS = [
    ("HIGH", "HIGH", "CRITICAL", "INSPECT_AND_PREPARE_REPLACEMENT", "Risiko kerusakan tinggi dan kecil kemungkinan bisa diperbaiki bila rusak. Periksa lebih awal dan siapkan unit pengganti."),
    ("HIGH", "MEDIUM", "HIGH", "PRIORITIZE_INSPECTION", "Risiko kerusakan tinggi. Dahulukan pemeriksaan, dan cek ketersediaan unit pengganti."),
    ("HIGH", "LOW", "HIGH", "PRIORITIZE_INSPECTION", "Risiko kerusakan tinggi, tetapi bila rusak umumnya masih bisa diperbaiki. Dahulukan pemeriksaan."),
    ("MEDIUM", "HIGH", "MEDIUM", "SCHEDULE_INSPECTION_AND_REVIEW_STOCK", "Risiko kerusakan sedang, tetapi bila rusak kecil kemungkinan bisa diperbaiki. Jadwalkan pemeriksaan dan tinjau stok pengganti."),
    ("MEDIUM", "MEDIUM", "MEDIUM", "SCHEDULE_INSPECTION", "Risiko kerusakan sedang. Jadwalkan pemeriksaan pada siklus terdekat."),
    ("MEDIUM", "LOW", "MEDIUM", "SCHEDULE_INSPECTION", "Risiko kerusakan sedang. Jadwalkan pemeriksaan pada siklus terdekat."),
    ("LOW", "HIGH", "LOW", "MONITOR", "Risiko kerusakan rendah. Belum perlu tindakan, tetapi bila nanti rusak kemungkinan besar tidak bisa diperbaiki."),
    ("LOW", "MEDIUM", "LOW", "MONITOR", "Risiko kerusakan rendah. Cukup dipantau."),
    ("LOW", "LOW", "LOW", "MONITOR", "Risiko kerusakan rendah. Cukup dipantau."),
    ("HIGH", None, "HIGH", "PRIORITIZE_INSPECTION", "Risiko kerusakan tinggi. Dahulukan pemeriksaan. Risiko scrap belum bisa dinilai untuk PART ini."),
    ("MEDIUM", None, "MEDIUM", "SCHEDULE_INSPECTION", "Risiko kerusakan sedang. Jadwalkan pemeriksaan. Risiko scrap belum bisa dinilai untuk PART ini."),
    ("LOW", None, "LOW", "MONITOR", "Risiko kerusakan rendah. Cukup dipantau. Risiko scrap belum bisa dinilai untuk PART ini."),
]


def recommended(scores: DataFrame) -> DataFrame:
    """Adds priority, action, message and is_replacement_candidate; an unknown level is an error."""
    table = scores.sparkSession.createDataFrame(DECISIONS, "_f string, _s string, priority string, action string, message string")
    out = scores.join(F.broadcast(table), (F.col("failure_level") == F.col("_f")) & F.col("scrap_level").eqNullSafe(F.col("_s")), "left")  # 12 rows
    known = F.when(F.col("priority").isNull(), F.raise_error(F.lit("unknown risk level"))).otherwise(F.col("priority"))
    candidate = F.col("failure_level").isin("MEDIUM", "HIGH") & (F.coalesce("scrap_level", F.lit("")) == "HIGH")
    return out.withColumn("priority", known).withColumn("is_replacement_candidate", candidate).drop("_f", "_s")


def ranked(scores: DataFrame, score: str = "score", key: str = "item") -> DataFrame:
    """Position by score, highest first and null last; equal scores by key. Ranges are sorted in parallel, sizes of earlier ones added."""
    out = order.sums_before(scores, [F.desc(score), F.asc(key)], {"rank": F.lit(1)})
    return out.withColumn("rank", F.col("rank") + 1)


def filtered(scores: DataFrame, risk: str | None = None, priority: str | None = None, kind: str | None = None, client: str | None = None, place: str | None = None, part: str | None = None, candidate: bool | None = None) -> DataFrame:
    """Case does not matter; a part of an id is taken literally."""
    same = lambda c, v: F.upper(c) == v.strip().upper()
    for column, value in (("failure_level", risk), ("priority", priority), ("item_type", kind), ("client", client), ("place", place)):
        if value:
            scores = scores.where(same(F.col(column), value))
    if part:
        scores = scores.where(F.upper("item").contains(part.strip().upper()))
    return scores if candidate is None else scores.where(F.col("is_replacement_candidate") == candidate)


def page(scores: DataFrame, offset: int, limit: int) -> DataFrame:
    return scores.orderBy("rank").offset(offset).limit(limit)


def page_with_total(scores: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: total (rows before the page is cut), returned, offset, items (the page's rows as structs in order of rank); a page beyond the end is empty and keeps its total."""
    rows = F.struct("rank", *[c for c in scores.columns if c != "rank"])
    items = page(scores, offset, limit).agg(F.sort_array(F.collect_list(rows)).alias("items"))  # at most limit rows
    total = scores.agg(F.count("*").alias("total"))
    return total.crossJoin(F.broadcast(items)).select("total", F.size("items").alias("returned"), F.lit(offset).alias("offset"), "items")  # one row each


def summary(scores: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("failure_level") == v).alias(f"failure_{v.lower()}") for v in ("HIGH", "MEDIUM", "LOW")]
    scrap = [F.count_if(F.coalesce("scrap_level", F.lit("")) == v).alias(f"scrap_{v.lower()}") for v in ("HIGH", "MEDIUM", "LOW")]
    return scores.agg(F.count("*").alias("total"), *levels, *scrap, F.count_if("is_replacement_candidate").alias("candidates"), F.count_if(F.col("priority") == "CRITICAL").alias("critical"))


def by_location(scores: DataFrame) -> DataFrame:
    return scores.where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("parts"), *[F.count_if(F.col("failure_level") == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")], F.count_if("is_replacement_candidate").alias("candidates"))


def facets(scores: DataFrame) -> DataFrame:
    """Sorted distinct values of each filter column, as (facet, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("item_type", "client", "place", "priority")])
    return scores.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()


def location_history(op: DataFrame) -> DataFrame:
    return op.where("place IS NOT NULL").groupBy("item", "place").agg(F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"), F.count("*").alias("events"))


def failure_history(op: DataFrame) -> DataFrame:
    """Failures with their number from the newest (1)."""
    w = Window.partitionBy("item").orderBy(F.desc("created_us"), F.desc("journey_id"))
    return op.where("is_onset").select("item", "journey_id", "created_us", "place", F.row_number().over(w).alias("newest"))


def score_distribution(scores: DataFrame, score: str = "score") -> DataFrame:
    q = order.quantiles(scores, score, [0.05, 0.25, 0.5, 0.75, 0.95]).select("q")
    one = scores.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.count(score).alias("n")).crossJoin(F.broadcast(q))  # one row each
    return one.select("min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))], "max", "mean", "n")


def drift(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and missing share of each column, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = rows.select(F.explode(pairs).alias("p")).select("p.*")
    middle = order.quantiles(long, "v", [0.5], "feature").select(F.col("feature").alias("_f"), F.col("q")[0].alias("median"))
    means = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.avg(F.col("v").isNull().cast("double")).alias("missing_share"))
    return means.join(F.broadcast(middle), F.col("feature") == F.col("_f"), "left").select("feature", "mean", "median", "missing_share")  # a row a column


def coverage(rows: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """How many rows fall on categories that training did not know well enough."""
    t = totals.select(F.col("model").alias("_m"), "support")
    both = rows.join(t, F.col("model") == F.col("_m"), "left")
    unknown = F.coalesce("support", F.lit(0)) < least
    return both.agg(F.count("*").alias("n"), F.avg(unknown.cast("double")).alias("unknown_share"), F.count_distinct("model").alias("active_models"), F.count_distinct(F.when(~unknown, F.col("model"))).alias("known_models"))


def statuses(asked: DataFrame, known: DataFrame, scored: DataFrame) -> DataFrame:
    """SCORED, NOT_SCORABLE or NOT_FOUND for each asked id."""
    ids = asked.select(X.normalise_id(F.col("item")).alias("item")).distinct()
    k = known.select(F.col("item").alias("_k")).distinct()
    s = scored.select(F.col("item").alias("_s")).distinct()
    both = ids.join(k, F.col("item") == F.col("_k"), "left").join(s, F.col("item") == F.col("_s"), "left")
    return both.select("item", F.when(F.col("_s").isNotNull(), "SCORED").when(F.col("_k").isNotNull(), "NOT_SCORABLE").otherwise("NOT_FOUND").alias("status"))


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str], rtol: float = 1e-9) -> DataFrame:
    """Differences of two snapshots by key and column with both values as text: missing on a side, or apart by more than rtol; null equals null."""

    def differs(a: Column, b: Column, kind: str) -> Column:
        if kind in ("double", "float"):
            near = F.abs(a - b) <= rtol * F.greatest(F.abs(a), F.abs(b))
            return ~F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)
        return ~a.eqNullSafe(b)

    kinds = dict(left.dtypes)
    l_, r_ = (df.select(F.col(key).alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in columns]) for df, p in ((left, "l"), (right, "r")))
    both = l_.join(r_, F.col("l_key") == F.col("r_key"), "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").cast("string").alias("left"), F.col(f"r_{c}").cast("string").alias("right"), differs(F.col(f"l_{c}"), F.col(f"r_{c}"), kinds[c]).alias("differs")) for c in columns])
    side = F.when(F.col("r_key").isNull(), "LEFT_ONLY").when(F.col("l_key").isNull(), "RIGHT_ONLY").otherwise("CHANGED")
    out = both.select(F.coalesce("l_key", "r_key").alias(key), side.alias("kind"), F.explode(cells).alias("c")).where((F.col("kind") != "CHANGED") | F.col("c.differs"))
    changed = F.col("kind") == "CHANGED"
    shown = lambda c, name: F.when(changed, F.col(f"c.{c}")).alias(name)
    return out.select(key, "kind", shown("column", "column"), shown("left", "left_value"), shown("right", "right_value")).distinct()


def risk_factors(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Up to nine conditional factors a row, as an array of (code, direction, value)."""
    factor = lambda code, way, value: F.struct(F.lit(code).alias("code"), F.lit(way).alias("direction"), F.round(value.cast("double"), 4).alias("value"))
    c = lambda n: F.coalesce(n, F.lit(0))
    oldest = cfg.age_bands[-1][0]
    factors = F.array(
        F.when(c("prior_failure_365d") > 0, factor("RECENT_FAILURE_HISTORY", "RISK", F.col("prior_failure_365d"))),
        F.when((c("prior_failure_365d") == 0) & (c("prior_failure_count") > 0), factor("OLDER_FAILURE_HISTORY", "CONTEXT", F.col("prior_failure_count"))),
        F.when((c("prior_failure_365d") == 0) & (c("prior_failure_count") == 0), factor("NO_FAILURE_HISTORY", "MITIGATING", F.lit(0))),
        F.when(c("prior_corrective_30d") > 0, factor("RECENT_CORRECTIVE_MAINTENANCE", "RISK", F.col("prior_corrective_30d"))),
        F.when((c("prior_corrective_count") > 0) & F.col("days_since_last_corrective").isNotNull(), factor("CORRECTIVE_HISTORY", "CONTEXT", F.floor("days_since_last_corrective"))),
        F.when(c("age_days") >= oldest, factor("INSTALLATION_AGE", "RISK", F.floor("age_days"))).otherwise(factor("INSTALLATION_AGE", "CONTEXT", F.floor("age_days"))),
        F.when(c("model_failures") > 0, factor("FLEET_CONDITION", "RISK", F.col("model_failure_rate_90d"))),
        F.when(F.coalesce("has_previous", F.lit(False)), factor("PREVIOUS_CYCLE_LIFETIME", "CONTEXT", F.floor("previous_mean_days"))),
        F.when(c("prior_distinct_places") > 1, factor("LOCATION_CHANGES", "CONTEXT", F.col("prior_distinct_places"))),
    )
    return rows.withColumn("factors", F.array_compact(factors))


def death_risk(scores: DataFrame) -> DataFrame:
    return scores.withColumn("death_risk", F.round(F.col("failure_probability") * F.col("scrap_probability"), 5))

