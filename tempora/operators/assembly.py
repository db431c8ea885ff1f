"""Scores of all models brought together: the ranked table, assessments of asked parts, monitoring of scrap, folds, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN
from ..functions import expr as X
from . import order, serve


def assembled(failure: DataFrame, scrap: DataFrame, advisory: DataFrame, context: DataFrame) -> DataFrame:
    """The ranked table: failure scores (one row an item) with scrap, survival advisory and context where there is one, decided and ranked by `score`.

    All four are keyed by item and joined on it alone, so one partitioning by item serves the three joins.
    """
    out = failure.join(scrap, "item", "left").join(advisory, "item", "left").join(context, "item", "left")
    return serve.ranked(serve.death_risk(serve.recommended(out)))


def assessed(asked: DataFrame, known: DataFrame, table: DataFrame, factors: DataFrame, notes: DataFrame) -> DataFrame:
    """(item, status, failure, scrap, survival, decision, factors, caveats) of each asked id; structs are null where nothing is scored.

    `table` is the ranked table of the batch, so that single assessments cannot differ from it.
    """
    status = serve.statuses(asked, known, table)
    scored = table.select(
        "item",
        F.struct("failure_probability", "failure_level", "rank").alias("failure"),
        F.when(F.col("scrap_probability").isNotNull(), F.struct("scrap_probability", "scrap_level")).alias("scrap"),
        F.when(F.col("median_days").isNotNull(), F.struct("median_days", "medium_days", "high_days")).alias("survival"),
        F.struct("priority", "action", "is_replacement_candidate", "death_risk").alias("decision"),
    )
    return status.join(scored, "item", "left").join(factors.select("item", "factors"), "item", "left").join(notes.select("item", "caveats"), "item", "left")


def scrap_monitoring(scores: DataFrame, known_types: DataFrame) -> DataFrame:
    """One row: scored parts, mean scrap probability, parts by level, share of parts whose type training did not know (of those with a type)."""
    k = known_types.select(F.col("item_type").alias("_k")).distinct()
    both = scores.join(k, F.col("item_type") == F.col("_k"), "left")
    unknown = F.when(F.col("item_type").isNotNull(), F.col("_k").isNull().cast("double"))
    levels = [F.count_if(F.coalesce("scrap_level", F.lit("")) == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")]
    return both.agg(F.count("scrap_probability").alias("scored"), F.avg("scrap_probability").alias("mean_probability"), *levels, F.coalesce(F.avg(unknown), F.lit(0.0)).alias("unknown_type_share"))


def monitoring(scores: DataFrame, trained_high_share: DataFrame) -> DataFrame:
    """One row: score distribution of the live table, its share of HIGH, and how that compares with the share in training."""
    live = serve.score_distribution(scores, "failure_probability").crossJoin(F.broadcast(scores.agg(F.avg((F.col("failure_level") == "HIGH").cast("double")).alias("high_share"))))
    return live.crossJoin(F.broadcast(trained_high_share)).withColumn("high_ratio", F.try_divide("high_share", "trained_high_share"))  # one row each


def flagged(rows: DataFrame, cuts: dict[str, float], score: str = "score") -> DataFrame:
    """One row: how many rows reach each fixed cut-off."""
    return rows.agg(*[F.count_if(F.col(score) >= v).alias(n) for n, v in cuts.items()], F.count(score).alias("n"))


def terminal_context(cycles: DataFrame, links: DataFrame) -> DataFrame:
    """cycles with type and model of the terminal they were installed in, by links valid at that time only; UNKNOWN without one."""
    good = links.where("link_state = 'VALID_POINT_IN_TIME_RELATION'").groupBy(F.col("item").alias("_i"), F.col("installed_us").alias("_t")).agg(F.min("terminal_type").alias("terminal_type"), F.min("terminal_model").alias("terminal_model"))
    out = cycles.join(good, (F.col("item") == F.col("_i")) & (F.col("installed_us") == F.col("_t")), "left").drop("_i", "_t")
    return out.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("terminal_type", "terminal_model")})


def previous_cycle_columns(rows: DataFrame) -> DataFrame:
    """Logs of the confirmed lifetimes before, 0 without one, and whether there is one."""
    return rows.withColumns({f"log_{c}": X.log1p0(F.col(c)) for c in ("confirmed_mean_days", "confirmed_last_days")} | {f"has_{c}": F.col(c).isNotNull() for c in ("confirmed_mean_days", "confirmed_last_days")})


def grouped_folds(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """rows with a fold from the key's digest, so that all rows of a key share it at any partitioning."""
    return rows.withColumn("fold", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % n).cast("int"))


def share_below(rows: DataFrame, score: Column, name: str) -> DataFrame:
    """rows with the share of other rows of a smaller score (0 to 1): sums run over the distinct scores."""
    by = rows.groupBy(score.alias("_s")).agg(F.count("*").alias("_n"))
    below = order.sums_before(by, [F.asc("_s")], {"_b": F.col("_n")}).select("_s", "_b")
    every = rows.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("_all"))
    return rows.join(below, score.eqNullSafe(F.col("_s"))).crossJoin(F.broadcast(every)).withColumn(name, F.col("_b") / F.col("_all")).drop("_s", "_b", "_all")  # one row


def ensembles(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with the mean, the maximum and the mean rank of two scores."""
    ranks = share_below(share_below(rows, F.col(a), "_ra"), F.col(b), "_rb")
    return ranks.withColumns({"mean": (F.col(a) + F.col(b)) / 2, "highest": F.greatest(a, b), "mean_rank": (F.col("_ra") + F.col("_rb")) / 2}).drop("_ra", "_rb")
