"""Canonical names: exact match, then approved alias, then a clear fuzzy winner, else none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.expr import clean, fuzzy_key, similarity


def _span(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (s_key, n_key, score) of the pairs of left (s_key) and right (n_key) whose similarity is at least `least` (over 0), met by equal pieces.

    Such a pair is within d edits, d fixed by the right key's length. Cut into d + 1 pieces, that key keeps one piece whole in the
    left one, at most d places from where it was. So rows meet by (length, piece, text), never all with all, and no pair is lost.
    """
    slack = 1 - least + 0.0000500001  # scores are rounded to four places
    n = F.col("n_len")
    edits = F.floor(F.floor(n / F.lit(1 - slack)) * slack)
    begin = lambda i: F.floor(i * n / (F.col("edits") + 1)).cast("int")

    def cut(rows: DataFrame) -> DataFrame:
        """rows with n_len, and for each piece of a key of that length its number, start and width."""
        rows = rows.withColumn("edits", edits).withColumn("piece", F.explode(_span(F.lit(0), F.col("edits"))))
        return rows.withColumn("start", begin(F.col("piece"))).withColumn("width", begin(F.col("piece") + 1) - F.col("start"))

    names = cut(right.select("n_key", F.length("n_key").alias("n_len")).where("n_len > 0").distinct())
    names = names.select("n_key", F.col("n_len").alias("_len"), F.col("piece").alias("_piece"), F.col("n_key").substr(F.col("start") + 1, F.col("width")).alias("_text"))
    own = left.select("s_key", F.length("s_key").alias("s_len")).where("s_len > 0").distinct()
    length = F.col("s_len")
    probes = cut(own.withColumn("n_len", F.explode(_span(F.ceil(length * (1 - slack)), F.floor(length / F.lit(1 - slack))))))
    shift = _span(F.greatest(F.lit(0), F.col("start") - F.col("edits")), F.least(length - F.col("width"), F.col("start") + F.col("edits")))
    probes = probes.withColumn("at", F.explode(shift)).select("s_key", "n_len", "piece", F.col("s_key").substr(F.col("at") + 1, F.col("width")).alias("text")).distinct()
    met = probes.join(names, (F.col("n_len") == F.col("_len")) & (F.col("piece") == F.col("_piece")) & (F.col("text") == F.col("_text")))
    return met.select("s_key", "n_key").distinct().withColumn("score", similarity(F.col("s_key"), F.col("n_key"))).where(F.col("score") >= least)


def canonical_map(sources: DataFrame, masters: DataFrame, alias: tuple[tuple[str, str], ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """sources (source), masters (code, name) -> (source, canonical, how). Master tables are small and leave the planner its choice of join."""
    spark = sources.sparkSession
    source = sources.select(clean(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()
    master = masters.select(clean(F.col("code")).alias("code"), clean(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()
    names = master.select("name").distinct()
    keys = master.select(F.explode(F.array("code", "name")).alias("key"), "name").where("key IS NOT NULL")
    exact = keys.groupBy("key").agg(F.count_distinct("name").alias("n"), F.min("name").alias("exact_name"))
    approved = spark.createDataFrame([(a.upper(), b) for a, b in alias], "a_source string, a_name string").join(names, F.col("a_name") == F.col("name"), "left_semi")
    placed = source.join(exact, F.col("source") == F.col("key"), "left").join(approved, F.col("source") == F.col("a_source"), "left")
    # only values without an exact match and alias are compared, each distinct value once
    open_ = placed.where("key IS NULL AND a_source IS NULL").select("source", fuzzy_key(F.col("source"), cfg).alias("s_key"))
    # a name below the least winning score by more than the margin changes nothing
    named = names.select(F.col("name").alias("f_name"), fuzzy_key(F.col("name"), cfg).alias("f_key"))
    pairs = similar(open_, named.select(F.col("f_key").alias("n_key")), cfg.fuzzy_score - cfg.fuzzy_margin).withColumnRenamed("s_key", "_s_key")
    scored = open_.join(pairs, F.col("s_key") == F.col("_s_key")).join(named, F.col("n_key") == F.col("f_key"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "f_name")
    best = scored.select("source", "f_name", "score", F.row_number().over(w).alias("r"), F.lead("score").over(w).alias("second")).where("r = 1")
    won = best.where((F.col("score") >= cfg.fuzzy_score) & (F.bround(F.col("score") - F.coalesce("second", F.lit(0.0)), 6) >= cfg.fuzzy_margin)).select(F.col("source").alias("w_source"), "f_name")
    out = placed.join(won, F.col("source") == F.col("w_source"), "left")
    canonical = F.when(F.col("n") == 1, F.col("exact_name")).when(F.col("a_source").isNotNull(), F.col("a_name")).when(F.col("key").isNull(), F.col("f_name"))
    how = F.when(F.col("n") == 1, "EXACT").when(F.col("a_source").isNotNull(), "ALIAS").when(F.col("key").isNull() & F.col("f_name").isNotNull(), "FUZZY").otherwise("UNMAPPED")
    return out.select("source", canonical.alias("canonical"), how.alias("how"))
