"""Models as Spark ML pipelines: classifier, scrap vote, discrete-time survival, calibration, promotion."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAY
from ..functions.tables import stored
from . import metrics, order, outcome
from .features import CATEGORICAL, NUMERIC
from .survival import through_knots

SCRAP_NUMERIC = ["log_age_total_days", "log_cycle_age_days", "log_prior_repaired", "log_prior_failures"]


def balanced(rows: DataFrame, target: str) -> DataFrame:
    """Adds a weight that gives both classes the same mass."""
    n, p = rows.agg(F.count("*"), F.sum(F.col(target).cast("double"))).first()
    pos, neg = n / (2 * max(p or 0, 1)), n / (2 * max(n - (p or 0), 1))
    return rows.withColumn("weight", F.when(F.col(target).cast("boolean"), pos).otherwise(neg)).withColumn("label", F.col(target).cast("double"))


def _inputs(categorical: list[str], numeric: list[str]) -> list:
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], dropLast=True)] if categorical else []
    return [*index, *hot, VectorAssembler(inputCols=[f"{c}_v" for c in categorical] + numeric, outputCol="features")]


def fit_classifier(train: DataFrame, iterations: int = 200, depth: int = 4, rate: float = 0.03) -> PipelineModel:
    """Boosted trees with balanced weights on the 32 columns; an unseen category is all zeros."""
    tree = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=rate, weightCol="weight", seed=42)
    return Pipeline(stages=[*_inputs(CATEGORICAL, NUMERIC), tree]).fit(balanced(train, "target"))


def fit_encoder(rows: DataFrame, categorical: list[str], numeric: list[str]) -> PipelineModel:
    """Categories as they are known here (an unseen one is all zeros), all columns with mean 0 and deviation 1."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[*_inputs(categorical, numeric), scale]).fit(rows)


def encoded(rows: DataFrame, encoder: PipelineModel, name: str = "x") -> DataFrame:
    """rows with the encoder's columns as an array."""
    keep = rows.columns
    return encoder.transform(rows).select(*keep, vector_to_array("scaled").alias(name))


def probability(scored: DataFrame, name: str = "raw_probability") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def isotonic(rows: DataFrame, score: str, target: str, h: int = 0) -> DataFrame:
    """Knots (h, x, y) of the fitted table: as many as the fit keeps."""
    data = rows.select(F.col(score).cast("double").alias("features"), F.col(target).cast("double").alias("label"))
    m = IsotonicRegression(isotonic=True).fit(data)
    knots = list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist(), strict=True))
    return rows.sparkSession.createDataFrame([(h, x, y) for x, y in knots], "h int, x double, y double").dropDuplicates(["h", "x"])


def calibrate(rows: DataFrame, knots: DataFrame, score: str, out: str) -> DataFrame:
    """rows with the score's place on the broken line through the knots; a null score stays null."""
    found = through_knots(rows.select(F.lit(0).alias("h"), F.col(score).alias("x")), knots).select(F.col("x").alias("_kx"), F.col("y").alias(out))
    return rows.drop(out).join(found, F.col(score) == F.col("_kx"), "left").drop("_kx")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in ("has_prior_repaired", "has_repeat_failure")})


def fit_scrap(train: DataFrame) -> tuple[PipelineModel, PipelineModel]:
    """Logistic regression and random forest, which vote softly."""
    rows = balanced(_plain(train), "is_scrap")
    inputs = _inputs(["type_category"], [*SCRAP_NUMERIC, "has_prior_repaired", "has_repeat_failure"])
    linear = Pipeline(stages=[*inputs, StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=0.01)])
    forest = Pipeline(stages=[*inputs, RandomForestClassifier(numTrees=100, maxDepth=5, weightCol="weight", seed=42)])
    return linear.fit(rows), forest.fit(rows)


def score_scrap(models: tuple[PipelineModel, PipelineModel], rows: DataFrame) -> DataFrame:
    rows = _plain(rows)
    for k, m in enumerate(models):
        keep = rows.columns
        rows = m.transform(rows).select(*keep, vector_to_array("probability")[1].alias(f"vote{k}"))
    return rows.withColumn("scrap_raw", (F.col("vote0") + F.col("vote1")) / 2)


def fit_boosted(train: DataFrame, iterations: int = 50) -> PipelineModel:
    """A boosted candidate on the scrap columns."""
    rows = balanced(_plain(train), "is_scrap")
    tree = GBTClassifier(maxIter=iterations, maxDepth=3, stepSize=0.1, weightCol="weight", seed=42)
    return Pipeline(stages=[*_inputs(["type_category"], [*SCRAP_NUMERIC, "has_prior_repaired", "has_repeat_failure"]), tree]).fit(rows)


def candidates(train: DataFrame, test: DataFrame) -> DataFrame:
    """test scored by every candidate that train gives: (candidate, score, target) in long form. The prior scores all rows alike."""
    base = train.agg(F.avg(F.col("is_scrap").cast("double"))).first()[0]
    scored = score_scrap(fit_scrap(train), test)
    scored = fit_boosted(train).transform(_plain(scored)).withColumn("boosted", vector_to_array("probability")[1])
    each = {"prior": F.lit(base), "linear": F.col("vote0"), "forest": F.col("vote1"), "boosted": F.col("boosted"), "vote": F.col("scrap_raw")}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), c.alias("score")) for n, c in each.items()])).alias("_c")
    return scored.select(F.col("onset_journey_id"), F.col("is_scrap").alias("target"), pairs).select("onset_journey_id", "target", "_c.*")


def rolling_origin(resolved: DataFrame, cuts: list[int]) -> DataFrame:
    """(origin, candidate, train_rows, n, positives, average_precision, roc_auc, brier): at each cut-off but the last, candidates learn from
    failures whose labels were known by then, with the types known by then, and score the failures up to the next cut-off.

    A cut-off at which one class is unknown is passed over.
    """
    out = None
    for k, (cut, until) in enumerate(zip(cuts, cuts[1:], strict=False)):
        past = stored(outcome.matured(resolved, cut), "past")
        types = outcome.known_types(past)
        train = stored(outcome.scrap_features(past, types), "train")
        n, p = train.agg(F.count("*"), F.coalesce(F.sum("is_scrap"), F.lit(0))).first()
        later = resolved.where(F.col("in_cohort") & F.col("is_labeled") & (F.col("onset_us") > cut) & (F.col("onset_us") <= until))
        if not 0 < p < n:
            continue
        scored = stored(candidates(train, outcome.scrap_features(later, types)), "scored")
        for name in ("prior", "linear", "forest", "boosted", "vote"):
            mine = scored.where(F.col("candidate") == name)
            ap, auc = metrics.average_precision(mine, "score", "target").first()[0], metrics.roc_auc(mine, "score", "target").first()[0]
            row = mine.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0)).cast("long").alias("positives"), F.avg((F.col("score") - F.col("target")) ** 2).alias("brier"))
            row = row.select(F.lit(k).alias("origin"), F.lit(name).alias("candidate"), F.lit(n).alias("train_rows"), "n", "positives", F.lit(ap).cast("double").alias("average_precision"), F.lit(auc).cast("double").alias("roc_auc"), "brier")
            out = row if out is None else out.unionByName(row)
    return resolved.sparkSession.createDataFrame([], "origin int, candidate string, train_rows long, n long, positives long, average_precision double, roc_auc double, brier double") if out is None else out


def folds(rows: DataFrame, target: str, by: list[Column], n: int = 5) -> DataFrame:
    """rows with a stratified fold: the position within the class in the order of `by`, which must be total, modulo n."""
    out = order.sums_before(rows, [F.col(target), *by], {"_at": F.lit(1)})
    first = out.groupBy(F.col(target).alias("_class")).agg(F.min("_at").alias("_first"))
    out = out.join(F.broadcast(first), F.col(target) == F.col("_class"))  # a row a class
    return out.withColumn("fold", ((F.col("_at") - F.col("_first")) % n).cast("int")).drop("_at", "_class", "_first")


def out_of_fold(rows: DataFrame, n: int = 5) -> DataFrame:
    """rows (with fold) scored each by the scrap models of the other folds; a fold without both classes outside it gives none."""
    out = None
    for k in range(n):
        scored = score_scrap(fit_scrap(rows.where(F.col("fold") != k)), rows.where(F.col("fold") == k))
        out = scored if out is None else out.unionByName(scored)
    return out


def fit_platt(rows: DataFrame, score: str, target: str) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the raw score: order is kept."""
    m = LogisticRegression(regParam=0.0).fit(VectorAssembler(inputCols=[score], outputCol="features").transform(rows.select(F.col(score), F.col(target).cast("double").alias("label"))))
    return float(m.coefficients[0]), float(m.intercept)


def platt(rows: DataFrame, curve: tuple[float, float], score: str, out: str) -> DataFrame:
    return rows.withColumn(out, 1 / (1 + F.exp(-(F.lit(curve[0]) * F.col(score) + F.lit(curve[1])))))


def capacity_cutoffs(rows: DataFrame, score: str, time_us: str, per_month: float, wider: float = 2.0, days_per_month: float = 30.44) -> DataFrame:
    """One row (per_month, high_share, high, medium): cut-offs that flag as many failures a month as the team can take, and `wider` times as many."""
    span = F.greatest(F.floor((F.max(time_us) - F.min(time_us)) / F.lit(DAY)) / days_per_month, F.lit(1.0))
    rate = F.count("*") / span
    one = rows.agg(rate.alias("per_month")).select("per_month", F.least(per_month / F.col("per_month"), F.lit(1.0)).alias("high_share"), F.least(wider * per_month / F.col("per_month"), F.lit(1.0)).alias("medium_share"))
    p = one.first()
    if p["per_month"] is None or not p["per_month"]:
        return one.select("per_month", "high_share", F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("medium"))
    cut = order.quantiles(rows, score, [1 - p["high_share"], 1 - p["medium_share"]]).select(F.col("q")[0].alias("high"), F.col("q")[1].alias("medium"))
    return one.select("per_month", "high_share").crossJoin(F.broadcast(cut))  # one row each


def fit_hazard(periods: DataFrame, numeric: list[str], weight: str | None = None) -> PipelineModel:
    """Discrete-time survival: probability of failing in an interval, given arrival at it. `weight`: how many equal rows a row stands for."""
    tree = GBTClassifier(maxIter=20, maxDepth=4, labelCol="y", seed=42, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=[*numeric, "interval"], outputCol="features"), tree]).fit(periods)


def measured(rows: DataFrame, key: str, window_days: float, per_month: float, score: str, target: str) -> dict[str, float]:
    """Average precision and recall at capacity: what a promotion compares (0 where there is no positive row)."""
    ap = metrics.average_precision(rows, score, target).first()[0]
    recall = metrics.capacity_topk(rows, key, window_days, per_month, score=score, target=target).first()["recall_at_capacity"]
    return {"average_precision": ap or 0.0, "recall_at_capacity": recall or 0.0}


def promoted(candidate: dict[str, float], incumbent: dict[str, float] | None, forced: bool = False) -> bool:
    """Both average precision and recall at capacity must not fall."""
    return forced or incumbent is None or all(candidate[k] >= incumbent[k] for k in ("average_precision", "recall_at_capacity"))


def survival_promoted(candidate: dict[int, float], incumbent: dict[int, float] | None, forced: bool = False) -> bool:
    """The Brier scores at 30 and 90 days must not rise."""
    return forced or incumbent is None or all(candidate[h] <= incumbent[h] for h in (30, 90))
