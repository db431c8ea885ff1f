"""A corpus pipeline of five stages; each takes and returns documents, the last one packs what is left.

Only documents that a stage rejects go: toxic ones; those without letters or without any language of
some weight; all but the smallest id of each group of near duplicates; of the rest, repeated passages.

In every stage: an empty table gives an empty one; a null text counts as an empty one; a row without doc_id is judged by its
text alone and is never a duplicate; rows that repeat a doc_id are judged each by itself until the third stage, which keeps
one of them; all columns come along whatever their names and types (the last stage returns its own).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import common, jaccard, language, packing, substrings, toxicity

#: Share of the letters that a document's language must have; mixed text of several languages passes.
LANGUAGE_SHARE = 0.35
#: Near duplicates: words of a shingle, and the least Jaccard similarity. op5_jaccard has its own contract (4 and 85).
NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; null and empty texts get the score of a text without votes and stay."""
    model = toxicity.fitted(spark, docs, sf_dir)
    rows, at = common.renamed(docs)
    kept = toxicity.scored(rows, model, at["text"]).where("tox_score < 0.5")
    return kept.select(*at.values()).toDF(*at)


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which LANGUAGE_SHARE at least are of one language; null and empty texts go. Without a labelled row, and so without a model, all stay."""
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    if not model.langs:
        return docs
    rows, at = common.renamed(docs)
    found = language.labelled(rows, model, at["text"])
    kept = found.where((F.col("lid_lang") != language.UNKNOWN) & (F.col("lid_score") >= LANGUAGE_SHARE))
    return kept.select(*at.values()).toDF(*at)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each component; of rows that repeat an id, that of the smallest text (then of the smallest other columns, as JSON)."""
    rows, at = common.renamed(docs)
    key, text = at["doc_id"], at["text"]
    found = jaccard.join(rows, key, text, size=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = common.without(rows, found.where(F.col("component_id") != F.col(key)).select(key).distinct(), key)
    if not rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        whole = F.struct(*at.values())
        one = kept.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min_by(whole, F.struct(F.coalesce(text, F.lit("")), F.to_json(whole))).alias("row")).select("row.*")
        kept = one.unionByName(kept.where(F.col(key).isNull()))
    return kept.toDF(*at)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, n_chars (where there is such a column) being theirs; a document that was nothing else goes."""
    rows, at = common.renamed(docs)
    found = substrings.deduped(rows, at["doc_id"], at["text"]).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {at["text"]: F.when(changed, F.col("kept")).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        n = at["n_chars"]
        new[n] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in at.values()]).toDF(*at)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their bins; a document without words has none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_no_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
