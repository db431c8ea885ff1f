"""Names met by equal pieces against all pairs; pages with their total; messages of decisions."""

import random

from pyspark.sql import functions as F

from tempora.functions.expr import similarity
from tempora.operators import canonical, serve


def test_pieces_lose_no_similar_pair(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("AB É", k=rnd.randrange(1, 26))).strip() or "A" for _ in range(60)]

    def bent(w):
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + rnd.choice("ABCÉ") + w[i:], w[:i] + w[i + 1 :], w[:i] + "B" + w[i + 1 :]])
        return w

    left = spark.createDataFrame([(bent(w),) for w in words * 5] + [("",), (None,)], "s_key string")
    right = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "n_key string")
    every = left.distinct().crossJoin(right.distinct()).withColumn("score", similarity(F.col("s_key"), F.col("n_key")))
    for least in (0.5, 0.82, 0.95):
        got = {(r[0], r[1], r[2]) for r in canonical.similar(left, right, least).collect()}
        want = {(r[0], r[1], r[2]) for r in every.where(F.col("score") >= least).collect()}
        assert got == want and len(want) > 20


def test_names_meet_by_an_equality(spark):
    names = spark.createDataFrame([("A", "ALPHA STATION")], "code string, name string")
    plan = canonical.canonical_map(spark.createDataFrame([("ALPHA STATIOM",)], "source string"), names)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_page_keeps_its_total(spark):
    scores = spark.createDataFrame([(k, f"I{k}") for k in range(1, 8)], "rank int, item string")
    got = serve.page_with_total(scores, 5, 10).first()
    assert (got["total"], got["returned"], got["offset"]) == (7, 2, 5) and [i["item"] for i in got["items"]] == ["I6", "I7"]
    beyond = serve.page_with_total(scores, 50, 10).first()
    assert (beyond["total"], beyond["returned"], beyond["items"]) == (7, 0, [])


def test_each_decision_says_what_to_do(spark):
    pairs = spark.createDataFrame([("HIGH", "HIGH"), ("LOW", "HIGH"), ("HIGH", None)], "failure_level string, scrap_level string")
    said = [r["message"] for r in serve.recommended(pairs).collect()]
    assert "siapkan unit pengganti" in said[0] and "Belum perlu tindakan" in said[1] and "Risiko scrap belum bisa dinilai" in said[2]
