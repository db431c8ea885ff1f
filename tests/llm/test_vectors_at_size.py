"""What the vector searches hold on the driver does not grow with rows times centroids, nor the sample with the partitions."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import ann, vectors


def test_many_centroids_are_fitted_in_bounded_memory():
    x = np.random.default_rng(1).normal(size=(8192, 9))
    tracemalloc.start()
    c = ann.centroids(x, 2048, rounds=2)
    ann.Graph(c)
    found, counts = ann.posted(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # a row for each pair of vector and centroid would be 134 MB, several times over
    near = vectors.distances(x, c).argmin(axis=1)
    assert (found[np.cumsum(counts) - counts] == near).all() and 1 <= counts.min() and counts.max() == ann.COPIES


def test_slices_change_no_result(monkeypatch):
    x = np.random.default_rng(2).normal(size=(900, 5))
    whole = ann.centroids(x, 40), ann.posted(x, x[:40]), ann.Graph(x[:40])
    monkeypatch.setattr(ann, "CELLS", 700)
    assert np.allclose(ann.centroids(x, 40), whole[0])
    assert all((a == b).all() for a, b in zip(ann.posted(x, x[:40]), whole[1], strict=True))
    assert all((a == b).all() for a, b in zip(ann.Graph(x[:40]).ties, whole[2].ties, strict=True))


def test_the_sample_is_the_first_by_hash_and_few_rows_are_sorted_for_it(spark, monkeypatch):
    rows = spark.range(40_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    sorted_rows, real = [], type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda self, *a, **k: sorted_rows.append(self.count()) or real(self, *a, **k))
    ids, v = vectors.sample(rows, 300, 40_000)
    assert ids.tolist() == want and (v[:, 0] == ids).all() and max(sorted_rows) < 900
    assert len(vectors.sample(rows, 50_000, 40_000)[0]) == 40_000 and vectors.sample(rows.where("false"), 5, 0)[1].shape == (0, 0)
