"""Operator 4: approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a penalty on large clusters. Every vector
goes to the posting list of its nearest centroid and, if it lies near a boundary, to the lists of
further centroids that are nearly as close and not hidden behind one already taken. Centroids are found
through an in-memory neighbour graph, searched greedily with a beam. A query visits the lists whose
centroid is within a ratio of its nearest one; lists longer than PART_ROWS are stored in parts, so a
list's size does not matter. Scores are exact inner products of the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without id; a query always gets k neighbours if there are as many candidates in its
lists, and looks at MIN_LISTS lists at least; rows that repeat an id count once, by the least of their vectors; of vectors of several lengths
those of the commonest length take part (of equally common ones, the shortest); an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

K = 20
SAMPLE_ROWS = 16_384
#: Vectors of a list on average, until MAX_LISTS centroids, which are held in memory; vectors of the sample for each centroid.
PER_LIST = 200
MAX_LISTS = 4096
SAMPLE_PER_LIST = 16
COPIES = 3
CLOSE = 1.05
RATIO = 1.25
MIN_LISTS = 12
BEAM = 96
DEGREE = 16
#: Products of a query and a vector that are made at once, and distances that are held at once.
PAIRS = 65_536
CELLS = 2_097_152


def slices(n: int, width: int) -> list[slice]:
    """Rows of an n x width matrix in slices of at most CELLS cells."""
    step = max(CELLS // max(width, 1), 1)
    return [slice(at, at + step) for at in range(0, n, step)]


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means whose assignment adds to a distance what a cluster is over its share. Distances are made a slice at a time, once for their median and once to assign."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        near = np.concatenate([vectors.distances(x[s], c).min(axis=1) for s in slices(len(x), k)])
        over = np.median(near**2) * np.maximum(load / (len(x) / k) - 1, 0)[None, :] * 0.2
        near = np.concatenate([(vectors.distances(x[s], c) ** 2 + over).argmin(axis=1) for s in slices(len(x), k)])
        load = np.bincount(near, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(load[:, None] > 0, sums / np.maximum(load, 1)[:, None], c)
    return c


def posted(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists of all rows one after the other, number of each row's): the nearest centroid, and further ones that are nearly as close and not hidden behind one taken."""
    out, counts = [], []
    for s in slices(len(x), len(c)):
        d = vectors.distances(x[s], c)
        n = min(4 * COPIES, d.shape[1])
        order = np.argpartition(d, n - 1, axis=1)[:, :n]
        far = np.take_along_axis(d, order, 1)
        by = np.argsort(far, axis=1)
        order, far = np.take_along_axis(order, by, 1), np.take_along_axis(far, by, 1)
        at = c[order]
        own = (at * at).sum(axis=2)
        apart = np.sqrt(np.maximum(own[:, :, None] + own[:, None, :] - 2 * (at @ at.transpose(0, 2, 1)), 0))
        kept = np.zeros(order.shape, bool)
        kept[:, 0] = True
        for j in range(1, n):
            hidden = (kept & (apart[:, j] <= far[:, j, None] * 0.5)).any(axis=1)
            kept[:, j] = (far[:, j] <= CLOSE * far[:, 0]) & (kept.sum(axis=1) < COPIES) & ~hidden
        out.append(order[kept])
        counts.append(kept.sum(axis=1))
    return np.concatenate(out), np.concatenate(counts)


class Graph:
    """Neighbour graph of the centroids: each is tied to near ones that no nearer tie already covers."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.ties = []
        for s in slices(len(c), len(c)):
            for i, d in enumerate(vectors.distances(c[s], c), s.start):
                close = np.argsort(d, kind="stable")[: 4 * DEGREE + 1]
                apart = vectors.distances(c[close], c[close])
                kept: list[int] = []  # places in close
                for a, j in enumerate(close.tolist()):
                    if j != i and len(kept) < DEGREE and (d[j] <= apart[a, kept]).all():
                        kept.append(a)
                self.ties.append(close[kept].tolist())
        for i, kept in enumerate(list(map(list, self.ties))):
            for j in kept:
                if i not in self.ties[j]:
                    self.ties[j].append(i)
        self.ties = [np.array(t, np.int64) for t in self.ties]
        # one way into each part that the ties leave apart
        seen, self.entries = np.zeros(len(c), bool), []
        for i in range(len(c)):
            if not seen[i]:
                self.entries.append(i)
                todo = [i]
                seen[i] = True
                while todo:
                    new = [j for j in self.ties[todo.pop()].tolist() if not seen[j]]
                    seen[new] = True
                    todo += new

    def near(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near q and their distances, nearest first."""
        seen = np.zeros(len(self.c), bool)
        seen[self.entries] = True
        start = vectors.distances(q[None, :], self.c[self.entries])[0]
        todo = [(d, i) for d, i in zip(start.tolist(), self.entries, strict=True)]
        found = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(found)
        while len(found) > beam:
            heapq.heappop(found)
        while todo:
            d, i = heapq.heappop(todo)
            if len(found) >= beam and d > -found[0][0]:
                break
            new = self.ties[i][~seen[self.ties[i]]]
            seen[new] = True
            if len(new):
                for dj, j in zip(vectors.distances(q[None, :], self.c[new])[0].tolist(), new.tolist(), strict=True):
                    if len(found) < beam or dj < -found[0][0]:
                        heapq.heappush(todo, (dj, j))
                        heapq.heappush(found, (-dj, j))
                        if len(found) > beam:
                            heapq.heappop(found)
        found.sort(reverse=True)
        return np.array([i for _, i in found]), np.array([-d for d, _ in found])


def search(rows: DataFrame, is_query: Column, k: int = K, part_rows: int = vectors.PART_ROWS, ratio: float = RATIO, min_lists: int = MIN_LISTS) -> DataFrame:
    """rows: (id, v). Per query: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = vectors.once(common.stored(rows, "vectors"))
    rows, m2, total = vectors.measured(rows)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(np.clip(total // PER_LIST, 1, MAX_LISTS))
    _, sampled = vectors.sample(rows, max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists), total)
    lifted = vectors.lifted(sampled, m2)
    graph = Graph(centroids(lifted, lists))
    held = spark.sparkContext.broadcast(graph)  # at most MAX_LISTS centroids

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found, counts = posted(vectors.lifted(vectors.matrix(b.column(1)), m2), held.value.c)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))], ["id", "v", "lists"])

    copies = rows.mapInArrow(post, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    sizes = {r["list"]: r["n"] for r in copies.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    parts = {g: -(-n // part_rows) for g, n in sizes.items()}
    number = F.get(F.lit(np.array([parts.get(g, 1) for g in range(lists)], np.int32)), F.col("list"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, data = vectors.pack(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"list": [pdf["list"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [ids], "data": [data]})

    packed = copies.withColumn("part", F.pmod(F.xxhash64("id"), number).cast("int")).groupBy("list", "part").applyInPandas(gather, f"list int, part int, {vectors.BLOB}")

    def ask(batches):
        g = held.value
        for b in batches:
            for at in range(0, b.num_rows, vectors.BLOCK_ROWS):
                s = b.slice(at, vectors.BLOCK_ROWS)
                ids, q = s.column(0).to_numpy(), vectors.matrix(s.column(1))
                # a query's length does not change which product is largest: it is brought to that of the vectors
                scaled = q * np.sqrt(m2 / (q * q).sum(axis=1))[:, None]
                wanted: dict[int, list[int]] = {}
                for i, row in enumerate(np.hstack([scaled, np.zeros((len(q), 1))])):
                    near, d = g.near(row)
                    for j in near[(d <= ratio * d[0]) | (np.arange(len(d)) < min_lists)].tolist():
                        wanted.setdefault(j, []).append(i)
                out = [(j, list(range(parts[j])), *vectors.pack(ids[m], q[m])) for j, m in wanted.items() if j in parts]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["q_list", "parts", "q_ids", "q_data"])

    blocks = rows.where(is_query).mapInArrow(ask, "q_list int, parts array<int>, q_ids binary, q_data binary")
    blocks = blocks.select("q_list", F.explode("parts").alias("q_part"), "q_ids", "q_data")
    met = blocks.join(packed, (F.col("q_list") == F.col("list")) & (F.col("q_part") == F.col("part"))).select("ids", "data", "q_ids", "q_data")

    def find(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, x = vectors.unpack(r["ids"], r["data"])
                own, q = vectors.unpack(r["q_ids"], r["q_data"])
                score = q @ x.T
                score[own[:, None] == ids[None, :]] = -np.inf
                n = min(k + 1, len(ids))
                edge = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
                # the product of matrices rounds as its blocks fall: all within the rounding of the edge stay, and exact scores rank them
                slack = 1e-12 * np.sqrt((q * q).sum(axis=1) * m2)
                i, j = np.nonzero((score >= (edge - slack)[:, None]) & (score > -np.inf))
                # many equal vectors lie at the edge together: their products come a bounded number at once
                exact = np.concatenate([(q[i[at : at + PAIRS]] * x[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
                # equal scores at the edge may be many: the smaller ids of them are enough
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, exact = i[first < k], j[first < k], exact[first < k]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(exact)], ["query_id", "vec_id", "score"])

    return vectors.best(met.mapInArrow(find, "query_id long, vec_id long, score double"), k, repeated=True)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(vectors.valid(common.documents(spark, sf_dir, "embeddings"), zero=False), F.col("id") % 20 == 0)
