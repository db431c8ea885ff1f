"""Operator 1: exact top-k search by inner product with M-trees.

A bounded sample of vectors serves as the routing objects of the top level. Each vector goes to its
nearest routing object; every region, cut into parts of bounded size, becomes an M-tree of paged
nodes: entries hold their distance to the parent's routing object, and nodes their covering radius. A
query keeps only the regions whose bound reaches the k-th best score that it has seen among the routing
objects, and searches the trees of those best first: |d(q, parent) - d(entry, parent)| bounds an
entry's distance before it is computed, and the search ends when no page can hold a better hit.

Scores are integers, so bounds get a slack far above rounding and far below 1.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without id; a query has fewer rows when there are fewer candidates; rows that repeat an id count
once, by the least of their vectors; of vectors of several lengths
those of the commonest length take part (of equally common ones, the shortest); an empty table gives an empty one; further columns are ignored.
Components must stay below 2^31 / 1024 in size, so that scores fit in 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 1024
ROUTING = 256
PAGE = 64
FANOUT = 16
K = 10
#: Vectors of the sample among which a query's first k-th best score is found; the routing objects are the first of them.
FLOOR_ROWS = 4096
#: No vector; no score.
NONE = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min + 1


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """k row numbers far apart from each other: each next one is farthest from those taken."""
    taken = [0]
    d = vectors.distances(x[:1], x)[0]
    while len(taken) < k and d.max() > 0:
        taken.append(int(d.argmax()))
        d = np.minimum(d, vectors.distances(x[taken[-1:]], x)[0])
    return np.array(taken)


class Tree:
    """An M-tree in arrays. Node i covers rows[first[i]:last[i]] of the point order or child nodes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m2: float):
        self.ids, self.x, self.m2 = ids, x, m2
        self.lift = vectors.lifted(x, m2)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.parent_d: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.points: list[np.ndarray | None] = []
        self.point_d: list[np.ndarray | None] = []
        self._build(np.arange(len(ids)), None)
        self.centre, self.radius, self.parent_d = np.array(self.centre), np.array(self.radius), np.array(self.parent_d)

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        centre = int(rows[vectors.distances(self.lift[rows].mean(axis=0, keepdims=True), self.lift[rows])[0].argmin()])
        d = vectors.distances(self.lift[[centre]], self.lift[rows])[0]
        i = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.parent_d.append(0.0 if parent is None else float(vectors.distances(self.lift[[centre]], self.lift[[parent]])[0, 0]))
        for column in (self.children, self.points, self.point_d):
            column.append(None)
        if len(rows) <= PAGE or d.max() == 0:
            order = np.argsort(d, kind="stable")
            self.points[i], self.point_d[i] = rows[order], d[order]
            return i
        seeds = _spread(self.lift[rows], FANOUT)
        near = vectors.distances(self.lift[rows], self.lift[rows[seeds]]).argmin(axis=1)
        if (near == near[0]).all():
            near = np.arange(len(rows)) * FANOUT // len(rows)
        self.children[i] = np.array([self._build(rows[near == s], centre) for s in np.unique(near)])
        return i

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a block of queries up to k (score, id) each of at least `floor`: matrices, empty places at the end with NONE as id.

        Best first over pages: the page whose bound promises most to any query of the block comes next, with those queries
        that it still can serve.
        """
        q2 = (q * q).sum(axis=1)
        far = np.hstack([q, np.zeros((len(q), 1))])
        slack = 1e-3 + 1e-9 * (q2 + self.m2)
        bound = lambda d, i: (q2[i] + self.m2 - d * d) / 2 + slack[i]
        column = lambda i: (i, None)
        wide = float(q2.max(initial=0) * self.m2) >= 2.0**104  # scores beyond 2^52 are summed as whole numbers
        scores = np.full((len(q), k), -np.inf if not wide else LOWEST, np.float64 if not wide else np.int64)
        ids = np.full((len(q), k), NONE)
        worst = floor.astype(np.float64)
        every = np.arange(len(q))
        d0 = vectors.distances(far, self.lift[[self.centre[0]]])[:, 0]
        b0 = bound(np.maximum(d0 - self.radius[0], 0), every)
        queue = [(-float(b0.max(initial=-np.inf)), 0, every, d0, b0)]
        while queue:
            _, i, who, d, b = heapq.heappop(queue)
            live = b >= worst[who]
            if not live.any():
                continue
            who, d = who[live], d[live]
            if self.children[i] is not None:
                c = self.children[i]
                # by the stored distance to the parent, before any is computed
                low = np.maximum(np.abs(d[:, None] - self.parent_d[c]) - self.radius[c], 0)
                open_ = bound(low, column(who)) >= worst[who, None]
                c, open_ = c[open_.any(axis=0)], open_[:, open_.any(axis=0)]
                if not len(c):
                    continue
                dc = vectors.distances(far[who], self.lift[self.centre[c]])
                bc = bound(np.maximum(dc - self.radius[c], 0), column(who))
                open_ &= bc >= worst[who, None]
                for j in np.flatnonzero(open_.any(axis=0)).tolist():
                    m = open_[:, j]
                    heapq.heappush(queue, (-float(bc[m, j].max()), int(c[j]), who[m], dc[m, j], bc[m, j]))
                continue
            rows, stored = self.points[i], self.point_d[i]
            open_ = bound(np.abs(d[:, None] - stored), column(who)) >= worst[who, None]
            at, rows = open_.any(axis=1), rows[open_.any(axis=0)]
            who = who[at]
            if not len(who):
                continue
            if wide:
                found = q[who].astype(np.int64) @ self.x[rows].astype(np.int64).T
                found[own[who][:, None] == self.ids[rows]] = LOWEST
            else:
                found = q[who] @ self.x[rows].T
                found[own[who][:, None] == self.ids[rows]] = -np.inf
            better = found.max(axis=1) >= worst[who]
            who, found = who[better], found[better]
            if not len(who):
                continue
            s = np.hstack([scores[who], found])
            v = np.hstack([ids[who], np.broadcast_to(self.ids[rows], found.shape)])
            order = np.lexsort((v, -s))[:, :k]
            scores[who], ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
            worst[who] = np.maximum(floor[who], scores[who, -1])
        ids[scores <= (LOWEST if wide else -np.inf)] = NONE
        ids[scores < floor[:, None]] = NONE
        return scores, ids


def search(rows: DataFrame, is_query: Column, k: int = K, routing: int = ROUTING, part_rows: int = vectors.PART_ROWS) -> DataFrame:
    """rows: (id, v) with whole-number components. Per query: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = vectors.once(common.stored(rows, "vectors"))
    rows, m2, total = vectors.measured(rows)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first_ids, first = vectors.sample(rows, max(routing, FLOOR_ROWS), total)
    pivots = first[: min(routing, -(-total // PAGE))]
    lifted = vectors.lifted(pivots, m2)

    def route(batches):
        for b in batches:
            if b.num_rows:
                d = vectors.distances(vectors.lifted(vectors.matrix(b.column(1)), m2), lifted)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], ["id", "v", "region", "d"])

    routed = rows.mapInArrow(route, "id long, v array<double>, region int, d double")
    stats = {r["region"]: r for r in routed.groupBy("region").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()}  # at most `routing` rows
    parts = {g: -(-r["n"] // part_rows) for g, r in stats.items()}
    radius = np.array([stats[g]["radius"] if g in stats else -1.0 for g in range(len(pivots))])
    number = F.element_at(F.create_map(*[F.lit(x) for g, n in parts.items() for x in (g, n)]), F.col("region"))
    salted = routed.withColumn("part", F.pmod(F.xxhash64("id"), number).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, data = vectors.pack(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [ids], "data": [data]})

    pages = salted.groupBy("region", "part").applyInPandas(grow, f"region int, part int, {vectors.BLOB}")

    def ask(batches):
        """Blocks of queries for each region that they cannot rule out; with the k-th best score seen so far."""
        for b in batches:
            for at in range(0, b.num_rows, vectors.BLOCK_ROWS):
                s = b.slice(at, vectors.BLOCK_ROWS)
                ids, q = s.column(0).to_numpy(), vectors.matrix(s.column(1))
                score = q @ first.T
                score[ids[:, None] == first_ids[None, :]] = -np.inf
                # whole numbers up to 2^53 are exact; beyond, rounding may not lift the floor
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(ids), -np.inf)
                floor -= 1e-12 * np.abs(floor) * (np.abs(floor) >= 2.0**52)
                q2 = (q * q).sum(axis=1)[:, None]
                d = vectors.distances(np.hstack([q, np.zeros((len(q), 1))]), lifted)
                bound = (q2 + m2 - np.maximum(d - radius[None, :], 0) ** 2) / 2 + 1e-3 + 1e-9 * (q2 + m2)
                live = (bound >= floor[:, None]) & (radius[None, :] >= 0)
                out = []
                for g in np.flatnonzero(live.any(axis=0)).tolist():
                    m = live[:, g]
                    out.append((g, list(range(parts[g])), *vectors.pack(ids[m], np.hstack([q[m], floor[m][:, None]]))))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["q_region", "parts", "q_ids", "q_data"])

    blocks = rows.where(is_query).mapInArrow(ask, "q_region int, parts array<int>, q_ids binary, q_data binary")
    blocks = blocks.select("q_region", F.explode("parts").alias("q_part"), "q_ids", "q_data")
    met = blocks.join(pages, (F.col("q_region") == F.col("region")) & (F.col("q_part") == F.col("part"))).select("region", "part", "ids", "data", "q_ids", "q_data")
    met = met.sortWithinPartitions("region", "part")  # a tree is grown once for all its blocks

    def find(batches):
        last, tree = None, None
        for b in batches:
            for r in b.to_pylist():
                if last != (r["region"], r["part"]):
                    tree, last = Tree(*vectors.unpack(r["ids"], r["data"]), m2), (r["region"], r["part"])
                own, q = vectors.unpack(r["q_ids"], r["q_data"])
                score, ids = tree.search(q[:, :-1], own, k, q[:, -1])
                i, j = np.nonzero(ids != NONE)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i, j]), pa.array(score[i, j].astype(np.int64))], ["query_id", "vec_id", "score"])

    return vectors.best(met.mapInArrow(find, "query_id long, vec_id long, score long"), k)


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.valid(common.documents(spark, sf_dir, "embeddings"))
    whole = rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    return search(whole, F.col("id") % 100 == 0)


ORACLE = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
