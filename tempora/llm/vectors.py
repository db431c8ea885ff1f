"""What the two vector searches share: valid vectors, packed blocks, the reduction to a metric, merging of hits.

The largest inner product is the nearest Euclidean neighbour once every vector gets one more component
that brings it to the same norm M: |q - x|^2 = |q|^2 + M^2 - 2 q.x with q's own extra component 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a page file or list part, and queries in a block: what one row of a join may hold.
PART_ROWS = 4096
BLOCK_ROWS = 256
BLOB = "ids binary, data binary"


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(id long, v array<double>) without null, empty or non-finite vectors (without all-zero ones too, if not zero)."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def measured(rows: DataFrame) -> tuple[DataFrame, float, int]:
    """(rows, largest squared norm, number) of a stored table (id, v). Where vectors differ in length, only those of the commonest take part (of equally common ones, the shortest)."""
    square = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    m2, total, low, high = rows.agg(square, F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if total and low != high:
        width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()["w"]
        rows = rows.where(F.size("v") == width)
        m2, total = rows.agg(square, F.count("*")).first()
    return rows, m2, total


def once(rows: DataFrame) -> DataFrame:
    """rows (id, v) of a stored table with each id once, by its least vector. Only where ids repeat are vectors shuffled, and those alone."""
    repeated = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    if repeated.isEmpty():
        return rows
    least = rows.join(repeated, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return rows.join(repeated, F.col("id") == F.col("again"), "left_anti").unionByName(least)


def matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def pack(ids: np.ndarray, data: np.ndarray) -> tuple[bytes, bytes]:
    return np.ascontiguousarray(ids, np.int64).tobytes(), np.ascontiguousarray(data, np.float64).tobytes()


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.float64).reshape(len(i), -1) if len(i) else np.zeros((0, 0))


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    """Vectors with the component that brings them to norm sqrt(m2)."""
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def sample(rows: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n of the total vectors in the order of their ids' hashes: a bounded number, on the driver.

    Only rows below a hash that about n rows lie below are sorted: what is sent to the place that merges them does not grow with the partitions.
    """
    h, wanted, share = F.xxhash64("id"), min(n, total), (n + 10 * n**0.5) / max(total, 1)
    low = rows
    while share < 0.5:
        low = rows.where(h < F.lit(int(share * 2**64) - 2**63))
        if low.count() >= wanted:
            break
        low, share = rows, share * 2
    found = low.orderBy(h, "id").limit(n).select("id", "v").toArrow().combine_chunks()
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return found.column("id").to_numpy(), matrix(found.column("v").chunk(0))


def best(hits: DataFrame, k: int, repeated: bool = False) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query, ranked; ties go to the smaller vec_id. If repeated, a pair counts once, by its highest score."""
    if repeated:
        hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
