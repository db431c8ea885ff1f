"""Operator 5: n-gram Jaccard join as a metric-space join.

The Jaccard distance is a metric, but between unrelated texts it is nearly always 1, so document pivots
alone tell nothing apart at the top. The first pivots are therefore single shingles: a document's home is
the region of its first shingle in a global order, rare ones first, and its window reaches the regions
of the next |x| - ceil(0.85 |x|): two documents within the distance share one of them, so no link is lost
(the prefix bound, which for such pivots is what the triangle inequality gives, sharpened).

Equal sets are one class from the start. Each region's smallest document is its pivot; documents linked
to pivots form first components, and regions within one component are done. In the others, documents are
embedded by their shingle counts in SLICES hash classes: the L1 distance there never exceeds the size of
the symmetric difference. Within a region, pivots make Voronoi cells of that space; the triangle
inequality replicates documents to cells whose pivot is within twice the greatest allowed distance
farther; cells join recursively, and what their bounds leave is verified on the whole sets.

Near copies share most of their regions. A pair is compared in the first of them only, as far as the first few regions of
both tell: each row carries those of its document. In a pair's first region the shingles before it are in one set alone,
which bounds the common ones.

Defined results: null and empty texts, and those without words, have an empty set, are linked with
nothing and are their own component; a document with fewer words than a shingle has one shingle; a row
without id joins its class but links none; rows that repeat an id share its component; an empty table
gives an empty one; further columns are ignored. Shingles are told apart by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import Words, mix

SHINGLE = 4
PERCENT = 85
SLICES = 128
SAMPLE_DOCS = 20_000
FREQUENT_ROWS = 300_000
#: Documents of a region that one task joins; larger regions are dealt as pairs of blocks.
BLOCK_DOCS = 2048
CELL = 256
PIVOTS = 8
#: Classes of the folded sketch; pairs that a leaf compares at once; rows of whole regions that a task joins at once.
COARSE = 16
LEAF_PAIRS = 200_000
JOINED_ROWS = 20_000
#: Regions, the first in the order, that each row of a document names: a pair that shares one of them is left to it.
FIRST = 4
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by both; fewer words than a shingle are one together."""
    w = Words(texts, lower=True)
    d, _, h = w.windows(size)
    few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < size))
    if len(few):
        n = np.diff(w.first)[few]
        with np.errstate(over="ignore"):
            # the number of words is part of the hash: no short text equals a shingle
            turned = mix(w.hashes() + _STEP * (np.arange(w.total) - w.first[w.owner] + 1).astype(np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turned, dtype=np.uint64)])
            whole = mix(sums[w.first[few + 1]] - sums[w.first[few]] + n.astype(np.uint64))
        d, h = np.concatenate([d, few]), np.concatenate([h, whole])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return d[new], h[new]


def _needed(n, percent: int):
    """The least size of a set that may reach the similarity with one of n (number or array)."""
    return -(-percent * n // 100)


def _frequent(rows: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample hold, sorted, and the class (log2) of how many."""

    def run(batches):
        for b in common.chunked(batches):
            keys, n = np.unique(shingles(b.column(1), size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    found = picked.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "h").limit(FREQUENT_ROWS)
    table = found.toPandas()  # at most FREQUENT_ROWS
    order = np.argsort(table["h"].to_numpy(np.int64).view(np.uint64))
    return table["h"].to_numpy(np.int64).view(np.uint64)[order], np.log2(table["n"].to_numpy(float)[order]).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _bytes(column) -> np.ndarray:
    """All bytes of an Arrow column of binary values, one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]


def _described(rows: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: id, n, sig (of the whole set), sketch (counts by slice), prefix (regions of home and window)."""
    held = rows.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_ROWS

    def run(batches):
        keys, kinds = held.value
        for b in common.chunked(batches):
            d, h = shingles(b.column(1), size)
            total = b.num_rows
            n = np.bincount(d, minlength=total)
            ends = np.cumsum(n)
            # equal sets by 128 bits: sums of two mixed hashes of their shingles
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(k)), dtype=np.uint64)]) for k in (11, 23)]
            sig = np.stack([x[ends] - x[ends - n] for x in sums], 1).view(np.uint8).reshape(total, 16)
            counts = np.bincount(d * SLICES + (h & np.uint64(SLICES - 1)).astype(np.int64), minlength=total * SLICES)
            sketch = np.minimum(counts, 255).astype(np.uint8).reshape(total, SLICES)
            # the rarest come first
            kind = np.zeros(len(h), np.uint8)
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                kind = np.where(keys[at] == h, kinds[at], 0)
                order = np.lexsort((h, kind, d))
                h = h[order]
            k = np.where(n > 0, n - _needed(n, percent) + 1, 0)
            mine = np.arange(len(h)) - np.repeat(ends - n, n) < np.repeat(k, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(h[mine].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _binary(sig), _binary(sketch), prefix], ["id", "n", "sig", "sketch", "prefix"])

    return rows.mapInArrow(run, "id long, n long, sig binary, sketch binary, prefix array<long>")


def _close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """By sizes and sketches: may the (aligned) sets reach the similarity?"""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return (100 * small >= percent * large) & ((100 + percent) * gap <= (100 - percent) * (na + nb))


def _here(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int, pos: np.ndarray, first: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each pair of rows of one region: may this be the first region that they share, and may the sets reach the similarity if it is?

    pos shingles come before the region's in the row's set; first are its document's first regions, of which `known` come before this one.
    What is refused here has met in an earlier region, or is too far apart: at the first common region none of the pos is common.
    """
    good = (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])
    for a in range(first.shape[1]):
        for b in range(first.shape[1]):
            good &= (first[x, a] != first[y, b]) | (known[x] <= a) | (known[y] <= b)
    return good


def _leaf(sk: np.ndarray, coarse: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int, cell: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, place: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one row marked left, one marked right, of different groups) within each cell that the bounds leave, all cells at once.

    rows are row numbers, sorted by (cell, n); a row meets those after it in its cell that are not too large for it. With a place
    (pos, first, known), a pair is left to the first region that it shares.
    """
    big = np.int64(int(n.max(initial=0)) * 100 // percent + 2)
    key = cell * big + n[rows]
    last = np.searchsorted(key, cell * big + n[rows] * 100 // percent, side="right")
    count = last - np.arange(len(rows)) - 1
    ends = np.cumsum(count)
    out, at = [], 0
    while at < len(rows):
        # as many rows as have about LEAF_PAIRS pairs
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAF_PAIRS, side="right")))
        c = count[at:stop]
        i = np.repeat(np.arange(at, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        either = (left[i] & right[j]) | (left[j] & right[i])
        x, y = rows[i], rows[j]
        good = either & (group[x] != group[y])
        x, y = x[good], y[good]
        if place is not None:
            good = _here(x, y, n, percent, *place)
            x, y = x[good], y[good]
        for table in (coarse, sk):
            gap = np.abs(table[x].astype(np.int16) - table[y].astype(np.int16)).sum(axis=1, dtype=np.int32)
            good = (100 + percent) * gap.astype(np.int64) <= (100 - percent) * (n[x] + n[y])
            x, y = x[good], y[good]
        out.append((x, y))
        at = stop
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (np.zeros(0, np.int64),) * 2


def _folded(sk: np.ndarray) -> np.ndarray:
    """The sketch by COARSE classes: its distances never exceed the sketch's own, at a fraction of the work."""
    return sk.reshape(len(sk), COARSE, -1).sum(axis=2, dtype=np.int16)


def _cells(sk: np.ndarray, n: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Recursive Voronoi cells of the rows: (left rows, right rows) such that each pair within reach meets in one at least."""
    if not len(left) or not len(right):
        return []
    same = left is right
    if len(left) + len(right) > CELL and depth < 6:
        both = left if same else np.union1d(left, right)
        reach = (100 - percent) * 2 * int(n[both].max()) // (100 + percent)
        wide = sk.astype(np.int16)
        pivots = np.random.default_rng(depth).choice(both, min(PIVOTS, len(both)), replace=False)
        far = lambda rows: np.stack([np.abs(wide[rows] - wide[p]).sum(axis=1) for p in pivots], 1)
        dl = far(left)
        dr = dl if same else far(right)
        home = dl.argmin(axis=1)
        windows_, cost = [], 0
        for c in range(len(pivots)):
            mine = home == c
            # a partner's distance to this cell's pivot is at most its nearest one and twice the reach
            near = (dr[:, c] <= dr.min(axis=1) + 2 * reach) & (dr[:, c] <= dl[mine, c].max(initial=-1) + reach)
            windows_.append((left[mine], right[near]))
            cost += int(mine.sum()) * int(near.sum())
        if cost < 0.7 * len(left) * len(right):
            return [x for a, b in windows_ for x in _cells(sk, n, percent, a, b, depth + 1)]
    return [(left, right)]


def _pairs_of(sk: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int, blocks: list[tuple[np.ndarray, np.ndarray]], place: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different groups that the bounds leave; blocks are (left rows, right rows), large ones cut into cells first."""
    cells = [c for a, b in blocks for c in (_cells(sk, n, percent, a, b) if len(a) + len(b) > CELL else [(a, b)])]
    rows, cell, left, right = [], [], [], []
    for k, (a, b) in enumerate(cells):
        both = a if a is b else np.union1d(a, b)
        rows.append(both), cell.append(np.full(len(both), k))
        left.append(np.ones(len(both), bool) if a is b else np.isin(both, a, assume_unique=True))
        right.append(np.ones(len(both), bool) if a is b else np.isin(both, b, assume_unique=True))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cell, left, right = (np.concatenate(x) for x in (rows, cell, left, right))
    order = np.lexsort((n[rows], cell))
    return _leaf(sk, _folded(sk), n, group, percent, cell[order], rows[order], left[order], right[order], place)


def _join_regions(percent: int):
    """Rows sorted by (s, bi, bj), of which one region block is held at a time -> candidate pairs."""

    def pairs(rows: pa.Table, cuts: list[int]):
        """The pairs of several whole regions (blocks), which end at `cuts`."""
        ids, n, group = (rows.column(c).to_numpy() for c in ("id", "n", "comp"))
        mine = rows.column("left").to_numpy()
        place = rows.column("pos").to_numpy(), np.stack([rows.column(f"first{k}").to_numpy() for k in range(FIRST)], 1), rows.column("known").to_numpy()
        sk = _bytes(rows.column("sketch")).reshape(len(ids), SLICES)
        at = [0, *cuts]
        sizes = np.diff(at)
        whole = np.logical_and.reduceat(mine, at[:-1])
        # regions of one block that are small already are cells
        small = whole & (sizes <= CELL)
        found = []
        if small.any():
            cell = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.flatnonzero(small[cell])
            order = keep[np.lexsort((n[keep], cell[keep]))]
            every = np.ones(len(order), bool)
            found.append(_leaf(sk, _folded(sk), n, group, percent, cell[order], order, every, every, place))
        blocks = []
        for k in np.flatnonzero(~small).tolist():
            r = np.arange(at[k], at[k + 1])
            a = r if whole[k] else r[mine[r]]
            blocks.append((a, a if whole[k] else r[~mine[r]]))
        if blocks:
            found.append(_pairs_of(sk, n, group, percent, blocks, place))
        x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        keep = (low < high) & np.concatenate([np.ones(min(len(low), 1), bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(high[keep])], ["x", "y"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < JOINED_ROWS:
                continue
            t = pa.Table.from_batches(held)
            cuts = _changes(t)
            if cuts:
                yield pairs(t.slice(0, cuts[-1]), cuts)
            rest = t.slice(cuts[-1] if cuts else 0)
            held, size = rest.to_batches(), rest.num_rows
        if size:
            t = pa.Table.from_batches(held)
            yield pairs(t, [*_changes(t), t.num_rows])

    return run


def _changes(rows: pa.Table) -> list[int]:
    """Where another region (block) begins."""
    keys = [rows.column(c).to_numpy() for c in ("s", "bi", "bj")]
    return (np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist()


def _sets(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(s_id, set) of the documents in ids: their texts are read again, as sets of all documents would not fit the disks."""

    def run(batches):
        for b in common.chunked(batches):
            d, h = shingles(b.column(1), size)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=b.num_rows))]) * 8
            made = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["s_id", "set"])

    few = ids.count() <= common.BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("k"), "left_semi").mapInArrow(run, "s_id long, set binary")


def _linked(pairs: DataFrame, sketches: DataFrame, rows: DataFrame, size: int, percent: int, tested: bool) -> DataFrame:
    """The pairs (x, y) that reach the similarity, on whole sets; unless tested, sizes and sketches sift them first."""

    def sift(batches):
        for b in batches:
            if b.num_rows:
                a, c = (_bytes(b.column(i)).reshape(b.num_rows, SLICES) for i in (4, 5))
                good = _close(a, c, b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["x", "y"])

    if not tested:
        side = lambda k: sketches.select(F.col("id").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"k{k}"))
        both = pairs.join(side(1), F.col("x") == F.col("i1")).join(side(2), F.col("y") == F.col("i2")).select("x", "y", "n1", "n2", "k1", "k2")
        pairs = both.mapInArrow(sift, "x long, y long")
    pairs = common.stored(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    sets = common.stored(_sets(rows, ids, size), "sets")

    def verify(batches):
        for b in batches:
            good = []
            for u, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            if any(good):
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["x", "y"])

    side = lambda k: sets.select(F.col("s_id").alias(f"i{k}"), F.col("set").alias(f"s{k}"))
    met = pairs.join(side(1), F.col("x") == F.col("i1")).join(side(2), F.col("y") == F.col("i2")).select("x", "y", "s1", "s2")
    return common.stored(met.mapInArrow(verify, "x long, y long"), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach)."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.where(F.col("id").isNotNull())
    share = min(1.0, SAMPLE_DOCS / max(known.count(), 1))
    base = common.stored(_described(rows, size, percent, _frequent(known, size, share)), "described")
    filled = base.where("n > 0 AND id IS NOT NULL")
    keepers = filled.groupBy("sig").agg(F.min("id").alias("rep"))
    keepers = common.stored(keepers, "keepers")
    first = keepers.select(F.col("sig").alias("c_sig"), "rep")
    classes = filled.join(first, (F.col("sig") == F.col("c_sig")) & (F.col("id") == F.col("rep")), "left_semi")
    homes = classes.select(F.posexplode("prefix").alias("pos", "s"), "id")
    regions = homes.groupBy(F.col("s").alias("r_s")).agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    active = common.stored(homes.join(regions, F.col("s") == F.col("r_s")).select("s", "id", "pos", "pivot"), "active")
    sketches = filled.select("id", "n", "sketch")
    stars = active.where("id <> pivot").select(F.col("pivot").alias("x"), F.col("id").alias("y")).distinct()
    links = _linked(stars, sketches, known, size, percent, tested=False)
    comps = common.stored(components(links), "components")

    placed = active.join(comps, F.col("id") == F.col("node"), "left").select("s", "id", "pos", F.coalesce("component", "id").alias("comp"))
    placed = common.stored(placed, "placed")
    open_ = placed.groupBy(F.col("s").alias("r_s")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("r_s", ((F.col("m") + BLOCK_DOCS - 1) / BLOCK_DOCS).cast("int").alias("blocks"))
    opened = placed.join(open_, F.col("s") == F.col("r_s"))
    # a document's first open regions: two documents of different components that share a region share an open one
    firsts = opened.groupBy(F.col("id").alias("k_id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "s"))), 1, FIRST).alias("first"))
    left = opened.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each pair of blocks of a region meets once: a document is on the left of its own block's pairs, on the right of earlier ones
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("s", "id", "pos", "comp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") <= F.col("other")).alias("left"))
    # of an id with several texts, rows don't tell to which of them a position belongs
    several = keepers.groupBy(F.col("rep").alias("m_id")).count().where("count > 1").select("m_id")
    about = firsts.join(sketches, F.col("k_id") == F.col("id")).drop("id").join(several, F.col("k_id") == F.col("m_id"), "left")
    single = F.col("m_id").isNull().cast("int")
    named_first = [F.coalesce(F.get("first", F.lit(k))["s"], F.lit(0)).alias(f"first{k}") for k in range(FIRST)]
    known_first = (single * F.size(F.filter("first", lambda f: f["pos"] < F.col("pos")))).alias("known")
    full = left.join(about, F.col("id") == F.col("k_id")).select("s", "bi", "bj", "id", "n", "comp", "left", (single * F.col("pos")).alias("pos"), known_first, *named_first, "sketch")
    cells = full.repartition("s", "bi", "bj").sortWithinPartitions("s", "bi", "bj")
    more = _linked(cells.mapInArrow(_join_regions(percent), "x long, y long"), sketches, known, size, percent, tested=True)
    found = components(links.unionByName(more)).select(F.col("node").alias("f_id"), "component")

    named = base.select("id", "n", "sig").join(first, F.col("sig") == F.col("c_sig"), "left")
    named = named.withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = named.join(found, F.col("rep") == F.col("f_id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))
