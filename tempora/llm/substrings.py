"""Operator 7: removal of repeated passages by fixed-block anchors.

Every document's non-overlapping blocks of BLOCK words are reference anchors, and every rolling window
of BLOCK words probes them: a repeat of WINDOW >= 2 * BLOCK - 1 words holds a whole anchor wherever it
lies. A probe that meets an anchor's hash in another document is a hit. Hits are then extended: the
WINDOW-word windows around them are compared across documents by two independent hashes of 96 bits
together, so that no chance meeting is to be expected among 10^13 windows, and neighbouring
repeats join to the maximal exact repeat. A word goes if it lies in a window that also starts in a
document with a smaller id.

Texts are split and hashed a chunk at a time, not word by word (words.py). Hashes travel in packed blobs,
dealt by hash range; beyond DEAL buckets they are dealt in two exchanges, so that a chunk never makes more
than DEAL rows and a bucket always fits a task. Only windows around hits travel in the second round. Hashes
that a bounded sample of documents shows to be frequent do not travel: they count as hits at once, and their
smallest document is found by pre-aggregation.

Defined results: null and empty texts have no words and lose none; a document without id keeps all its
words and makes no other lose any; rows that repeat an id do not make each other lose words; an empty
table gives an empty one; further columns come along whatever their names (a column called n_words, n_removed
or kept gives way to the new one).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, words
from .words import mix

WINDOW = 13
BLOCK = 7
#: Windows that one bucket holds on average, and the most buckets that one exchange deals to.
BUCKET_ROWS = 500_000
DEAL = 4096
#: Windows that a task of the second dealing holds at once.
DEALT_ROWS = 4_000_000
SAMPLE_DOCS = 5000
FREQUENT = 8
FREQUENT_ROWS = 100_000
NOBODY = np.iinfo(np.int64).max
#: The group of what is not dealt by document.
LOWS = -1

BLOBS = "bucket int, ids binary, counts binary, places binary, hashes binary, checks binary"
DEALT = "g int, ids binary, counts binary, found binary"


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by their place in the number: high bytes, which differ little, stand together for the shuffle's compression."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the hash's upper 32 bits, in order of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _sorted_by(part: np.ndarray, buckets: int) -> np.ndarray:
    return np.argsort(part.astype(np.uint16) if buckets <= 1 << 16 else part, kind="stable")


def _cuts(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of a sorted array, `change` being where a value differs from the one before."""
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.append(starts[1:], len(change) + 1)


def _packed(part: np.ndarray, ids: np.ndarray, p: np.ndarray, h: np.ndarray, check: np.ndarray | None, buckets: int) -> list[tuple]:
    """One row a bucket that has windows: (bucket, documents, their counts, places, hashes, second hashes)."""
    if not len(part):
        return []
    order = _sorted_by(part, buckets)
    part, ids, p, h = part[order], ids[order], p[order], h[order]
    check = None if check is None else check[order]
    new = part[1:] != part[:-1]
    starts, ends = _cuts(new)
    runs, stops = _cuts(new | (ids[1:] != ids[:-1]))
    counts, held = (stops - runs).astype(np.int32), ids[runs]
    first = np.searchsorted(runs, starts).tolist()
    last = [*first[1:], len(runs)]
    out = []
    for a, z, r, s in zip(starts.tolist(), ends.tolist(), first, last, strict=True):
        out.append((int(part[a]), _planes(held[r:s]), _planes(counts[r:s]), _planes(p[a:z]), h[a:z].tobytes(), b"" if check is None else check[a:z].tobytes()))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "ids", "counts", "places", "hashes", "checks"])


def _opened(rows, kind=np.uint64, check_kind=np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash, second hash) of the windows of several blobs."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for ids, counts, places, hashes, checks in rows:
        out[0].append(np.repeat(_unplanes(ids, np.int64), _unplanes(counts, np.int32)))
        out[1].append(_unplanes(places, np.int32))
        out[2].append(np.frombuffer(hashes, kind))
        out[3].append(np.frombuffer(checks, check_kind))
    return tuple(np.concatenate(x) for x in out)


def _columns(pdf: pd.DataFrame):
    return zip(pdf["ids"], pdf["counts"], pdf["places"], pdf["hashes"], pdf["checks"], strict=True)


def _dealt(d: np.ndarray, values: np.ndarray, groups: int) -> pd.DataFrame:
    """(document, value) pairs in packed blobs, dealt by document: a row a group, however many documents it has."""
    if not len(d):
        return pd.DataFrame({"g": np.zeros(0, np.int32), "ids": [], "counts": [], "found": []})
    g = (mix(d.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((d, g))
    g, d, values = g[order], d[order], values[order]
    starts, ends = _cuts(g[1:] != g[:-1])
    runs, stops = _cuts(d[1:] != d[:-1])
    counts = (stops - runs).astype(np.int32)
    first = np.searchsorted(runs, starts).tolist()
    last = [*first[1:], len(runs)]
    return pd.DataFrame({
        "g": g[starts].astype(np.int32),
        "ids": [_planes(d[runs[r:s]]) for r, s in zip(first, last, strict=True)],
        "counts": [_planes(counts[r:s]) for r, s in zip(first, last, strict=True)],
        "found": [_planes(values[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)],
    })


def _by_doc(kind):
    """All values of each document of a group as one blob."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.concatenate([np.repeat(_unplanes(i, np.int64), _unplanes(n, np.int32)) for i, n in zip(pdf["ids"], pdf["counts"], strict=True)])
        values = np.concatenate([_unplanes(f, kind) for f in pdf["found"]])
        order = np.lexsort((values, d))
        d, values = d[order], values[order]
        starts, ends = _cuts(d[1:] != d[:-1])
        return pd.DataFrame({"id": d[starts], "found": [values[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]})

    return run


def _isin(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table."""
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h


def _runs(h: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts h (and check), and the number of the run of equal values of each sorted place."""
    order = np.argsort(h, kind="stable") if check is None else np.lexsort((check, h))
    s = h[order]
    new = s[1:] != s[:-1]
    if check is not None:
        c = check[order]
        new |= c[1:] != c[:-1]
    return order, np.concatenate([np.zeros(min(len(h), 1), np.int64), np.cumsum(new)])


def _meet(pdf: pd.DataFrame, buckets: int, groups: int) -> pd.DataFrame:
    """Places of the windows whose hash is an anchor's somewhere and occurs in two documents at least."""
    d, p, h, _ = _opened(_columns(pdf), _probe_kind(buckets))
    if pdf["bucket"].iloc[0] >= buckets:  # hits by themselves
        return _dealt(d, p, groups)
    order, run = _runs(h)
    ds, n = d[order], int(run[-1]) + 1
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    anchor = np.bincount(run, p[order] % BLOCK == 0, n) > 0
    hit = (anchor & (np.minimum.reduceat(ds, starts) < np.maximum.reduceat(ds, starts)))[run]
    return _dealt(ds[hit], p[order][hit], groups)


def _later(pdf: pd.DataFrame, groups: int, frequent: np.ndarray) -> pd.DataFrame:
    """Of each document, the hashes of its windows that a smaller document has too; and as group LOWS the smallest document of each frequent window."""
    d, _, h, check = _opened(_columns(pdf), check_kind=np.uint32)
    order, run = _runs(h, check)
    ds = d[order]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    low = np.minimum.reduceat(ds, starts)
    late = ds > low[run]
    out = _dealt(ds[late], h[order][late], groups)
    often = _isin(first := h[order][starts], frequent)
    if often.any():
        lows = pd.DataFrame({"g": np.array([LOWS], np.int32), "ids": [_planes(low[often])], "counts": [b""], "found": [_planes(first[often])]})
        out = pd.concat([out, lows]) if len(out) else lows
    return out


def _probe_kind(buckets: int):
    """Hits are only candidates, so 32 bits and the bucket's number do; the second exchange needs the upper bits too."""
    return np.uint32 if buckets <= DEAL else np.uint64


def _exchanged(blobs: DataFrame, buckets: int, extra: int = 0) -> DataFrame:
    """Blobs dealt to `buckets` ranges of their hashes (and `extra` others behind): at once, or coarsely and then each coarse range finely."""
    if buckets <= DEAL:
        return blobs
    coarse = _coarse(buckets)

    def run(batches):
        held, n = [], 0

        def handed():
            d, p, h, check = _opened([r[1:] for r in held], check_kind=np.uint32)
            return _packed(_bucket(h, buckets), d, p, h, check if len(check) else None, buckets)

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[0] >= coarse:
                    yield _batch([(r[0] - coarse + buckets, *r[1:])])
                    continue
                if held and (r[0] != held[0][0] or n > DEALT_ROWS):
                    yield _batch(handed())
                    held, n = [], 0
                held.append(r)
                n += len(r[4]) // 8
        if held:
            yield _batch(handed())

    return blobs.repartition(coarse + extra, "bucket").sortWithinPartitions("bucket").mapInArrow(run, BLOBS)


def _coarse(buckets: int) -> int:
    """Ranges of the first exchange: all, or so many that the second has about as many in each."""
    return buckets if buckets <= DEAL else int(np.ceil(buckets**0.5))


def _sampled(rows: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BLOCK- and of WINDOW-word windows that at least FREQUENT documents of a sample hold; of each at most FREQUENT_ROWS, sorted."""

    def run(batches):
        for b in common.chunked(batches):
            w = words.Words(b.column(1))
            for size in (BLOCK, WINDOW):
                d, _, h = w.windows(size)
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                new = np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
                keys, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["size", "h", "n"])

    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    found = picked.mapInArrow(run, "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    tables = []
    found = common.stored(found, "frequent")
    for size in (BLOCK, WINDOW):
        top = found.where(F.col("size") == size).orderBy(F.desc("n"), "h").limit(FREQUENT_ROWS).collect()
        tables.append(np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64)))
    return tables[0], tables[1]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return deduped(docs.select(id_col, text_col), id_col, text_col).select(id_col, "n_words", "n_removed", "kept")


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the further columns n_words, n_removed and kept; columns of these names in docs are replaced."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where(F.col("id").isNotNull())
    size, n = known.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = int(max(2 * common.slots(spark), (size or 0) / 6.5 // BUCKET_ROWS))
    groups = max(common.slots(spark), buckets // 4)
    coarse, kind = _coarse(buckets), _probe_kind(buckets)
    frequent7, frequent13 = _sampled(known, min(1.0, SAMPLE_DOCS / max(n, 1)))
    held = spark.sparkContext.broadcast((frequent7, frequent13))  # at most FREQUENT_ROWS each

    def probes(batches):
        """All BLOCK-word windows, those of frequent hashes as hits in buckets of their own."""
        for b in common.chunked(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            d, p, h = words.Words(b.column(1)).windows(BLOCK)
            d = ids[d]
            often = _isin(h, held.value[0])
            rare = ~often
            rows = _packed(_bucket(h[rare], coarse), d[rare], p[rare], h[rare].astype(kind), None, coarse)
            if often.any():
                d, p = d[often], p[often]
                g = (mix(d.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
                rows += [(k + coarse, *r) for k, *r in _packed(g, d, p, np.zeros(len(d), kind), None, groups)]
            if rows:
                yield _batch(rows)

    blobs = _exchanged(known.mapInArrow(probes, BLOBS), buckets, groups)
    hits = blobs.groupBy("bucket").applyInPandas(lambda pdf: _meet(pdf, buckets, groups), DEALT)
    places = common.stored(hits.groupBy("g").applyInPandas(_by_doc(np.int32), "id long, found binary"), "hits").withColumnRenamed("id", "h_id")
    marked = known.join(places, F.col("id") == F.col("h_id")).select("id", "text", "found")

    def near(batches):
        """The WINDOW-word windows that hold a hit; of frequent ones a chunk's smallest document only."""
        for b in common.chunked(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            w = words.Words(b.column(1))
            counts = np.array([len(x) // 4 for x in b.column(2).to_pylist()])
            at = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32) + np.repeat(w.first[:-1], counts)
            cover = np.zeros(w.total + 1, np.int64)
            # places of a row that repeats an id with another text may lie beyond this one's words
            at = at[at < np.repeat(w.first[1:], counts)]
            np.add.at(cover, np.maximum(at - (WINDOW - BLOCK), 0), 1)
            np.add.at(cover, at + 1, -1)
            d, p, h, check = w.windows(WINDOW, checked=True)
            mine = np.cumsum(cover)[w.first[d] + p] > 0
            d, p, h, check = ids[d[mine]], p[mine], h[mine], check[mine].astype(np.uint32)
            often = _isin(h, held.value[1])
            if often.any():
                order = np.flatnonzero(often)[np.lexsort((d[often], h[often]))]
                least = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]
                keep = np.concatenate([np.flatnonzero(~often), least])
                d, p, h, check = d[keep], p[keep], h[keep], check[keep]
            rows = _packed(_bucket(h, coarse), d, p, h, check, coarse)
            if rows:
                yield _batch(rows)

    second = _exchanged(marked.mapInArrow(near, BLOBS), buckets)
    later = common.stored(second.groupBy("bucket").applyInPandas(lambda pdf: _later(pdf, groups, held.value[1]), DEALT), "late")
    lows = spark.sparkContext.broadcast(_lows(later, frequent13))
    late = later.where(F.col("g") != LOWS).groupBy("g").applyInPandas(_by_doc(np.uint64), "id long, found binary").withColumnsRenamed({"id": "l_id", "found": "late"})

    added = ("n_words", "n_removed", "kept")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    fields = [f"c{i}" for i in range(len(names))]
    at_id, at_text = names.index(id_col), names.index(text_col)
    schema = StructType()
    for f, field in zip(fields, docs.schema, strict=True):
        schema.add(f, field.dataType)
    schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def cut(batches):
        for b in common.chunked(batches, at_text):
            w = words.Words(b.column(at_text))
            d, p, h = w.windows(WINDOW)
            found = b.column(len(fields)).to_pylist()
            counts = [len(x or b"") // 8 for x in found]
            bad = _late_here(d, h, np.repeat(np.arange(len(found)), counts), np.frombuffer(b"".join(x or b"" for x in found), np.uint64))
            if len(frequent := held.value[1]):
                known = np.array([i is not None for i in b.column(at_id).to_pylist()], bool)
                ids = np.array([i or 0 for i in b.column(at_id).to_pylist()], np.int64)
                at = np.searchsorted(frequent, h)
                at[at == len(frequent)] = 0
                bad |= (frequent[at] == h) & known[d] & (ids[d] > lows.value[at])
            drop = np.zeros(w.total + 1, np.int64)
            start = w.first[d[bad]] + p[bad]
            np.add.at(drop, start, 1)
            np.add.at(drop, start + WINDOW, -1)
            stay = np.cumsum(drop)[:-1] == 0
            gone = w.sums(~stay)
            new = [pa.array(np.diff(w.first), pa.int64()), pa.array(gone, pa.int64()), w.joined(stay)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], *new], [*fields, *added])

    out = docs.toDF(*fields).join(late, F.col(f"c{at_id}").cast("long") == F.col("l_id"), "left").select(*fields, "late")
    return out.mapInArrow(cut, schema).toDF(*names, *added)


def _late_here(d: np.ndarray, h: np.ndarray, ld: np.ndarray, lh: np.ndarray) -> np.ndarray:
    """Which windows (document, hash) are among the late ones (ld, lh)."""
    if not len(lh):
        return np.zeros(len(h), bool)
    with np.errstate(over="ignore"):
        key = lambda x, y: y + mix(x.astype(np.uint64) + np.uint64(1))
    late = key(ld, lh)
    order = np.argsort(late)
    at = np.searchsorted(late[order], key(d, h))
    at[at == len(late)] = 0
    at = order[at]
    return (lh[at] == h) & (ld[at] == d)


def _lows(later: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """The smallest document of each frequent window; NOBODY where none holds a hit."""
    out = np.full(len(frequent), NOBODY)
    for r in later.where(F.col("g") == LOWS).select("ids", "found").collect() if len(frequent) else []:  # at most FREQUENT_ROWS entries
        at = np.searchsorted(frequent, _unplanes(bytes(r["found"]), np.uint64))
        np.minimum.at(out, at, _unplanes(bytes(r["ids"]), np.int64))
    return out


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
