"""Operator 8: variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length. Piece lengths are bounded, so the
packing is planned on the histogram of lengths (at most that many rows): best-fit decreasing over
several permitted bin lengths at once. A piece goes to the open bin that it leaves least room in; with
none, the bin length is opened that costs least for the piece and what can still be put beside it; in
the end each bin is downsized to the least permitted length that holds its contents. Open bins are
held as classes of equal ones with their number, so the plan's size follows the number of distinct
lengths. Pieces then
find their bins by their rank among the pieces of equal length; ranks come from salted counts, so no
length is in one task alone.

Defined results: a document without words (or null) has no piece and takes no part; a repeated row is
packed each time; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin beyond its length: what the start of a sequence costs, in tokens.
OPENING = 16
SALT_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _opened(lengths: list[int], left: dict[int, int], caps: Sequence[int]) -> tuple[int, int]:
    """(capacity, bins) to open for the longest length: the least cost a token with what can still be put beside the piece."""
    top = lengths[-1]
    best = None
    for cap in caps[bisect.bisect_left(caps, top) :]:
        content, room = {}, cap
        i = len(lengths) - 1
        while room > 0 and i >= 0:
            n = lengths[i]
            if k := min(room // n, left[n]):
                content[n] = k
                room -= k * n
            i = min(i, bisect.bisect_right(lengths, room)) - 1
        used = cap - room
        cost = (caps[bisect.bisect_left(caps, used)] + OPENING) / used  # downsized
        if best is None or cost < best[0]:
            best = (cost, cap, min(left[n] // k for n, k in content.items()))
    return best[1], best[2]


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, int, int, dict[int, int]]]:
    """Groups of equal bins: (first bin number, bins, capacity, pieces of each length in a bin).

    Open bins are held as classes of equal bins in order of their room. After a piece its bin is still the one of least
    room that may hold the next piece of this length, so a class takes room // n pieces a bin; at most one class a length
    is split, so there are few more classes than lengths.
    """
    caps = sorted(capacities)
    left = {n: k for n, k in histogram.items() if k > 0}
    lengths = sorted(left)
    open_: list[tuple[int, int, int, dict[int, int]]] = []  # room, number (so that no contents are compared), bins, contents
    done: list[tuple[int, dict[int, int]]] = []
    made = 0

    def keep(room: int, bins: int, content: dict[int, int]) -> None:
        nonlocal made
        if bins and room < lengths[0]:
            done.append((bins, content))
        elif bins:
            made += 1
            bisect.insort(open_, (room, made, bins, content))

    while lengths:
        n = lengths[-1]
        while k := left[n]:
            at = bisect.bisect_left(open_, (n,))
            if at < len(open_):
                room, _, bins, content = open_.pop(at)
            else:
                room, bins = _opened(lengths, left, caps)
                content = {}
            each = room // n
            full = min(bins, k // each)
            rest = k - full * each if full < bins else 0  # for one bin more, not filled
            keep(room - each * n, full, content | {n: each}) if full else None
            keep(room - rest * n, 1, content | {n: rest}) if rest else None
            keep(room, bins - full - bool(rest), content) if content else None
            left[n] -= full * each + rest
        del left[n]
        lengths.pop()
    done += [(bins, content) for _, _, bins, content in open_]
    groups, first = [], 0
    for bins, content in done:
        used = sum(n * k for n, k in content.items())
        groups.append((first, bins, caps[bisect.bisect_left(caps, used)], content))  # downsized
        first += bins
    return groups


def pieces(docs: DataFrame, length: Column, largest: int, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, piece (from 0), start, n. Longer documents are cut at the largest capacity."""
    sized = docs.select(F.col(id_col).alias("id"), length.cast("long").alias("total")).where("total > 0")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / largest).cast("int"))))
    return cut.select("id", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("start"), F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).cast("int").alias("n"))


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, length: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, piece, start, n, bin_id, bin_size. The driver holds the histogram only: at most max(capacities) rows."""
    spark = docs.sparkSession
    items = common.stored(pieces(docs, word_count() if length is None else length, max(capacities), id_col), "pieces")
    total = items.count()
    salts = max(8, -(-total // SALT_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = salted.groupBy("n", "salt").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    histogram = {r["n"]: r["k"] for r in items.groupBy("n").agg(F.count("*").alias("k")).collect()}
    groups = plan(histogram, capacities)
    # of each length: from which rank on its pieces go to which group, and how many of them a bin takes
    at, rows = dict.fromkeys(histogram, 0), []
    for first, bins, size, content in groups:
        for n, k in content.items():
            rows.append((n, at[n], at[n] + bins * k, k, first, size))
            at[n] += bins * k
    table = spark.createDataFrame(rows, "g_n int, g_from long, g_to long, g_each long, g_first long, g_size int")
    steps = table.groupBy("g_n").agg(F.sort_array(F.collect_list(F.struct("g_from", "g_to", "g_each", "g_first", "g_size"))).alias("steps"))
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("n", "salt").orderBy("id", "piece")))
        .join(F.broadcast(before.withColumnsRenamed({"n": "b_n", "salt": "b_salt"})) if salts * len(histogram) < 200_000 else before.withColumnsRenamed({"n": "b_n", "salt": "b_salt"}), (F.col("n") == F.col("b_n")) & (F.col("salt") == F.col("b_salt")))
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
        .join(F.broadcast(steps), F.col("n") == F.col("g_n"))  # at most max(capacities) rows
    )
    mine = F.element_at(F.filter("steps", lambda s: (s["g_from"] <= F.col("rank")) & (F.col("rank") < s["g_to"])), 1)
    found = ranked.withColumn("step", mine)
    bin_id = F.col("step.g_first") + F.floor((F.col("rank") - F.col("step.g_from")) / F.col("step.g_each")).cast("long")
    return found.select(F.col("id").alias(id_col), "piece", "start", "n", bin_id.alias("bin_id"), F.col("step.g_size").alias("bin_size"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
