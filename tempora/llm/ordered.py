"""Positions of rows within their groups, along a global order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def group_key(column: Column) -> Column:
    """A text that is null for no value and sorts as the column's text does, null first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "laid") -> DataFrame:
    """rows with pos (from 0, of its place in its group) and n (rows of the group), as a stored table.

    Rows are laid out by ranges of (group, order, a hash of the row's own number), so neither a large group nor many equal
    rows meet in one task. A range's rows are numbered as they are written; what lies before a range in its group is a sum
    over at most one row a range and group. No column of rows may be called pos, n, _tie, _mid, _range or _row.
    """
    rows = common.stored(rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())), f"{name}-rows")
    keys = [F.col(group), *order, F.col("_tie")]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()).drop("_tie")
    laid = common.stored(laid, name)
    part, row = F.shiftright("_mid", ROW_BITS).alias("_range"), F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row")
    laid = laid.select("*", part, row).drop("_mid")
    runs = laid.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_k"), F.min("_row").alias("_first"))
    of = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_k").over(of.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_g", "_r", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(of).alias("n"))
    out = laid.join(runs, (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_g", "_r", "_range", "_row", "_shift")
