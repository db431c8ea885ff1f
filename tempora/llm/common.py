"""What the operators of this subpackage share: shared-folder tables, batches of bounded size, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a Python worker works on at once.
CHUNK_CHARS = 2_000_000
#: Rows of a batch that Spark hands to a Python worker: texts of a few KB make batches of a few MB.
BATCH_ROWS = 2000
#: Entries that a worker's word cache holds before it starts again, and the longest word that it keeps.
CACHE_WORDS = 100_000
CACHE_LENGTH = 64
#: The same for words whose tokens are kept (no text is as costly to encode again).
CACHE_TOKENS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master, which has no other machines, may go without and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, read again: cuts the lineage and survives lost executors. What it shuffled goes from the disks once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows alone, so that of whole texts is lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns c0, c1, ... and which name became which: no column that is added can clash."""
    fields = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*fields.values()), fields


def slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the optimizer can't put the value's expression in each of its places."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def chunked(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about limit bytes of column `text`; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_ids(df: DataFrame, bound: int, key: str = "doc_id", by: str | None = None) -> DataFrame:
    """Up to `bound` ids (for each value of `by`), in the order of their hash: the same rows at any partitioning.

    Of a large group only the ids under a threshold of the hash are ordered, which is set so that half as many again as
    needed are to be expected: no task gets a whole group.
    """
    cols = df.select(F.col(key).alias("_id"), *([F.col(by).alias("_by")] if by else [])).where(F.col("_id").isNotNull()).withColumn("_h", F.xxhash64("_id"))
    if not by:
        return cols.select("_id", "_h").distinct().orderBy("_h", "_id").limit(bound).select("_id")
    sizes = cols.groupBy(F.col("_by").alias("_of")).agg(F.count("*").alias("_n"))
    part = F.pmod(F.col("_h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = cols.join(sizes, F.col("_by").eqNullSafe(F.col("_of"))).where(part * F.col("_n") < 1.5 * bound + 1000).select("_id", "_by", "_h").distinct()
    w = Window.partitionBy("_by").orderBy(part, "_h", "_id")  # about 1.5 * bound + 1000 rows
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= bound).select("_id").distinct()


def annotated(docs: DataFrame, text_col: str, compute: Callable[[list[str]], list[pa.Array]], new: str) -> DataFrame:
    """docs with the further columns `new` ("name type, ..."), which compute gives for a list of whole texts.

    One narrow pass; all columns of docs come along whatever their names, but for those of the new ones' names, which give way.
    """
    from pyspark.sql.types import StructType

    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in StructType.fromDDL(new).names])
    names, at = docs.columns, docs.columns.index(text_col)
    fields = [f"c{i}" for i in range(len(names))]
    added = StructType.fromDDL(new)
    out = StructType()
    for f, field in zip(fields, docs.schema, strict=True):
        out.add(f, field.dataType)
    for field in added:
        out.add(field)

    def run(batches):
        for b in chunked(batches, at):
            found = compute(texts_of(b, at))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*fields, *added.names])

    rows = docs.toDF(*fields).mapInArrow(run, out)
    return rows.toDF(*names, *added.names)


#: Ids that may be broadcast (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (no column of which is called _gone) without the given (distinct) ids, which are broadcast only after their number was checked."""
    gone = stored(ids.toDF("_gone"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("_gone"), "left_anti")
