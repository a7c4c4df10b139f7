"""The vector store as Parquet: append, segments, recovery, upserts, statistics."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import stored

SEGMENT_ROWS, SEGMENT_BYTES, BLOCK_ROWS = 10_000, 64 << 20, 128
RECORD = "id long, vector array<float>, text string, metadata map<string,string>, norm float, created_at_ns long"


def record_size(vector: Column, text: Column) -> Column:
    """The estimated bytes of a record in memory."""
    return (F.lit(8 + 8 + 4 + 64) + 4 * F.size(vector) + F.octet_length(text)).cast("long")


def recovered(segments: DataFrame, log: DataFrame, id_: str = "id") -> DataFrame:
    """Segments and what only the log has; of a log that repeats an id, the first row by content."""
    once = log.dropDuplicates([id_])
    return segments.unionByName(once.join(segments.select(id_), id_, "left_anti"))


def next_id(rows: DataFrame, id_: str = "id") -> int:
    top = rows.agg(F.max(id_)).first()[0]
    return 0 if top is None else top + 1


def numbered(rows: DataFrame, first: int, id_: str = "id") -> DataFrame:
    """rows with gapless ids from `first`, in the order of partitions and of rows in them.  Partitions are
    counted and offset, so no single task sees all rows; rows are stored with their places first, so
    places can't change between the count and the use."""
    spark = rows.sparkSession
    placed = stored(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    base, at = [], first
    for r in sorted(placed.groupBy("__p").count().collect()):
        base.append((r["__p"], at))
        at += r["count"]
    offsets = spark.createDataFrame(base, "__p int, __base long")  # one row per partition
    return placed.join(F.broadcast(offsets), "__p").withColumn(id_, F.col("__base") + F.col("__i")).drop("__p", "__base", "__i")


@contextmanager
def writer_lock(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds the store at path for one writer: a file beside it, which the file system lets only one create.  A
    writer that died leaves it there, to be removed by hand."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.lock")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if not fs.exists(at):
            raise
        raise RuntimeError(f"{path} has another writer") from e
    try:
        yield
    finally:
        fs.delete(at, False)


def segment_rows(rows: DataFrame, vector: str = "vector", text: str = "text") -> int:
    """Rows of a segment: up to SEGMENT_ROWS, and no more than SEGMENT_BYTES hold by the mean size of a record."""
    if not {vector, text} <= set(rows.columns):
        return SEGMENT_ROWS
    mean = rows.agg(F.avg(record_size(F.col(vector), F.coalesce(text, F.lit(""))))).first()[0]
    return max(1, min(SEGMENT_ROWS, int(SEGMENT_BYTES / mean))) if mean else SEGMENT_ROWS


def append(spark: SparkSession, path: str, rows: DataFrame, id_: str = "id") -> None:
    """Adds rows (without ids) as sorted segment files of bounded length; a failed write leaves nothing, and a
    second writer fails before it reads."""
    with writer_lock(spark, path):
        try:
            first = next_id(spark.read.parquet(path), id_)
        except AnalysisException as e:  # an empty store has no files yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            first = 0
        placed = numbered(rows, first, id_)
        placed.sortWithinPartitions(id_).write.option("maxRecordsPerFile", segment_rows(placed)).mode("append").parquet(path)


def get(rows: DataFrame, ids: list[int], id_: str = "id") -> DataFrame:
    """Rows by id; the filter reaches the Parquet statistics."""
    return rows.where(F.col(id_).isin(*ids)) if ids else rows.where("false")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes last by `order`; rows without a key are not kept."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    kept = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("__n", F.row_number().over(w))
    return kept.where("__n = 1").drop("__n")


def block_index(rows: DataFrame, id_: str = "id", size: int = BLOCK_ROWS) -> DataFrame:
    """block, first_id, last_id, count of each `size` rows in order of id.  Row numbers come from sorted
    ranges and their counts, so there is no sort of all rows in one task."""
    ranged = rows.select(id_).repartitionByRange(F.col(id_)).sortWithinPartitions(id_)
    at = numbered(ranged, 0, "__n")
    return at.groupBy(F.floor(F.col("__n") / size).cast("long").alias("block")).agg(F.min(id_).alias("first_id"), F.max(id_).alias("last_id"), F.count("*").alias("count"))
