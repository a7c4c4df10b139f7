"""Sessions for local use, and stored intermediates in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """This application's part of the folder that the cluster shares (spark.checkpoint.dir).  A local session that
    names none gets a temporary one; on a cluster that would lose data, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cairn-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path there."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all intermediates of this application, once what was made of them is written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where it has fewer partitions than there are cores (a small file is often read by one
    task); larger inputs are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor
    costs a re-read, and several consumers share one computation."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution, as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairn")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
