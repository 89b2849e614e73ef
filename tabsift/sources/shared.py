"""The folder that the driver and all executors share, and tables in it that cut the lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set on one machine; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tabsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder by Hadoop's file system; a folder that is gone is no error."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tabsift-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write a Parquet table into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    remove(df.sparkSession, df.scratch)


#: Bytes of input for each core under which a scan has fewer tasks than there are cores, and those that are too few to care.
SMALL, TINY = 4 << 20, 128 << 10


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input that makes fewer scan tasks than there are cores to all of them, ahead of costly parsing.
    A larger input is left as it is, so that nothing is shuffled there."""
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if TINY < size < cores * SMALL else df
