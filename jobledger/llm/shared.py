"""Tables kept between jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of this machine only where none is set and all runs here (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return made


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """:func:`saved`, and the folder."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The folder stays until :func:`remove_saved`, as lazy results still read it.
    """
    return saved_at(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder where Spark sees it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def remove_saved(spark: SparkSession) -> None:
    """Delete all tables that :func:`saved` has written for this application; call it once results have been written or read."""
    remove(spark, _own_dir(spark))
