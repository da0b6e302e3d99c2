"""Reading and writing the job system's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger import schemas


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The event log; of JSON lines, malformed ones come with ``_corrupt_record`` set."""
    if fmt == "json":
        return spark.read.schema(f"{schemas.EVENT}, _corrupt_record string").json(path)
    return spark.read.schema(schemas.EVENT).parquet(path)


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """``lines(line)`` of JSON -> the event's columns and ``corrupt``, beside the other columns of ``lines``."""
    got = F.from_json("line", f"{schemas.EVENT}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    others = [c for c in lines.columns if c != "line"]
    return lines.withColumn("e", got).select(*others, "e.*", F.col("e._bad").isNotNull().alias("corrupt")).drop("_bad")


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The event log as a stream of its Parquet files."""
    return spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, partition_column: str = "id", bounds: tuple[int, int, int] | None = None, **jdbc: str) -> DataFrame:
    """A job or workflow table: a Parquet copy, or with ``jdbc:`` paths the database's, read in ``bounds`` = (low, high, parts)."""
    if path.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", path).options(**jdbc)
        if bounds:
            low, high, parts = bounds
            reader = reader.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        return reader.load()
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def decode_nodes(chains: DataFrame) -> DataFrame:
    """``nodes_json`` -> ``nodes``, null where it isn't such JSON."""
    return chains.withColumn("nodes", F.from_json("nodes_json", schemas.NODES)).drop("nodes_json")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A new version of a table; the caller switches to it, nothing is updated in place."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder where driver and executors both see it; of this machine only where no shared one is named and all run here (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-tables-")
