"""JSON lines of events from a stream: good ones to the log, others to quarantine, nothing lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from jobledger.sources.tables import parse_event_lines

#: The newest version of an event's schema that is understood.
SCHEMA_VERSION = 1


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of JSON lines as a stream of ``line``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "line")


def judged(lines: DataFrame) -> DataFrame:
    """``lines(line)`` -> line, the event's columns, reason: null for good ones.

    malformed: not such JSON. unknown version: of a schema newer than SCHEMA_VERSION, which may mean anything, or below 0. no kind, no time: what no fact is without. Blank lines are malformed.
    """
    got = parse_event_lines(lines.select(F.col("line").alias("raw"), "line"))
    version = F.coalesce(F.col("schema_version"), F.lit(0))
    reason = F.when(F.col("corrupt") | (F.trim(F.coalesce("raw", F.lit(""))) == ""), "malformed").when((version > SCHEMA_VERSION) | (version < 0), "unknown version").when(F.coalesce(F.col("kind"), F.lit("")) == "", "no kind").when(F.col("time").isNull(), "no time")
    return got.withColumn("reason", reason).drop("corrupt").withColumnRenamed("raw", "line")


def intake(lines: DataFrame, path: str) -> DataStreamWriter:
    """A writer of good events to ``path/events`` and of other lines, with their reason, to ``path/quarantine``, in a folder for each micro-batch.

    A batch that comes again replaces its folders, so each line is stored once, in one of the two.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = judged(batch)
        events = rows.where("reason is null").drop("line", "reason")
        events.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        rows.where("reason is not null").select("line", "reason").write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")

    return lines.writeStream.foreachBatch(write)
