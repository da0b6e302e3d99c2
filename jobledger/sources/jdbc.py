"""The job system's tables in a database: parallel reads and writes over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths of text columns that are searched or compared in the database; others are stored as it stores long text.
KEY_WIDTHS = {
    "queue_name": 255, "job_type": 255, "state": 32, "processing_token": 128, "lock_key": 255, "chain_id": 64, "batch_id": 64, "job_id": 64, "node_id": 64,
    "dispatch_id": 64, "workflow_kind": 32, "workflow_id": 64, "callback_key": 255, "kind": 64,
}


def write_jdbc(df: DataFrame, url: str, table: str, writers: int = 8, mode: str = "errorifexists", **options: str) -> None:
    """``df`` as a table of the database, over at most ``writers`` connections. Key columns get a fixed width, so the database can compare them.

    Each connection commits its own rows: where a write fails, a fresh table is to be written anew; ``append`` may have stored part of them.
    """
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    types = ", ".join(f"{c} VARCHAR({KEY_WIDTHS[c]})" for c in df.columns if c in KEY_WIDTHS and c in text)
    writer = df.coalesce(writers).write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options)
    (writer.option("createTableColumnTypes", types) if types else writer).save()


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8, where: str | None = None, **options: str) -> DataFrame:
    """A table of the database, read by ``parts`` tasks over ranges of the number ``by``; ``where`` is evaluated by the database.

    The ends of the ranges are asked of the database, two numbers; rows that are beyond them by the time they are read come with the first or last range.
    An empty range, or ``by`` unset, is read by one task. Filters and columns of what follows go to the database too.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    whole = reader.option("dbtable", table).load()
    if where:
        whole = whole.where(where)
    if by is None:
        return whole
    low, high = whole.agg(F.min(by), F.max(by)).first()
    if low is None or high == low:
        return whole
    ranged = reader.options(dbtable=table, partitionColumn=by, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()
    return ranged.where(where) if where else ranged
