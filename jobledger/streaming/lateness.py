"""Late rows: counted, kept aside, never lost without a trace."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter


class LateGate:
    """Splits each micro-batch by the watermark that stood before it: the latest ``time`` so far less ``delay``.

    Rows at or before it go to ``path/late``, the others to ``sink(rows, number)``; the watermark after a batch is a row under ``path/marks``. All are written in a folder
    for each batch number, so a batch that comes again is split as it was the first time.
    """

    def __init__(self, spark: SparkSession, path: str, delay: timedelta) -> None:
        self.spark, self.path, self.delay = spark, path, delay

    def writer(self, stream: DataFrame, sink: Callable[[DataFrame, int], Any]) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(lambda batch, number: sink(self.split(batch, number), number))

    def split(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows in time of micro-batch ``number``; its late ones are written."""
        was = self.spark.read.schema("mark timestamp").parquet(f"{self.path}/marks/batch={number - 1}").first().mark if number else None
        latest = batch.agg(F.max("time")).first()[0]  # one moment
        marks = [m for m in (was, latest and latest - self.delay) if m]
        self.spark.createDataFrame([(max(marks, default=None),)], "mark timestamp").write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")
        late = F.lit(False) if was is None else F.coalesce(F.col("time") <= F.lit(was), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        return batch.where(~late)

    def late(self, schema) -> DataFrame:
        """All late rows so far, with the number of the ``batch`` they came in."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/late")


def observed(stream: DataFrame, name: str = "facts") -> DataFrame:
    """``stream`` with the rows and the latest time of each micro-batch as a metric of that name, for :class:`ProgressLog`."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.max("time").alias("latest"))


class ProgressLog(StreamingQueryListener):
    """What streams report: for each (query id, batch number) the rows observed and those that stateful operators dropped as late.

    Add it by ``spark.streams.addListener``. A batch that comes again replaces its numbers. Kept on the driver, two numbers a batch; :meth:`drain` hands them over and forgets them.
    """

    def __init__(self, name: str = "facts") -> None:
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if row is not None or dropped:
            self.batches[str(p.id), p.batchId] = (row["rows"] if row is not None else 0, dropped)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def drain(self) -> list[tuple[str, int, int, int]]:
        """(query id, batch, rows, dropped) since the last call."""
        out = sorted((q, b, *v) for (q, b), v in self.batches.items())
        self.batches = {}
        return out
