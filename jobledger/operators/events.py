"""Normalising and deduplicating the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions import scalar


def normalize_events(events: DataFrame) -> DataFrame:
    """Fill version 1, an id, the kind's layer and the default queue where they are missing.

    A missing id becomes a hash of the row instead of a random one, so reruns agree.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    return events.withColumns({
        "schema_version": F.when(F.coalesce(F.col("schema_version"), F.lit(0)) == 0, 1).otherwise(F.col("schema_version")),
        "event_id": F.when(F.coalesce(F.col("event_id"), F.lit("")) == "", F.concat(F.lit("evt_"), F.substring(F.sha2(row, 256), 1, 32))).otherwise(F.col("event_id")),
        "layer": F.when(F.coalesce(F.col("layer"), F.lit("")) == "", scalar.event_layer(F.col("kind"))).otherwise(F.col("layer")),
        "queue": scalar.default_queue(F.col("queue")),
    })


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row for each event_id, the first by (time, seq).

    Spark keeps the first of each id in a partition before the shuffle, so repeats of a hot id meet there, and columns that
    nothing later needs are neither read nor shuffled.
    """
    first = Window.partitionBy("event_id").orderBy("time", "seq")
    return events.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
