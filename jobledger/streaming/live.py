"""The whole statistics snapshot kept up from a stream, micro-batch by micro-batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from jobledger import schemas
from jobledger.operators import gauges, stats
from jobledger.operators.events import dedupe_events

LOOSE = ["queue", "x_dispatch", "x_job", "x_attempt"]
SUMS = (*[f"process_{k}" for k in ("succeeded", "failed", "retried", "archived")], "run_ns", "runs", "wait_ns", "waits")
#: The tables of a state and their columns. Waits in nanoseconds may add up to more than a long holds.
TABLES = {
    "meta": "mark timestamp, latest timestamp",
    "queues": "queue string, " + ", ".join(f"{c} {'decimal(38,0)' if c == 'wait_ns' else 'bigint'}" for c in (*SUMS, "pending", "scheduled", "paused")),
    "waits": "queue string, job_key string, time timestamp, seq bigint, took_at timestamp",
    "exact": "queue string, settlement_id string",
    "loose": "queue string, x_dispatch string, x_job string, x_attempt int, open bigint",
    "seen": "event_id string, time timestamp, seq bigint, kind string, queue string, job_key string, dispatch_id string, job_id string, attempt int, scheduled boolean, duration_ns bigint, settlement_id string",
    "held": schemas.EVENT,
    "late": schemas.EVENT,
}
#: Tables of which each batch writes only what is new; a read takes all of them.
ADDED = ("seen", "late")


def column_names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class LiveStats:
    """State of every queue's counters, gauges, waits, open executions and throughput under ``path``, in a folder for each micro-batch.

    Facts may come up to ``delay`` later than others of a later time. Those that are newer than the watermark (the latest time so far
    less ``delay``) are held; the rest are applied in (time, seq) order, each event_id once, so what the state holds depends on the log and not
    on how it was cut into micro-batches. A fact older than what was applied already is late: it is counted and written to a side table.
    An id that comes again more than ``repeats`` after its first fact counts anew.

    No queue is one task: a batch is worked on by the bucketed passes of the batch operators, and carried over are sums a
    queue, open enqueues (as rows ahead of the batch's, so first in first out goes on), open settlement ids, open executions
    by key and the facts applied, of which the last week's ends are counted. A batch that comes again replaces its folder.
    """

    def __init__(self, spark: SparkSession, path: str, delay: timedelta = timedelta(minutes=10), repeats: timedelta = timedelta(days=1)) -> None:
        self.spark, self.path, self.delay, self.repeats = spark, path, delay, repeats

    def writer(self, events: DataFrame) -> DataStreamWriter:
        return events.select(*column_names(schemas.EVENT)).writeStream.foreachBatch(lambda batch, number: self.apply(batch, number))

    def read(self, name: str, number: int) -> DataFrame:
        """A table as it stood after a micro-batch; empty before the first."""
        if number < 0:
            return self._empty(TABLES[name])
        if name not in ADDED:
            return self._batch(name, number)
        return self.spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{self.path}/{name}").where(F.col("batch") <= number).drop("batch")

    def _empty(self, ddl: str) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in ddl.split(", ")]).where("false")

    def _batch(self, name: str, number: int) -> DataFrame:
        """What one micro-batch wrote."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/batch={number}")

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.select(*column_names(TABLES[name])).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def apply(self, batch: DataFrame, number: int, to_end: bool = False) -> None:
        """Apply micro-batch ``number``; ``to_end`` also applies what is held."""
        old, last = number - 1, self.read("meta", number - 1).first()
        was = last.mark if last else None
        first, newest = batch.agg(F.min("time"), F.max("time")).first()
        latest = max(filter(None, [newest, last.latest if last else None]), default=None)
        mark = latest if to_end or latest is None else max(filter(None, [was, latest - self.delay]))
        self._write("meta", number, self.spark.range(1).select(F.lit(mark).cast("timestamp").alias("mark"), F.lit(latest).cast("timestamp").alias("latest")))
        late = F.lit(False) if was is None else F.col("time") <= F.lit(was)
        due = F.lit(False) if mark is None else F.col("time") <= F.lit(mark)
        # each pass over the micro-batch reads all its columns: none is made for late facts where there are none
        self._write("late", number, batch.where(late) if was and first and first <= was else self._empty(TABLES["late"]))
        rows = batch.where(~late).unionByName(self.read("held", old))
        self._write("held", number, rows.where(~due))
        ready = dedupe_events(rows.where(due).select(*column_names(TABLES["seen"])))
        if old >= 0 and was is not None:
            known = self.read("seen", old).where(F.col("time") > F.lit(was - self.repeats)).select("event_id")
            ready = ready.join(known, "event_id", "left_anti")
        self._write("seen", number, ready)
        self._fold(self._batch("seen", number), number, mark)

    def _fold(self, ready: DataFrame, number: int, mark: datetime | None) -> None:
        old, kind = number - 1, F.col("kind")
        ended = kind.isin(*stats.ENDED)
        # waits: carried enqueues stand before the batch's facts; a row for each enqueue, with the start that took it
        puts = self.read("waits", old).where("took_at is null").select("queue", "job_key", "time", "seq", F.lit("enqueue_accepted").alias("kind"))
        facts = puts.unionByName(ready.where(kind.isin("enqueue_accepted", "process_started") & (F.col("job_key") != "")).select(*puts.columns))
        self._write("waits", number, gauges.enqueues(facts))
        ns = (F.unix_micros("took_at") - F.unix_micros("time")) * 1000
        waits = self._batch("waits", number).withColumn("ns", ns).where("ns > 0")
        # sums and gauges a queue
        run = F.when(ended, F.col("duration_ns"))
        counted = ready.groupBy("queue").agg(*[stats.count_if(kind == c).alias(c) for c in SUMS[:4]], F.sum(run).alias("run_ns"), F.count(run).alias("runs"), stats.last_turn()["kind"].alias("turn"))
        waited = waits.groupBy("queue").agg(F.sum(F.col("ns").cast("decimal(19,0)")).alias("wait_ns"), F.count("*").alias("waits"))
        moved = gauges.summed_gauges(ready, ["queue"], pending=gauges.pending_delta(), scheduled=gauges.scheduled_delta())
        before = self.read("queues", old)
        before = before.select("queue", *[F.col(c).alias(f"was_{c}") for c in before.columns if c != "queue"])
        met = before.join(counted, "queue", "full").join(waited, "queue", "left").join(moved, "queue", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        levels = [(zero(f"was_{g}") + zero(f"{g}_sum") - F.least(F.lit(0), zero(f"was_{g}") + zero(f"{g}_low"))).alias(g) for g in ("pending", "scheduled")]
        paused = F.when(F.col("turn").isNotNull(), (F.col("turn") == "queue_paused").cast("long")).otherwise(zero("was_paused"))
        total = lambda c: F.coalesce(F.col(f"was_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
        self._write("queues", number, met.select("queue", *[total(c).cast(before.schema[f"was_{c}"].dataType).alias(c) for c in SUMS], *levels, paused.alias("paused")))
        # open executions: the last fact of a settlement id decides; without one, a gauge by key
        opened = ready.where(F.col("settlement_id").isNotNull() & kind.isin("process_started", *stats.ENDED, "settlement_failed")).groupBy("queue", "settlement_id").agg(F.max_by("kind", F.struct("time", "seq")).alias("last"))
        kept = self.read("exact", old).join(opened, ["queue", "settlement_id"], "full").where("coalesce(last, 'process_started') = 'process_started'")
        self._write("exact", number, kept)
        by_key = gauges.summed_by_size(gauges.loose_facts(ready), LOOSE, open=F.when(kind == "process_started", 1).otherwise(-1))
        met = self.read("loose", old).withColumnRenamed("open", "was").join(by_key, LOOSE, "full")
        level = zero("was") + zero("open_sum") - F.least(F.lit(0), zero("was") + zero("open_low"))
        self._write("loose", number, met.select(*LOOSE, level.alias("open")).where("open > 0"))

    def last(self) -> int:
        """The number of the last applied micro-batch, -1 if there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/meta").agg(F.max("batch")).first()[0]
        except AnalysisException:
            return -1

    def close(self) -> int:
        """Apply all that is held, as a micro-batch of its own; for the end of a stream. Its number."""
        number = self.last() + 1
        self.apply(self._empty(schemas.EVENT), number, to_end=True)
        return number

    def snapshot(self, number: int, as_of: datetime | None = None) -> DataFrame:
        """All columns of the batch snapshot after micro-batch ``number``, throughput up to ``as_of`` (default: the latest fact applied)."""
        now = as_of or self.read("seen", number).agg(F.max("time")).first()[0]  # one moment
        exact = self.read("exact", number).groupBy("queue").agg(F.count("*").alias("open"))
        active = exact.unionByName(self.read("loose", number).groupBy("queue").agg(F.sum("open").alias("open"))).groupBy("queue").agg(F.sum("open").alias("active"))
        week = self.read("seen", number).where(F.col("kind").isin(*stats.ENDED))
        if now is not None:
            week = week.where(F.col("time") >= F.lit(now - timedelta(seconds=max(stats.WINDOWS.values()))))
        windows = []
        for name, seconds in stats.WINDOWS.items():
            recent = F.lit(False) if now is None else F.col("time") >= F.lit(now - timedelta(seconds=seconds))
            windows += [stats.count_if(recent & (F.col("kind") == f"process_{k}")).alias(f"{c}_{name}") for k, c in (("succeeded", "processed"), ("failed", "failed"))]
        met = self.read("queues", number).join(active, "queue", "left").join(week.groupBy("queue").agg(*windows), "queue", "left")
        names = dict(zip(SUMS[:4], ("processed", "failed", "retry", "archived"), strict=True))
        mean = lambda total, n: F.expr(f"coalesce({total} div nullif({n}, 0), 0)")
        throughput = [F.coalesce(f"{c}_{w}", F.lit(0)).alias(f"{c}_{w}") for w in stats.WINDOWS for c in ("processed", "failed")]
        return met.select("queue", *[F.col(c).alias(n) for c, n in names.items()], mean("run_ns", "runs").alias("avg_run_ns"), mean("wait_ns", "waits").alias("avg_wait_ns"), F.col("paused").cast("int").alias("paused"), *throughput, "pending", "scheduled", F.coalesce("active", F.lit(0)).alias("active"))
