"""Registered queries of the streaming operators: each streams the events table to its end and returns what came out."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.jobs import sql
from jobledger.jobs.registry import KEY_PREFIX, ORACLES, query
from jobledger.operators.events import normalize_events
from jobledger.operators.stats import kind_is
from jobledger.sources import fixtures as fx
from jobledger.sources import tables
from jobledger.streaming import intake, streams
from jobledger.streaming.lateness import LateGate
from jobledger.streaming.live import LiveStats


#: Rows of events in a file of the derived log.
FILE_ROWS = 250_000


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _log(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The log as it would stand in a lake, one file for each stretch of time, read as a stream by the library's reader.

    Files hold about ``FILE_ROWS`` rows, so that a task's share doesn't grow with the log; a micro-batch takes half of them.
    """
    path = f"{folder}/log"
    files = max(4, -(-fx.table(spark, sf_dir, "events").count() // FILE_ROWS))
    tables.write_table(normalize_events(fx.events_raw(spark, sf_dir)).repartitionByRange(files, "time", "seq").sortWithinPartitions("time", "seq"), path)
    return tables.stream_events(spark, path, files_per_trigger=-(-files // 2))


def _deliveries(df: DataFrame, path: str, late_ms: int, parts: int = 4):
    """Append ``df`` as ``parts`` deliveries under ``path``, by time plus up to ``late_ms``, so rows come out of order by so much: gives control back after each.

    A row's delivery is told by its time and number, so each delivery derives only its own rows of the table.
    """
    arrives = F.unix_millis("time") + (F.pmod(F.xxhash64("seq"), F.lit(late_ms)) if late_ms else F.lit(0))
    cuts = df.select(F.percentile_approx(arrives, [i / parts for i in range(1, parts)], 1000)).first()[0]  # a few numbers
    part = F.lit(0)
    for c in cuts:
        part = part + (arrives > c).cast("int")
    for i in range(parts):
        df.where(part == i).write.mode("append").parquet(path)
        yield i


def _in_parts(spark: SparkSession, rows: DataFrame, of, late_ms: int = 0, mode: str = "append") -> DataFrame:
    """What the stream ``of`` makes of ``rows``, which come in four deliveries; the stream is stopped and goes on after each."""
    folder = tables.folder(spark)
    for _ in _deliveries(rows, f"{folder}/log", late_ms):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        out = streams.run_to_end(of(stream), f"{folder}/out", f"{folder}/checkpoint", mode)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(fx.map_events(_raw(spark, sf_dir)))


def _result(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    folder = tables.folder(spark)
    return streams.run_to_end(df, f"{folder}/out", f"{folder}/checkpoint", mode)


@query(sql.events("SELECT kind, queue, count(*) AS events FROM e1 GROUP BY ALL"))
def stream_events(spark, sf):
    """The log, written as files, read as a stream and counted."""
    folder = tables.folder(spark)
    out = streams.run_to_end(_log(spark, sf, folder).select("seq", "kind", "queue"), f"{folder}/out", f"{folder}/checkpoint")
    return out.groupBy("kind", "queue").agg(F.count("*").alias("events"))


_WATERMARK = "mark AS (SELECT max(us) // 1000 * 1000 - 21600000000 AS us FROM e1)"
#: How much rows come out of order, and what streams allow for.
LATE_MS, DELAY = 5 * 3_600_000, "6 hours"


@query(sql.events("SELECT (us // 1000000) // 21600 * 21600 AS start, " + ", ".join(sql._COUNT.format(f"process_{k}", k) for k in ("started", "succeeded", "failed", "retried")) + " FROM e1 GROUP BY 1 HAVING ((min(us) // 1000000) // 21600 + 1) * 21600 * 1000000 <= (SELECT us FROM mark)", _WATERMARK))
def stream_rates(spark, sf):
    """Six-hour rates over four deliveries with rows up to five hours out of order; windows that the watermark hasn't passed at the end stay open."""
    return _in_parts(spark, normalize_events(fx.events_raw(spark, sf)), lambda e: streams.stream_rates(e, "6 hours", delay=DELAY), LATE_MS)


@query(sql.events("SELECT event_id, count(*) AS facts FROM e GROUP BY event_id"))
def stream_dedupe(spark, sf):
    """Every id once, over four deliveries out of order; which of its facts came first depends on the order."""
    out = _in_parts(spark, normalize_events(fx.events_raw(spark, sf)), lambda e: streams.stream_dedupe(e, "40 days").select("event_id", "seq"), LATE_MS)
    return out.groupBy("event_id").agg(F.count("*").alias("facts"))


@query(sql.events("SELECT c.queue, c.processed, c.failed, c.retry, c.archived, coalesce(p.pending, 0) AS pending, coalesce(s.scheduled, 0) AS scheduled, z.paused FROM (" + sql.COUNTERS.replace("FROM e ", "FROM e1 ") + ") c LEFT JOIN (" + sql.PENDING.replace("FROM e ", "FROM e1 ") + ") p USING (queue) LEFT JOIN (" + sql.SCHEDULED.replace("FROM e ", "FROM e1 ") + ") s USING (queue) LEFT JOIN (" + sql.PAUSED.replace("FROM e ", "FROM e1 ") + ") z USING (queue)"))
def stream_stats(spark, sf):
    """The counters after the last micro-batch, over the log with its repeats, which comes in two parts; the stream goes on where it was."""
    folder = tables.folder(spark)
    log = normalize_events(fx.events_raw(spark, sf))
    middle = log.agg(F.timestamp_micros(F.expr("(unix_micros(min(time)) + unix_micros(max(time))) div 2"))).first()[0]
    for part in (log.where(F.col("time") < F.lit(middle)), log.where(F.col("time") >= F.lit(middle))):
        part.write.mode("append").parquet(f"{folder}/log")
        stream = tables.stream_events(spark, f"{folder}/log", files_per_trigger=1_000_000)  # what came together is put in order together
        streams.finish(streams.stream_stats(stream, f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{folder}/out")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


@query(sql.over(sql.REQUESTS, "n0 AS (SELECT seq, t, ttl, q || chr(0) || job_type || chr(0) || payload AS key, row_number() OVER (PARTITION BY q, job_type, payload ORDER BY t, seq) AS i FROM d WHERE ttl > 0)", "n AS (SELECT key, seq, i, true AS accepted, t + ttl AS until FROM n0 WHERE i = 1 UNION ALL SELECT b.key, b.seq, b.i, b.t >= n.until, CASE WHEN b.t >= n.until THEN b.t + b.ttl ELSE n.until END FROM n JOIN n0 b ON b.key = n.key AND b.i = n.i + 1)", "SELECT seq, accepted FROM n UNION ALL SELECT seq, true FROM d WHERE ttl <= 0"))
def stream_unique(spark, sf):
    """The gate over four deliveries; claims are carried from each to the next."""
    d = fx.requests(spark, sf)
    key = scalar.unique_key(scalar.default_queue(F.col("queue")), F.col("job_type"), F.col("payload"), KEY_PREFIX)
    d = d.select(key.alias("unique_key"), "time", "seq", F.unix_millis("time").alias("t"), F.col("unique_ttl_ms").alias("ttl"))
    return _in_parts(spark, d, streams.stream_unique)


@query(sql.events(
    """SELECT s.settlement_id, s.us // 1000 AS started_ms, s.us // 1000 + s.own AS due_ms, s.seq FROM
      (SELECT *, CASE WHEN k.timeout_ms > 0 THEN k.timeout_ms ELSE 300000 END + 2000 AS own FROM e1 JOIN k USING (job_type) WHERE settlement_id IS NOT NULL AND kind = 'process_started') s
      WHERE s.us + 86402000000 <= (SELECT us FROM mark) AND NOT EXISTS (SELECT 1 FROM e1 t WHERE t.settlement_id = s.settlement_id AND t.kind IN ('process_succeeded', 'process_failed') AND (t.us > s.us OR (t.us = s.us AND t.seq > s.seq)) AND t.us // 1000 <= s.us // 1000 + s.own)""",
    _WATERMARK,
    "k AS (SELECT 'type-' || i AS job_type, i * 12000000::BIGINT AS timeout_ms FROM range(7) r(i))",
))
def stream_stale(spark, sf):
    """Executions without an end in time, over four deliveries out of order; each job type has a timeout of its own, up to twenty hours."""
    e = normalize_events(fx.events_raw(spark, sf))
    timeouts = e.select("job_type").distinct().withColumn("timeout_ms", F.substring("job_type", 6, 9).cast("long") * 12_000_000)
    return _in_parts(spark, e, lambda s: streams.stream_stale(s, timeouts, delay=DELAY), LATE_MS)


_LATE = timedelta(milliseconds=LATE_MS + 1)


@query(ORACLES["stats_snapshot"])
def live_snapshot(spark, sf):
    """The whole snapshot from a stream that is stopped and goes on after each of four deliveries, with rows out of order and repeats of ids."""
    folder = tables.folder(spark)
    rows = normalize_events(fx.events_raw(spark, sf))
    live = LiveStats(spark, f"{folder}/state", _LATE)
    for _ in _deliveries(rows, f"{folder}/log", LATE_MS):
        stream = tables.stream_events(spark, f"{folder}/log", files_per_trigger=1_000_000)
        streams.finish(live.writer(stream).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return live.snapshot(live.close())


_EPISODES = """SELECT {keys}, min(start) AS start, max(start) + {s} AS "end", count(*) AS windows, max(level) AS peak FROM (SELECT *, start - {s} * row_number() OVER (PARTITION BY {keys} ORDER BY start) AS island FROM (
  SELECT {keys}, (us // 1000000) // {s} * {s} AS start, (count(*) FILTER (WHERE kind IN ({kinds})))::BIGINT AS level FROM e1 GROUP BY ALL HAVING level > {limit})) GROUP BY {keys}, island HAVING (max(start) + 2 * {s}) * 1000000 <= (SELECT us FROM mark)"""


@query(sql.events(_EPISODES.format(keys="queue, job_type", kinds="'process_failed', 'process_retried'", s=43200, limit=1), _WATERMARK))
def stream_churn_episodes(spark, sf):
    """More than one failure or retry of a queue's job type in half a day, over four deliveries out of order; episodes that can't be over yet stay open."""
    level = F.when(kind_is("process_failed", "process_retried"), 1).otherwise(0)
    return _in_parts(spark, normalize_events(fx.events_raw(spark, sf)), lambda e: streams.stream_episodes(e, ["queue", "job_type"], level, 1, 43_200, DELAY), LATE_MS)


@query(sql.events(_EPISODES.format(keys="kind", kinds="'republish_failed', 'settlement_failed', 'process_recovered'", s=86400, limit=2), _WATERMARK))
def stream_internal_failure_episodes(spark, sf):
    """More than two of the queue system's own failures of a kind in a day."""
    level = F.when(kind_is("republish_failed", "settlement_failed", "process_recovered"), 1).otherwise(0)
    return _in_parts(spark, normalize_events(fx.events_raw(spark, sf)), lambda e: streams.stream_episodes(e, ["kind"], level, 2, 86_400, DELAY), LATE_MS)


@query(sql.events("SELECT kind, (count(*) FILTER (WHERE late))::BIGINT AS late, (count(*) FILTER (WHERE NOT late))::BIGINT AS in_time FROM (SELECT kind, seq % 10 = 0 AND us <= (SELECT max(us) FROM e1 WHERE seq % 10 <> 0) - 86400000000 AS late FROM e1) GROUP BY kind"))
def late_events(spark, sf):
    """Every tenth fact comes in a second delivery; those over a day older than the first one's latest are late and stand in the side table."""
    base, rows = tables.folder(spark), normalize_events(fx.events_raw(spark, sf))
    gate = LateGate(spark, f"{base}/gate", timedelta(days=1))
    for part in (rows.where("seq % 10 <> 0"), rows.where("seq % 10 = 0")):
        part.write.mode("append").parquet(f"{base}/log")
        stream = tables.stream_events(spark, f"{base}/log", files_per_trigger=1_000_000)
        sink = lambda batch, number: batch.select("kind").write.mode("overwrite").parquet(f"{base}/in_time/batch={number}")
        streams.finish(gate.writer(stream, sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    both = gate.late("kind string").select("kind", F.lit(1).alias("late")).unionByName(spark.read.parquet(f"{base}/in_time").select("kind", F.lit(0).alias("late")))
    return both.groupBy("kind").agg(F.sum("late").cast("long").alias("late"), F.sum(1 - F.col("late")).cast("long").alias("in_time"))


@query(sql.events("SELECT CASE WHEN seq % 101 = 0 THEN 'malformed' WHEN seq % 103 = 0 THEN 'unknown version' WHEN seq % 107 = 0 THEN 'no kind' ELSE 'good' END AS verdict, count(*) AS n FROM e0 GROUP BY ALL"))
def json_intake(spark, sf):
    """Lines of JSON in two deliveries, some cut short, of a newer schema or without a kind: what is stored where."""
    base = tables.folder(spark)
    seq = F.col("seq")
    rows = fx.events_raw(spark, sf).withColumns({"schema_version": F.when(seq % 103 == 0, 9).otherwise(F.col("schema_version")), "kind": F.when(seq % 107 == 0, "").otherwise(F.col("kind"))})
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    lines = rows.select(F.when(seq % 101 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"), "seq")
    for part in (lines.where(seq % 2 == 0), lines.where(seq % 2 == 1)):
        part.select("value").write.mode("append").text(f"{base}/in")
        streams.finish(intake.intake(intake.stream_lines(spark, f"{base}/in"), f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    good = spark.read.parquet(f"{base}/out/events").select(F.lit("good").alias("verdict"))
    return good.union(spark.read.parquet(f"{base}/out/quarantine").select("reason")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(sql.events("SELECT kind, count(*) AS events FROM e1 GROUP BY kind"))
def fan_out(spark, sf):
    """Every batch to a broken observer and a good one: the good one's rows."""
    folder, failures = tables.folder(spark), []

    def good(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    def broken(batch: DataFrame, number: int) -> None:
        raise RuntimeError("observer")

    streams.finish(streams.fan_out(_log(spark, sf, folder).select("kind"), {"broken": broken, "good": good}, failures).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    if not failures:
        raise RuntimeError("the broken observer went unnoticed")
    lost = [f for f in failures if f[1] == "good"]
    if lost:
        raise RuntimeError(f"batches were not written: {lost}")
    return spark.read.parquet(f"{folder}/out").groupBy("kind").agg(F.count("*").alias("events"))
