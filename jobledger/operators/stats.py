"""Counters over the event log."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators import gauges


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0).cast("long"))


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


ENDED = ("process_succeeded", "process_failed")


def counter_columns() -> list[Column]:
    return [count_if(kind_is(f"process_{kind}")).alias(name) for kind, name in (("succeeded", "processed"), ("failed", "failed"), ("retried", "retry"), ("archived", "archived"))]


def run_column() -> Column:
    """Mean duration of ended executions in whole nanoseconds, null without any."""
    ended = "kind in ('process_succeeded', 'process_failed')"
    return F.expr(f"sum(case when {ended} then duration_ns end) div nullif(count(case when {ended} then 1 end), 0)").alias("avg_run_ns")


def simple_counters(events: DataFrame) -> DataFrame:
    """processed, failed, retry, archived of every queue that any event names."""
    return events.groupBy("queue").agg(*counter_columns())


def avg_run(events: DataFrame) -> DataFrame:
    """Mean duration of ended executions, of queues that have one."""
    return events.where(kind_is(*ENDED)).groupBy("queue").agg(run_column())


def avg_wait(events: DataFrame) -> DataFrame:
    """Mean wait in whole nanoseconds, over starts later than the enqueue they consume. Their sum may be more than a long holds."""
    waits = gauges.match_waits(events).withColumn("wait", (F.unix_micros("started_at") - F.unix_micros("enqueued_at")) * 1000).where("wait > 0")
    return waits.groupBy("queue").agg(F.expr("sum(cast(wait as decimal(19, 0))) div count(*)").alias("avg_wait_ns"), F.count("*").alias("waits"))


def last_turn() -> Column:
    """The last pause or resume: (time, seq, kind)."""
    return F.max(F.when(kind_is("queue_paused", "queue_resumed"), F.struct("time", "seq", F.col("kind").alias("kind"))))


def paused_column() -> Column:
    return F.coalesce((last_turn()["kind"] == "queue_paused").cast("int"), F.lit(0)).alias("paused")


def paused_state(events: DataFrame) -> DataFrame:
    """1 if the last pause or resume of a queue is a pause; queues without either are 0."""
    return events.groupBy("queue").agg(paused_column())


WINDOWS = {"hour": 3600, "day": 86_400, "week": 7 * 86_400}


def throughput_columns(now: Column) -> list[Column]:
    cols = []
    for name, seconds in WINDOWS.items():
        recent = F.col("time") >= now - F.expr(f"INTERVAL {seconds} SECONDS")
        cols += [count_if(kind_is("process_succeeded") & recent).alias(f"processed_{name}"), count_if(kind_is("process_failed") & recent).alias(f"failed_{name}")]
    return cols


def _timed(events: DataFrame, as_of: datetime | None) -> tuple[DataFrame, Column]:
    if as_of is not None:
        return events, F.lit(as_of)
    return events.crossJoin(F.broadcast(events.agg(F.max("time").alias("as_of")))), F.col("as_of")  # one row


def throughput(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """processed and failed since an hour, a day and a week before ``as_of`` (default: the latest event), by queue."""
    timed, now = _timed(events, as_of)
    return timed.groupBy("queue").agg(*throughput_columns(now))


def stats_snapshot(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """All counters, gauges, averages and throughput of every queue: one row each.

    What needs no order comes from one aggregation over the log; gauges and waits from bucketed windows, so no queue's
    log meets in one task.
    """
    timed, now = _timed(events, as_of)
    counted = timed.groupBy("queue").agg(*counter_columns(), run_column(), paused_column(), *throughput_columns(now))
    gauge = gauges.final_gauges(events, ["queue"], pending=gauges.pending_delta(), scheduled=gauges.scheduled_delta())
    parts = [(counted, [c for c in counted.columns if c != "queue"]), (avg_wait(events), ["avg_wait_ns"]), (gauge, ["pending", "scheduled"]), (gauges.active_gauge(events), ["active"])]
    names = [c for _, own in parts for c in own]
    # a few rows a queue from each part: one small aggregation puts them together
    rows = [p.select("queue", *[(F.col(c) if c in own else F.lit(None)).cast("long").alias(c) for c in names]) for p, own in parts]
    out = reduce(DataFrame.union, rows).groupBy("queue").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
    return out.withColumn("paused", F.col("paused").cast("int"))


def dispatch_total(events: DataFrame) -> DataFrame:
    """Facts of dispatching by kind, driver and queue: what became of each request."""
    return events_total(events.where(kind_is("enqueue_accepted", "enqueue_duplicate", "enqueue_rejected", "enqueue_canceled")))


def workflow_family_totals(events: DataFrame) -> DataFrame:
    """Facts of chains and of batches by kind: family, kind, events."""
    family = F.when(F.col("kind").startswith("chain_"), "chain").when(F.col("kind").startswith("batch_"), "batch")
    return events.withColumn("family", family).where("family is not null").groupBy("family", "kind").agg(F.count("*").alias("events"))


def events_total(events: DataFrame) -> DataFrame:
    return events.groupBy("kind", "driver", "queue").agg(F.count("*").alias("events"))


def failure_counters(events: DataFrame) -> DataFrame:
    """Facts about the queue system's own failures, by driver and queue."""
    return events.groupBy("driver", "queue").agg(
        count_if(kind_is("enqueue_rejected", "enqueue_canceled")).alias("enqueue_failed"), count_if(kind_is("republish_failed")).alias("republish_failed"),
        count_if(kind_is("settlement_failed")).alias("settlement_failed"), count_if(kind_is("process_recovered")).alias("process_recovered"),
    )


def _histogram(rows: DataFrame, by: list[str], bounds_ms: list[int]) -> DataFrame:
    rows = rows.withColumn("bucket", scalar.bucket_of(F.col("duration_ns"), [b * 1_000_000 for b in bounds_ms]))
    counted = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("sum_ns"))
    return counted.withColumn("cumulative", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def duration_histogram(events: DataFrame, bounds_ms: list[int]) -> DataFrame:
    """Executions by driver, queue and job type in buckets up to each bound, the last open; ``cumulative`` counts all up to the bucket."""
    return _histogram(events.where(kind_is(*ENDED)), ["driver", "queue", "job_type"], bounds_ms)


def workflow_jobs(events: DataFrame) -> DataFrame:
    """kind (job_succeeded or job_failed), queue, job_type, duration_ns of workflow jobs: from a start to the end that follows it."""
    w = Window.partitionBy("dispatch_id", "job_id").orderBy("time", "seq")
    facts = events.where((F.col("job_id") != "") & kind_is("process_started", *ENDED)).withColumn("was", F.lag("kind").over(w)).withColumn("was_at", F.lag("time").over(w))
    ended = facts.where(kind_is(*ENDED) & (F.col("was") == "process_started"))
    kind = F.when(kind_is("process_succeeded"), "job_succeeded").otherwise("job_failed")
    return ended.select(kind.alias("kind"), "queue", "job_type", ((F.unix_micros("time") - F.unix_micros("was_at")) * 1000).alias("duration_ns"))


def workflow_duration_histogram(jobs: DataFrame, bounds_ms: list[int]) -> DataFrame:
    """:func:`workflow_jobs` by kind, queue and job type in buckets, as :func:`duration_histogram`."""
    return _histogram(jobs, ["kind", "queue", "job_type"], bounds_ms)


def percentile_columns(c: str, unit: str, exact: bool) -> list[Column]:
    """P50, P95, P99: sketches of fixed size, or exact."""
    of = lambda p: F.percentile(c, F.lit(p)) if exact else F.percentile_approx(c, p, 10_000)
    return [of(p).alias(f"p{round(100 * p)}_{unit}") for p in (0.5, 0.95, 0.99)]


def duration_sketches(events: DataFrame, seconds: int = 3600, k: int = 200) -> DataFrame:
    """queue, job_type, start (epoch second), n, sketch: a quantile sketch of durations of each stretch of time, of bounded size; for keeping.

    ``k`` sets the size; a quantile's rank is off by about 2.65 / k ** 0.95 at most (1.7 % at 200) but for one time in a hundred.
    """
    ended = events.where(kind_is(*ENDED)).withColumn("start", F.floor(F.unix_seconds("time") / seconds) * seconds)
    return ended.groupBy("queue", "job_type", "start").agg(F.count("duration_ns").alias("n"), F.kll_sketch_agg_bigint("duration_ns", k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], since: int | None = None, until: int | None = None, probabilities: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Stored sketches of [since, until) merged by ``by``: n and p50_ns and so on. No event is read again."""
    span = sketches
    if since is not None:
        span = span.where(F.col("start") >= since)
    if until is not None:
        span = span.where(F.col("start") < until)
    merged = span.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(f"p{round(100 * p)}_ns") for p in probabilities])


def rank_errors(events: DataFrame, quantiles: DataFrame, by: list[str], probabilities: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """How far each quantile's true rank among ended executions is from what was asked: ``by``, n, e50 and so on, 0 where it lies at it.

    A value of rank range [a, b] (shares below it, and up to it) is off by its distance from p.
    """
    told = quantiles.select(*[F.col(c).alias(f"q_{c}") for c in by], *[f"p{round(100 * p)}_ns" for p in probabilities])
    met = events.where(kind_is(*ENDED)).join(told, [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in by])
    counted = met.groupBy(*by).agg(F.count("duration_ns").alias("n"), *[x for p in probabilities for x in (count_if(F.col("duration_ns") < F.col(f"p{round(100 * p)}_ns")).alias(f"a{round(100 * p)}"), count_if(F.col("duration_ns") <= F.col(f"p{round(100 * p)}_ns")).alias(f"b{round(100 * p)}"))])
    off = lambda p: F.greatest(F.lit(0.0), F.col(f"a{round(100 * p)}") / F.col("n") - p, p - F.col(f"b{round(100 * p)}") / F.col("n"))
    return counted.select(*by, "n", *[off(p).alias(f"e{round(100 * p)}") for p in probabilities])


def duration_percentiles(events: DataFrame, exact: bool = False) -> DataFrame:
    """P50, P95, P99 of durations by job type and queue."""
    return events.where(kind_is(*ENDED)).groupBy("job_type", "queue").agg(*percentile_columns("duration_ns", "ns", exact))


def completion_latency(events: DataFrame, exact: bool = False) -> DataFrame:
    """First enqueue to the first later success of a job, by queue of the enqueue: jobs, mean, largest and percentiles in milliseconds."""
    facts = events.where((F.col("job_id") != "") & kind_is("enqueue_accepted", "process_succeeded"))
    put = facts.where("kind = 'enqueue_accepted'").groupBy("job_id").agg(F.min(F.struct("time", "seq", "queue")).alias("e")).select("job_id", F.col("e.queue").alias("queue"), F.col("e.time").alias("t0"))
    done = facts.where("kind = 'process_succeeded'").select("job_id", "time")
    took = done.join(put, "job_id").where("time >= t0").groupBy("job_id", "queue", "t0").agg(F.min("time").alias("t1"))
    ms = F.unix_millis("t1") - F.unix_millis("t0")
    return took.withColumn("ms", ms).groupBy("queue").agg(F.count("*").alias("jobs"), F.expr("sum(ms) div count(*)").alias("avg_ms"), F.max("ms").alias("max_ms"), *percentile_columns("ms", "ms", exact))


def workflow_event_totals(events: DataFrame) -> DataFrame:
    return events.where("layer = 'workflow'").groupBy("kind", "queue").agg(F.count("*").alias("events"))


def dispatch_summary(requests: DataFrame) -> DataFrame:
    """Requests by queue and type, by type, and in all (nulls mark what is summed over)."""
    return requests.withColumn("queue", scalar.default_queue(F.col("queue"))).rollup("job_type", "queue").agg(F.count("*").alias("requests"))


def chain_summary(events: DataFrame) -> DataFrame:
    """Progress of chains by their facts."""
    facts = events.where(F.col("chain_id") != "").where(F.col("kind").startswith("chain_"))
    ended = F.when(kind_is("chain_completed", "chain_failed"), F.struct("time", "seq", "kind"))
    return facts.groupBy("chain_id").agg((count_if(kind_is("chain_started")) > 0).alias("started"), F.count_distinct(F.when(kind_is("chain_advanced"), F.col("event_id"))).alias("advanced"), F.max(ended)["kind"].alias("terminal"))


def poison_jobs(events: DataFrame, min_failures: int) -> DataFrame:
    """Job keys that fail again and again: failures, largest attempt, distinct errors and the commonest (smallest of equal ones)."""
    failed = events.where("kind = 'process_failed'").groupBy("job_key", "job_type", "error").agg(F.count("*").alias("n"), F.max("attempt").alias("attempt"))
    return failed.groupBy("job_key", "job_type").agg(F.sum("n").alias("failures"), F.max("attempt").alias("max_attempt"), F.count("*").alias("errors"), F.min_by("error", F.struct(-F.col("n"), F.col("error"))).alias("top_error")).where(F.col("failures") >= min_failures)


def top_failing(events: DataFrame, n: int) -> DataFrame:
    """The job types and queues with most failures and retries; ties by name."""
    got = events.groupBy("job_type", "queue").agg(count_if(kind_is("process_failed")).alias("failures"), count_if(kind_is("process_retried")).alias("retries"))
    return got.orderBy(F.desc(F.col("failures") + F.col("retries")), "job_type", "queue").limit(n)


def queue_names(events: DataFrame) -> DataFrame:
    return events.select("queue").distinct().orderBy("queue")


def merge_snapshots(native: DataFrame, collected: DataFrame) -> DataFrame:
    """Native rows, and collected rows of the queues that have none."""
    return native.unionByName(collected.join(native.select("queue"), "queue", "left_anti"))
