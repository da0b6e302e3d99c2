"""Consistency and delivery audits over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators import gauges
from jobledger.operators.jumps import admitted
from jobledger.operators.stats import count_if, kind_is


def trace(events: DataFrame) -> DataFrame:
    """What happened under each dispatch: facts by layer, kinds, jobs, first and last moment. Counts, so a giant dispatch stays small."""
    return events.where(F.col("dispatch_id") != "").groupBy("dispatch_id").agg(
        *[count_if(F.col("layer") == x).alias(f"{x}_facts") for x in ("queue", "worker", "workflow")],
        F.count_distinct("kind").alias("kinds"), F.count_distinct(F.when(F.col("job_id") != "", F.col("job_id"))).alias("jobs"), F.unix_micros(F.min("time")).alias("first_us"), F.unix_micros(F.max("time")).alias("last_us"),
    )


def unprocessed(events: DataFrame) -> DataFrame:
    """Jobs with an accepted enqueue and no success: job_id, queue of the first enqueue."""
    put = events.where(kind_is("enqueue_accepted") & (F.col("job_id") != "")).groupBy("job_id").agg(F.min_by("queue", F.struct("time", "seq")).alias("queue"))
    return put.join(events.where(kind_is("process_succeeded")).select("job_id").distinct(), "job_id", "left_anti")


def not_before_violations(requests: DataFrame, events: DataFrame, tolerance_ms: int) -> DataFrame:
    """Requests with a delay whose job's first later start came before it was over: ``requests(job_id, seq, time, delay_ms)``."""
    starts = events.where(kind_is("process_started") & (F.col("job_id") != "")).select("job_id", F.col("time").alias("started"))
    first = requests.where("delay_ms > 0").join(starts, "job_id").where("started >= time").groupBy("job_id", "seq", "time", "delay_ms").agg(F.min("started").alias("started"))
    early = F.unix_millis("time") + F.col("delay_ms") - F.unix_millis("started")
    return first.withColumn("early_ms", early).where(F.col("early_ms") > tolerance_ms).select("seq", "job_id", "early_ms")


def backoff_violations(events: DataFrame, policy: int | DataFrame, tolerance_ms: int) -> DataFrame:
    """Starts of a job that follow its previous start, of a lower attempt, sooner than the backoff.

    ``policy`` is one backoff in milliseconds, or a table of them by job type, one row each: ``(job_type, backoff_ms)``.
    """
    w = Window.partitionBy("dispatch_id", "job_id").orderBy("time", "seq")
    starts = events.where(kind_is("process_started") & (F.col("job_id") != "")).withColumn("was", F.lag("attempt").over(w)).withColumn("was_at", F.lag("time").over(w))
    gap = F.unix_millis("time") - F.unix_millis("was_at")
    again = starts.where(F.col("attempt") == F.col("was") + 1).withColumn("gap_ms", gap)
    if isinstance(policy, DataFrame):
        met = again.join(policy.select("job_type", "backoff_ms"), "job_type")
        return met.where(F.col("gap_ms") < F.col("backoff_ms") - tolerance_ms).select("seq", "job_id", "attempt", "gap_ms", "backoff_ms")
    return again.where(F.col("gap_ms") < policy - tolerance_ms).select("seq", "job_id", "attempt", "gap_ms")


def executions(events: DataFrame) -> DataFrame:
    """Each start with the next end of its settlement id: job_key, seq, start, finish (null while open)."""
    w = Window.partitionBy("settlement_id").orderBy("time", "seq")
    facts = events.where("settlement_id is not null").where(kind_is("process_started", "process_succeeded", "process_failed"))
    facts = facts.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_time", F.lead("time").over(w))
    return facts.where(kind_is("process_started") & (F.col("job_key") != "")).select("job_key", "seq", F.unix_micros("time").alias("start"), F.when(F.col("next_kind") != "process_started", F.unix_micros("next_time")).alias("finish"))


def overlap_audit(runs: DataFrame, ttl_us: int, block_us: int = 86_400_000_000) -> DataFrame:
    """Executions that start while an admitted one of their key holds [start, min(finish, start + ttl)): job_key, seq. Keys are cut into blocks of ``block_us``."""
    until = F.least(F.coalesce("finish", F.lit(2**62)), F.col("start") + ttl_us)
    scanned = admitted(runs.select("job_key", "seq", "start", until.alias("until")), ["job_key"], "start", "until", ["seq"], block_us)
    return scanned.where("not admitted").select("job_key", "seq")


def concurrency(runs: DataFrame, block_us: int = 86_400_000_000) -> DataFrame:
    """Any overlap, by a sweep instead of a self-join: job_key, runs, overlapping (runs that share a moment with another), peak (most at once).

    Executions hold [start, finish), open ones without end; empty ones hold nothing and overlap nothing. A run overlaps if one that started before it, in
    (start, seq) order, ends after its start, or the next one starts before its end. Latest ends so far are taken within blocks and then over the blocks' latest, running
    counts likewise, so a key with most of the runs spreads.
    """
    rows = runs.select("job_key", "seq", "start", F.coalesce("finish", F.lit(2**62)).alias("end")).withColumn("live", F.col("end") > F.col("start"))
    busy = rows.where("live").withColumn("block", F.floor(F.col("start") / block_us))
    per_block = busy.groupBy("job_key", "block").agg(F.max("end").alias("top"), F.min("start").alias("head"))
    w = Window.partitionBy("job_key").orderBy("block")
    around = per_block.select("job_key", "block", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top_before"), F.lead("head").over(w).alias("head_after"))
    inner = Window.partitionBy("job_key", "block").orderBy("start", "seq")
    seen = busy.withColumn("inside", F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead("start").over(inner)).join(around, ["job_key", "block"])
    hit = F.coalesce(F.greatest("inside", "top_before") > F.col("start"), F.lit(False)) | F.coalesce(F.coalesce("next", "head_after") < F.col("end"), F.lit(False))
    counted = seen.groupBy("job_key").agg(count_if(hit).alias("overlapping"))
    # at one moment ends come before starts
    turns = busy.select("job_key", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))).groupBy("job_key", "at").agg(F.sum("step").alias("step"))
    turns = turns.withColumn("block", F.floor(F.col("at") / block_us))
    upto = Window.partitionBy("job_key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = turns.withColumn("level", F.sum("step").over(upto)).groupBy("job_key", "block").agg(F.max("level").alias("high"), F.sum("step").alias("sum"))
    base = F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    peaks = blocks.withColumn("peak", base + F.col("high")).groupBy("job_key").agg(F.max("peak").alias("peak"))
    total = rows.groupBy("job_key").agg(F.count("*").alias("runs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return total.join(counted, "job_key", "left").join(peaks, "job_key", "left").select("job_key", "runs", zero("overlapping"), zero("peak"))


def settlement_gaps(events: DataFrame) -> DataFrame:
    """Ended executions with a later failed settlement of the same delivery: settlement_id, ended, failures."""
    facts = events.where("settlement_id is not null")
    first = facts.where(kind_is("process_succeeded", "process_failed")).groupBy("settlement_id").agg(F.min("time").alias("ended"))
    bad = facts.where(kind_is("settlement_failed")).select("settlement_id", F.col("time").alias("at"))
    return bad.join(first, "settlement_id").where("at >= ended").groupBy("settlement_id").agg(F.unix_micros(F.min("ended")).alias("ended_us"), F.count("*").alias("failures"))


def retry_bound_violations(events: DataFrame) -> DataFrame:
    """Jobs with more distinct started attempts than retries allow."""
    got = events.where(kind_is("process_started") & (F.col("job_id") != "")).groupBy("job_id").agg(F.count_distinct("attempt").alias("attempts"), F.max("max_retry").alias("max_retry"))
    return got.where(F.col("attempts") > F.col("max_retry") + 1)


def duplicate_effects(events: DataFrame) -> DataFrame:
    """Jobs with more than one success."""
    return events.where(kind_is("process_succeeded") & (F.col("job_id") != "")).groupBy("job_id").agg(F.count("*").alias("successes")).where("successes > 1")


def retry_fact_gaps(events: DataFrame) -> DataFrame:
    """Later attempts that started without a retry fact, and retry facts without such a start: dispatch_id, job_id, attempt, missing."""
    key = ["dispatch_id", "job_id", "attempt"]
    rows = events.where(F.col("job_id") != "")
    starts = rows.where(kind_is("process_started") & (F.col("attempt") > 0)).select(*key).distinct().withColumn("s", F.lit(True))
    retries = rows.where(kind_is("process_retried") & (F.col("attempt") > 0)).select(*key).distinct().withColumn("r", F.lit(True))
    both = starts.join(retries, key, "full")
    return both.where("s is null or r is null").select(*key, F.when(F.col("r").isNull(), "retry").otherwise("start").alias("missing"))


def job_ordering_audit(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Starts that overtake: a start whose enqueue came before that of an earlier start of its queue. queue, starts, inversions.

    Over matched pairs; the running maximum is taken within time buckets, then over the buckets' maxima.
    """
    pairs = gauges.match_waits(events).select("queue", "job_key", "nth", F.col("started_at").alias("time"), F.unix_micros("enqueued_at").alias("e")).withColumn("bucket", gauges.time_bucket(seconds))
    tops = pairs.groupBy("queue", "bucket").agg(F.max("e").alias("top"))
    tops = tops.withColumn("before", F.max("top").over(Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inner = Window.partitionBy("queue", "bucket").orderBy("time", "job_key", "nth").rowsBetween(Window.unboundedPreceding, -1)
    seen = pairs.withColumn("inside", F.max("e").over(inner)).join(tops, ["queue", "bucket"])
    return seen.groupBy("queue").agg(F.count("*").alias("starts"), count_if(F.col("e") < F.greatest("inside", "before")).alias("inversions"))


def retry_episodes(events: DataFrame) -> DataFrame:
    """Starts of each job in order: attempt, gap to the previous start, and the job's last end so far known."""
    w = Window.partitionBy("dispatch_id", "job_id").orderBy("time", "seq")
    facts = events.where((F.col("job_id") != "") & kind_is("process_started", "process_succeeded", "process_failed"))
    facts = facts.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_time", F.lead("time").over(w))
    starts = facts.where(kind_is("process_started"))
    ended = F.col("next_kind") != "process_started"
    return starts.select("dispatch_id", "job_id", "attempt", "seq", F.when(ended, F.col("next_kind")).alias("outcome"), F.when(ended, F.unix_micros("next_time") - F.unix_micros("time")).alias("took_us"), (F.unix_micros("time") - F.unix_micros(F.lag("time").over(w))).alias("gap_us"))


def skip_permanent(events: DataFrame) -> DataFrame:
    """Failures with the class that retry decisions see: boom-0 errors count as permanent."""
    cls = scalar.mark_permanent(F.col("error"), F.col("error_class"), F.col("error") == "boom-0")
    return events.where(kind_is("process_failed")).withColumn("error_class", cls)
