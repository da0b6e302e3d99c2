"""Set-based transforms of the job table: admit, recover, claim, settle, administer, list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators.stats import count_if
from jobledger.operators.unique import unique_gate

# Fixed values of the recovery rule: text, grace and lease.
RECOVERED_TEXT = "recovered stale processing job"
GRACE_MS, LEASE_MS = 2_000, 300_000
CANCELED_TEXT = "canceled from queue admin"


def skip_when(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that the predicate doesn't match; null is no match."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def rejection(resolved: bool = False) -> Column:
    """Why a request can't be dispatched, null if it can: the first of these reasons. An empty queue is one only once queues are resolved."""
    out = F.when(F.coalesce(F.col("job_type"), F.lit("")) == "", "missing job type")
    if resolved:
        out = out.when(F.coalesce(F.col("queue"), F.lit("")) == "", "missing queue")
    for c, why in (("timeout_ms", "negative timeout"), ("max_retry", "negative retry"), ("backoff_ms", "negative backoff"), ("delay_ms", "negative delay"), ("unique_ttl_ms", "negative unique ttl")):
        out = out.when(F.col(c) < 0, why)
    return out


def validate_dispatch(requests: DataFrame, resolved: bool = False) -> DataFrame:
    """Requests with ``reason``, null for valid ones. ``resolved``: an empty queue no longer means the default one."""
    return requests.withColumn("reason", rejection(resolved))


def admit_jobs(requests: DataFrame, as_of_ms: int, base_id: int = 0) -> DataFrame:
    """Job rows of valid requests: pending, attempt 0, available after the delay; ids follow (time, seq).

    Numbering is two-level: hours are counted, and rows numbered within their hour, so no task sorts all of them.
    """
    ok = validate_dispatch(requests).where("reason is null").withColumn("hour", F.floor(F.unix_seconds("time") / 3600))
    ahead = ok.groupBy("hour").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = ok.withColumn("i", F.row_number().over(Window.partitionBy("hour").orderBy("time", "seq"))).join(ahead.drop("n"), "hour")
    return rows.select(
        (F.col("ahead") + F.col("i") + base_id).alias("id"), scalar.default_queue(F.col("queue")).alias("queue_name"), "job_type", "payload",
        F.when(F.col("timeout_ms") > 0, F.greatest(F.lit(1), F.ceil(F.col("timeout_ms") / 1000))).cast("long").alias("timeout_seconds"), F.coalesce("max_retry", F.lit(0)).alias("max_retry"),
        F.coalesce("backoff_ms", F.lit(0)).alias("backoff_millis"), F.lit(0).alias("attempt"), (F.lit(as_of_ms) + F.coalesce("delay_ms", F.lit(0))).alias("available_at"), F.lit("pending").alias("state"),
    )


def bind_payload(rows: DataFrame, schema: str) -> DataFrame:
    """``bound`` (struct) and ``bind_ok``: a payload that isn't such JSON is marked, never an error."""
    text = F.col("payload").cast("string")
    got = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.withColumn("bound", got).withColumn("bind_ok", F.coalesce(F.col("bound").isNotNull() & F.col("bound._bad").isNull() & (text != ""), F.lit(False)))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """pending (with scheduled and retry ones), active and archived jobs of each queue."""
    return jobs.groupBy("queue_name").agg(*[count_if(F.col("state") == s).alias(n) for s, n in (("pending", "pending"), ("processing", "active"), ("dead", "archived"))])


def with_state(jobs: DataFrame, as_of_ms: int) -> DataFrame:
    return jobs.withColumn("derived", scalar.derive_job_state(F.col("state"), F.col("attempt"), F.col("available_at"), as_of_ms))


def state_counts(jobs: DataFrame, as_of_ms: int) -> DataFrame:
    """The six listing states of each queue; finished jobs are deleted, so completed is 0."""
    states = ["pending", "active", "scheduled", "retry", "archived"]
    got = with_state(jobs, as_of_ms).groupBy("queue_name").agg(*[count_if(F.col("derived") == s).alias(s) for s in states])
    return got.withColumn("completed", F.lit(0).cast("long"))


def list_jobs(jobs: DataFrame, as_of_ms: int, queue: str = "", state: str = "", page: int = 1, page_size: int = 50, after_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of jobs by descending id, total): defaults are queue default, state pending, page 1, 50 rows; at most 500.

    ``after_id`` continues below an id instead of skipping pages. An unknown state is an error; completed is always empty.
    """
    queue, state = queue or scalar.DEFAULT_QUEUE, state or "pending"
    if state not in ("pending", "active", "scheduled", "retry", "archived", "completed"):
        raise ValueError(f"unknown job state {state!r}")
    size = min(page_size, 500) if page_size > 0 else 50
    rows = with_state(jobs, as_of_ms).where((F.col("queue_name") == queue) & (F.col("derived") == state))
    total = rows.agg(F.count("*").alias("total"))
    if after_id is not None:
        return rows.where(F.col("id") < after_id).orderBy(F.desc("id")).limit(size), total
    return rows.orderBy(F.desc("id")).offset((max(page, 1) - 1) * size).limit(size), total


def recover_stale(jobs: DataFrame, as_of_ms: int, marker: str, grace_ms: int = GRACE_MS, lease_ms: int = LEASE_MS) -> DataFrame:
    """The job table with ``recovered``: running jobs past their timeout and grace, or without one past the lease, are pending again.

    Those without a token, or with an empty one, get ``marker`` for one. A negative timeout is none.
    """
    timeout = F.coalesce(F.col("timeout_seconds"), F.lit(0))
    started = F.col("processing_started_at")
    stale = (F.col("state") == "processing") & F.coalesce(F.when(timeout > 0, started + timeout * 1000 + grace_ms <= as_of_ms).otherwise(started <= as_of_ms - lease_ms), F.lit(False))
    rows = jobs.withColumn("recovered", stale)
    back = F.col("recovered")
    return rows.withColumns({
        "state": F.when(back, "pending").otherwise(F.col("state")), "available_at": F.when(back, F.lit(as_of_ms)).otherwise(F.col("available_at")),
        "processing_token": F.when(back & (F.coalesce("processing_token", F.lit("")) == ""), F.lit(marker)).otherwise(F.col("processing_token")),
        "processing_started_at": F.when(~back, started), "last_error": F.when(back, RECOVERED_TEXT).otherwise(F.col("last_error")), "updated_at": F.when(back, F.lit(as_of_ms)).otherwise(F.col("updated_at")),
    })


def recovered_facts(recovered: DataFrame, as_of_ms: int) -> DataFrame:
    """A process_recovered fact for each recovered job: kind, queue (empty), time. Only how many there were is reported, so facts name no job."""
    return recovered.where("recovered").select(F.lit("process_recovered").alias("kind"), F.lit("").alias("queue"), F.timestamp_millis(F.lit(as_of_ms)).alias("time"))


def claim_next(jobs: DataFrame, as_of_ms: int, n: int) -> DataFrame:
    """The ``n`` lowest due pending ids of each queue, marked running; each partition first keeps its own lowest."""
    due = jobs.where((F.col("state") == "pending") & (F.col("available_at") <= as_of_ms))
    first = due.withColumn("r", F.row_number().over(Window.partitionBy("queue_name").orderBy("id"))).where(F.col("r") <= n).drop("r")
    token = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(as_of_ms))), 256)
    return first.withColumns({"state": F.lit("processing"), "processing_started_at": F.lit(as_of_ms), "processing_token": token, "updated_at": F.lit(as_of_ms)})


def recover_and_claim(jobs: DataFrame, as_of_ms: int, n: int, marker: str) -> tuple[DataFrame, DataFrame]:
    """(the job table afterwards, the claimed rows): stale jobs are recovered first and can be claimed in the same step.

    A recovered job keeps its old token until it is claimed anew, so an outcome reported under it no longer counts.
    """
    ready = recover_stale(jobs, as_of_ms, marker).drop("recovered")
    claimed = claim_next(ready, as_of_ms, n)
    return ready.join(claimed.select("id"), "id", "left_anti").select(*jobs.columns).unionByName(claimed.select(*jobs.columns)), claimed


def settle_jobs(jobs: DataFrame, outcomes: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs after settling, outcomes that settle nothing, archive facts).

    ``outcomes(id, processing_token, failed, error_class, error, time, seq)``; seq tells them apart. An outcome counts only for the running
    row with its id and token, and of several with one id and token only the first in (time, seq) order, as the row is no longer
    running then; the others are unmatched. Success removes the row; retry and redeliver make it pending after its backoff, failure dead;
    attempts grow by one except on redelivery. Rows without a token match nothing. Reports of one run are combined before the shuffle.
    """
    told = F.struct("time", "seq", "failed", "error_class", "error")
    first = outcomes.groupBy(F.col("id").alias("o_id"), F.col("processing_token").alias("o_token")).agg(F.min(told).alias("o"))
    met = jobs.join(first, (F.col("id") == F.col("o_id")) & (F.col("processing_token") == F.col("o_token")) & (F.col("state") == "processing"), "left")
    met = met.withColumn("outcome", F.when(F.col("o").isNotNull(), scalar.classify_attempt(F.col("attempt"), F.col("max_retry"), F.col("o.failed"), F.col("o.error_class"))))
    again, dead = F.col("outcome").isin("retry", "redeliver"), F.col("outcome") == "failed"
    kept = met.where("outcome is null or outcome <> 'succeeded'")
    touched = F.col("outcome").isNotNull()
    after = kept.withColumns({
        "state": F.when(again, "pending").when(dead, "dead").otherwise(F.col("state")), "available_at": F.when(again, F.lit(as_of_ms) + F.col("backoff_millis")).otherwise(F.col("available_at")),
        "attempt": F.when(touched & (F.col("outcome") != "redeliver"), F.col("attempt") + 1).otherwise(F.col("attempt")), "last_error": F.when(touched, F.col("o.error")).otherwise(F.col("last_error")),
        "processing_token": F.when(~touched, F.col("processing_token")), "processing_started_at": F.when(~touched, F.col("processing_started_at")), "updated_at": F.when(touched, F.lit(as_of_ms)).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)
    settled = met.where(touched).select("id", "processing_token", F.col("o.time").alias("time"), F.col("o.seq").alias("seq"))
    unmatched = outcomes.join(settled, ["id", "processing_token", "time", "seq"], "left_anti")
    archived = met.where("outcome = 'failed'").select("id", F.lit("process_archived").alias("kind"), F.col("queue_name").alias("queue"), "job_type", F.col("o.error").alias("error"))
    return after, unmatched, archived


def settlement_failures(unmatched: DataFrame, jobs: DataFrame, as_of_ms: int) -> DataFrame:
    """A settlement_failed fact for each outcome that settled nothing; queue and type are those of the job, if it is still there."""
    known = jobs.select(F.col("id").alias("j_id"), F.col("queue_name").alias("queue"), "job_type")
    met = unmatched.join(known, F.col("id") == F.col("j_id"), "left")
    return met.select("id", "seq", F.lit("settlement_failed").alias("kind"), F.coalesce("queue", F.lit("")).alias("queue"), F.coalesce("job_type", F.lit("")).alias("job_type"), "error", F.timestamp_millis(F.lit(as_of_ms)).alias("time"))


def apply_admin(jobs: DataFrame, commands: DataFrame, as_of_ms: int) -> DataFrame:
    """``commands(seq, op, id, queue)``: delete and retry count only for the job of that id in that queue, cancel for the id, clear for the queue.

    An empty queue is the default one. What is deleted or cleared is gone; of retries and cancels that count for a job, the last decides its
    state. Retry makes a job pending now without its error, keeping its attempts; cancel makes it dead and leaves the time it is available
    at, which an earlier retry has set. Commands of one job are combined before the shuffle.
    """
    told = commands.withColumn("queue", scalar.default_queue(F.col("queue")))
    gone = told.where("op = 'delete'").select("id", F.col("queue").alias("queue_name"))
    cleared = told.where("op = 'clear'").select(F.col("queue").alias("queue_name")).distinct()
    left = jobs.join(gone, ["id", "queue_name"], "left_anti").join(cleared, "queue_name", "left_anti")
    # the last command by job and queue it names (none for cancels): a retry that names another queue must not hide an earlier command
    named = told.where("op in ('retry', 'cancel')").groupBy("id", F.when(F.col("op") == "retry", F.col("queue")).alias("named")).agg(F.max(F.struct("seq", "op")).alias("last"))
    of_job = named.groupBy(F.col("id").alias("c_id")).agg(F.max(F.when(F.col("named").isNull(), F.col("last.seq"))).alias("canceled"), F.map_from_entries(F.collect_list(F.when(F.col("named").isNotNull(), F.struct("named", F.col("last.seq").alias("seq"))))).alias("retried"))
    met = left.join(of_job, F.col("id") == F.col("c_id"), "left").withColumn("retried", F.try_element_at("retried", F.col("queue_name")))
    retry = F.coalesce(F.col("retried") > F.coalesce("canceled", F.lit(-(1 << 62))), F.lit(False))
    cancel = F.col("canceled").isNotNull() & ~retry
    either = retry | cancel
    return met.withColumns({
        "state": F.when(retry, "pending").when(cancel, "dead").otherwise(F.col("state")), "available_at": F.when(F.col("retried").isNotNull(), F.lit(as_of_ms)).otherwise(F.col("available_at")),
        "last_error": F.when(retry, F.lit(None).cast("string")).when(cancel, CANCELED_TEXT).otherwise(F.col("last_error")), "updated_at": F.when(either, F.lit(as_of_ms)).otherwise(F.col("updated_at")),
        "processing_token": F.when(~either, F.col("processing_token")), "processing_started_at": F.when(~either, F.col("processing_started_at")),
    }).select(*jobs.columns)


def admission_events(requests: DataFrame, prefix: str) -> DataFrame:
    """One enqueue fact for each request, with its ids (dispatch_id, job_id, chain_id, batch_id, where the requests have them).

    In this order: rejected (with ``reason``) if it is invalid, canceled if its caller gave up (``canceled``, if there is such a column),
    duplicate if the gate holds it back, else accepted. Only requests that reach the gate claim a key there; ``prefix`` as for the gate.
    """
    ids = [c for c in ("dispatch_id", "job_id", "chain_id", "batch_id") if c in requests.columns]
    gave_up = F.coalesce(F.col("canceled"), F.lit(False)) if "canceled" in requests.columns else F.lit(False)
    checked = validate_dispatch(requests).withColumn("stopped", F.when(F.col("reason").isNotNull(), "enqueue_rejected").when(gave_up, "enqueue_canceled"))
    gated = unique_gate(checked.where("stopped is null"), prefix)
    scheduled = (F.coalesce(F.col("delay_ms"), F.lit(0)) > 0).alias("scheduled")
    out = ["seq", scalar.default_queue(F.col("queue")).alias("queue"), "job_type", *ids, F.coalesce("max_retry", F.lit(0)).alias("max_retry"), scheduled]
    passed = gated.select(F.when(F.col("accepted"), "enqueue_accepted").otherwise("enqueue_duplicate").alias("kind"), F.lit(None).cast("string").alias("reason"), *out)
    return passed.unionByName(checked.where("stopped is not null").select(F.col("stopped").alias("kind"), "reason", *out))
