"""Scalar rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobledger import schemas

# Event kinds of the worker and workflow layers; every other kind belongs to the queue layer.
WORKER_KINDS = [
    "process_started", "process_succeeded", "process_failed", "process_retried", "process_archived", "process_recovered",
    "republish_failed", "settlement_failed",
]
WORKFLOW_KINDS = [
    "job_started", "job_succeeded", "job_failed", "chain_started", "chain_advanced", "chain_completed", "chain_failed",
    "batch_started", "batch_progressed", "batch_completed", "batch_failed", "batch_cancelled", "callback_started",
    "callback_succeeded", "callback_failed",
]
DEFAULT_QUEUE = "default"
# The physical types under which deliveries carry a version 1 envelope.
ENVELOPE_TYPES = ["bus:job", "bus:chain:node", "bus:batch:job", "bus:callback"]


def default_queue(queue: Column) -> Column:
    return F.when(F.coalesce(queue, F.lit("")) == "", DEFAULT_QUEUE).otherwise(queue)


def event_layer(kind: Column) -> Column:
    """worker, workflow or, for any other kind, queue."""
    return F.when(kind.isin(WORKER_KINDS), "worker").when(kind.isin(WORKFLOW_KINDS), "workflow").otherwise("queue")


def canonical_payload(payload: Column) -> Column:
    """Absent, empty and JSON null payloads are one: the empty one."""
    text = payload.cast("string")
    return F.when(text.isNull() | (text == "") | (text == "null"), "").otherwise(text)


def observed_job_key(job_type: Column, payload: Column) -> Column:
    """Hex SHA-1 of ``type:payload``, the key under which telemetry groups jobs."""
    return F.sha1(F.concat(job_type, F.lit(":"), canonical_payload(payload)).cast("binary"))


def framed(*parts: Column) -> Column:
    """Each part after its length in eight bytes, most significant first: no two lists of parts run together alike."""
    pieces = []
    for p in parts:
        raw = p.cast("binary")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw]
    return F.concat(*pieces)


def unique_key(queue: Column, job_type: Column, payload: Column, prefix: str) -> Column:
    """``v1:`` and the SHA-256 of the prefix and the framed identity. The prefix is that of the system whose keys are to match."""
    body = F.concat(F.lit(prefix).cast("binary"), framed(queue, job_type, canonical_payload(payload)))
    return F.concat(F.lit("v1:"), F.sha2(body, 256))


def legacy_unique_key(queue: Column, job_type: Column, payload: Column) -> Column:
    """SHA-256 of ``queue:type:payload`` of the physical job."""
    return F.sha2(F.concat(queue, F.lit(":"), job_type, F.lit(":"), F.coalesce(payload.cast("string"), F.lit(""))).cast("binary"), 256)


def stable_event_id(kind: Column, *identity: Column, version: int = 1) -> Column:
    """``evt_`` and 16 bytes of the SHA-256 over version, kind and identity, framed: the same fact has the same id."""
    return F.concat(F.lit("evt_"), F.substring(F.sha2(framed(F.lit(str(version)), kind, *identity), 256), 1, 32))


def job_fingerprint(*fields: Column) -> Column:
    """SHA-256 over framed fields of a job; nulls count as empty."""
    return F.sha2(framed(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def resolve_delivery(job_type: Column, payload: Column) -> Column:
    """Struct of the logical identity: that of a readable version 1 envelope, else the physical one (decoded = false).

    An envelope without a job type keeps the physical type and payload but gives its ids.
    """
    e = F.from_json(payload.cast("string"), schemas.ENVELOPE)
    body = F.when(F.coalesce(e["job"]["payload"], F.lit("")) == "", F.lit("").cast("binary")).otherwise(F.try_to_binary(e["job"]["payload"], F.lit("base64")))
    ok = F.coalesce(job_type.isin(ENVELOPE_TYPES) & (e["schema_version"] == 1) & body.isNotNull(), F.lit(False))
    named = ok & (F.coalesce(e["job"]["type"], F.lit("")) != "")
    text = lambda c: F.when(ok, F.coalesce(c, F.lit(""))).otherwise("")
    return F.struct(
        ok.alias("decoded"), F.when(named, e["job"]["type"]).otherwise(job_type).alias("job_type"), F.when(named, body).otherwise(payload.cast("binary")).alias("payload"),
        text(e["dispatch_id"]).alias("dispatch_id"), text(e["job_id"]).alias("job_id"), text(e["chain_id"]).alias("chain_id"), text(e["batch_id"]).alias("batch_id"),
        F.when(ok, F.coalesce(e["attempt"], F.lit(0))).otherwise(0).alias("attempt"),
    )


def resolve_metadata(job_type: Column, payload: Column, metadata_json: Column) -> Column:
    """As :func:`resolve_delivery`, with the ids of a version 1 sidecar in place of the envelope's."""
    d, m = resolve_delivery(job_type, payload), F.from_json(metadata_json, schemas.SIDECAR)
    trusted = F.coalesce(m["schema_version"] == 1, F.lit(False))
    ids = [F.when(trusted & (F.coalesce(m[c], F.lit("")) != ""), m[c]).otherwise(d[c]).alias(c) for c in ("dispatch_id", "job_id", "chain_id", "batch_id")]
    return F.struct(d["decoded"].alias("decoded"), trusted.alias("sidecar"), d["job_type"].alias("job_type"), *ids, F.when(trusted, F.coalesce(m["queue"], F.lit(""))).otherwise("").alias("queue"))


def physical_queue(default: Column, name: Column) -> Column:
    """The name on the backend: trimmed, the default if empty, and under the default's ``<prefix>_`` unless it has that already."""
    d, n = F.trim(F.coalesce(default, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    prefix = F.when(F.endswith(d, F.lit("_default")), F.substring(d, F.lit(1), F.char_length(d) - F.lit(len("default")))).otherwise("")
    full = F.when(n == "", F.when(d == "", DEFAULT_QUEUE).otherwise(d)).when((prefix == "") | F.startswith(n, prefix), n)
    return full.otherwise(F.concat(prefix, n))


def derive_job_state(state: Column, attempt: Column, available_at: Column, as_of_ms: int | Column) -> Column:
    """The state that listings show, from the stored one."""
    return F.when(state == "processing", "active").when(state == "dead", "archived").when(attempt > 0, "retry").when(available_at > as_of_ms, "scheduled").otherwise("pending")


def classify_attempt(attempt: Column, max_retry: Column, failed: Column, error_class: Column) -> Column:
    """succeeded, redeliver (uncommitted), failed (permanent or no retry left) or retry, judged in this order."""
    return F.when(~failed, "succeeded").when(F.coalesce(error_class == "uncommitted", F.lit(False)), "redeliver").when(F.coalesce(error_class == "permanent", F.lit(False)) | (attempt >= max_retry), "failed").otherwise("retry")


def mark_permanent(error: Column, error_class: Column, predicate: Column | None = None) -> Column:
    """Errors that match the predicate, or all without one, become permanent; rows without an error keep theirs."""
    match = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    return F.when(error.isNotNull() & match, "permanent").otherwise(error_class)


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Index of the first bound that is at least ``value``; len(bounds) beyond the last."""
    return reduce(lambda c, i: c.when(value <= bounds[i], i), range(1, len(bounds)), F.when(value <= bounds[0], 0)).otherwise(len(bounds))
