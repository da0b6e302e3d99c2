"""Schemas of the tables that a background-job system leaves behind, as DDL. Never inferred."""

from __future__ import annotations

EVENT = (
    "seq bigint, schema_version int, event_id string, layer string, kind string, driver string, queue string, job_type string, "
    "job_key string, dispatch_id string, job_id string, chain_id string, batch_id string, attempt int, max_retry int, "
    "scheduled boolean, duration_ns bigint, error string, error_class string, settlement_id string, time timestamp"
)
REQUEST = (
    "seq bigint, time timestamp, queue string, job_type string, payload binary, timeout_ms bigint, backoff_ms bigint, "
    "delay_ms bigint, unique_ttl_ms bigint, max_retry int, metadata_json string"
)
JOB = (
    "id bigint, queue_name string, job_type string, payload binary, metadata_json string, timeout_seconds bigint, max_retry int, "
    "backoff_millis bigint, attempt int, available_at bigint, processing_started_at bigint, processing_token string, "
    "last_error string, state string, created_at bigint, updated_at bigint"
)
#: The delivery envelope, version 1.
ENVELOPE = (
    "schema_version int, dispatch_id string, kind string, job_id string, chain_id string, batch_id string, node_id string, "
    "attempt int, job struct<type:string,payload:string>, callback_kind string, error string"
)
#: The delivery metadata beside it, version 1.
SIDECAR = ("schema_version int, dispatch_id string, job_id string, chain_id string, batch_id string, queue string")
#: Nodes of a chain as stored in JSON.
NODES = "array<struct<node_id:string,job:struct<type:string,payload:string,options:struct<queue:string,delay_ns:bigint,timeout_ns:bigint,retry:int,backoff_ns:bigint,unique_for_ns:bigint>>>>"
