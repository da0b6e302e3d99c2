"""Time-to-live deduplication of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators.jumps import admitted

#: Stretch of a key that meets in one task.
BLOCK_MS = 24 * 3_600_000


def _keyed(requests: DataFrame, prefix: str) -> DataFrame:
    queue = scalar.default_queue(F.col("queue"))
    return requests.withColumns({
        "unique_key": scalar.unique_key(queue, F.col("job_type"), F.col("payload"), prefix), "legacy_key": scalar.legacy_unique_key(queue, F.col("job_type"), F.col("payload")),
        "t": F.unix_millis("time"), "ttl": F.coalesce(F.col("unique_ttl_ms"), F.lit(0)),
    })


def _gated(rows: DataFrame, block_ms: int) -> DataFrame:
    """Requests that claim: accepted if no accepted one of their key holds [t, t + ttl). No key is one task."""
    return admitted(rows.withColumn("_until", F.col("t") + F.col("ttl")), ["unique_key"], "t", "_until", ["seq"], block_ms).drop("_until").withColumnRenamed("admitted", "accepted")


def unique_gate(requests: DataFrame, prefix: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Requests with ``accepted``: one with a ttl is let in if no accepted request of its key holds [t, t + its own ttl).

    ``prefix`` starts what is hashed to a key. A claim that ends exactly now is free. Requests without a ttl are always let in and claim nothing.
    A key is cut into blocks of ``block_ms``; take them several times as long as claims last.
    """
    rows = _keyed(requests, prefix)
    free = rows.where("ttl <= 0").withColumn("accepted", F.lit(True))
    return _gated(rows.where("ttl > 0"), block_ms).unionByName(free)


def unique_gate_dual(requests: DataFrame, locks: DataFrame, as_of_ms: int, prefix: str, block_ms: int = BLOCK_MS) -> tuple[DataFrame, DataFrame]:
    """As :func:`unique_gate` with both kinds of keys and stored locks: (requests with accepted, locks alive at ``as_of_ms``).

    ``locks(lock_key, expires_at)``: a stored lock on either key of a request blocks it until the lock expires. Both keys
    are always claimed together and the legacy key decides the other, so within a run the scan over one key decides.
    """
    rows = _keyed(requests, prefix)
    held = locks.groupBy("lock_key").agg(F.max("expires_at").alias("until"))
    rows = rows.join(held.toDF("unique_key", "u1"), "unique_key", "left").join(held.toDF("legacy_key", "u2"), "legacy_key", "left")
    blocked = F.col("t") < F.greatest(F.coalesce("u1", F.lit(-1)), F.coalesce("u2", F.lit(-1)))
    rows = rows.withColumn("blocked", F.coalesce(blocked, F.lit(False)) & (F.col("ttl") > 0)).drop("u1", "u2")
    stopped = rows.where("blocked").withColumn("accepted", F.lit(False))
    free = rows.where("not blocked and ttl <= 0").withColumn("accepted", F.lit(True))
    gated = _gated(rows.where("not blocked and ttl > 0").drop("blocked"), block_ms).withColumn("blocked", F.lit(False))
    out = gated.unionByName(free).unionByName(stopped).drop("blocked")
    new = out.where("accepted and ttl > 0").select(F.inline(F.array(*[F.struct(F.col(k).alias("lock_key"), (F.col("t") + F.col("ttl")).alias("expires_at")) for k in ("unique_key", "legacy_key")])))
    alive = locks.select("lock_key", "expires_at").unionByName(new).groupBy("lock_key").agg(F.max("expires_at").alias("expires_at")).where(F.col("expires_at") > as_of_ms)
    return out, alive
