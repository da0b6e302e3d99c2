"""Structured Streaming forms of the live computations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobledger.operators import gauges
from jobledger.operators.scan import hops
from jobledger.operators.stats import count_if, counter_columns, kind_is, last_turn


def stream_rates(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """started, succeeded, failed and retried in each event-time window; rows later than ``delay`` are dropped by Spark."""
    windows = F.window("time", size, slide) if slide else F.window("time", size)
    got = events.withWatermark("time", delay).groupBy(windows.alias("w")).agg(*[count_if(kind_is(f"process_{k}")).alias(k) for k in ("started", "succeeded", "failed", "retried")])
    return got.select(F.unix_seconds("w.start").alias("start"), "started", "succeeded", "failed", "retried")


def stream_dedupe(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first of facts with one event_id that come within ``delay`` of each other."""
    return events.withWatermark("time", delay).dropDuplicatesWithinWatermark(["event_id"])


COUNTS = ("processed", "failed", "retry", "archived")
GAUGES = ("pending", "scheduled")


def batch_summary(events: DataFrame) -> DataFrame:
    """What some events do to each queue's counters: counts, sum and least running sum of the gauges, last pause or resume."""
    counted = events.groupBy("queue").agg(*counter_columns(), last_turn().alias("turn"))
    moved = gauges.summed_gauges(events, ["queue"], pending=gauges.pending_delta(), scheduled=gauges.scheduled_delta())
    return counted.join(moved, "queue", "left")


def folded(state: DataFrame | None, summary: DataFrame) -> DataFrame:
    """``state(queue, counts, gauges, paused)`` after a summary; a row a queue."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    if state is None:
        state = summary.select("queue", *[F.lit(0).cast("long").alias(c) for c in (*COUNTS, *GAUGES)], F.lit(0).alias("paused"))
    was = state.select("queue", *[F.col(c).alias(f"was_{c}") for c in (*COUNTS, *GAUGES, "paused")])
    met = was.join(summary, "queue", "full")
    counts = [(zero(f"was_{c}") + zero(c)).alias(c) for c in COUNTS]
    levels = [(zero(f"was_{g}") + zero(f"{g}_sum") - F.least(F.lit(0), zero(f"was_{g}") + zero(f"{g}_low"))).alias(g) for g in GAUGES]
    paused = F.when(F.col("turn").isNotNull(), (F.col("turn.kind") == "queue_paused").cast("int")).otherwise(F.coalesce("was_paused", F.lit(0)))
    return met.select("queue", *counts, *levels, paused.cast("int").alias("paused"))


def stream_stats(events: DataFrame, path: str) -> DataStreamWriter:
    """A writer of each queue's counters and gauges so far, as a table for each micro-batch under ``path/batch=<number>``.

    A batch is summed up as a whole, in (time, seq) order, by the bucketed passes of the batch operators, so no queue's rows meet in one
    task and no state but the last small table is kept. A batch that comes again replaces its own table.
    """

    def write(batch: DataFrame, number: int) -> None:
        state = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}") if number else None
        folded(state, batch_summary(batch)).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.select("queue", "time", "seq", "kind", "scheduled").writeStream.foreachBatch(write)


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    free_from = state.get[0] if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True)
    if rows.empty:  # the claim ran out
        state.remove()
        return
    rows = rows.sort_values(["t", "seq"])
    t, ttl = rows["t"].to_numpy(np.int64), rows["ttl"].to_numpy(np.int64)
    accepted = ttl <= 0
    claims = np.flatnonzero(~accepted)
    if len(claims):
        accepted[claims], free_from = hops(t[claims], (t + ttl)[claims], np.zeros(1, np.int64), free_from)
    if free_from is not None:
        state.update((free_from,))
        state.setTimeoutTimestamp(max(free_from, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"seq": rows["seq"], "accepted": accepted})


def stream_unique(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """seq, accepted of ``requests(unique_key, seq, time, t, ttl)``; a key's claim leaves the state once the watermark has passed it."""
    rows = requests.withWatermark("time", delay).select("unique_key", "time", "seq", "t", "ttl")
    free = rows.where("ttl <= 0").select("seq", F.lit(True).alias("accepted"))  # these need no state
    gated = rows.where("ttl > 0").groupBy("unique_key").applyInPandasWithState(_gate, "seq long, accepted boolean", "free_from long", "append", GroupStateTimeout.EventTimeTimeout)
    return gated.union(free)


def _above_watermark(condition: Column) -> Column:
    """A filter that names the event time, so it isn't pushed below the watermark: rows that it drops move the watermark too."""
    return F.when(condition, F.greatest(F.unix_seconds("time"), F.lit(1))).otherwise(0) > 0


def stream_stale(events: DataFrame, timeouts: DataFrame | None = None, grace_ms: int = 2_000, lease_ms: int = 300_000, longest_ms: int = 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """settlement_id, started_ms, due_ms of executions without an end within their timeout and grace, or the lease and grace without one.

    ``timeouts(job_type, timeout_ms)``: timeouts of at most ``longest_ms``; a longer one raises. Starts meet the ends of their settlement id by
    an outer interval join of two streams on event time, so it doesn't matter in which micro-batch, or in which order, either comes
    within ``delay``. All facts move the watermark, so executions that hang are told of also when none ends any more. A start is given once the watermark has passed the longest timeout and no end came in time; an end at the very
    moment counts if its seq is larger. Spark keeps only rows that can still meet another.
    """
    rows, limit = events.withWatermark("time", delay), F.lit(lease_ms)
    starts = rows.where(_above_watermark(F.col("settlement_id").isNotNull() & kind_is("process_started")))
    if timeouts is not None:
        own = F.coalesce(F.when(F.col("timeout_ms") > 0, F.col("timeout_ms")), F.lit(lease_ms))
        limit = F.when(own <= longest_ms, own).otherwise(F.raise_error(F.lit("a timeout is longer than longest_ms")).cast("long"))
        starts = starts.join(timeouts.groupBy("job_type").agg(F.max("timeout_ms").alias("timeout_ms")), "job_type", "left")
    longest = (longest_ms if timeouts is not None else lease_ms) + grace_ms
    due = F.unix_millis("time") + limit + grace_ms
    starts = starts.select("settlement_id", F.col("time").alias("start"), "seq", due.alias("due_ms"))
    ends = rows.where(_above_watermark(F.col("settlement_id").isNotNull() & kind_is("process_succeeded", "process_failed"))).select(F.col("settlement_id").alias("e_id"), F.col("time").alias("end"), F.col("seq").alias("e_seq"))
    after = (F.col("end") > F.col("start")) | ((F.col("end") == F.col("start")) & (F.col("e_seq") > F.col("seq")))
    reach = (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("start") + F.expr(f"INTERVAL {longest // 1000} SECONDS {longest % 1000} MILLISECONDS"))
    met = starts.join(ends, (F.col("settlement_id") == F.col("e_id")) & reach & after & (F.unix_millis("end") <= F.col("due_ms")), "left_outer")
    return met.where("e_id is null").select("settlement_id", F.unix_millis("start").alias("started_ms"), "due_ms", "seq")


def _episodes(keys: list[str], seconds: int, limit: int) -> Callable:
    """Facts of a key -> episodes of neighbouring windows in alarm, each once it is over. The state holds open windows and the open episode."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, windows, peak, starts, levels = state.get if state.exists else (None, None, 0, 0, [], [])
        open_ = dict(zip(starts, levels, strict=True))
        for rows in [] if state.hasTimedOut else batches:
            for start, level in rows.groupby("start")["level"].sum().items():
                open_[start] = open_.get(start, 0) + int(level)
        mark, done = state.getCurrentWatermarkMs(), []
        for start in sorted(w for w in open_ if (w + seconds) * 1000 <= mark):  # complete
            level = open_.pop(start)
            if first is not None and (level <= limit or start != last + seconds):
                done.append((first, last + seconds, windows, peak))
                first, windows, peak = None, 0, 0
            if level > limit:
                first, last, windows, peak = start if first is None else first, start, windows + 1, max(peak, level)
        if first is not None and (last + 2 * seconds) * 1000 <= mark:  # the next window is complete, too
            done.append((first, last + seconds, windows, peak))
            first, windows, peak = None, 0, 0
        ends = [(w + seconds) * 1000 for w in open_] + ([(last + 2 * seconds) * 1000] if first is not None else [])
        if ends:
            state.update((first, last, windows, peak, [int(w) for w in open_], list(open_.values())))
            state.setTimeoutTimestamp(min(ends))
        elif state.exists:
            state.remove()
        if done:
            out = pd.DataFrame(done, columns=["start", "end", "windows", "peak"])
            yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "start", "end", "windows", "peak"]]

    return run


def stream_episodes(events: DataFrame, keys: list[str], level: Column, limit: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Alerts that open and close once: keys (strings), start, end, windows, peak of each run of neighbouring windows of which the summed ``level`` (0 at least) exceeds ``limit``.

    A window counts once the watermark has passed its end. An episode is closed by a complete window that isn't in alarm, or by the
    watermark where the next window stays empty. So what comes out depends on event times only. Facts with level 0 need no state; a key's state is its windows within ``delay``
    and one episode, and goes when neither is left.
    """
    rows = events.withWatermark("time", delay).withColumn("level", level.cast("long")).where(_above_watermark(F.col("level") > 0))
    rows = rows.select(*keys, "time", (F.floor(F.unix_seconds("time") / seconds) * seconds).alias("start"), "level")
    schema = ", ".join([*(f"{k} string" for k in keys), "start long, end long, windows long, peak long"])
    held = "first long, last long, windows long, peak long, starts array<long>, levels array<long>"
    return rows.groupBy(*keys).applyInPandasWithState(_episodes(keys, seconds, limit), schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], Any]], failures: list | None = None):
    """A writer that hands each micro-batch to every sink; one that raises doesn't stop the others and is noted in ``failures``.

    Sinks get the batch's number and should replace what they wrote under it, as a batch can come again.
    """
    noted = failures if failures is not None else []

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                except Exception as error:  # noqa: BLE001  whatever an observer raises stays its own
                    noted.append((number, name, repr(error)))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def finish(started: StreamingQuery, wait: timedelta | None = None) -> None:
    """Wait until a stream has ended; one that runs longer than ``wait`` is stopped and raises, as its output is not whole."""
    if wait is None:
        started.awaitTermination()
    elif not started.awaitTermination(int(wait.total_seconds())):
        started.stop()
        raise TimeoutError(f"the stream has not ended within {wait}")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", wait: timedelta | None = None) -> DataFrame:
    """Process what there is, write it as Parquet under ``path``, and read that back."""
    started = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finish(started, wait)
    return df.sparkSession.read.schema(df.schema).parquet(path)
