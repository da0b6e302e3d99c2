"""Streams that run long or fail in a write raise instead of giving part of their rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from jobledger import schemas
from jobledger.jobs import catalog
from jobledger.operators import gauges, stats
from jobledger.operators.events import dedupe_events
from jobledger.streaming import streams
from jobledger.streaming.lateness import LateGate, ProgressLog, observed
from jobledger.streaming.live import LiveStats

T0 = datetime(2024, 1, 1)


def _slow(batches):
    for batch in batches:
        time.sleep(5)
        yield batch


def test_a_stream_that_runs_too_long_raises(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    slow = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").mapInPandas(_slow, "id long")
    with pytest.raises(TimeoutError):
        streams.run_to_end(slow, f"{tmp_path}/cut", f"{tmp_path}/cut_checkpoint", wait=timedelta(seconds=1))
    assert streams.run_to_end(slow, f"{tmp_path}/out", f"{tmp_path}/checkpoint").count() == 3


@pytest.mark.parametrize("name", ["stream_stats", "fan_out"])
def test_a_failed_write_raises(spark, sf_dir, monkeypatch, name):
    write = DataFrameWriter.parquet

    def broken(self, *args, **kwargs):
        write(self, *args, **kwargs)
        raise OSError("disk")

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(Exception, match="disk"):
        catalog.QUERIES[name](spark, sf_dir).collect()


def fact(seq, minute, kind, sid=None, key="", queue="q", job_type="t", event_id=None):
    at = T0 + timedelta(minutes=minute)
    return (seq, 1, event_id or f"e{seq}", "worker", kind, "database", queue, job_type, key, "d", "j", "", "", 0, 0, False, 1000, None, None, sid, at)


def deliver(spark, path, rows):
    spark.createDataFrame(rows, schemas.EVENT).coalesce(1).write.mode("append").parquet(path)


def test_an_end_before_its_start_is_no_alarm(spark, tmp_path):
    """The end comes in an earlier micro-batch than its start; another start has its end too late, a third none, a fourth one at its last moment."""
    first = [fact(2, 11, "process_succeeded", "s1"), fact(1, 10, "process_started", "s2")]
    second = [fact(3, 10, "process_started", "s1"), fact(4, 20, "process_failed", "s2"), fact(5, 12, "process_started", "s3"), fact(6, 13, "process_started", "s4"), fact(7, 13 + 302 / 60, "process_succeeded", "s4")]
    third = [fact(8, 900, "enqueue_accepted")]  # no start or end comes any more
    for rows in (first, second, third):
        deliver(spark, f"{tmp_path}/log", rows)
        stream = spark.readStream.schema(schemas.EVENT).parquet(f"{tmp_path}/log")
        out = streams.run_to_end(streams.stream_stale(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(x.settlement_id for x in out.collect()) == ["s2", "s3"]


def test_claims_are_carried_over_deliveries(spark, tmp_path):
    """One key holds nearly all requests, which come one delivery after the other."""
    ms = 1_704_067_200_000  # T0
    rows = [("k", i, T0 + timedelta(seconds=i), ms + 1000 * i, 7000 if i % 5 else 0) for i in range(60)] + [("other", 60, T0 + timedelta(minutes=1), ms + 60_000, 10)]
    want, free = {}, 0
    for key, seq, _, t, ttl in rows:
        ok = ttl <= 0 or key == "other" or t >= free
        free = t + ttl if ok and ttl > 0 and key == "k" else free
        want[seq] = ok
    schema = "unique_key string, seq long, time timestamp, t long, ttl long"
    for part in (rows[:7], rows[7:40], rows[40:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = streams.run_to_end(streams.stream_unique(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {x.seq: x.accepted for x in out.collect()} == want


def test_live_statistics_hold_back_count_late_and_replace(spark, tmp_path):
    live = LiveStats(spark, f"{tmp_path}/state", timedelta(minutes=10))
    first = [fact(1, 0, "enqueue_accepted", key="k"), fact(3, 30, "process_started", "s", "k"), fact(5, 58, "process_succeeded", "s", "k")]
    second = [fact(2, 55, "enqueue_accepted", key="k"), fact(4, 1, "enqueue_accepted", key="k"), fact(6, 59, "process_started", "s2", "k"), fact(7, 59.5, "process_started", "s2", "k", event_id="e6")]
    for number, rows in enumerate((first, second)):
        batch = spark.createDataFrame(rows, schemas.EVENT)
        live.apply(batch, number)
        live.apply(batch, number)  # a batch that comes again
    got = live.snapshot(0).first()
    assert (got.pending, got.active, got.processed) == (0, 1, 0)  # the success at minute 58 is held
    number = live.close()
    assert [x.seq for x in live.read("late", number).collect()] == [4]
    got = live.snapshot(number).first()
    assert (got.pending, got.active, got.processed, got.processed_hour, got.avg_run_ns) == (0, 1, 1, 1, 1000)
    assert got.avg_wait_ns == (30 + 4) * 60 * 10**9 // 2  # the enqueue of minute 55 waits for the start of minute 59
    assert live.read("seen", number).count() == 5


def test_live_statistics_do_not_depend_on_the_cut(spark, tmp_path):
    rows = []
    kinds = ["enqueue_accepted", "process_started", "process_succeeded", "process_failed", "settlement_failed", "queue_paused", "queue_resumed", "process_retried"]
    r = random.Random(3)
    for i in range(400):
        rows.append(fact(i, i / 4, r.choice(kinds), r.choice([None, None, "a", "b", "c"]), r.choice(["", "k1", "k2"]), r.choice(["q", "p"]), event_id=f"e{i - 1 if i % 40 == 39 else i}"))
    want = sorted(map(tuple, stats.stats_snapshot(dedupe_events(spark.createDataFrame(rows, schemas.EVENT))).collect()))
    rows.sort(key=lambda x: x[0] + r.randrange(30))
    live = LiveStats(spark, f"{tmp_path}/state", timedelta(minutes=8))
    for number, (a, b) in enumerate([(0, 150), (150, 160), (160, 400)]):
        live.apply(spark.createDataFrame(rows[a:b], schemas.EVENT), number)
    out = live.snapshot(live.close())
    columns = stats.stats_snapshot(spark.createDataFrame(rows[:1], schemas.EVENT)).columns
    assert sorted(map(tuple, out.select(*columns).collect())) == want
    assert live.read("late", live.last()).count() == 0


def test_waits_may_add_up_to_more_than_a_long_holds(spark, tmp_path):
    years = 250 * 365 * 1440
    rows = [fact(i, 0, "enqueue_accepted", key="k") for i in range(4)] + [fact(4 + i, years, "process_started", key="k") for i in range(4)]
    log = spark.createDataFrame(rows, schemas.EVENT)
    live = LiveStats(spark, f"{tmp_path}/state")
    live.apply(log, 0)
    assert live.snapshot(live.close()).first().avg_wait_ns == stats.avg_wait(log).first().avg_wait_ns == years * 60 * 10**9


def test_keys_with_many_rows_give_what_one_window_gives(spark):
    """All keys in windows of their own, all in buckets, and one of each; a key's rows are shuffled once for their gauge."""
    r = random.Random(5)
    rows = [fact(i, i, r.choice(["enqueue_accepted", "process_started"]), None, r.choice(["k", "k", "k", "k", f"k{i % 30}"]), r.choice(["q", None])) for i in range(600)]
    log = spark.createDataFrame(rows, schemas.EVENT)
    pairs = [sorted(map(str, gauges.enqueues(log, many).collect())) for many in (1000, 0, 50)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) == sum(x[4] == "enqueue_accepted" for x in rows)
    few, others = gauges.by_size(log, ["queue", "job_key"], 50)
    assert few.count() and others.count() and few.count() + others.count() == 600
    sums = [sorted(map(str, gauges.summed_by_size(log, ["queue", "job_key"], many, g=gauges.pending_delta()).collect())) for many in (1000, 0, 50)]
    assert sums[0] == sums[1] == sums[2] == sorted(map(str, gauges.summed_gauges(log, ["queue", "job_key"], g=gauges.pending_delta()).collect()))
    plan = gauges.floored_gauge(log.select("queue", "job_key", "time", "seq", "kind"), ["queue", "job_key"], gauges.pending_delta())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # the rows, the same again for the sums of buckets, and those to their key and back


def test_late_rows_stand_aside_and_totals_add_up(spark, tmp_path):
    gate, kept = LateGate(spark, f"{tmp_path}/gate", timedelta(minutes=10)), {}
    batches = [[fact(1, 0, "k"), fact(2, 30, "k")], [], [fact(3, 19, "k"), fact(4, 20, "k"), fact(5, 21, "k"), fact(6, 50, "k")], [fact(7, 39, "k"), fact(8, 41, "k")]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that comes again
            kept[number] = sorted(x.seq for x in gate.split(spark.createDataFrame(rows, schemas.EVENT), number).collect())
    late = sorted((x.batch, x.seq) for x in gate.late("seq long, batch int").collect())
    assert late == [(2, 3), (2, 4), (3, 7)] and kept == {0: [1, 2], 1: [], 2: [5, 6], 3: [8]}


def test_dropped_rows_are_counted(spark, tmp_path):
    """The windows drop what is too late; the listener says how much came and how much was dropped."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        for rows in ([fact(1, 0, "process_started"), fact(2, 300, "process_started")], [fact(3, 1, "process_started"), fact(4, 301, "process_started")]):
            deliver(spark, f"{tmp_path}/log", rows)
            stream = observed(spark.readStream.schema(schemas.EVENT).parquet(f"{tmp_path}/log"))
            streams.run_to_end(streams.stream_rates(stream, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        for _ in range(50):
            if sum(rows for rows, _ in log.batches.values()) >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    told = log.drain()
    assert sum(rows for *_, rows, _ in told) == 4 and sum(dropped for *_, dropped in told) == 1
    assert log.drain() == []


def test_episodes_open_and_close_once(spark, tmp_path):
    """Three hours in alarm over two deliveries, an hour off, one more hour in alarm that isn't over yet."""
    at = lambda h, m: 60 * h + m
    first = [fact(i, at(0, i), "process_failed") for i in range(3)] + [fact(10 + i, at(1, i), "process_failed") for i in range(3)]
    second = [fact(20 + i, at(2, i), "process_failed") for i in range(4)] + [fact(30, at(3, 5), "process_failed")] + [fact(40 + i, at(4, i), "process_failed") for i in range(3)] + [fact(50, at(4, 30), "process_succeeded")]
    level = F.when(F.col("kind") == "process_failed", 1).otherwise(0)
    for rows in (first, second):
        deliver(spark, f"{tmp_path}/log", rows)
        stream = spark.readStream.schema(schemas.EVENT).parquet(f"{tmp_path}/log")
        out = streams.run_to_end(streams.stream_episodes(stream, ["queue"], level, 2, 3600), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    began = int(spark.sql("select unix_seconds(timestamp '2024-01-01')").first()[0])
    assert [tuple(x) for x in out.collect()] == [("q", began, began + 3 * 3600, 3, 4)]


def test_files_of_the_log_grow_in_number(spark, sf_dir, tmp_path, monkeypatch):
    from jobledger.jobs import streams as jobs

    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    jobs._log(spark, sf_dir, f"file://{tmp_path}")
    assert len(list((tmp_path / "log").glob("*.parquet"))) == -(-n // 100) > 4
