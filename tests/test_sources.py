"""Databases, versioned tables, JSON intake, traces and sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobledger import schemas
from jobledger.operators import stats, traces
from jobledger.sources import tables
from jobledger.sources.jdbc import read_jdbc, write_jdbc
from jobledger.sources.versions import VersionedTable
from jobledger.streaming import intake, streams

T0 = datetime(2024, 1, 1)
JOB = "id bigint, queue_name string, state string, attempt int, last_error string"


def rows(n, queues="abc"):
    return [(i, queues[i % len(queues)], "pending" if i % 4 else "dead", i % 3, None if i % 5 else f"e{i}") for i in range(n)]


def test_a_job_table_goes_through_a_database(spark):
    """Derby, which comes with Spark, within this process."""
    url = f"jdbc:derby:memory:jobs{random.randrange(10**9)};create=true"
    df = spark.createDataFrame(rows(200), JOB)
    write_jdbc(df, url, "queue_jobs", writers=2)
    got = read_jdbc(spark, url, "queue_jobs", by="id", parts=4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(rows(200))
    dead = read_jdbc(spark, url, "queue_jobs", by="id", parts=3, where="state = 'dead'").select("id", "state")
    plan = dead._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(state), *EqualTo(state,dead)]" in plan and "last_error" not in plan
    assert sorted(x[0] for x in dead.collect()) == [i for i in range(200) if i % 4 == 0]
    write_jdbc(df.where("id < 3").withColumn("id", F.col("id") + 1000), url, "queue_jobs", mode="append")
    assert read_jdbc(spark, url, "queue_jobs", by="id").count() == 203
    with pytest.raises(Exception, match="(?i)exists"):
        write_jdbc(df, url, "queue_jobs")
    write_jdbc(spark.createDataFrame([("k", 5)], "lock_key string, expires_at long"), url, "queue_locks")
    assert read_jdbc(spark, url, "queue_locks", where="lock_key = 'k'").first().expires_at == 5
    write_jdbc(df.where("false"), url, "none_yet")
    assert read_jdbc(spark, url, "none_yet", by="id").count() == 0


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t", JOB, "queue_name")
    assert table.version() == 0 and table.read().count() == 0
    assert table.upsert(spark.createDataFrame([*rows(30), (99, None, "dead", 0, None), (98, "a/b=c", "dead", 0, None)], JOB), ["id"]) == 1
    before = table._manifest(1)
    new = spark.createDataFrame([(0, "a", "pending", 9, None), (300, "a", "pending", 0, None)], JOB)
    assert table.upsert(new, ["id"], spark.createDataFrame([(3, "a")], "id long, queue_name string")) == 2
    after = table._manifest(2)
    assert {n for n in before if before[n] != after[n]} == {"x61"}  # only the partition of queue a
    got = {x.id: x.attempt for x in table.read().collect()}
    assert got[0] == 9 and 300 in got and 3 not in got and len(got) == 32
    assert table.read(1).count() == 32 and {x.id: x.attempt for x in table.read(1).collect()}[0] == 0
    assert {x.queue_name for x in table.read().where("id > 90 and id < 100").collect()} == {None, "a/b=c"}
    # killed between write and publish: the old version stands
    monkeypatch.setattr(VersionedTable, "_announce", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(1, "b", "dead", 77, None)], JOB), ["id"])
    monkeypatch.undo()
    assert table.version() == 2 and table.read().where("attempt = 77").count() == 0
    # a row that moves from one partition to another
    moved = spark.createDataFrame([(1, "c", "dead", 5, None)], JOB)
    table.upsert(moved, ["id"], touched=spark.createDataFrame([("b",)], "queue_name string"))
    assert [x.queue_name for x in table.read().where("id = 1").collect()] == ["c"]
    # a partition that loses all its rows
    table.upsert(spark.createDataFrame([], JOB), ["id"], spark.createDataFrame([(98, "a/b=c")], "id long, queue_name string"))
    assert table.read().where("id = 98").count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", JOB, "queue_name")
    table.upsert(spark.createDataFrame(rows(6), JOB), ["id"])
    table.publish(spark.createDataFrame(rows(3), JOB), {"x61", "x62", "x63"}, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        table.publish(spark.createDataFrame(rows(1), JOB), {"x61"}, 1)


def test_intake_loses_nothing(spark, tmp_path):
    lines = ['{"seq":1,"kind":"process_started","time":"2024-01-01T00:00:00Z"}', "", "   ", "{", '{"seq":"x"}', '{"seq":2,"schema_version":2,"kind":"k","time":"2024-01-01T00:00:00Z"}', '{"seq":3,"schema_version":1,"time":"2024-01-01T00:00:00Z"}', '{"seq":4,"kind":"k"}', '{"seq":5,"schema_version":-1,"kind":"k","time":"2024-01-01T00:00:00Z"}', "[]", "null"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    stream = intake.stream_lines(spark, f"{tmp_path}/in")
    streams.finish(intake.intake(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    good = spark.read.parquet(f"{tmp_path}/out/events").collect()
    bad = sorted((x.line or "", x.reason) for x in spark.read.parquet(f"{tmp_path}/out/quarantine").collect())
    assert [x.seq for x in good] == [1]
    reasons = dict(bad)
    assert len(bad) == len(lines) - 1
    assert reasons[lines[5]] == reasons[lines[8]] == "unknown version" and reasons[lines[6]] == "no kind" and reasons[lines[7]] == "no time" and reasons["{"] == reasons[""] == reasons['{"seq":"x"}'] == "malformed"


def test_json_lines_keep_what_stands_beside_them(spark):
    got = tables.parse_event_lines(spark.createDataFrame([(7, "x")], "n int, line string")).first()
    assert got.n == 7 and got.corrupt


def test_identifiers_connect_like_union_find(spark):
    r = random.Random(2)
    links = [(f"j:{r.randrange(80)}", f"d:{r.randrange(80)}") for _ in range(70)] + [(f"c:{i:03}", f"c:{i + 1:03}") for i in range(130)] + [("x:hub", f"y:{i}") for i in range(50)] + [("z:1", "z:1")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.id: x.trace for x in traces.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert traces.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_giant_trace_is_numbered_over_days(spark):
    at = [T0 + timedelta(hours=7 * i) for i in range(50)]
    facts = [(i, 1, f"e{i}", "worker", "k", "", "q", "t", "", "d1" if i % 2 else "", "j1", "", "", 0, 0, False, 0, None, None, None, at[i]) for i in range(50)] + [(99, 1, "e", "worker", "k", "", "q", "t", "", "", "", "", "", 0, 0, False, 0, None, None, None, T0)]
    got = traces.trace_facts(spark.createDataFrame(facts, schemas.EVENT)).orderBy("position").collect()
    assert [(x.trace, x.position, x.gap_us, x.seq) for x in got] == [("d:d1", i + 1, None if i == 0 else 7 * 3600 * 10**6, i) for i in range(50)]


def test_merged_sketches_are_close(spark):
    """40,000 skewed durations in 24 stretches: the rank of each estimate is within the bound."""
    e = spark.range(40_000).select(F.lit("q").alias("queue"), F.lit("t").alias("job_type"), F.lit("process_succeeded").alias("kind"), F.pow(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1000, F.lit(3)).cast("long").alias("duration_ns"), F.timestamp_seconds(F.col("id") % 86_400).alias("time"))
    kept = stats.duration_sketches(e)
    assert kept.count() == 12 and kept.agg(F.max(F.length("sketch"))).first()[0] < 8000
    off = stats.rank_errors(e, stats.merged_quantiles(kept, ["queue"]), ["queue"]).first()
    assert off.n == 40_000 and max(off.e50, off.e95, off.e99) < 0.035
    assert stats.merged_quantiles(kept, ["queue"], since=3600, until=7200).first().n == 3600
