"""Keys that hold most of all rows, cut into blocks: the same rows are taken as by a loop, and no key is one task."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobledger.operators import audits, unique
from jobledger.operators.jumps import FREE, admitted, joined_table, jump, jump_tables


def by_loop(rows):
    """(key, t, seq, until) in any order -> seqs that are taken."""
    free, taken = {}, set()
    for key, t, seq, until in sorted(rows, key=lambda r: (r[1], r[2])):
        if t >= free.get(key, FREE):
            free[key] = until
            taken.add(seq)
    return taken


@pytest.mark.parametrize("seed", range(40))
def test_tables_say_what_a_loop_does(seed):
    r = random.Random(seed)
    t = np.array(sorted(r.randrange(60) for _ in range(r.randrange(1, 50))))
    until = t + np.array([r.choice([0, 1, 3, 9, 40]) for _ in t])
    cuts = sorted({0, *(r.randrange(len(t)) for _ in range(3))})
    tables = list(zip(*jump_tables(t, until, np.array(cuts)), strict=True))
    assert sum(len(e) for e, _ in tables) <= len(t)
    whole = joined_table(tables)
    for barred in [FREE, *range(-1, 110)]:
        now = barred
        for x, u in zip(t.tolist(), until.tolist(), strict=True):
            now = u if x >= now else now
        assert jump(*whole, np.int64(barred)) == now
        step = np.int64(barred)
        for table in tables:
            step = jump(*table, step)
        assert step == now


@pytest.mark.parametrize(("size", "fan"), [(10, 2), (25, 3), (1000, 256)])
def test_hot_key_equals_a_loop(spark, size, fan):
    r = random.Random(size)
    rows = []
    for seq in range(900):
        t = r.randrange(2000)
        rows.append((None if seq % 50 == 0 else "hot" if seq % 10 else r.choice("abc"), t, seq, t + r.choice([0, 5, 30, 700])))
    df = spark.createDataFrame(rows, "key string, t long, seq long, until long").repartition(5)
    got = admitted(df, ["key"], "t", "until", ["seq"], size, fan)
    assert got.columns == ["key", "t", "seq", "until", "admitted"] and got.count() == len(rows)
    assert {x.seq for x in got.where("admitted").collect()} == by_loop(rows)


def test_a_hot_key_is_many_tasks(spark):
    """One key has nine tenths of the requests: they are marked in several tasks, none of which has most of them."""
    at, r = datetime(2024, 1, 1), random.Random(1)
    rows = [(i, at + timedelta(minutes=r.randrange(60 * 24 * 30)), "q", "t", (b"hot" if i % 10 else str(i).encode()), r.choice([0, 1, 5, 48]) * 3_600_000) for i in range(4000)]
    d = spark.createDataFrame(rows, "seq long, time timestamp, queue string, job_type string, payload binary, unique_ttl_ms long")
    got = unique.unique_gate(d, "p")
    ms = {seq: int((t - at).total_seconds() * 1000) for seq, t, *_ in rows}
    want = by_loop([(p, ms[i], i, ms[i] + ttl) for i, _, _, _, p, ttl in rows if ttl > 0]) | {i for i, *_, ttl in rows if ttl <= 0}
    assert {x.seq for x in got.where("accepted").collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else the few rows of this test go to one task
    spread = [x["count"] for x in got.where("payload = cast('hot' as binary) and ttl > 0").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 3 and max(spread) < 0.6 * sum(spread)


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, t long, seq long, until long")
    assert admitted(df, ["key"], "t", "until", ["seq"], 10).count() == 0


def test_concurrency_equals_pairs(spark):
    r = random.Random(5)
    rows = [("k" if i % 9 else "l", i, s := r.randrange(300), None if i == 7 else s + r.choice([0, 1, 10, 90])) for i in range(120)]
    got = {x.job_key: (x.runs, x.overlapping, x.peak) for x in audits.concurrency(spark.createDataFrame(rows, "job_key string, seq long, start long, finish long"), 50).collect()}
    for key in "kl":
        own = [(s, f if f is not None else 2**62) for k, _, s, f in rows if k == key]
        live = [x for x in own if x[1] > x[0]]
        hit = sum(any(a < d and c < b for j, (c, d) in enumerate(live) if j != i) for i, (a, b) in enumerate(live))
        assert got[key] == (len(own), hit, max(sum(a <= x < b for a, b in live) for x in range(400)))
