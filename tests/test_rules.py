"""Small literal cases of the rules, and properties over random logs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators import gauges, history, jobtable, scan, stats, unique, workflow

T0 = datetime(2024, 1, 1)
# Fixed value: what the golden unique keys are salted with.
PREFIX = "queue:unique:v1"
KINDS = ["enqueue_accepted", "process_started", "process_succeeded", "process_failed", "process_retried", "settlement_failed", "queue_paused", "queue_resumed"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("one"))
    return row.select(column.alias("x")).first()["x"]


def log(spark, rows):
    """rows of (kind, queue, job_key, job_id, attempt, scheduled, duration, settlement) at one second each."""
    data = [(i, f"evt_{i}", "", k, "db", q, "t", key, "d", job, a, 2, s, d, None, None, st, T0 + timedelta(seconds=i)) for i, (k, q, key, job, a, s, d, st) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, event_id string, layer string, kind string, driver string, queue string, job_type string, job_key string, dispatch_id string, job_id string, attempt int, max_retry int, scheduled boolean, duration_ns long, error string, error_class string, settlement_id string, time timestamp")


def fold(rows):
    """The collector's rules, one event at a time."""
    out = {}
    for i, (kind, queue, key, job, attempt, scheduled, duration, settlement) in enumerate(rows):
        q = out.setdefault(queue or "default", dict(processed=0, failed=0, retry=0, paused=0, pending=0, scheduled=0, active=0, wait=0, waits=0, run=0, runs=0, fifo={}, open=set(), by_key={}))
        if kind == "enqueue_accepted":
            q["pending"] += 1
            q["scheduled"] += scheduled
            if key:
                q["fifo"].setdefault(key, []).append(i)
        elif kind == "process_started":
            q["pending"] = max(0, q["pending"] - 1)
            if scheduled:
                q["scheduled"] = max(0, q["scheduled"] - 1)
            if settlement:
                q["open"].add(settlement)
            else:
                k = (job, attempt) if job else None
                q["by_key"][k] = q["by_key"].get(k, 0) + 1
            if key and q["fifo"].get(key):
                at = q["fifo"][key].pop(0)
                if i > at:
                    q["wait"] += (i - at) * 10**9
                    q["waits"] += 1
        elif kind in ("process_succeeded", "process_failed", "settlement_failed"):
            if settlement:
                q["open"].discard(settlement)
            elif kind != "settlement_failed":
                k = (job, attempt) if job else None
                q["by_key"][k] = max(0, q["by_key"].get(k, 0) - 1)
            if kind != "settlement_failed":
                q["processed" if kind == "process_succeeded" else "failed"] += 1
                q["run"] += duration
                q["runs"] += 1
        elif kind == "process_retried":
            q["retry"] += 1
        else:
            q["paused"] = int(kind == "queue_paused")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_equals_fold(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(KINDS), r.choice(["a", "b"]), r.choice(["", "k1", "k2"]), r.choice(["", "j1", "j2"]), r.randrange(2), r.random() < 0.4, r.randrange(1000), r.choice([None, None, "s1", "s2"])) for _ in range(400)]
    got = {x["queue"]: x for x in stats.stats_snapshot(log(spark, rows).repartition(3)).collect()}
    want = fold(rows)
    assert set(got) == set(want)
    for queue, q in want.items():
        x = got[queue]
        assert (x.processed, x.failed, x.retry, x.paused, x.pending, x.scheduled) == tuple(q[c] for c in ("processed", "failed", "retry", "paused", "pending", "scheduled"))
        assert x.active == len(q["open"]) + sum(q["by_key"].values())
        assert x.avg_wait_ns == (q["wait"] // q["waits"] if q["waits"] else 0)
        assert x.avg_run_ns == (q["run"] // q["runs"] if q["runs"] else 0)


def test_empty_log(spark):
    assert stats.stats_snapshot(log(spark, [])).count() == 0


def test_gauge_over_bucket_borders(spark):
    r = random.Random(5)
    deltas = [r.choice([1, -1, -1]) for _ in range(300)]
    data = [(i, T0 + timedelta(seconds=i * 61), d) for i, d in enumerate(deltas)]
    df = spark.createDataFrame(data, "seq long, time timestamp, d int").withColumn("k", F.lit("x"))
    got = [x.gauge for x in gauges.floored_gauge(df, ["k"], F.col("d")).orderBy("seq").collect()]
    level, want = 0, []
    for d in deltas:
        level = max(0, level + d)
        want.append(level)
    assert got == want
    assert gauges.final_gauges(df, ["k"], g=F.col("d")).first()["g"] == want[-1]


def test_settlement_without_identity_changes_nothing(spark):
    rows = [("process_started", "q", "", "j", 0, False, 0, None), ("settlement_failed", "q", "", "j", 0, False, 0, None)]
    assert gauges.active_gauge(log(spark, rows)).first()["active"] == 1


def test_late_settlement_keeps_the_new_execution_open(spark):
    rows = [("process_started", "q", "", "j", 0, False, 0, "old"), ("process_failed", "q", "", "j", 0, False, 1, "old"), ("process_started", "q", "", "j", 0, False, 0, "new"), ("settlement_failed", "q", "", "j", 0, False, 0, None)]
    assert gauges.active_gauge(log(spark, rows)).first()["active"] == 1
    rows.append(("process_succeeded", "q", "", "j", 0, False, 1, "new"))
    assert gauges.active_gauge(log(spark, rows)).first()["active"] == 0


def test_unique_keys(spark):
    key = scalar.unique_key(F.col("q"), F.col("t"), F.col("p"), PREFIX)
    assert one(spark, key, q="a", t="b:c", p="x") != one(spark, key, q="a:b", t="c", p="x")
    empty = {one(spark, key, q="q", t="t", p=p) for p in ("", "null")} | {one(spark, scalar.unique_key(F.lit("q"), F.lit("t"), F.lit(None).cast("string"), PREFIX))}
    assert len(empty) == 1 and all(k.startswith("v1:") and len(k) == 67 for k in empty)


@pytest.mark.parametrize("attempt, retries, failed, cls, want", [(0, 0, False, None, "succeeded"), (0, 3, True, "uncommitted", "redeliver"), (3, 3, True, "uncommitted", "redeliver"), (0, 3, True, "permanent", "failed"), (3, 3, True, None, "failed"), (0, 3, True, None, "retry"), (0, 0, True, None, "failed")])
def test_classify(spark, attempt, retries, failed, cls, want):
    assert one(spark, scalar.classify_attempt(F.lit(attempt), F.lit(retries), F.lit(failed), F.lit(cls).cast("string"))) == want


@pytest.mark.parametrize("default, name, want", [("default", "", "default"), ("default", "emails", "emails"), ("app_default", "emails", "app_emails"), ("app_default", "app_emails", "app_emails"), ("default", " with-spaces ", "with-spaces"), ("default", "日本語", "日本語"), ("", "", "default")])
def test_physical_queue(spark, default, name, want):
    assert one(spark, scalar.physical_queue(F.lit(default), F.lit(name))) == want


@pytest.mark.parametrize("payload, decoded, job_type", [
    ('{"schema_version":1,"dispatch_id":"d","job":{"type":"real","payload":"eA=="}}', True, "real"), ('{"schema_version":2,"job":{"type":"real"}}', False, "bus:job"),
    ("not json", False, "bus:job"), ('{"schema_version":1,"job":{"type":"real","payload":"*"}}', False, "bus:job"), ('{"schema_version":1,"dispatch_id":"d","job":{"type":""}}', True, "bus:job"), ("", False, "bus:job"),
])
def test_envelope(spark, payload, decoded, job_type):
    got = one(spark, scalar.resolve_delivery(F.lit("bus:job"), F.lit(payload)))
    assert (got["decoded"], got["job_type"]) == (decoded, job_type)


def requests(spark, rows):
    data = [(i, T0 + timedelta(milliseconds=t), "q", "t", p, ttl) for i, (t, p, ttl) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, time timestamp, queue string, job_type string, payload string, unique_ttl_ms long")


def test_gate(spark):
    rows = [(0, "a", 100), (50, "a", 500), (100, "a", 10), (105, "a", 0), (109, "a", 1), (110, "a", 5), (0, "b", 100)]
    got = {x.seq: x.accepted for x in unique.unique_gate(requests(spark, rows), PREFIX).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_gate_is_the_rule_at_random(spark):
    r = random.Random(3)
    rows = sorted((r.randrange(5000), r.choice("ab"), r.choice([0, 30, 200])) for _ in range(500))
    got = [x.accepted for x in unique.unique_gate(requests(spark, rows).repartition(5), PREFIX).orderBy("seq").collect()]
    free, want = {}, []
    for t, p, ttl in rows:
        ok = ttl <= 0 or t >= free.get(p, 0)
        if ok and ttl > 0:
            free[p] = t + ttl
        want.append(ok)
    assert got == want


def test_dual_gate_honours_stored_locks(spark):
    rows = requests(spark, [(0, "a", 100), (60, "a", 100)])
    key = rows.select(scalar.legacy_unique_key(F.col("queue"), F.col("job_type"), F.col("payload")).alias("k")).first()["k"]
    start = rows.selectExpr("unix_millis(min(time)) t").first()["t"]
    locks = spark.createDataFrame([(key, start + 50)], "lock_key string, expires_at long")
    out, alive = unique.unique_gate_dual(rows, locks, start + 100, PREFIX)
    assert [x.accepted for x in out.orderBy("seq").collect()] == [False, True]
    assert {x.expires_at for x in alive.collect()} == {start + 160}


def test_history_drops_equal_samples_close_by(spark):
    data = [("q", T0 + timedelta(seconds=s), i, p, 0) for i, (s, p) in enumerate([(0, 1), (10, 1), (29, 1), (30, 1), (40, 2), (45, 2), (46, 1)])]
    df = spark.createDataFrame(data, "queue string, at timestamp, seq long, processed long, failed long")
    as_of = df.selectExpr("unix_millis(max(at)) t").first()["t"]
    got = sorted((x.at_ms - as_of) // 1000 + 46 for x in history.history(df, "no such window", as_of).collect())
    assert got == [0, 30, 40, 46]


def test_history_keeps_all_samples_of_its_days(spark):
    df = spark.range(30_100).select(F.lit("q").alias("queue"), F.timestamp_millis(F.col("id") * 100).alias("at"), F.col("id").alias("seq"), F.col("id").alias("processed"), F.lit(0).cast("long").alias("failed"))
    assert history.history(df, "hour", 3_009_900).count() == 30_100


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, queue_name string, job_type string, state string, attempt int, max_retry int, available_at long, timeout_seconds long, processing_started_at long, processing_token string, backoff_millis long, last_error string, updated_at long")


def test_list_defaults(spark):
    table = jobs(spark, [(i, "default", "t", "pending", 0, 1, 0, None, None, None, 0, None, 0) for i in range(600)])
    page, total = jobtable.list_jobs(table, 10)
    assert page.count() == 50 and total.first()["total"] == 600 and page.first()["id"] == 599
    assert jobtable.list_jobs(table, 10, page_size=1000)[0].count() == 500
    assert [x.id for x in jobtable.list_jobs(table, 10, after_id=3)[0].collect()] == [2, 1, 0]
    assert jobtable.list_jobs(table, 10, state="completed")[0].count() == 0
    with pytest.raises(ValueError):
        jobtable.list_jobs(table, 10, state="odd")


def test_settle_is_fenced_by_token(spark):
    table = jobs(spark, [(i, "q", "t", "processing", 0, 1, 0, None, 1, f"k{i}", 250, None, 0) for i in range(5)])
    outcomes = spark.createDataFrame([(0, "k0", False, None, None), (1, "old", False, None, None), (2, "k2", True, None, "e"), (3, "k3", True, "permanent", "e"), (4, "k4", True, "uncommitted", "e"), (2, "k2", False, None, None)], "id long, processing_token string, failed boolean, error_class string, error string")
    outcomes = outcomes.withColumn("seq", F.monotonically_increasing_id()).withColumn("time", F.lit(5))
    after, unmatched, archived = jobtable.settle_jobs(table, outcomes, 1000)
    got = {x.id: (x.state, x.attempt, x.available_at) for x in after.collect()}
    assert got == {1: ("processing", 0, 0), 2: ("pending", 1, 1250), 3: ("dead", 1, 0), 4: ("pending", 0, 1250)}
    assert sorted(x.id for x in unmatched.collect()) == [1, 2] and [x.id for x in archived.collect()] == [3]


def test_settle_takes_the_first_of_repeated_outcomes(spark):
    table = jobs(spark, [(1, "q", "t", "processing", 0, 3, 0, None, 1, "k", 0, None, 0)])
    outcomes = spark.createDataFrame([(1, "k", True, None, "b", 9, 2), (1, "k", True, None, "a", 9, 1), (1, "k", False, None, None, 10, 0)], "id long, processing_token string, failed boolean, error_class string, error string, time long, seq long")
    after, unmatched, _ = jobtable.settle_jobs(table, outcomes, 1000)
    assert [(x.state, x.attempt, x.last_error) for x in after.collect()] == [("pending", 1, "a")]
    assert sorted(x.seq for x in unmatched.collect()) == [0, 2]


def test_admin_commands_are_fenced_by_queue(spark):
    table = jobs(spark, [(i, "default" if i == 4 else "q", "t", "dead", 2, 3, 5, None, None, None, 0, "e", 0) for i in range(6)])
    commands = [(1, "retry", 0, "other"), (2, "retry", 1, "q"), (3, "retry", 1, "other"), (4, "retry", 2, "q"), (5, "cancel", 2, None), (6, "retry", 2, "other"), (7, "delete", 3, "other"), (8, "retry", 4, ""), (9, "delete", 5, "q")]
    got = {x.id: (x.state, x.available_at, x.last_error, x.updated_at) for x in jobtable.apply_admin(table, spark.createDataFrame(commands, "seq long, op string, id long, queue string"), 77).collect()}
    assert got == {0: ("dead", 5, "e", 0), 1: ("pending", 77, None, 77), 2: ("dead", 77, "canceled from queue admin", 77), 3: ("dead", 5, "e", 0), 4: ("pending", 77, None, 77)}


def test_recovery_replaces_empty_tokens(spark):
    rows = [(1, "q", "t", "processing", 0, 3, 0, None, 1, "", 0, None, 0), (2, "q", "t", "processing", 0, 3, 0, None, 1, None, 0, None, 0), (3, "q", "t", "processing", 0, 3, 0, -4, 1, "k", 0, None, 0)]
    got = {x.id: (x.state, x.processing_token, x.updated_at) for x in jobtable.recover_stale(jobs(spark, rows), 10**6, "mark").collect()}
    assert got == {1: ("pending", "mark", 10**6), 2: ("pending", "mark", 10**6), 3: ("pending", "k", 10**6)}
    after, claimed = jobtable.recover_and_claim(jobs(spark, rows), 10**6, 2, "mark")
    assert sorted(x.id for x in claimed.collect()) == [1, 2] and {x.id: x.state for x in after.collect()} == {1: "processing", 2: "processing", 3: "pending"}


def test_invalid_requests_claim_nothing(spark):
    rows = [(1, T0, "q", "t", b"p", -5, 0, 0, 60_000, 0, False), (2, T0, "q", "t", b"p", 5, 0, 0, 60_000, 0, True), (3, T0, "q", "t", b"p", 5, 0, 0, 60_000, 0, False), (4, T0, "q", "t", b"p", 5, 0, 9, 60_000, 0, False)]
    d = spark.createDataFrame(rows, "seq long, time timestamp, queue string, job_type string, payload binary, timeout_ms long, backoff_ms long, delay_ms long, unique_ttl_ms long, max_retry int, canceled boolean")
    got = [(x.kind, x.reason, x.scheduled) for x in jobtable.admission_events(d, "p").orderBy("seq").collect()]
    assert got == [("enqueue_rejected", "negative timeout", False), ("enqueue_canceled", None, False), ("enqueue_accepted", None, False), ("enqueue_duplicate", None, True)]


def batch(spark, allow, outcomes, members=("j1", "j2", "j3"), cancelled=None):
    b = spark.createDataFrame([("b", allow, T0)], "batch_id string, allow_failed boolean, created_at timestamp")
    m = spark.createDataFrame([("b", j) for j in members], "batch_id string, job_id string")
    o = spark.createDataFrame([("b", j, (T0 + timedelta(seconds=i), i, 0, 0, 0), bad) for i, (j, bad) in enumerate(outcomes)], "batch_id string, job_id string, place struct<time:timestamp,a:long,b:long,c:long,d:long>, failed boolean")
    c = spark.createDataFrame([("b", T0 + timedelta(seconds=cancelled))] if cancelled is not None else [], "batch_id string, cancelled_at timestamp")
    owner = [x.job_id for x in workflow.batch_terminal_owner(b, m, o, c).collect()]
    return workflow.batch_state(b, m, o, c).first(), owner


def test_batches(spark):
    s, owner = batch(spark, False, [("j1", False), ("j2", True)])
    assert (s.pending, s.completed, s.cancelled, s.failed) == (1, True, True, 1) and owner == ["j2"]
    s, owner = batch(spark, True, [("j1", True), ("j2", False), ("j3", False), ("j3", True), ("zz", True)])
    assert (s.completed, s.cancelled, s.failed, s.processed) == (True, False, 1, 3) and owner == ["j3"]
    s, owner = batch(spark, True, [("j1", False)], cancelled=0)
    assert s.completed and s.cancelled and s.processed == 1 and owner == []


def test_chain_fold_and_dispositions(spark):
    chains = spark.createDataFrame([("c", 3), ("none", 2)], "chain_id string, n_nodes int")
    nodes = [(0, False), (0, False), (0, True), (2, False), (1, False), (5, False), (2, True), (2, True), (2, False)]
    o = spark.createDataFrame([("c", n, (T0 + timedelta(seconds=i), 0, 0, 0, 0), bad) for i, (n, bad) in enumerate(nodes)], "chain_id string, node int, place struct<time:timestamp,a:long,b:long,c:long,d:long>, failed boolean")
    s = {x.chain_id: x for x in workflow.chain_state(chains, o).collect()}
    assert (s["c"].next_index, s["c"].completed, s["c"].failed, s["c"].acted, s["c"].replayed, s["c"].early, s["c"].unknown) == (2, False, True, 3, 4, 1, 1)
    assert (s["none"].next_index, s["none"].completed) == (0, False)
    got = [x.disposition for x in workflow.chain_outcome_disposition(chains, o).orderBy("time").collect()]
    assert got == ["claimed", "replay_owned", "replay_lost", "rejected_early", "claimed", "unknown_node", "claimed", "replay_owned", "replay_lost"]


def test_chains_can_be_given_up(spark):
    """The first stop of a chain ends it unless it has ended; later outcomes do nothing. The cause and the last change are kept."""
    at = lambda s: T0 + timedelta(seconds=s)
    chains = spark.createDataFrame([(c, 2, T0) for c in ("done", "bad", "stopped", "early", "live")], "chain_id string, n_nodes int, created_at timestamp")
    told = [("done", 0, 1, False), ("done", 1, 2, False), ("bad", 0, 3, True), ("stopped", 0, 4, False), ("stopped", 1, 10, False), ("early", 0, 5, False), ("live", 0, 6, False)]
    outcomes = spark.createDataFrame([(c, n, (at(s), 0, 0, 0, 0), bad, f"why {c}" if bad else None) for c, n, s, bad in told], "chain_id string, node int, place struct<time:timestamp,a:long,b:long,c:long,d:long>, failed boolean, error string")
    stops = spark.createDataFrame([("done", at(9), "x"), ("bad", at(9), "x"), ("stopped", at(10), "first"), ("stopped", at(11), "second"), ("early", at(5), "x")], "chain_id string, time timestamp, error string")
    got = {x.chain_id: (x.next_index, x.completed, x.failed, x.failure, x.updated_at) for x in workflow.chain_state(chains, outcomes, stops).collect()}
    assert got == {"done": (2, True, False, None, at(2)), "bad": (0, False, True, "why bad", at(3)), "stopped": (1, False, True, "first", at(10)), "early": (0, False, True, "x", at(5)), "live": (1, False, False, None, at(6))}


def test_prune_keeps_what_is_live_or_recent(spark):
    at = {"old": T0, "new": T0 + timedelta(days=2)}
    rows = lambda key: spark.createDataFrame([(i, ended, at[age]) for i, (ended, age) in enumerate([(True, "old"), (False, "old"), (True, "new")])], f"{key} long, ended boolean, updated_at timestamp")
    hang = lambda key: spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (0, "c")], f"{key} long, member string")
    receipts = spark.createDataFrame([("chain", "0"), ("chain", "1"), ("batch", "0"), ("batch", "2")], "workflow_kind string, workflow_id string")
    callbacks = spark.createDataFrame([("k1", at["old"]), ("k2", at["new"])], "callback_key string, created_at timestamp")
    tables = {"chains": rows("chain_id"), "nodes": hang("chain_id"), "batches": rows("batch_id"), "members": hang("batch_id"), "receipts": receipts, "callbacks": callbacks}
    kept = {k: sorted(map(tuple, t.collect())) for k, t in workflow.prune(tables, F.lit(T0 + timedelta(days=1))).items()}
    assert [r[0] for r in kept["chains"]] == [r[0] for r in kept["batches"]] == [1, 2]
    assert [r[0] for r in kept["nodes"]] == [r[0] for r in kept["members"]] == [1, 2]
    assert kept["receipts"] == [("batch", "2"), ("chain", "1")] and [r[0] for r in kept["callbacks"]] == ["k2"]


def in_batches(step, columns, keys, cuts):
    """What a scan step gives over some batches, as the scan calls it."""
    out, last, carry = [], None, None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        k = keys[a:b]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        got, carry = step({c: v[a:b] for c, v in columns.items()}, starts, carry if k[0] == last else None)
        last = k[-1]
        out.append(got[0])
    return np.concatenate(out).tolist()


@pytest.mark.parametrize("seed", range(30))
def test_scan_steps_equal_loops(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    keys = np.sort(r.integers(0, 6, n))
    t = np.concatenate([np.sort(r.integers(0, 50, (keys == k).sum())) for k in np.unique(keys)])
    cuts = [0, *sorted(r.integers(0, n + 1, 3).tolist()), n]
    kept, last = [], {}
    for k, x in zip(keys.tolist(), t.tolist(), strict=True):
        ok = k not in last or x >= last[k] + 5
        if ok:
            last[k] = x
        kept.append(ok)
    columns = {"t": t}
    assert in_batches(scan.keep_spaced("t", 5), columns, keys, cuts) == kept


@pytest.mark.parametrize("seed", range(30))
def test_dispositions_equal_a_loop(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 80))
    keys = np.sort(r.integers(0, 5, n))
    node, bad, nodes = r.integers(-1, 5, n), r.random(n) < 0.2, 2 + keys % 3
    want, state = [], {}
    for k, x, b, m in zip(keys.tolist(), node.tolist(), bad.tolist(), nodes.tolist(), strict=True):
        at, ended = state.get(k, (0, False))
        if x < 0 or x >= m:
            want.append("unknown_node")
        elif x == at and not ended:
            want.append("claimed")
            state[k] = (at + (not b), b)
        elif x <= at:
            want.append("replay_owned" if b == (x == at) else "replay_lost")
        else:
            want.append("rejected_early")
    cuts = [0, *sorted(r.integers(0, n + 1, 3).tolist()), n]
    assert in_batches(workflow._dispose, {"node": node, "failed": bad, "n_nodes": nodes}, keys, cuts) == want


@pytest.mark.parametrize("name, most", [("transition_receipts", 8), ("audit_receipts", 9), ("decide_commits", 9)])
def test_receipts_meet_in_few_shuffles(spark, sf_dir, name, most):
    from jobledger.jobs import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= most


def test_receipts_beside_their_workflows_are_judged_alike(spark):
    rows = [(1, "1", T0, 1, False), (1, "2", T0, 2, True), (2, "1", T0, 3, True), (3, "1", T0, 4, False)]
    o = spark.createDataFrame(rows, "batch_id long, job_id string, time timestamp, a long, failed boolean").select("batch_id", "job_id", F.struct("time", "a", *[F.lit(0).cast("long").alias(x) for x in "bcd"]).alias("place"), "failed")
    m = spark.createDataFrame([(1, "1"), (1, "2"), (2, "1"), (2, "2"), (3, "1"), (3, "2")], "batch_id long, job_id string")
    b = spark.createDataFrame([(1, True, T0, "x"), (2, False, T0, "y"), (3, True, T0, "z")], "batch_id long, allow_failed boolean, created_at timestamp, dispatch_id string")
    c = spark.createDataFrame([], "batch_id long, cancelled_at timestamp")
    spoil = lambda r: r.withColumn("outcome", F.when(F.col("member_id") == "", "succeeded").otherwise(F.col("outcome"))).where("not (workflow_id = '1' and member_id = '2')")
    beside = workflow.judged(spoil(workflow.batch_receipts(b, m, o, c, standing=True)), ["id"])
    states = workflow.batch_state(b, m, o, c).join(b.select("batch_id", "dispatch_id", "created_at"), "batch_id")
    parents = states.select(F.lit("batch").alias("workflow_kind"), F.col("batch_id").cast("string").alias("workflow_id"), "dispatch_id", F.unix_micros("created_at").alias("created_us"), "completed", "cancelled")
    apart = workflow.audit_receipts(spoil(workflow.batch_receipts(b, m, o, c)), parents)
    got = sorted(map(tuple, beside.collect()))
    assert got == sorted(map(tuple, apart.collect())) == [("batch", "1", "", "no single member receipt"), ("batch", "2", "", "outcome of another")]
