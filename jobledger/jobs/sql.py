"""DuckDB SQL of the registered queries, over views of the data folder's tables.

Each text starts from the same derived rows as the Spark query (see ``jobledger.sources.fixtures``).
"""

from __future__ import annotations

#: Events: e0 as derived, e1 normalised, e each fact once.
EVENTS = r"""
k0 AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events),
k1 AS (SELECT *, CASE event_type WHEN 'signup' THEN 'enqueue_accepted' WHEN 'click' THEN 'process_started' WHEN 'purchase' THEN 'process_succeeded' WHEN 'error' THEN 'process_failed'
  ELSE ['process_retried', 'process_archived', 'queue_paused', 'queue_resumed', 'enqueue_duplicate', 'enqueue_rejected', 'enqueue_canceled', 'republish_failed', 'settlement_failed', 'process_recovered', 'dispatch_started', 'job_started'][k % 12 + 1] END AS kind,
  'type-' || (user_id % 7) AS jt, CASE WHEN k % 10 = 0 THEN '' ELSE '{"u":' || (user_id % 40) || '}' END AS payload FROM k0),
e0 AS (SELECT event_id AS seq, 'evt_' || CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS event_id, kind, 'database' AS driver,
  CASE WHEN kind = 'process_recovered' THEN '' ELSE ['', 'emails', 'critical', 'reports', 'app_default'][user_id % 5 + 1] END AS queue, jt AS job_type, payload,
  CASE WHEN k % 17 = 0 THEN '' ELSE sha1(jt || ':' || payload) END AS job_key, 'dsp_' || user_id AS dispatch_id, CASE WHEN k % 11 = 0 THEN '' ELSE 'job_' || user_id END AS job_id,
  k % 3 AS attempt, 2 AS max_retry, k % 4 = 0 AS scheduled,
  CASE WHEN kind IN ('process_succeeded', 'process_failed') THEN CAST(round(value * 100) AS BIGINT) * 10000 ELSE 0 END AS duration_ns,
  CASE WHEN kind = 'process_failed' THEN 'boom-' || (k % 5) END AS error, CASE WHEN kind = 'process_failed' AND k % 13 = 0 THEN 'permanent' WHEN kind = 'process_failed' AND k % 13 = 1 THEN 'uncommitted' END AS error_class,
  CASE WHEN k % 2 = 1 THEN 'gen_' || user_id || '_' || (k % 3) END AS settlement_id, ts AS time, epoch_us(ts) AS us FROM k1),
e1 AS (SELECT * REPLACE (CASE WHEN queue = '' THEN 'default' ELSE queue END AS queue), 1 AS schema_version,
  CASE WHEN kind IN ('process_started', 'process_succeeded', 'process_failed', 'process_retried', 'process_archived', 'process_recovered', 'republish_failed', 'settlement_failed') THEN 'worker'
    WHEN kind IN ('job_started') THEN 'workflow' ELSE 'queue' END AS layer FROM e0),
e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time, seq) AS rn FROM e1) WHERE rn = 1)
"""

REQUESTS = r"""
k0 AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events),
d0 AS (SELECT event_id AS seq, ts AS time, epoch_us(ts) // 1000 AS t, ['', 'emails', 'critical', 'reports', 'app_default'][user_id % 5 + 1] AS queue, CASE WHEN event_id % 97 = 0 THEN '' ELSE 'type-' || (user_id % 7) END AS job_type,
  CASE WHEN k % 10 = 0 THEN '' ELSE '{"u":' || (user_id % 40) || '}' END AS payload, CASE WHEN k % 4 <> 0 THEN k::BIGINT * 700 END AS timeout_ms, (k % 3 * 500)::BIGINT AS backoff_ms,
  CASE WHEN event_id % 89 = 0 THEN -1 ELSE (k % 3) * 60000 END::BIGINT AS delay_ms, (k % 5)::BIGINT * 21600000 AS ttl, CASE WHEN k % 6 <> 0 THEN k % 4 END AS max_retry FROM k0),
d AS (SELECT *, CASE WHEN queue = '' THEN 'default' ELSE queue END AS q,
  CASE WHEN job_type = '' THEN 'missing job type' WHEN timeout_ms < 0 THEN 'negative timeout' WHEN max_retry < 0 THEN 'negative retry' WHEN backoff_ms < 0 THEN 'negative backoff' WHEN delay_ms < 0 THEN 'negative delay' WHEN ttl < 0 THEN 'negative unique ttl' END AS reason FROM d0)
"""

JOBS = r"""
j AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'emails' WHEN '3-MEDIUM' THEN 'default' WHEN '4-NOT SPECIFIED' THEN 'reports' ELSE 'low' END AS queue_name,
  'type-' || (o_custkey % 10) AS job_type, '{"c":' || o_custkey || '}' AS payload, CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 5) * 86400 END AS timeout_seconds, 2 AS max_retry, (o_orderkey % 4) * 250 AS backoff_millis, (o_orderkey % 3)::INT AS attempt,
  epoch_ms(o_orderdate) AS available_at, CASE WHEN o_orderstatus = 'P' THEN epoch_ms(o_orderdate) + 1000 END AS processing_started_at, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 9 = 4 THEN '' WHEN o_orderstatus = 'P' AND o_orderkey % 9 <> 0 THEN 'tok_' || o_orderkey END AS processing_token,
  CASE WHEN o_orderstatus = 'F' THEN 'boom-' || (o_orderkey % 5) END AS last_error, CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'dead' ELSE 'pending' END AS state, epoch_ms(o_orderdate) AS updated_at, o_custkey AS cust FROM orders),
js AS (SELECT *, CASE WHEN state = 'processing' THEN 'active' WHEN state = 'dead' THEN 'archived' WHEN attempt > 0 THEN 'retry' WHEN available_at > 896659200000 THEN 'scheduled' ELSE 'pending' END AS derived FROM j),
o0 AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'old' ELSE processing_token END AS o_token, cust % 4 <> 0 AS f, 896659200000 - cust % 100 AS said FROM j WHERE state = 'processing' AND id % 2 = 0),
o AS (SELECT id, o_token, f AS failed, [NULL, 'plain', 'permanent', 'uncommitted'][cust % 4 + 1] AS error_class, CASE WHEN f THEN 'err-' || id END AS error, said AS time, id * 2 AS seq FROM o0
  UNION ALL SELECT id, o_token, NOT f, NULL, CASE WHEN NOT f THEN 'again-' || id END, said + [-1, 0, 1][id % 3 + cust % 3 + 1], id * 2 + 1 FROM o0 WHERE id % 3 = 0),
s1 AS (SELECT o.* FROM o JOIN j ON j.id = o.id AND j.processing_token = o.o_token AND j.state = 'processing' QUALIFY row_number() OVER (PARTITION BY o.id, o.o_token ORDER BY o.time, o.seq) = 1)
"""

BATCHES = r"""
b AS (SELECT o_orderkey AS batch_id, o_orderstatus = 'O' AS allow_failed, o_orderdate AS created_at, o_custkey AS cust FROM orders),
m AS (SELECT DISTINCT l_orderkey AS batch_id, l_linenumber::VARCHAR AS job_id FROM lineitem JOIN b ON b.batch_id = l_orderkey WHERE NOT (l_linenumber = 7 AND cust % 5 = 0) UNION ALL SELECT batch_id, 'extra' FROM b WHERE cust % 4 = 0),
x AS (SELECT l_orderkey AS batch_id, l_linenumber::VARCHAR AS job_id, l_shipdate AS time, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, CAST(round(l_extendedprice * 100) AS BIGINT) AS d, l_returnflag = 'R' AS failed FROM lineitem),
c AS (SELECT batch_id, created_at + INTERVAL 60 DAY AS cancelled_at FROM b WHERE cust % 11 = 0),
w AS (SELECT * EXCLUDE (rn) FROM (SELECT x.*, row_number() OVER (PARTITION BY batch_id, job_id ORDER BY time, a, b, c, d, failed) AS rn FROM x SEMI JOIN m USING (batch_id, job_id)) WHERE rn = 1),
t AS (SELECT batch_id, count(DISTINCT job_id) AS total FROM m GROUP BY batch_id),
bs0 AS (SELECT b.batch_id, b.allow_failed, coalesce(t.total, 0)::BIGINT AS total, coalesce(p.n, 0)::BIGINT AS processed, coalesce(p.f, 0)::BIGINT AS failed, c.cancelled_at, c.batch_id IS NOT NULL AS asked
  FROM b LEFT JOIN t USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM w GROUP BY batch_id) p USING (batch_id) LEFT JOIN c USING (batch_id)),
bs1 AS (SELECT *, total - processed AS pending, asked OR (failed > 0 AND NOT allow_failed) AS cancelled FROM bs0),
bs AS (SELECT *, cancelled OR pending = 0 AS completed FROM bs1),
ow AS (SELECT * FROM (
  SELECT w.batch_id, w.job_id, w.time, row_number() OVER (PARTITION BY w.batch_id ORDER BY w.time, w.a, w.b, w.c, w.d) AS pos, w.failed, bs.allow_failed, bs.total, bs.cancelled_at FROM w JOIN bs USING (batch_id))
  WHERE (failed AND NOT allow_failed) OR pos = total QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY pos) = 1),
own AS (SELECT batch_id, job_id FROM ow WHERE cancelled_at IS NULL OR time < cancelled_at)
"""

CHAINS = r"""
ch AS (SELECT l_orderkey AS chain_id, max(l_linenumber) AS n_nodes, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1),
co AS (SELECT l_orderkey AS chain_id, l_linenumber - 1 AS node, l_returnflag = 'R' AND l_linestatus = 'F' AS failed, l_shipdate AS shipped, epoch_us(l_shipdate) || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) AS claim, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS i FROM lineitem),
f AS (
  SELECT ch.chain_id, ch.n_nodes, 0::BIGINT AS i, 0 AS nx, false AS ended, NULL::INT AS node, NULL::BOOLEAN AS failed, NULL::VARCHAR AS disposition FROM ch
  UNION ALL
  SELECT f.chain_id, f.n_nodes, co.i, CASE WHEN NOT f.ended AND co.node = f.nx AND NOT co.failed THEN f.nx + 1 ELSE f.nx END, f.ended OR (co.node = f.nx AND co.failed), co.node, co.failed,
    CASE WHEN co.node < 0 OR co.node >= f.n_nodes THEN 'unknown_node' WHEN co.node = f.nx AND NOT f.ended THEN 'claimed' WHEN co.node <= f.nx THEN CASE WHEN co.failed = (co.node = f.nx) THEN 'replay_owned' ELSE 'replay_lost' END ELSE 'rejected_early' END
  FROM f JOIN co ON co.chain_id = f.chain_id AND co.i = f.i + 1),
cs AS (SELECT chain_id, max_by(nx, i) AS next_index, max_by(nx, i) = any_value(n_nodes) AS completed, max_by(ended, i) AS failed, any_value(n_nodes) AS n_nodes,
  (count(*) FILTER (WHERE disposition = 'claimed'))::INT AS acted, (count(*) FILTER (WHERE disposition LIKE 'replay%'))::INT AS replayed, (count(*) FILTER (WHERE disposition = 'rejected_early'))::INT AS early, (count(*) FILTER (WHERE disposition = 'unknown_node'))::INT AS unknown
  FROM f GROUP BY chain_id),
nodes AS (SELECT chain_id, list_transform(range(1, n_nodes + 1), lambda i: {'node_id': 'n' || i, 'job_type': 'type-' || (i % 3), 'queue': CASE WHEN i % 2 = 0 THEN 'emails' ELSE '' END}) AS nodes, CASE WHEN chain_id % 2 = 0 THEN 'critical' ELSE 'reports' END AS queue FROM ch)
"""

#: Bucket-free forms of the gauges: running sum and running minimum over all of a key's rows.
GAUGE = r"""
SELECT {keys}, (sum(delta) - least(0, min(s)))::BIGINT AS {name} FROM (
  SELECT *, sum(delta) OVER (PARTITION BY {keys} ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS s FROM ({rows})) GROUP BY {keys}
"""
_PENDING = "SELECT *, CASE kind WHEN 'enqueue_accepted' THEN 1 WHEN 'process_started' THEN -1 END AS delta FROM e WHERE kind IN ('enqueue_accepted', 'process_started')"
PENDING = GAUGE.format(keys="queue", name="pending", rows=_PENDING)
SCHEDULED = GAUGE.format(keys="queue", name="scheduled", rows=_PENDING + " AND scheduled")
ACTIVE = (
    r"""SELECT queue, sum(open)::BIGINT AS active FROM (
  SELECT queue, (max_by(kind, (time, seq)) = 'process_started')::INT AS open FROM e WHERE settlement_id IS NOT NULL AND kind IN ('process_started', 'process_succeeded', 'process_failed', 'settlement_failed') GROUP BY queue, settlement_id
  UNION ALL SELECT queue, open FROM ("""
    + GAUGE.format(keys="queue, xd, xj, xa", name="open", rows="SELECT *, CASE WHEN job_id <> '' THEN dispatch_id ELSE '' END AS xd, job_id AS xj, CASE WHEN job_id <> '' THEN attempt ELSE -1 END AS xa, CASE kind WHEN 'process_started' THEN 1 ELSE -1 END AS delta FROM e WHERE settlement_id IS NULL AND kind IN ('process_started', 'process_succeeded', 'process_failed')")
    + ")) GROUP BY queue"
)
#: First in, first out: a start is matched if its key's gauge before it is above zero.
WAITS = r"""
g0 AS (SELECT queue, job_key, time, us, seq, kind, CASE kind WHEN 'enqueue_accepted' THEN 1 ELSE -1 END AS delta FROM e WHERE kind IN ('enqueue_accepted', 'process_started') AND job_key <> ''),
g1 AS (SELECT *, sum(delta) OVER w AS s FROM g0 WINDOW w AS (PARTITION BY queue, job_key ORDER BY time, seq ROWS UNBOUNDED PRECEDING)),
g2 AS (SELECT *, s - delta - least(0, coalesce(min(s) OVER (PARTITION BY queue, job_key ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY queue, job_key, kind ORDER BY time, seq) AS nth FROM g2 WHERE delta = 1 OR before > 0),
w AS (SELECT p.queue, p.job_key, p.nth, p.us AS enqueued, s.us AS started, s.time FROM g3 p JOIN g3 s USING (queue, job_key, nth) WHERE p.kind = 'enqueue_accepted' AND s.kind = 'process_started')
"""
_COUNT = "(count(*) FILTER (WHERE kind = '{0}'))::BIGINT AS {1}"
COUNTERS = "SELECT queue, " + ", ".join(_COUNT.format(f"process_{a}", b) for a, b in (("succeeded", "processed"), ("failed", "failed"), ("retried", "retry"), ("archived", "archived"))) + " FROM e GROUP BY queue"
RUN = "SELECT queue, (sum(duration_ns) // count(*))::BIGINT AS avg_run_ns FROM e WHERE kind IN ('process_succeeded', 'process_failed') GROUP BY queue"
WAIT = "SELECT queue, (sum((started - enqueued) * 1000) // count(*))::BIGINT AS avg_wait_ns, count(*) AS waits FROM w WHERE started > enqueued GROUP BY queue"
PAUSED = "SELECT queue, coalesce(max_by(kind, (time, seq)) FILTER (WHERE kind IN ('queue_paused', 'queue_resumed')) = 'queue_paused', false)::INT AS paused FROM e GROUP BY queue"
THROUGHPUT = "SELECT queue, " + ", ".join(f"(count(*) FILTER (WHERE kind = 'process_{k}' AND us >= (SELECT max(us) FROM e) - {s} * 1000000::BIGINT))::BIGINT AS {n}_{w}" for w, s in (("hour", 3600), ("day", 86400), ("week", 604800)) for k, n in (("succeeded", "processed"), ("failed", "failed"))) + " FROM e GROUP BY queue"
#: Windows of a day: pending at their end, successes in them, from each queue's first to its last.
WINDOWS = r"""
q0 AS (SELECT *, (us // 1000000) // 86400 * 86400 AS start FROM e),
q1 AS (SELECT queue, start, (count(*) FILTER (WHERE kind = 'process_succeeded'))::BIGINT AS succeeded FROM q0 GROUP BY ALL),
q2 AS (SELECT queue, unnest(range(min(start), max(start) + 1, 86400)) AS start FROM q1 GROUP BY queue),
q3 AS (SELECT *, sum(delta) OVER (PARTITION BY queue ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT queue, start, time, seq, CASE kind WHEN 'enqueue_accepted' THEN 1 ELSE -1 END AS delta FROM q0 WHERE kind IN ('enqueue_accepted', 'process_started'))),
q4 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY queue ORDER BY time, seq ROWS UNBOUNDED PRECEDING)) AS gauge FROM q3),
q5 AS (SELECT queue, start, max_by(gauge, (time, seq)) AS level FROM q4 GROUP BY ALL),
q AS (SELECT queue, start, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY queue ORDER BY start ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS pending, coalesce(succeeded, 0)::BIGINT AS succeeded FROM q2 LEFT JOIN q1 USING (queue, start) LEFT JOIN q5 USING (queue, start))
"""


def over(*parts: str) -> str:
    """``WITH`` the named parts, then the last one."""
    *ctes, query = parts
    return "WITH RECURSIVE " + ", ".join(c.strip() for c in ctes) + "\n" + query


def events(query: str, *more: str) -> str:
    return over(EVENTS, *more, query)
