"""Gauges that never go below zero, and what is read off them.

A gauge that adds +1 and -1 but ignores -1 at zero is S - min(0, M): S the running sum, M its running minimum.
(S, M) of a stretch of time combine as (S + S', min(M, S + M')), so a queue with most of the log is cut into time
buckets: windows run within (queue, bucket), and only the buckets' sums are put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["time", "seq"]


def time_bucket(seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds("time") / seconds)


def floored_gauge(df: DataFrame, keys: list[str], delta: Column, bucket: Column | None = None) -> DataFrame:
    """``df(keys, time, seq, ...)`` with ``gauge_before``, ``gauge`` and ``puts`` (increments so far) of the rows whose ``delta`` isn't 0.

    The floor at zero is applied over each key's rows in (time, seq) order. Increments so far less the gauge are the
    decrements that took effect so far, so the same pass numbers both sides of a first-in-first-out matching.
    """
    others = [c for c in df.columns if c not in keys]
    rows = df.withColumn("delta", delta.cast("long")).where("delta <> 0").withColumn("bucket", time_bucket() if bucket is None else bucket)
    # a key with its bucket is one value, equal to itself also where a part is null: windows, sums and the join below all stay where its rows are;
    # its hash goes first, so that sorting seldom compares more than a number
    rows = rows.select(F.xxhash64(*keys, "bucket").alias("h"), F.struct(*keys, "bucket").alias("g"), *others, "delta", F.greatest("delta", F.lit(0).cast("long")).alias("put"))
    inner = Window.partitionBy("h", "g").orderBy(*ORDER)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"s": F.sum("delta").over(upto), "e": F.sum("put").over(upto)})
    # before this row: the same with its delta taken out of sum and minimum
    rows = rows.withColumns({"m": F.min("s").over(upto), "prior": F.min("s").over(inner.rowsBetween(Window.unboundedPreceding, -1))})
    sums = rows.groupBy("h", "g").agg(F.sum("delta").alias("bs"), F.min("s").alias("bm"), F.sum("put").alias("be"))
    sums = sums.select("*", *[F.col(f"g.{k}").alias(f"g_{k}") for k in (*keys, "bucket")])
    before = Window.partitionBy(*[f"g_{k}" for k in keys]).orderBy("g_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"s0": F.coalesce(F.sum("bs").over(before), F.lit(0)), "e0": F.coalesce(F.sum("be").over(before), F.lit(0))})
    sums = sums.withColumn("m0", F.coalesce(F.min(F.col("s0") + F.col("bm")).over(before), F.lit(0)))
    met = rows.join(sums.select("h", "g", "s0", "m0", "e0"), ["h", "g"])
    total = F.col("s0") + F.col("s")
    now = total - F.least(F.lit(0), F.col("m0"), F.col("s0") + F.col("m"))
    was = (total - F.col("delta")) - F.least(F.lit(0), F.col("m0"), F.coalesce(F.col("s0") + F.col("prior"), F.lit(0)))
    return met.select(*[F.col(f"g.{c}").alias(c) if c in keys else F.col(c) for c in df.columns], "delta", F.col("g.bucket").alias("bucket"), now.alias("gauge"), was.alias("gauge_before"), (F.col("e0") + F.col("e")).alias("puts"))


#: Keys are dealt to so many classes by their hash; a key of more than so many rows isn't left to one window.
CLASSES, MANY = 65_536, 100_000


def by_size(df: DataFrame, keys: list[str], many: int = MANY) -> tuple[DataFrame, DataFrame | None]:
    """``df`` in two: rows of keys with at most ``many`` rows, for which a window each will do, and the others, if any.

    Rows are counted by class of key, which combines before the shuffle; only the numbers of classes with more are collected, one for
    ``many`` rows at most. A key of a full class goes with the others whatever its own size.
    """
    of = F.pmod(F.xxhash64(*keys), F.lit(CLASSES))
    full = [x[0] for x in df.groupBy(of.alias("c")).count().where(F.col("count") > many).select("c").collect()]
    return (df.where(~of.isin(full)), df.where(of.isin(full))) if full else (df, None)


def whole_gauge(df: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    """:func:`floored_gauge` for keys of few rows: one window a key, no buckets."""
    inner = Window.partitionBy(*keys).orderBy(*ORDER)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("delta", delta.cast("long")).where("delta <> 0")
    rows = rows.withColumns({"s": F.sum("delta").over(upto), "puts": F.sum(F.greatest("delta", F.lit(0).cast("long"))).over(upto)})
    rows = rows.withColumns({"m": F.min("s").over(upto), "prior": F.min("s").over(inner.rowsBetween(Window.unboundedPreceding, -1))})
    now, was = F.col("s") - F.least(F.lit(0), F.col("m")), F.col("s") - F.col("delta") - F.least(F.lit(0), F.coalesce(F.col("prior"), F.lit(0)))
    return rows.select(*df.columns, "delta", now.alias("gauge"), was.alias("gauge_before"), "puts")


def bucket_sums(df: DataFrame, keys: list[str], **deltas: Column) -> DataFrame:
    """Sum ``b_name`` and least running sum ``m_name`` of each delta in each time bucket. One pass for all of them."""
    some = F.lit(False)
    for d in deltas.values():
        some = some | (d != 0)
    rows = df.where(some).select(*keys, *ORDER, time_bucket().alias("bucket"), *[d.cast("long").alias(f"d_{n}") for n, d in deltas.items()])
    upto = Window.partitionBy(*keys, "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({f"s_{n}": F.sum(f"d_{n}").over(upto) for n in deltas})
    return sums.groupBy(*keys, "bucket").agg(*[x for n in deltas for x in (F.sum(f"d_{n}").alias(f"b_{n}"), F.min(f"s_{n}").alias(f"m_{n}"))])


def summed_gauges(df: DataFrame, keys: list[str], **deltas: Column) -> DataFrame:
    """keys, ``name_sum`` and ``name_low`` (least running sum, 0 at most) of each delta: what a stretch of time does to a gauge.

    A gauge at g goes to g + sum - min(0, g + low) over the stretch, so stretches can be folded one after the other.
    """
    sums = bucket_sums(df, keys, **deltas)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({f"low_{n}": F.coalesce(F.sum(f"b_{n}").over(before), F.lit(0)) + F.col(f"m_{n}") for n in deltas})
    return sums.groupBy(*keys).agg(*[x for n in deltas for x in (F.sum(f"b_{n}").alias(f"{n}_sum"), F.least(F.lit(0), F.min(f"low_{n}")).alias(f"{n}_low"))])


def summed_by_size(df: DataFrame, keys: list[str], many: int = MANY, **deltas: Column) -> DataFrame:
    """:func:`summed_gauges` where most keys have few rows: those meet in one shuffle, and only the others are cut into buckets."""
    few, others = by_size(df, keys, many)
    upto = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = few.select(*keys, *ORDER, *[d.cast("long").alias(f"d_{n}") for n, d in deltas.items()])
    rows = rows.withColumns({f"s_{n}": F.sum(f"d_{n}").over(upto) for n in deltas})
    out = rows.groupBy(*keys).agg(*[x for n in deltas for x in (F.sum(f"d_{n}").alias(f"{n}_sum"), F.least(F.lit(0), F.min(f"s_{n}")).alias(f"{n}_low"))])
    return out if others is None else out.unionByName(summed_gauges(others, keys, **deltas))


def final_gauges(df: DataFrame, keys: list[str], **deltas: Column) -> DataFrame:
    """Only the last value of each key's gauges: keys and a column for each delta. One pass for all of them."""
    return summed_gauges(df, keys, **deltas).select(*keys, *[(F.col(f"{n}_sum") - F.col(f"{n}_low")).alias(n) for n in deltas])


def pending_delta() -> Column:
    return F.when(F.col("kind") == "enqueue_accepted", 1).when(F.col("kind") == "process_started", -1).otherwise(0)


def scheduled_delta() -> Column:
    return F.when(F.coalesce(F.col("scheduled"), F.lit(False)), pending_delta()).otherwise(0)


def pending_gauge(events: DataFrame) -> DataFrame:
    """queue, pending."""
    return final_gauges(events, ["queue"], pending=pending_delta())


def scheduled_gauge(events: DataFrame) -> DataFrame:
    """queue, scheduled: the pending gauge over events with the scheduled mark."""
    return final_gauges(events, ["queue"], scheduled=scheduled_delta())


def loose_facts(events: DataFrame) -> DataFrame:
    """Starts and ends without a settlement id, with the key by which they are counted: x_dispatch, x_job, x_attempt."""
    loose = events.where(F.col("kind").isin("process_started", "process_succeeded", "process_failed") & F.col("settlement_id").isNull())
    has = F.col("job_id") != ""
    return loose.withColumns({"x_dispatch": F.when(has, F.col("dispatch_id")).otherwise(""), "x_attempt": F.when(has, F.col("attempt")).otherwise(-1), "x_job": F.col("job_id")})


def active_gauge(events: DataFrame) -> DataFrame:
    """queue, active: executions that are open.

    With a settlement id an execution is open if the last of its facts is a start. Without one, starts and ends are
    counted by (dispatch, job, attempt), or for all without a job id together; a failed settlement then changes nothing.
    """
    facts = events.where(F.col("kind").isin("process_started", "process_succeeded", "process_failed", "settlement_failed"))
    exact = facts.where("settlement_id is not null").groupBy("queue", "settlement_id").agg(F.max_by("kind", F.struct(*ORDER)).alias("last")).groupBy("queue").agg(F.sum((F.col("last") == "process_started").cast("long")).alias("open"))
    loose = loose_facts(events)
    by_key = final_gauges(loose, ["queue", "x_dispatch", "x_job", "x_attempt"], open=F.when(F.col("kind") == "process_started", 1).otherwise(-1))
    return exact.unionByName(by_key.select("queue", "open")).groupBy("queue").agg(F.sum("open").alias("active"))


def match_waits(events: DataFrame) -> DataFrame:
    """Starts with the enqueue that each consumes, first in first out by (queue, job_key): queue, job_key, nth, enqueued_at, started_at.

    A start consumes one if the gauge of its key is above zero before it; the k-th such start takes the k-th enqueue.
    Both numbers are running counts of the gauge's one bucketed pass, so a key with most of the log still spreads, and the two
    rows of a number meet in an aggregation.
    """
    return matched(numbered_waits(events.where(F.col("kind").isin("enqueue_accepted", "process_started") & (F.col("job_key") != ""))))


def numbered_waits(facts: DataFrame) -> DataFrame:
    """queue, job_key, nth, put (an enqueue, else a start), time, seq of enqueues and of the starts that consume one."""
    return _numbered(floored_gauge(facts.select("queue", "job_key", *ORDER, "kind"), ["queue", "job_key"], pending_delta()))


def _numbered(rows: DataFrame) -> DataFrame:
    put = F.col("delta") == 1
    nth = F.when(put, F.col("puts")).when(F.col("gauge_before") > 0, F.col("puts") - F.col("gauge"))
    return rows.select("queue", "job_key", nth.alias("nth"), put.alias("put"), *ORDER).where("nth is not null")


def enqueues(facts: DataFrame, many: int = MANY) -> DataFrame:
    """Each enqueue with the start that takes it: queue, job_key, nth, time, seq, took_at (null: none).

    Keys with few rows meet in one shuffle from their order to the pairs; the others are cut into buckets of time.
    """
    keys, put = ["queue", "job_key"], F.col("put")
    few, others = by_size(facts.select(*keys, *ORDER, "kind"), keys, many)
    parts = [whole_gauge(few, keys, pending_delta())] + ([] if others is None else [floored_gauge(others, keys, pending_delta())])
    pairs = [_numbered(p).groupBy(*keys, "nth").agg(*[F.max(F.when(put, F.col(c))).alias(c) for c in ORDER], F.max(F.when(~put, F.col("time"))).alias("took_at")) for p in parts]
    return reduce(DataFrame.unionByName, pairs).where("time is not null")


def matched(numbered: DataFrame) -> DataFrame:
    """The two rows of a number side by side: queue, job_key, nth, enqueued_at, started_at."""
    met = numbered.groupBy("queue", "job_key", "nth").agg(F.max(F.when(F.col("put"), F.col("time"))).alias("enqueued_at"), F.max(F.when(~F.col("put"), F.col("time"))).alias("started_at"))
    return met.where("enqueued_at is not null and started_at is not null")


def running_counts(events: DataFrame) -> DataFrame:
    """queue, at, seq, processed, failed: counts so far at each success and failure."""
    rows = events.where(F.col("kind").isin("process_succeeded", "process_failed")).withColumn("bucket", time_bucket(86_400)).withColumn("p", (F.col("kind") == "process_succeeded").cast("long")).withColumn("f", (F.col("kind") == "process_failed").cast("long"))
    sums = rows.groupBy("queue", "bucket").agg(F.sum("p").alias("bp"), F.sum("f").alias("bf"))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("queue", "bucket", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bf").over(before), F.lit(0)).alias("f0"))
    upto = Window.partitionBy("queue", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cp", F.sum("p").over(upto)).withColumn("cf", F.sum("f").over(upto))
    return rows.join(sums, ["queue", "bucket"]).select("queue", F.col("time").alias("at"), "seq", (F.col("p0") + F.col("cp")).alias("processed"), (F.col("f0") + F.col("cf")).alias("failed"))
