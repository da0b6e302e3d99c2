"""The job system's tables, derived from the general tables of a data folder.

Only integer and string expressions are used, so that other engines derive equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.operators.events import dedupe_events, normalize_events

#: The moment at which the derived job table is looked at: 1998-06-01T00:00:00Z.
JOBS_AS_OF_MS = 896_659_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values) -> Column:
    """The value at a number from 0 on."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (index + 1).cast("int"))


def _k(props: Column) -> Column:
    return F.regexp_extract(props, r"(\d+)", 1).cast("int")


def _user_queue(user: Column) -> Column:
    return pick(user % 5, "", "emails", "critical", "reports", "app_default")


def _payload(k: Column, user: Column) -> Column:
    return F.when(k % 10 == 0, "").otherwise(F.concat(F.lit('{"u":'), (user % 40).cast("string"), F.lit("}")))


def map_events(raw: DataFrame) -> DataFrame:
    """Rows of ``events`` as job events, not yet normalised: empty queue names, no layer, version 0."""
    k, user = F.col("k"), F.col("user_id")
    raw = raw.withColumn("k", _k(F.col("props")))
    view = pick(k % 12, "process_retried", "process_archived", "queue_paused", "queue_resumed", "enqueue_duplicate", "enqueue_rejected", "enqueue_canceled", "republish_failed", "settlement_failed", "process_recovered", "dispatch_started", "job_started")
    known = {"signup": "enqueue_accepted", "click": "process_started", "purchase": "process_succeeded", "error": "process_failed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in known.items()], view)
    ended, failed = F.col("kind").isin("process_succeeded", "process_failed"), F.col("kind") == "process_failed"
    job_type = F.concat(F.lit("type-"), (user % 7).cast("string"))
    rows = raw.withColumn("kind", kind)
    return rows.select(
        F.col("event_id").cast("long").alias("seq"), F.lit(0).alias("schema_version"),
        F.concat(F.lit("evt_"), F.when(F.col("event_id") % 50 == 49, F.col("event_id") - 1).otherwise(F.col("event_id")).cast("string")).alias("event_id"),
        F.lit("").alias("layer"), "kind", F.lit("database").alias("driver"), F.when(F.col("kind") == "process_recovered", "").otherwise(_user_queue(user)).alias("queue"),
        job_type.alias("job_type"), F.when(k % 17 == 0, "").otherwise(scalar.observed_job_key(job_type, _payload(k, user))).alias("job_key"),
        F.concat(F.lit("dsp_"), user.cast("string")).alias("dispatch_id"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("job_"), user.cast("string"))).alias("job_id"),
        F.lit("").alias("chain_id"), F.lit("").alias("batch_id"), (k % 3).cast("int").alias("attempt"), F.lit(2).alias("max_retry"), (k % 4 == 0).alias("scheduled"),
        F.when(ended, F.round(F.col("value") * 100).cast("long") * 10000).otherwise(F.lit(0).cast("long")).alias("duration_ns"),
        F.when(failed, F.concat(F.lit("boom-"), (k % 5).cast("string"))).alias("error"),
        F.when(failed & (k % 13 == 0), "permanent").when(failed & (k % 13 == 1), "uncommitted").alias("error_class"),
        F.when(k % 2 == 1, F.concat(F.lit("gen_"), user.cast("string"), F.lit("_"), (k % 3).cast("string"))).alias("settlement_id"),
        F.col("ts").cast("timestamp").alias("time"),
    )


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_events(table(spark, sf_dir, "events"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events, each fact once."""
    return dedupe_events(normalize_events(events_raw(spark, sf_dir)))


def map_requests(raw: DataFrame) -> DataFrame:
    """Rows of ``events`` as dispatch requests; some are malformed on purpose."""
    k, user, i = F.col("k"), F.col("user_id"), F.col("event_id")
    raw = raw.withColumn("k", _k(F.col("props")))
    big = lambda c: c.cast("long")
    return raw.select(
        big(i).alias("seq"), F.col("ts").cast("timestamp").alias("time"), _user_queue(user).alias("queue"),
        F.when(i % 97 == 0, "").otherwise(F.concat(F.lit("type-"), (user % 7).cast("string"))).alias("job_type"), _payload(k, user).alias("payload"),
        F.when(k % 4 != 0, big(k) * 700).alias("timeout_ms"), big((k % 3) * 500).alias("backoff_ms"),
        F.when(i % 89 == 0, F.lit(-1).cast("long")).otherwise(big((k % 3) * 60_000)).alias("delay_ms"), big(k % 5) * 21_600_000, F.when(k % 6 != 0, k % 4).cast("int").alias("max_retry"),
    ).toDF("seq", "time", "queue", "job_type", "payload", "timeout_ms", "backoff_ms", "delay_ms", "unique_ttl_ms", "max_retry")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_requests(table(spark, sf_dir, "events"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the job table."""
    o, key, cust = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    queue = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "emails").when(F.col("o_orderpriority") == "3-MEDIUM", "default").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "reports").otherwise("low")
    running = F.col("o_orderstatus") == "P"
    return o.select(
        key.alias("id"), queue.alias("queue_name"), F.concat(F.lit("type-"), (cust % 10).cast("string")).alias("job_type"), F.concat(F.lit('{"c":'), cust.cast("string"), F.lit("}")).alias("payload"),
        F.when(cust % 3 != 0, (cust % 5) * 86_400).alias("timeout_seconds"), F.lit(2).alias("max_retry"), ((key % 4) * 250).alias("backoff_millis"), (key % 3).cast("int").alias("attempt"),
        at.alias("available_at"), F.when(running, at + 1000).alias("processing_started_at"), F.when(running & (key % 9 == 4), "").when(running & (key % 9 != 0), F.concat(F.lit("tok_"), key.cast("string"))).alias("processing_token"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("boom-"), (key % 5).cast("string"))).alias("last_error"),
        F.when(running, "processing").when(F.col("o_orderstatus") == "F", "dead").otherwise("pending").alias("state"), at.alias("created_at"), at.alias("updated_at"), cust.alias("cust"),
    )


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """What handlers report for every second running job; some tokens are stale, and some report twice, the other way round, before or after."""
    cls = pick(F.col("cust") % 4, F.lit(None).cast("string"), "plain", "permanent", "uncommitted")
    token = F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("processing_token"))
    failed, at = F.col("cust") % 4 != 0, F.lit(JOBS_AS_OF_MS) - F.col("cust") % 100
    told = jobs.where("state = 'processing' and id % 2 = 0")
    out = ["id", token.alias("processing_token")]
    first = told.select(*out, failed.alias("failed"), cls.alias("error_class"), F.when(failed, F.concat(F.lit("err-"), F.col("id").cast("string"))).alias("error"), at.alias("time"), (F.col("id") * 2).alias("seq"))
    again = told.where("id % 3 = 0").select(*out, (~failed).alias("failed"), F.lit(None).cast("string").alias("error_class"), F.when(~failed, F.concat(F.lit("again-"), F.col("id").cast("string"))).alias("error"), (at + pick(F.col("id") % 3 + F.col("cust") % 3, -1, 0, 1)).alias("time"), (F.col("id") * 2 + 1).alias("seq"))
    return first.union(again)


def admin_commands(jobs: DataFrame) -> DataFrame:
    """Two commands for every third job; some name another queue, or none. One queue is cleared."""
    op = pick(F.col("cust") % 4, F.lit(None).cast("string"), "retry", "cancel", "delete")
    other = pick(F.col("cust") % 5, F.col("queue_name"), F.col("queue_name"), "other", F.col("queue_name"), "")
    third = jobs.where("id % 3 = 0")
    first = third.select((F.col("id") * 2).alias("seq"), op.alias("op"), "id", other.alias("queue"))
    second = third.where("id % 2 = 0").select((F.col("id") * 2 + 1).alias("seq"), pick(F.col("cust") % 3, "cancel", "retry", F.lit(None).cast("string")).alias("op"), "id", pick(F.col("cust") % 7 % 2, F.col("queue_name"), "other").alias("queue"))
    clear = jobs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("clear").alias("op"), F.lit(None).cast("long").alias("id"), F.lit("low").alias("queue"))
    return first.union(second).where("op is not null").union(clear)


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(batches, members, outcomes, cancels) from ``orders`` and ``lineitem``."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    batch = o.select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderstatus") == "O").alias("allow_failed"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("cust"))
    cust = batch.select("batch_id", "cust")
    of_lines = line.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("string").alias("job_id")).join(cust, "batch_id").where("not (job_id = '7' and cust % 5 = 0)").select("batch_id", "job_id").distinct()
    members = of_lines.union(cust.where("cust % 4 = 0").select("batch_id", F.lit("extra")))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    place = F.struct(F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b"), F.col("l_suppkey").cast("long").alias("c"), cents.alias("d"))
    outcomes = line.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("string").alias("job_id"), place.alias("place"), (F.col("l_returnflag") == "R").alias("failed"))
    cancels = batch.where("cust % 11 = 0").select("batch_id", (F.col("created_at") + F.expr("INTERVAL 60 DAYS")).alias("cancelled_at"))
    return batch.drop("cust"), members, outcomes, cancels


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chains, outcomes): nodes 1 .. n of each order's lines, reported in shipping order."""
    line = table(spark, sf_dir, "lineitem")
    chain = line.groupBy(F.col("l_orderkey").alias("chain_id")).agg(F.max("l_linenumber").cast("int").alias("n_nodes"), F.min("l_shipdate").cast("timestamp").alias("created_at"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    place = F.struct(F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b"), F.col("l_suppkey").cast("long").alias("c"), cents.alias("d"))
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    outcomes = line.select(F.col("l_orderkey").alias("chain_id"), (F.col("l_linenumber") - 1).cast("int").alias("node"), place.alias("place"), bad.alias("failed"), F.when(bad, F.concat(F.lit("cause-"), F.col("l_partkey").cast("string"))).alias("error"))
    return chain, outcomes


def samples(events: DataFrame) -> DataFrame:
    """Running processed and failed counts of each queue at each end of an execution."""
    from jobledger.operators.gauges import running_counts

    return running_counts(events)
