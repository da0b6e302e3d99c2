"""Alert conditions over fixed windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.operators import gauges
from jobledger.operators.stats import count_if, kind_is


def window_start(seconds: int) -> Column:
    """Epoch second at which the row's window starts."""
    return F.floor(F.unix_seconds("time") / seconds) * seconds


def rates(events: DataFrame, seconds: int) -> DataFrame:
    """Started, succeeded, failed and retried in each window."""
    return events.groupBy(window_start(seconds).alias("start")).agg(*[count_if(kind_is(f"process_{k}")).alias(k) for k in ("started", "succeeded", "failed", "retried")])


def queue_windows(events: DataFrame, seconds: int) -> DataFrame:
    """queue, start, pending at the window's end, succeeded in it: for all windows between a queue's first and last, also empty ones."""
    rows = events.withColumn("start", window_start(seconds))
    base = rows.groupBy("queue", "start").agg(count_if(kind_is("process_succeeded")).alias("succeeded"))
    span = base.groupBy("queue").agg(F.min("start").alias("a"), F.max("start").alias("b")).select("queue", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("start"))
    level = gauges.floored_gauge(rows.select("queue", "time", "seq", "kind", "start"), ["queue"], gauges.pending_delta())
    level = level.groupBy("queue", "start").agg(F.max_by("gauge", F.struct("time", "seq")).alias("level"))
    full = span.join(base, ["queue", "start"], "left").join(level, ["queue", "start"], "left")
    back = Window.partitionBy("queue").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("queue", "start", F.coalesce(F.last("level", ignorenulls=True).over(back), F.lit(0)).alias("pending"), F.coalesce("succeeded", F.lit(0)).alias("succeeded"))


def backlog_alert(events: DataFrame, seconds: int, threshold: int) -> DataFrame:
    """Windows with more than ``threshold`` pending, more than the window before, while successes didn't rise."""
    w = Window.partitionBy("queue").orderBy("start")
    rows = queue_windows(events, seconds).withColumn("p0", F.lag("pending").over(w)).withColumn("s0", F.lag("succeeded").over(w))
    return rows.where((F.col("pending") > threshold) & (F.col("pending") > F.col("p0")) & (F.col("succeeded") <= F.col("s0"))).select("queue", "start", "pending", "succeeded")


def sustained_backlog(events: DataFrame, seconds: int, threshold: int, windows: int) -> DataFrame:
    """Episodes of sustained backlog: queue, start (of the first window), end (of the last), windows, peak (most pending).

    A window is in alarm if over it and the ``windows`` - 1 before it (all there) pending stayed above ``threshold``, the regression of pending on time
    rises, and that of successes doesn't. Neighbouring windows in alarm are one episode, from the first alarm on.
    """
    order = Window.partitionBy("queue").orderBy("start")
    span = order.rowsBetween(-(windows - 1), 0)
    rows = queue_windows(events, seconds).withColumn("x", F.row_number().over(order).cast("double"))
    slope = lambda y: F.regr_slope(F.col(y).cast("double"), F.col("x")).over(span)
    alarm = (F.count("*").over(span) == windows) & (F.min("pending").over(span) > threshold) & (slope("pending") > 1e-9) & (slope("succeeded") <= 1e-9)
    told = rows.withColumn("alarm", F.coalesce(alarm, F.lit(False))).where("alarm").withColumn("island", F.col("x") - F.row_number().over(order))
    return told.groupBy("queue", "island").agg(F.min("start").alias("start"), (F.max("start") + seconds).alias("end"), F.count("*").alias("windows"), F.max("pending").alias("peak")).drop("island")


def no_progress_alert(events: DataFrame, seconds: int) -> DataFrame:
    """Windows with pending jobs and no success."""
    return queue_windows(events, seconds).where("pending > 0 and succeeded = 0").select("queue", "start", "pending")


def churn_alert(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Windows in which a queue's job type fails or retries more than ``limit`` times."""
    got = events.groupBy("queue", "job_type", window_start(seconds).alias("start")).agg(count_if(kind_is("process_failed")).alias("failed"), count_if(kind_is("process_retried")).alias("retried"))
    return got.where((F.col("failed") > limit) | (F.col("retried") > limit))


def alert_episodes(events: DataFrame, keys: list[str], level: Column, limit: int, seconds: int) -> DataFrame:
    """keys, start, end, windows, peak of each run of neighbouring windows of which the summed ``level`` exceeds ``limit``."""
    hot = events.groupBy(*keys, window_start(seconds).alias("start")).agg(F.sum(level).alias("level")).where(F.col("level") > limit)
    island = F.col("start") - seconds * F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    return hot.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), (F.max("start") + seconds).alias("end"), F.count("*").alias("windows"), F.max("level").alias("peak")).drop("island")


def internal_failure_alerts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Windows with more than ``limit`` of the queue system's own failures of a kind."""
    got = events.where(kind_is("republish_failed", "settlement_failed", "process_recovered")).groupBy("kind", window_start(seconds).alias("start")).agg(F.count("*").alias("n"))
    return got.where(F.col("n") > limit)
