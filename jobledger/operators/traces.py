"""Traces: facts that belong together because their identifiers meet, in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.sources.tables import folder, write_table

#: Identifiers by which facts are correlated, and the letter that tells them apart.
IDS = {"dispatch_id": "d", "job_id": "j", "chain_id": "c", "batch_id": "b"}


def _stored(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identifiers() -> Column:
    """The fact's identifiers, each as letter:value; empty ones are none."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{k}:"), F.col(c))) for c, k in IDS.items()]))


def connected(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``links(a, b)`` of strings -> (id, trace): the least identifier that each can reach; one alone reaches itself.

    Every identifier points at a smaller one or itself. In a round it looks at what its neighbours point at, the least of these becomes what its own
    target points at too, and then each points where its target does: paths halve, so rounds grow with the logarithm of the longest
    one. Each round is written; the loop ends when a round changes nothing and raises when ``most_rounds`` don't suffice. A hub's neighbours are combined before the shuffle.
    """
    both = _stored(links.where("a is not null and b is not null").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    now = _stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
    for _ in range(most_rounds):
        at = now.select(F.col("id").alias("at_id"), F.col("to").alias("at_to"))
        least = both.join(at, F.col("b") == F.col("at_id")).groupBy("a").agg(F.min("at_to").alias("near"))
        met = now.join(least, F.col("id") == F.col("a")).select("id", "to", F.least("to", "near").alias("near"))
        # each identifier, and what it points at, may point at the least one seen
        offers = met.select("id", F.col("near").alias("to")).union(met.select(F.col("to").alias("id"), F.col("near").alias("to")))
        hooked = _stored(offers.groupBy("id").agg(F.min("to").alias("to")))
        ahead = hooked.select(F.col("id").alias("h_id"), F.col("to").alias("h_to"))
        new = _stored(hooked.join(ahead, F.col("to") == F.col("h_id"), "left").select("id", F.least("to", F.coalesce("h_to", F.col("to"))).alias("to")))
        if new.join(now, ["id", "to"], "left_anti").isEmpty():
            return new.select("id", F.col("to").alias("trace"))
        now = new
    raise RuntimeError("identifiers did not settle")


def trace_facts(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Every fact that has an identifier: trace, position (from 1), gap_us (since the fact before, null at first), seq, layer, kind, time.

    Facts that share a dispatch, job, chain or batch belong to one trace, and so do all that are reached over shared identifiers; it is
    named by the least of its identifiers. Order is (time, seq). A giant trace is numbered within stretches of ``seconds``, whose
    counts and last moments are put in order, a row each; so it stays in long form and is never one task.
    """
    rows = events.withColumn("ids", identifiers()).where(F.size("ids") > 0)
    links = rows.select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).distinct()
    names = connected(links)
    placed = rows.withColumn("own", F.col("ids")[0]).join(names, F.col("own") == F.col("id")).withColumn("block", F.floor(F.unix_seconds("time") / seconds))
    blocks = placed.groupBy("trace", "block").agg(F.count("*").alias("n"), F.max("time").alias("last"))
    before = Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("trace", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.max("last").over(before).alias("last_before"))
    inner = Window.partitionBy("trace", "block").orderBy("time", "seq")
    numbered = placed.withColumn("nth", F.row_number().over(inner)).withColumn("was", F.lag("time").over(inner)).join(blocks, ["trace", "block"])
    gap = F.unix_micros("time") - F.unix_micros(F.coalesce("was", "last_before"))
    return numbered.select("trace", (F.col("ahead") + F.col("nth")).alias("position"), gap.alias("gap_us"), "seq", "layer", "kind", "time")


def trace_summary(facts: DataFrame) -> DataFrame:
    """trace, facts, kinds, layers, took_us, longest_gap_us of :func:`trace_facts`."""
    return facts.groupBy("trace").agg(F.count("*").alias("facts"), F.count_distinct("kind").alias("kinds"), F.count_distinct("layer").alias("layers"), (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))).alias("took_us"), F.max("gap_us").alias("longest_gap_us"))
