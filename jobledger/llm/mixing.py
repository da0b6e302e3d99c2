"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.shared import saved

#: Words: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most_repeats: int) -> DataFrame:
    """``sizes(source, source_size)`` -> source, source_size, rank, target: one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share percent % of all sizes. No target
    exceeds ``most_repeats`` times its source; the excess is shared anew by weight until none is above. In order of
    (limit / weight) the capped sources come first, so the level is found with running sums instead of rounds:
    source i is capped if the level left to it and those after it, per weight, is at least its limit per weight.
    One task orders the sources, a row each.
    """
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int") + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * most_repeats).withColumn("total", F.sum("source_size").over(everywhere) * percent / 100.0)
    order = everywhere.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(after))
    capped = F.col("most") * F.col("rest") <= F.col("left") * F.col("weight")
    # the first uncapped source fixes the level for all after it
    level = F.first(F.when(~capped, F.struct("left", "rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = filled.withColumn("level", level)
    return filled.select("source", "source_size", "rank", F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.rest")).alias("target"))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A fixed pseudo-random place of a document: equal for every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def placed_documents(docs: DataFrame, weights: tuple[int, ...], percent: int, most_repeats: int, seed: int, buckets: int) -> DataFrame:
    """Every document with its source's target and its start: words of its source before it in shuffled order.

    Running sums are taken in two levels (within hash buckets, then over bucket totals), so that a source with a
    third of all rows still spreads over ``buckets`` groups.
    """
    key = shuffle_key(F.col("doc_id"), seed)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    sized = saved(sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")))  # texts are read and their words counted once
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sources = source_targets(per_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, percent, most_repeats)
    of_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("base", F.coalesce(F.sum("in_bucket").over(of_source), F.lit(0))).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "base", "source_size", "rank", "target")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("ahead", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("start", F.col("base") + F.col("ahead"))
        .select("doc_id", "source", "size", "source_size", "target", "rank", "start")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most_repeats: int = 2, seed: int = 0, buckets: int = 1024, quantum: int = 128, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text, source)`` -> (every document with its place, the mix in its order).

    The documents of a source are shuffled by a hash of doc_id and queued ``most_repeats`` times, one round of the
    source after the other; documents of more than ``quantum`` words are queued in slices of so many. The virtual finish time
    of a slice is the source's words up to its end divided by the source's target. The queue is range-sorted by
    finish time, then source and place, and served until ``budget`` words are taken (default: the sum of all targets);
    the slice in service there is cut, later ones are left out. What a source gets follows from that order alone: within a slice of
    its share at every moment.

    First result, one row per input row: doc_id, source, size, source_size, target, rank (of the source), start (words of
    its source before it). Second, sorted by finish: source, rank, start, repeat, begin, finish, words (taken of this
    slice) and mix_start (words of the mix before it).

    The sort is written with the number of each range, so running sums need the sums of the ranges only, one row each. ``buckets`` spread
    the places within a source; raise them with the data.

    Null texts have size 0; a null source is a source of its own, last in order; null doc_ids sort as empty. Sources
    without words have target 0. Rows that repeat a doc_id are mixed each for itself.
    """
    spark = docs.sparkSession
    placed = saved(placed_documents(docs, weights, percent, most_repeats, seed, buckets))
    if budget is None:  # one number
        targets = placed.groupBy("rank").agg(F.max("target").alias("target"))
        budget = targets.agg(F.floor(F.round(F.sum("target"), 3)).cast("long")).first()[0] or 0
    first = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1)))
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(quantum).cast("long")))
    queue = placed.where("size > 0").select("source", "rank", "start", "size", "source_size", "target", first.alias("repeat")).select("*", slices.alias("at"))
    queue = queue.withColumn("begin", F.col("start") + F.col("repeat") * F.col("source_size") + F.col("at")).withColumn("length", F.least(F.lit(quantum), F.col("size") - F.col("at")))
    queue = queue.withColumn("finish", (F.col("begin") + F.col("length")) / F.col("target")).select("source", "rank", "start", "repeat", "begin", "length", "finish")
    order = ["finish", "rank", "begin"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(queue.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("length").alias("in_range"))
    sums = sums.select("range", F.coalesce(F.sum("in_range").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    live = ranged.join(F.broadcast(sums.where(F.col("range_start") < budget)), "range")  # a row for each range
    in_range = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mix = live.withColumn("mix_start", F.col("range_start") + F.coalesce(F.sum("length").over(in_range), F.lit(0))).where(F.col("mix_start") < budget)
    mix = mix.withColumn("words", F.least(F.col("length"), budget - F.col("mix_start")))
    return placed, mix.select("source", "rank", "start", "repeat", "begin", "finish", "words", "mix_start")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``docs(doc_id, text, source)`` -> doc_id, source, size, source_size, target, taken: words that the mix takes, repeats counted."""
    placed, mix = mix_sources(docs, **options)
    of_doc = mix.groupBy("rank", "start").agg(F.sum("words").alias("taken")).toDF("m_rank", "m_start", "taken")
    met = placed.join(of_doc, (F.col("rank") == F.col("m_rank")) & (F.col("start") == F.col("m_start")) & (F.col("size") > 0), "left")
    return met.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
