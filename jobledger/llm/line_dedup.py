"""Lines that many documents repeat: drop them everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.llm.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters stripped at both ends of a line: space and U+0009 to U+000D.
STRIPPED = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _hashes(lines: Column, min_chars: int) -> Column:
    """128 bits of each line's key, null where the key is shorter than ``min_chars`` code points."""
    # one lambda for the key and one for its hash: an expression that a lambda uses twice is computed twice
    keys = F.transform(lines, lambda x: F.when(F.char_length(x) >= min_chars, lower_ascii(F.btrim(x, F.lit(STRIPPED)))))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(7)).alias("b"))))


def dedupe_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with a ``doc_id`` and ``text`` -> (row struct of all input columns, n_lines, n_dropped, kept_text).

    A line's key is the line stripped of blanks at both ends, with A-Z lower-cased. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` distinct documents hold lose all their lines except those of the largest such
    doc_id. What stays is joined by newlines in its old order. Null and empty texts are one empty line. Rows with a
    null doc_id count as no document; their copies of such lines go. Rows that repeat a doc_id count as one document.

    Hot lines: distinct documents are counted with partial aggregation, and marking is an equi-join whose skewed
    partitions adaptive execution splits. Texts are shuffled once, to meet the positions to drop.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    base = rows.select(
        "row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("text_hash"),
        F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n", -1).alias("lines"),
    )
    marks = base.select("id", "text_hash", F.posexplode(_hashes(F.col("lines"), min_chars)).alias("pos", "h")).where("h is not null").select("id", "text_hash", "pos", "h.a", "h.b")
    marks = saved(marks)  # lines are hashed once, for counting and for marking
    common = marks.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    common = saved(common)  # as a table, so that a hot line's side of the join can be split
    gone = marks.hint("merge").join(common, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    cuts = gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))
    met = base.join(cuts.withColumnRenamed("id", "cut_id").withColumnRenamed("text_hash", "cut_hash"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left")
    # slices between neighbouring cuts: linear in the number of lines
    ends = F.concat(F.array(F.lit(-1)), F.col("cuts"), F.array(F.size("lines")))
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") + 1), lambda j: F.slice(F.col("lines"), F.get(F.col("ends"), j - 1) + 2, F.get(F.col("ends"), j) - F.get(F.col("ends"), j - 1) - 1)))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return met.withColumn("ends", ends).select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long").alias("n_dropped"),
        F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
    )
