"""Bounded samples of labelled documents, for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows, those of least hash of the columns ``by``: the same in every run.

    A threshold on the hash first leaves about 1.1 n of them, so that the ordered limit doesn't get ``n`` rows from each
    partition of a large table.
    """
    h = F.xxhash64(*by)
    total = rows.count()
    if total > n:
        rows = rows.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.1 * n + 100) / total)))
    return rows.orderBy(F.pmod(h, F.lit(1 << 30)), *by).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: str | None = None) -> DataFrame:
    """(text, y) of labelled documents, at most ``per_class`` of each label 0 and 1, chosen by a hash of doc_id.

    Labels that are null or neither 0 nor 1, and rows without doc_id, are left out; a doc_id that is labelled or stored
    several times counts once with its largest label and text. ``where`` limits the labels by an expression on doc_id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if where:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = hash_sample(known.where("y = 0"), per_class, "doc_id").union(hash_sample(known.where("y = 1"), per_class, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most 2 * per_class pairs of integers
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).drop("doc_id")
