"""Documents to a training mix: five stages, each over all that the one before it kept.

Every stage is written as Parquet and read back before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobledger.llm import toxicity
from jobledger.llm.decontam import decontaminate
from jobledger.llm.line_dedup import dedupe_lines
from jobledger.llm.mixing import taken_words
from jobledger.llm.near_dedup import near_duplicates
from jobledger.llm.shared import saved


def _row(c: str) -> Column:
    return F.col(f"row.`{c}`").alias(c)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on this stage's labelled documents, doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*[_row(c) for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more share; a null text stays null, n_chars follows the text."""
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text.alias("text"), "n_chars": F.coalesce(F.char_length(text).cast("long"), _row("n_chars") if "n_chars" in docs.columns else F.lit(None)).alias("n_chars")}
    return dedupe_lines(docs).select(*[new.get(c, _row(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates (five words, 80 %)."""
    gone = near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.hint("merge").join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where("n_hit = 0").select(*[_row(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the words it takes of each: their columns, mix_size, mix_target (of the source), mix_taken.

    Rows with the same doc_id, source and size share what they take, to the word: they are numbered, and the first get one more.
    """
    key = F.struct("doc_id", "source", "size")
    taken = taken_words(docs).groupBy(key.alias("m_key")).agg(F.sum("taken").alias("sum"), F.count("*").alias("rows"), F.max("target").alias("mix_target")).where("sum > 0")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    same = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    met = docs.select(F.struct(*docs.columns).alias("row"), same.alias("key")).hint("merge").join(taken, F.col("key") == F.col("m_key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text")))
    share = F.expr("sum div rows").cast("long") + (nth <= F.col("sum") % F.col("rows")).cast("long")
    return met.select("row.*", F.col("key.size").alias("mix_size"), "mix_target", share.alias("mix_taken")).where("mix_taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: The first stage is a fitted model: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
