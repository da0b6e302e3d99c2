"""Columns computed from texts in Arrow batches, beside all columns that a table already has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm import textbytes as tb


def appended(df: DataFrame, make: Callable[[np.ndarray, np.ndarray], list], fields: str, text: str = "text", keep: list[str] | None = None, limit: int = tb.CHUNK) -> DataFrame:
    """``df`` (or its columns ``keep``) as a struct ``row``, with the columns ``fields`` that ``make(bytes, offsets)`` gives.

    ``make`` gets the UTF-8 bytes and n + 1 offsets of n texts and returns one Arrow array for each field. A struct
    keeps the names of the table apart from the new ones. No shuffle.
    """
    names = df.columns if keep is None else keep
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType.fromDDL(fields)
    new = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            for i, j in tb.row_groups(offsets, limit):
                made = make(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made], names=["row", *new])

    return inner.mapInArrow(run, T.StructType([inner.schema["row"], *schema.fields]))
