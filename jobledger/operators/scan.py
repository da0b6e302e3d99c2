"""The one helper for rules that must see a key's rows in order and can't be told by windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class _Columns(dict):
    """The columns of a batch as numpy arrays, made when asked for: what a step doesn't read stays in Arrow."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        super().__init__()
        self.batch = batch

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = found = self.batch.column(name).to_pandas().to_numpy()
        return found


def sorted_scan(df: DataFrame, keys: list[str], order: list[str], step: Callable, added: str, only: object = None, in_place: bool = False) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``step`` gives each row, in key and ``order``; if ``only`` is given, of rows whose first added column is that.

    ``step(columns, starts, carry) -> (arrays, carry)`` gets a batch of rows as numpy arrays, the places where a key starts
    (0 first) and, if the first key goes on from the batch before, what it returned for it (else None). Rows stream through
    in Arrow batches: only ``carry`` of the last key is held, never a whole key. ``in_place``: rows that lie by key already, after a join by it, aren't
    shuffled again; a window numbers and sorts them, and Spark shuffles for it only where that is needed.
    """
    types = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *types.fields])
    names, arrow = schema.names, [to_arrow_type(f.dataType) for f in types.fields]
    n_own = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            new[0] = True
            marks = {k: batch.column(k).to_pandas() for k in keys}
            for v in marks.values():
                new[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()[1:]
            starts = np.flatnonzero(new)
            first, final = (tuple(None if pd.isna(marks[k].iloc[i]) else marks[k].iloc[i] for k in keys) for i in (0, n - 1))
            out, carry = step(_Columns(batch), starts, carry if first == last else None)
            last = final
            got = pa.RecordBatch.from_arrays([*batch.columns[:n_own], *[pa.array(x, t) for x, t in zip(out, arrow, strict=True)]], names=names)
            yield got if only is None else got.filter(pa.array(np.asarray(out[0] == only, dtype=bool)))

    if in_place:
        rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        rows = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)


def key_numbers(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def hops(t: np.ndarray, until: np.ndarray, starts: np.ndarray, free_from: int | None, barred: np.ndarray | None = None) -> tuple[np.ndarray, int | None]:
    """Which rows are taken when each taken one bars its key until ``until``; ``t`` grows within a key. All keys hop at once.

    ``free_from`` bars the first key; ``barred``, if given, each key instead. Returned is what bars the last one.
    """
    n = len(t)
    ok = np.zeros(n, dtype=bool)
    if n == 0:
        return ok, free_from
    key, ends = key_numbers(starts, n), np.append(starts[1:], n)
    begin = [] if free_from is None and barred is None else [free_from] if barred is None else barred
    ranks = np.unique(np.concatenate([t, until, begin]).astype(np.int64) if len(begin) else np.concatenate([t, until]).astype(np.int64), return_inverse=True)[1]
    width = len(t) * 2 + len(begin) + 2
    place = key * width + ranks[:n]
    after = np.searchsorted(place, key * width + ranks[n : 2 * n])  # the first row of the key at or after ``until``
    after = np.maximum(np.minimum(after, ends[key]), np.arange(n) + 1)
    now = starts.copy()
    if len(begin):
        which = np.arange(len(begin))
        now[which] = np.minimum(np.searchsorted(place, which * width + ranks[2 * n :]), ends[which])
    at, stop = now, ends
    final = free_from if barred is None and len(starts) == 1 else None if barred is None else int(barred[-1])
    while True:
        live = at < stop
        at, stop = at[live], stop[live]
        if len(at) == 0:
            return ok, final
        ok[at] = True
        if stop[-1] == n:
            final = int(until[at[-1]])
        at = after[at]


def keep_spaced(time: str, gap: int) -> Callable:
    """Keep the first row and each that comes at least ``gap`` after the last kept one."""

    def step(c: dict, starts: np.ndarray, free_from):
        t = c[time].astype(np.int64)
        ok, free_from = hops(t, t + gap, starts, free_from)
        return (ok,), free_from

    return step
