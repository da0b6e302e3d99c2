"""Rows that are taken one after the other when each taken one bars its key for a while, cut so that no key is one task.

What such a rule does to a stretch of a key's rows depends only on the moment until which the key is barred when the stretch begins: the
first row at or after it is taken, and all else follows. So a key is cut into blocks of time, and each block gets a jump table:
for each row at which it can be entered, the moment until which the key is barred when the block is over, found for all rows at once by
pointer jumping. Tables of neighbouring blocks make one of the blocks together, over and over; then the moments go down the same tree,
and blocks are marked apart from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.operators.scan import hops, key_numbers

#: Barred by nothing.
FREE = -(1 << 62)


def _changes(columns: list[pd.Series], before: tuple | None) -> np.ndarray:
    """Where a row's key isn't that of the row before; ``before`` is the key ahead of the first."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for v in columns:
        was = v.shift()
        new[1:] |= ((v != was) & ~(v.isna() & was.isna())).to_numpy()[1:]
    new[0] = before is None or before != _key(columns, 0)
    return new


def _key(columns: list[pd.Series], i: int) -> tuple:
    return tuple(None if pd.isna(v.iloc[i]) else v.iloc[i] for v in columns)


def whole_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """``work(rows, starts)`` over runs of whole groups in key and ``order``, many small groups at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch[k] for k in keys]
            new = np.flatnonzero(_changes(columns, last))
            last = _key(columns, len(batch) - 1)
            cut = int(new[-1]) if len(new) else None
            if cut is None:
                pieces.append(batch)
                continue
            if pieces or cut:
                done = pd.concat([*pieces, batch.iloc[:cut]], ignore_index=True)
                if len(done):
                    yield work(done, np.flatnonzero(_changes([done[k] for k in keys], None)))
            pieces = [batch.iloc[cut:]]
        if pieces:
            done = pd.concat(pieces, ignore_index=True)
            yield work(done, np.flatnonzero(_changes([done[k] for k in keys], None)))

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def jump_tables(t: np.ndarray, until: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(entries, exits) of each group of rows in order of ``t``: barred until b, a group is left barred until exits[first entry at or after b].

    Rows that lead to the same exit are one entry, the last of them.
    """
    n = len(t)
    key, ends = key_numbers(starts, n), np.append(starts[1:], n)
    ranks = np.unique(np.concatenate([t, until]), return_inverse=True)[1]
    place = key * (2 * n + 2) + ranks[:n]
    after = np.searchsorted(place, key * (2 * n + 2) + ranks[n:])
    after = np.maximum(after, np.arange(n) + 1)
    to = np.where(after >= ends[key], np.arange(n), after)
    while True:  # each round doubles the jumps
        further = to[to]
        if (further == to).all():
            break
        to = further
    out = until[to]
    keep = np.ones(n, dtype=bool)
    keep[:-1] = (out[1:] != out[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(keep)
    cuts = np.searchsorted(at, starts[1:])
    return np.split(t[at], cuts), np.split(out[at], cuts)


def jump(entries: np.ndarray, exits: np.ndarray, barred: np.ndarray) -> np.ndarray:
    """Until when a block leaves its key barred that it is entered with; beyond its last row nothing changes."""
    i = np.searchsorted(entries, barred)
    return np.where(i < len(entries), exits[np.minimum(i, len(entries) - 1)], barred)


def joined_table(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The jump table of neighbouring blocks together."""
    entries, exits = tables[0]
    for e, x in tables[1:]:
        entries, exits = np.concatenate([entries, e]), np.concatenate([jump(e, x, exits), x])
        keep = np.append(exits[1:] != exits[:-1], True)
        entries, exits = entries[keep], exits[keep]
    return entries, exits


def _table_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL("block bigint, entries array<bigint>, exits array<bigint>").fields])


def _block_barriers(df: DataFrame, keys: list[str], t: str, until: str, order: list[str], size: int, fan: int) -> DataFrame:
    """keys, block, barred: until when a key is barred as a block begins, for blocks that begin barred."""
    schema = _table_schema(df, keys)

    def tables(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        entries, exits = jump_tables(rows["_t"].to_numpy(np.int64), rows["_until"].to_numpy(np.int64), starts)
        return rows.iloc[starts][[*keys, "block"]].assign(entries=entries, exits=exits)

    def together(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ends = np.append(starts[1:], len(rows))
        made = [joined_table(list(zip(rows["entries"].iloc[a:b], rows["exits"].iloc[a:b], strict=True))) for a, b in zip(starts, ends, strict=True)]
        out = rows.iloc[starts][keys].assign(block=rows["above"].iloc[starts].to_numpy())
        return out.assign(entries=[m[0] for m in made], exits=[m[1] for m in made])

    def down(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Rows of a group: perhaps one with the group's own moment, then its blocks."""
        marker, ends, barred = rows["marker"].to_numpy(), np.append(starts[1:], len(rows)), np.full(len(rows), FREE)
        for a, b in zip(starts, ends, strict=True):
            now = np.int64(FREE)
            for i in range(a, b):
                if marker[i]:
                    now = np.int64(rows["barred"].iloc[i])
                else:
                    barred[i] = now
                    now = jump(rows["entries"].iloc[i], rows["exits"].iloc[i], now)
        keep = ~marker & (barred > FREE)
        return rows.loc[keep, [*keys, "block"]].assign(barred=barred[keep])

    narrow = df.select(*keys, F.floor(F.col(t) / size).cast("long").alias("block"), F.col(t).alias("_t"), F.col(until).alias("_until"), *[F.col(c).alias(f"_o_{c}") for c in order])
    ends = narrow.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()  # two numbers
    level = whole_groups(narrow, [*keys, "block"], ["_t", *[f"_o_{c}" for c in order]], tables, schema)
    levels, low, high = [level], ends.low or 0, ends.high or 0
    while high - low >= fan:
        level = whole_groups(level.withColumn("above", F.floor(F.col("block") / fan).cast("long")), [*keys, "above"], ["block"], together, schema)
        levels.append(level)
        low, high = low // fan, high // fan
    out, barred = T.StructType([*schema.fields[:-2], T.StructField("barred", T.LongType())]), None
    for k in reversed(range(len(levels))):
        above = F.floor(F.col("block") / fan).cast("long") if barred is not None else F.lit(0).cast("long")
        rows = levels[k].select(*keys, above.alias("above"), "block", "entries", "exits", F.lit(FREE).alias("barred"), F.lit(False).alias("marker"))
        if barred is not None:
            empty = F.array().cast("array<bigint>")
            rows = rows.union(barred.select(*keys, F.col("block").alias("above"), F.lit(FREE).alias("block"), empty, empty, "barred", F.lit(True)))
        barred = whole_groups(rows, [*keys, "above"], ["block"], down, out)
    return barred


def admitted(df: DataFrame, keys: list[str], t: str, until: str, order: list[str], size: int, fan: int = 256) -> DataFrame:
    """``df`` with ``admitted``: in order of ``t`` and ``order`` a row is taken unless a taken row of its key bars it, being taken at t and barring [t, until).

    ``t`` and ``until`` are whole numbers without nulls, at least 0. Blocks are ``size`` long in the unit of ``t``; ``fan`` tables are joined at a time. A block of a key
    is the most that meets in one task, of which tables hold two numbers for each exit that its rows can lead to; take blocks several times as long
    as rows bar, so that most rows can't be where a block is entered. Null keys are a key. An empty table gives none.
    """
    names = df.columns
    barred = _block_barriers(df, keys, t, until, order, size, fan)
    rows = df.withColumns({"_block": F.floor(F.col(t) / size).cast("long"), "_barred": F.lit(None).cast("long")})
    marks = barred.select(*[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names], F.col("block").alias("_block"), F.col("barred").alias("_barred"))
    schema = T.StructType([*df.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, FREE
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in (*keys, "_block", "_barred", t, until)}
            columns = [column[k].to_pandas() for k in (*keys, "_block")]
            starts = np.flatnonzero(_changes(columns, last))
            mark = column["_barred"].is_valid().to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, dtype=bool)
            new[starts] = True
            if not len(starts) or starts[0]:
                starts = np.concatenate([[0], starts])  # goes on from the batch before
            own = key_numbers(starts, batch.num_rows)
            begin = np.full(len(starts), FREE)
            if not new[0]:
                begin[0] = carry
            begin[own[mark]] = column["_barred"].fill_null(FREE).to_numpy(zero_copy_only=False)[mark]
            at = np.flatnonzero(~mark)
            ok = np.zeros(batch.num_rows, dtype=bool)
            carry = begin[-1]
            if len(at):
                present, first = np.unique(own[at], return_index=True)
                ok[at], final = hops(column[t].fill_null(0).to_numpy(zero_copy_only=False)[at], column[until].fill_null(0).to_numpy(zero_copy_only=False)[at], first, None, begin[present])
                if present[-1] == len(starts) - 1:
                    carry = FREE if final is None else final
            last = _key(columns, batch.num_rows - 1)
            keep = pa.array(~mark)
            out = [batch.column(batch.schema.get_field_index(c)).filter(keep) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ok[~mark])], names=[*names, "admitted"])

    group = [*keys, "_block"]
    return rows.unionByName(marks).repartition(*[F.col(k) for k in group]).sortWithinPartitions(*group, F.col("_barred").asc_nulls_last(), t, *order).mapInArrow(run, schema)
