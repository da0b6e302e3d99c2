"""Near-duplicate classes of documents: fast similarity sketching, banding, exact verification.

1. Each document becomes its set of word shingles (64-bit hashes). Sets of equal SHA-256 collapse to their smallest doc_id
   before anything is compared, so groups of exact copies cost one aggregation.
2. Sketch: in round i every shingle is thrown into one of t bins with value i + hash; a bin keeps its least
   value. Rounds t .. 2t-1 fill bin i - t, so every coordinate is filled after 2t rounds at most, and a set of n
   shingles needs about n + t log t throws instead of n * t.
3. Banding: t = bands * rows, with as many rows as leave a pair at the threshold less than one chance in a million to
   share no band (8 rows of 51 bands at 0.85). Every document is tied to the smallest of each bucket, and the connected candidates form
   a candidate class: two documents that share any bucket are in one class.
4. Verification: the members of a class meet, first with 128 bytes of each sketch, which are banded again: a set is sent there in full only if its
   sketch agrees with some other's there as one at the threshold would (it is missed with less than 1e-9, and shares no band with it with less than 1e-7). A class that is too large for one
   task is cut into blocks of bounded size, first by size stratum (sets further than one stratum apart cannot reach the threshold), then by a
   hash, and every pair of blocks that can hold a link is such a meeting. So classes
   that chain through common wording move short sketches, and full sets follow the documents that are really alike. A
   task emits a spanning forest of its links, never all its pairs. No class, bucket or block is dropped or sampled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.components import components
from jobledger.llm.shared import saved

U64 = np.uint64
#: Coordinates of a sketch, a byte each, that are compared before full sets are.
COORDS = 128


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted: (hashes of all texts, n + 1 offsets)."""
    starts, ends, first = tb.word_bounds(raw, offsets, tb.BLANK_WORDS)
    words, n_words = tb.word_hashes(raw, starts, ends), np.diff(first)
    n = len(n_words)
    grams = tb.ngram_hashes(words, k)
    n_grams = np.maximum(n_words - k + 1, 0)
    hashes = [grams[tb.ragged(first[:-1], n_grams)]]
    owner = [np.repeat(np.arange(n), n_grams)]
    for m in range(1, k):  # fewer words: the whole sequence as one
        short = np.flatnonzero(n_words == m)
        if len(short):
            hashes.append(tb.mix(tb.ngram_hashes(words, m)[first[short]] + U64(m)))
            owner.append(short)
    h, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def sketches(h: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of each set: an array of sets by t coordinates, all filled where the set isn't empty."""
    n = len(bounds) - 1
    out = np.full((n, t), np.iinfo(np.uint64).max, dtype=U64)
    flat = out.reshape(-1)
    sizes = np.diff(bounds)
    open_sets = np.flatnonzero(sizes)
    elems, owner = h, np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if len(open_sets) == 0:
            break
        throw = tb.mix(elems + U64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (throw >> U64(32)) | U64(i << 32)
        if i < t:
            # bins by multiply-shift on the low half, the value from the high half
            bins = ((throw & U64(0xFFFFFFFF)) * U64(t)) >> U64(32)
            np.minimum.at(flat, owner * t + bins.astype(np.int64), value)
        else:
            np.minimum.at(flat, owner * t + (i - t), value)
        if i % 4 == 3 or i < 4:
            full = (out[open_sets] != np.iinfo(np.uint64).max).all(axis=1)
            if full.any():
                open_sets = open_sets[~full]
                live = np.zeros(n, dtype=bool)
                live[open_sets] = True
                stay = live[owner]
                elems, owner = elems[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each set and band; equal keys: all coordinates of the band agree."""
    n, t = sketch.shape
    rows = sketch.reshape(n, bands, t // bands)
    key = np.broadcast_to(tb.mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for j in range(t // bands):
        key = tb.mix(key ^ rows[:, :, j])
    return key


def rows_for(threshold: float, bands: int, miss: float = 1e-6) -> int:
    """The most rows a band with which a pair at the threshold shares no band with probability ``miss`` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** bands <= miss)


def rows_within(threshold: float, miss: float = 1e-7) -> int:
    """As :func:`rows_for`, for the coordinates that are compared within a class."""
    return max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** (COORDS // r) <= miss)


def agreeing(threshold: float, coordinates: int, miss: float = 1e-9) -> int:
    """The most coordinates of a sketch that a pair at the threshold agrees in but for a chance of ``miss``."""
    chance, k = (1 - threshold) ** coordinates, 0
    while chance <= miss:
        k += 1
        chance += math.comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
    return k


def _sketch_rows(k: int, bands: int, rows: int):
    def work(raw, offsets, batch):
        h, bounds = shingle_sets(raw, offsets, k)
        n = np.diff(bounds)
        digests = [hashlib.sha256(h[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sketch = sketches(h, bounds, bands * rows)
        coords = (sketch[:, :COORDS] & U64(0xFF)).astype(np.uint8)
        keys = band_keys(sketch, bands)
        keys = keys[n > 0].reshape(-1).view(np.int64)
        at = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in coords], pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys))],
            names=["doc_id", "tag", "n_shingles", "digest", "coords", "bands"],
        )

    return tb.per_batch(work, limit=4 << 20)


def _set_rows(k: int):
    def work(raw, offsets, batch):
        h, bounds = shingle_sets(raw, offsets, k)
        body = pa.py_buffer(np.ascontiguousarray(h).tobytes())
        sets = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds.astype(np.int64) * 8).tobytes()), body]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets, batch.column(2)], names=["doc_id", "shingles", "tasks"])

    return tb.per_batch(work, limit=4 << 20)


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what full comparison connects: (member, root) pairs.

    ``side`` holds 0 or 1; where both occur only sets of different sides need a comparison (same-side pairs meet in
    another task). A set is compared with all others at once, over a shingle -> sets index; sets that are already
    in the largest class are skipped, as one end of each open pair lies outside it.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets) if m else np.zeros(0, U64)
    _, token = np.unique(flat, return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    listed = owner[by_token]
    count = np.bincount(token)
    begin = np.cumsum(count) - count
    tokens = np.split(token, np.cumsum(size)[:-1]) if m else []
    root = np.arange(m)
    done = np.zeros(m, dtype=bool)
    for _ in range(m):
        names, sizes = np.unique(root, return_counts=True)
        if len(names) == 1:
            break
        todo = np.flatnonzero(~done if not done.any() else ~done & (root != names[np.argmax(sizes)]))
        if len(todo) == 0:
            break
        i = todo[0]
        done[i] = True
        t = tokens[i]
        common = np.bincount(listed[tb.ragged(begin[t], count[t])], minlength=m)
        near = 100 * common >= percent * (size[i] + size - common)
        near &= (root != root[i]) & (size > 0)
        if side.any() and not side.all():
            near &= side != side[i]
        for r in np.unique(root[near]):
            low, high = min(r, root[i]), max(r, root[i])
            root[root == high] = low
    return [(int(ids[j]), int(ids[root[j]])) for j in range(m) if ids[j] != ids[root[j]]]


def _verify(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(b, dtype=U64) for b in group["shingles"]]
        links = linked_forest(group["doc_id"].to_numpy(), sets, group["side"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _agree(x: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether sketches a[i] and b[i] agree in ``least`` coordinates and more."""
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = np.count_nonzero(x[a[part]] == x[b[part]], axis=1) >= least
    return out


def _all_pairs(x: np.ndarray, side: np.ndarray, both: bool, left: np.ndarray, right: np.ndarray, least: int, found: np.ndarray) -> None:
    """Mark those of ``left`` and ``right`` that agree with one of the other."""
    columns = np.ascontiguousarray(x[right].T)
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        same = np.zeros((len(rows), len(right)), np.uint8)
        for j in range(x.shape[1]):
            same += x[rows, j][:, None] == columns[j][None, :]
        near = (same >= least) & (rows[:, None] != right[None, :])
        if both:
            near &= side[rows][:, None] != side[right][None, :]
        found[rows] |= near.any(axis=1)
        found[right] |= near.any(axis=0)


def partnered(x: np.ndarray, side: np.ndarray, least: int, rows: int) -> tuple[np.ndarray, int]:
    """Which sketches agree with another one (of the other side, where there are two) in ``least`` coordinates and more; and how many pairs were compared.

    Only sketches that share a band of ``rows`` coordinates are compared. Each is held against the first of its bucket (of the other side) at
    once, which settles groups of copies in a number of steps that grows with their size; those that agree with none of these are
    held against all of their buckets. Where that is more than there are pairs, all pairs are compared instead.
    """
    n, bands = len(x), x.shape[1] // rows
    found, both = np.zeros(n, dtype=bool), bool(side.any() and not side.all())
    code = np.broadcast_to(np.arange(bands, dtype=U64), (n, bands)).copy()
    for j in range(rows):
        code = tb.mix(code ^ (x[:, j : bands * rows : rows].astype(U64) + U64(1 + (j << 9))))
    code = (code & ~U64(1)) | (side.astype(U64)[:, None] if both else U64(0))
    order = np.argsort(code, axis=None, kind="stable")
    bucket, member = code.reshape(-1)[order] >> U64(1), order // bands
    start = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if n else np.zeros(0, dtype=bool)
    head = np.flatnonzero(start)
    size = np.diff(np.append(head, len(bucket)))
    own = np.cumsum(start) - 1
    first, last = member[head][own], member[head + size - 1][own]
    other = np.where(side[member] == 1, first, last) if both else first  # sides are sorted within a bucket
    meet = np.flatnonzero((size[own] > 1) & (other != member) & ((side[other] != side[member]) | (not both)))
    pairs = np.unique(np.stack([np.minimum(member[meet], other[meet]), np.maximum(member[meet], other[meet])], axis=1), axis=0) if len(meet) else np.zeros((0, 2), np.int64)
    hit = pairs[_agree(x, pairs[:, 0], pairs[:, 1], least)]
    found[hit.reshape(-1)] = True
    compared = len(pairs)
    open_ = np.bincount(own[~found[member]], minlength=len(head)) if n else np.zeros(0, np.int64)
    todo = np.flatnonzero((open_ > 0) & (size > 2))
    if (open_[todo] * size[todo]).sum() >= n * n // 2:
        _all_pairs(x, side, both, np.flatnonzero(~found), np.arange(n), least, found)
        return found, compared + int((~found).sum()) * n
    for g in todo:
        here = member[head[g] : head[g] + size[g]]
        left = here[~found[here]]
        compared += len(left) * len(here)
        _all_pairs(x, side, both, left, here, least, found)
    return found, compared


def _partners(least: int, rows: int):
    """Sketches of a task -> those that agree with another one in ``least`` coordinates and more."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["coords"]), np.uint8).reshape(len(group), -1)
        found, _ = partnered(x, group["side"].to_numpy(), least, rows)
        return group.loc[found, ["doc_id", "tag", "component", "s1", "z1", "s2", "z2", "side"]]

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 51, rows: int | None = None, sketch_docs: int = 4096, block_shingles: int = 1 << 20) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their distinct k-word shingles; component_id is
    the smallest doc_id reachable over links. Null and empty texts, and texts without words, have no shingles and
    are linked with nothing. Rows that repeat a doc_id count as one document. A row with a null doc_id is linked with
    nothing and kept. Other columns are ignored.

    A task compares at most two blocks of ``sketch_docs`` documents and ``block_shingles`` shingles.
    """
    rows = rows or rows_for(percent / 100, bands)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    sketch = saved(texts.mapInArrow(_sketch_rows(k, bands, rows), "doc_id long, tag long, n_shingles long, digest binary, coords binary, bands array<long>"))
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = saved(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tag", "n_shingles", "coords")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), "r.tag", "r.n_shingles", "r.coords"))

    keys = usable.select("doc_id", "tag", "bands").join(reps.select(F.col("rep").alias("doc_id"), "tag"), ["doc_id", "tag"], "left_semi").select("doc_id", F.explode("bands").alias("key"))
    hubs = saved(keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub"))  # as a table, so that a hot bucket's side of the join can be split
    ties = keys.hint("merge").join(hubs, "key").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    classes = saved(components(ties).join(reps.select(F.col("rep").alias("node"), "tag", F.col("n_shingles").alias("weight"), "coords"), "node"))

    links = _verified(texts, classes, k, percent, sketch_docs, block_shingles)
    found = components(links)

    of_set = reps.join(found, reps.rep == found.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


TASK = "component:long,s1:int,z1:int,s2:int,z2:int,side:int"


def comparisons(classes: DataFrame, percent: int, sketch_docs: int, block_shingles: int) -> DataFrame:
    """``classes(node, tag, component, weight, coords)`` -> doc_id, tag, list: the tasks to which its full set goes, if any.

    A task is (component, s1, z1, s2, z2, side): two blocks of size strata, lower one first; side tells which of them it is in.
    """
    # a stratum is a little wider than the threshold's size ratio, so that linked sets are at most one apart
    width = -math.log(percent / 100 - 0.01)
    sized = classes.withColumn("s", F.floor(F.log(F.col("weight").cast("double")) / width).cast("int"))
    need = lambda docs, weight, most: F.greatest(F.ceil(docs / most), F.ceil(weight / block_shingles)).cast("int")
    strata = sized.groupBy("component", "s").agg(F.count("*").alias("docs"), F.sum("weight").alias("weight"))
    plan = strata.groupBy("component").agg(
        (need(F.sum("docs"), F.sum("weight"), sketch_docs) == 1).alias("single"),
        F.map_from_entries(F.collect_list(F.struct("s", need(F.col("docs"), F.col("weight"), sketch_docs).alias("n")))).alias("cuts"),
    )
    near = lambda d: F.coalesce(F.col("cuts")[F.col("s") + d], F.lit(0))
    me = F.pmod(F.xxhash64("node", "tag"), near(0)).cast("int")
    pair = lambda s1, z1, s2, z2, side: F.struct(F.col("component").alias("component"), s1.cast("int").alias("s1"), z1.cast("int").alias("z1"), s2.cast("int").alias("s2"), z2.cast("int").alias("z2"), side.cast("int").alias("side"))
    s, zero, one = F.col("s"), F.lit(0), F.lit(1)
    same = F.transform(F.sequence(zero, near(0) - 1), lambda z: pair(s, F.least(z, me), s, F.greatest(z, me), F.when(z < me, 1).otherwise(0)))
    up = F.transform(F.sequence(one, near(1)), lambda z: pair(s, me, s + 1, z - 1, zero))
    down = F.transform(F.sequence(one, near(-1)), lambda z: pair(s - 1, z - 1, s, me, one))
    none = F.array().cast(f"array<struct<{TASK}>>")
    several = F.concat(same, F.when(near(1) > 0, up).otherwise(none), F.when(near(-1) > 0, down).otherwise(none))
    tasks = F.when(F.col("single"), F.array(pair(zero, zero, zero, zero, zero))).otherwise(several)  # a class that is one block meets itself
    met = sized.join(plan, "component").select(F.col("node").alias("doc_id"), "tag", "coords", F.inline(tasks))
    kept = met.groupBy("component", "s1", "z1", "s2", "z2").applyInPandas(_partners(agreeing(percent / 100, COORDS), rows_within(percent / 100)), "doc_id long, tag long, component long, s1 int, z1 int, s2 int, z2 int, side int")
    return kept.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("component", "s1", "z1", "s2", "z2", "side")).alias("list"))


def _verified(texts: DataFrame, classes: DataFrame, k: int, percent: int, sketch_docs: int, block_shingles: int) -> DataFrame:
    """Links confirmed on full sets, as spanning forests of each task: (a, b)."""
    placed = comparisons(classes, percent, sketch_docs, block_shingles)
    schema = f"doc_id long, shingles binary, tasks array<struct<{TASK}>>"
    sets = texts.hint("merge").join(placed, ["doc_id", "tag"]).select("doc_id", "text", F.col("list").alias("tasks")).mapInArrow(_set_rows(k), schema)
    dealt = sets.select("doc_id", "shingles", F.inline("tasks"))
    return dealt.groupBy("component", "s1", "z1", "s2", "z2").applyInPandas(_verify(percent), "a long, b long")
