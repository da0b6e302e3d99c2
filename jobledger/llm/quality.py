"""Quality scores by Bradley-Terry pairwise ranking over style features of whole texts.

Each training pair holds a document labelled 1 and one labelled 0; every labelled document is in one. The model's chance that the first wins is
sigmoid(w.(x1 - x0)), fitted by logistic loss on feature differences. The threshold is the quantile of the latent
score at the share of label 0; scores are squashed so that this threshold reads ``cut``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.appended import appended
from jobledger.llm.near_dedup import shingle_sets
from jobledger.llm.shared import saved

#: Byte classes whose rates are features: each ASCII mark by itself, then wider classes.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = _i + 1
for _name, _range in enumerate([range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), [0x20], [0x0A], range(0x80, 0x100)]):
    _CLASS[list(_range)] = len(_MARKS) + 1 + _name
_CLASSES = len(_MARKS) + 7
N_FEATURES = 2 * _CLASSES + 10


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of dense features for each text; an empty text has zeros."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    hist = np.zeros((n, _CLASSES))
    for a in range(0, len(raw), tb.CHUNK):
        b = min(len(raw), a + tb.CHUNK)
        of_byte = np.repeat(np.arange(n), np.diff(np.clip(offsets, a, b)))
        hist += np.bincount(of_byte * _CLASSES + _CLASS[raw[a:b]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    rates = hist / np.maximum(length, 1)[:, None]
    starts, ends, first = tb.word_bounds(raw, offsets, tb.BLANK_WORDS)
    words, n_words = tb.word_hashes(raw, starts, ends), np.diff(first)
    of_word = np.repeat(np.arange(n), n_words)
    per_word = 1 / np.maximum(n_words, 1)
    sums = lambda x: np.bincount(of_word, weights=x, minlength=n) * per_word
    size = (ends - starts).astype(float)
    mean = sums(size)
    spread = np.sqrt(np.maximum(sums(size * size) - mean * mean, 0))
    again = np.zeros(len(words))
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    distinct = [np.diff(shingle_sets(raw, offsets, k)[1]) for k in (1, 2)]
    marked = np.zeros(len(words))
    if len(words):
        last = _CLASS[raw[ends - 1]]
        marked = ((last >= 1) & (last <= len(_MARKS))).astype(float)
    some = (n_words > 0).astype(float)
    dense = [
        np.log1p(n_words), mean / 10, spread / 10, sums(again), np.sqrt(sums(again)), distinct[0] * per_word, distinct[1] * per_word,
        np.minimum(1, distinct[0] / np.maximum(1, 12 * np.sqrt(n_words))), sums(marked), some,
    ]
    return np.concatenate([rates, np.log1p(200 * rates), np.stack(dense, axis=1)], axis=1)


@dataclass
class Ranker:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steep: float
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.steep * (self.latent(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _measured(docs: DataFrame, labels: DataFrame, where: str | None) -> DataFrame:
    """y, h (a hash of doc_id) and features (float32 bytes) of every labelled document. Texts stay in their task; only features are shuffled.

    Labels other than 0 and 1 and rows without doc_id are left out; a doc_id that is labelled or stored several times counts once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            for i, j in tb.row_groups(offsets):
                x = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    chosen = lambda df: df.where("doc_id is not null") if where is None else df.where("doc_id is not null").where(where)
    known = chosen(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    met = texts.mapInArrow(rows, "doc_id long, x binary").join(known, "doc_id")
    return met.groupBy("doc_id").agg(F.max("x").alias("x"), F.max("y").alias("y")).select("y", F.xxhash64("doc_id").alias("h"), "x")


def _summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all batches: a row of numbers for each partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = sorted(bytes(r.sums) for r in df.mapInArrow(run, "sums binary").collect())
    return np.sum([np.frombuffer(x) for x in sums], axis=0) if sums else None


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)


def _paired(rows: DataFrame, n: tuple[int, int], center: np.ndarray, scale: np.ndarray, pairs: int, seed: int) -> DataFrame:
    """d: chunks of feature differences, label 1 less label 0. Every row is in a pair; there are at least ``pairs``.

    Rows are dealt to blocks by their hash, about 4,096 of the commoner label in each. The rarer label is dealt to as many blocks
    as it takes for about 64 of it in each, so no block lacks one.
    """
    few = int(n[1] < n[0])
    blocks = max(1, n[1 - few] // 4096)
    copies = min(blocks, -(-64 * blocks // n[few]))
    rounds = max(1, -(-pairs // n[1 - few]))
    own = F.pmod("h", F.lit(blocks))
    again = F.when(F.col("y") == few, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("y", "h", "x", own.alias("own"), F.explode(again).alias("i")).select(F.pmod(F.col("own") + F.col("i"), F.lit(blocks)).alias("block"), "y", "h", "x")

    def pair(table: pa.Table) -> pa.Table:
        y, h = table.column("y").to_numpy(), table.column("h").to_numpy()
        x = np.clip((_matrix(table.column("x")) - center) / scale, -8, 8)
        draw = np.random.default_rng([seed, table.column("block")[0].as_py()])
        order = np.lexsort((h, y))  # the same order of rows in every run
        good, bad = order[y[order] == 1], order[y[order] == 0]
        out = []
        for _ in range(rounds if len(good) and len(bad) else 0):
            both = max(len(good), len(bad))
            a, b = np.resize(draw.permutation(good), both), np.resize(draw.permutation(bad), both)
            out += [(x[a[k : k + 512]] - x[b[k : k + 512]]).astype(np.float32).tobytes() for k in range(0, both, 512)]
        return pa.table({"d": pa.array(out, pa.binary())})

    return dealt.groupBy("block").applyInArrow(pair, "d binary")


def _least_loss(pairs: DataFrame, ridge: float = 1e-3, most: int = 60) -> np.ndarray:
    """Weights of least mean logistic loss over all pairs, plus ``ridge`` / 2 times their square, by Newton's method: a pass for each step."""
    w = before = step = np.zeros(N_FEATURES)
    least = np.inf
    for _ in range(most):

        def part(batch: pa.RecordBatch, w=w) -> np.ndarray:
            d = _matrix(batch.column(0))
            z = d @ w
            p = 1 / (1 + np.exp(np.clip(z, -40, 40)))
            return np.concatenate([[len(d), np.logaddexp(0, -z).sum()], -(d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).reshape(-1)])

        s = _summed(pairs, part)
        loss = s[1] / s[0] + ridge / 2 * (w @ w)
        if loss > least + 1e-12:  # too far: half the way
            step = step / 2
        else:
            least, before = loss, w
            g = s[2 : 2 + N_FEATURES] / s[0] + ridge * w
            step = -np.linalg.solve(s[2 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES) / s[0] + ridge * np.eye(N_FEATURES), g)
        if np.abs(step).max() < 1e-7:
            break
        w = before + step
    return np.round(before, 6)  # sums differ in their last digits from run to run


def _nth(values: DataFrame, n: int, most: int = 10_000) -> float:
    """The value at place ``n`` (from 0) of ``values(z)``, by counts of 65,536 bins of what is left."""
    while True:
        lo, hi, count = values.agg(F.min("z"), F.max("z"), F.count("*")).first()
        if lo == hi:
            return lo
        if count <= most:
            return sorted(r.z for r in values.collect())[n]
        bins = F.floor((F.col("z") - lo) / (hi - lo) * 65_536)
        for b, size in sorted((r.b, r["count"]) for r in values.groupBy(bins.alias("b")).count().collect()):
            if n < size:
                break
            n -= size
        values = values.where(bins == b)


def fit(docs: DataFrame, labels: DataFrame, pairs: int = 60_000, cut: float = 0.3, where: str | None = None, seed: int = 11) -> Ranker:
    """A ranker from every labelled document (``where``: an expression on doc_id), each in a preference pair and ``pairs`` pairs at least.

    Features, pairs and latent scores are tables; sums of numbers and bin counts reach the driver.
    """
    rows = saved(_measured(docs, labels, where))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y, x = batch.column(0).to_numpy(), _matrix(batch.column(2))
        return np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    s = _summed(rows, moments)
    n = (0, 0) if s is None else (int(s[0]), int(s[1]))
    if not all(n):  # nothing to rank: every text gets the same score, on the side of the label that there is
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 1.0 if n[0] else -1.0, 1.0, cut)
    center = s[2 : 2 + N_FEATURES] / sum(n)
    scale = np.sqrt(np.maximum(s[2 + N_FEATURES :] / sum(n) - center * center, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    center, scale = np.round(center, 9), np.round(scale, 9)
    ranker = Ranker(center, scale, _least_loss(saved(_paired(rows, n, center, scale, pairs, seed))), 0.0, 1.0, cut)

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranker.latent(_matrix(batch.column(0))))], names=["z"])

    z = saved(rows.select("x").mapInArrow(latent, "z double"))
    ranker.threshold = (_nth(z, n[0] - 1) + _nth(z, n[0])) / 2
    return ranker


def score(docs: DataFrame, ranker: Ranker, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` -> row (struct of the input's columns, or of ``keep``), score (0 to 1), predicted (1 if score >= the cut).

    Null and empty texts have the features of a text without words. Whole texts are read; nothing is shuffled.
    """

    def make(raw, offsets):
        p = ranker.scores(features(raw, offsets))
        return [pa.array(p), pa.array((p >= ranker.cut).astype(np.int32))]

    return appended(docs, make, "score double, predicted int", keep=keep)
