"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are words and word prefixes of 4, 5 and 6 bytes (a stem with any ending), as exact 64-bit hashes. A bounded
vocabulary of those most associated with the label is kept, so unseen words can't collide with known ones. Grades:
0 is not toxic; labels tell no more, so toxic training rows get 1, 2 or 3 by thirds of how much wording they hold that the
other half of the sample, not their own, associates with the label. One weight vector is
shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), theta increasing. The result is the expected grade.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.appended import appended
from jobledger.llm.labelled import labelled_sample

U64 = np.uint64
GRADES = 4
PREFIXES = (4, 5, 6)
#: Standard deviations by which a feature's share among labelled texts must stand out to be kept.
LEAST_Z = 5
#: How many times commoner it must be among toxic texts: words of a language that is labelled more often are not.
LEAST_LIFT = 10
_BITS = 20


def occurrences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, their texts, words of each text)."""
    starts, ends, first = tb.word_bounds(raw, offsets, tb.ALNUM_WORDS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(starts) == 0:
        return np.zeros(0, U64), text, np.diff(first)
    found, owner = [], []
    for i, j in tb.word_runs(starts, ends):  # one word of more than a chunk by itself
        a, b, own = starts[i:j], ends[i:j], text[i:j]
        low, high = int(a[0]), int(b[-1])
        whole = None if high - low > tb.CHUNK else tb.prefix_hashes(tb._BYTE_LOWER[raw[low:high]])
        for p in (0, *PREFIXES):
            use = slice(None) if p == 0 else b - a > p
            x, y = a[use], b[use] if p == 0 else a[use] + p
            sums = tb.span_sums(raw, x, y) if whole is None else tb.span_hashes(whole, x - low, y - low)
            found.append(tb.mix(sums + (y - x).astype(U64) * U64(0xA24BAED4963EE407) + U64(0x632BE59BD9B4E019 if p else 0)))
            owner.append(own[use])
    return np.concatenate(found), np.concatenate(owner), np.diff(first)


def distinct_pairs(text: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) with their counts."""
    pair, count = np.unique(text.astype(np.int64) * width + feature, return_counts=True)
    return pair // width, pair % width, count


@dataclass
class Vocabulary:
    hashes: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.hashes >> U64(64 - _BITS)).astype(np.int64)] = True

    def __reduce__(self):
        return Vocabulary, (self.hashes,)

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, index, count) of known features, and words of each text."""
        h, text, n_words = occurrences(raw, offsets)
        near = np.flatnonzero(self.seen[(h >> U64(64 - _BITS)).astype(np.int64)])
        h, text = h[near], text[near]
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        return (*distinct_pairs(text[known], at[known], max(1, len(self.hashes))), n_words)


@dataclass
class Model:
    words: Vocabulary
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text, for k = 0, 1, ..."""
        text, index, count, n_words = self.words.rows(raw, offsets)
        z = np.bincount(text, weights=self.weights[index] * np.log1p(count), minlength=len(n_words)) if len(index) else np.zeros(len(n_words))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thetas, -40, 40)))


def _associated(sample: DataFrame, most: int, least_docs: int) -> pd.DataFrame:
    """The features that speak for the label: h, pos, neg (documents that hold them); at most ``most`` rows.

    Only such ones: what speaks against it is that none occurs, so a text of unknown words is no suspect.
    """

    def count(batches):
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(0))
            y = np.asarray(batch.column(1))
            for i, j in tb.row_groups(offsets, 4 << 20):
                h, text, _ = occurrences(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names, index = np.unique(h, return_inverse=True)
                text, index, _ = distinct_pairs(text, index, max(1, len(names)))
                pos = np.bincount(index[y[i:j][text] == 1], minlength=len(names))
                neg = np.bincount(index[y[i:j][text] == 0], minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(neg)], names=["h", "pos", "neg"])

    counted = sample.mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= least_docs)
    total = sample.groupBy().agg(F.sum(F.col("y")).alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    p, n = max(total["p"] or 0, 1), max(total["n"] or 0, 1)
    # z score of the difference of document shares
    share = (F.col("pos") + F.col("neg")) / (p + n)
    z = (F.col("pos") / p - F.col("neg") / n) / F.sqrt(share * (1 - share) * (1 / p + 1 / n) + F.lit(1e-12))
    return counted.withColumn("z", z).where((F.col("z") > LEAST_Z) & (F.col("pos") / p >= LEAST_LIFT * F.col("neg") / n)).orderBy(F.col("z").desc(), "h").limit(most).toPandas()


def _vocabulary(found: pd.DataFrame) -> Vocabulary:
    return Vocabulary(np.sort(found["h"].to_numpy(np.int64).view(U64)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, most: int = 1 << 15, least_docs: int = 5, where: str | None = None) -> Model:
    """A model from at most ``per_class`` rows of either label; what reaches the driver is bounded by ``per_class`` and ``most``."""
    half = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)).cast("int")
    sample = labelled_sample(docs, labels, "toxic", per_class, where).select("text", "y", half.alias("half")).persist()
    try:
        words, *others = (_vocabulary(_associated(part, most, least_docs)) for part in (sample, sample.where("half = 1"), sample.where("half = 0")))

        def rows(batches):
            for batch in batches:
                raw, offsets = tb.text_buffer(batch.column(0))
                text, index, count, n_words = words.rows(raw, offsets)
                at = np.searchsorted(text, np.arange(len(n_words) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (index, count)]
                amounts = np.stack([np.bincount(t, weights=np.log1p(n), minlength=len(n_words)) for t, _, n, _ in (v.rows(raw, offsets) for v in others)])
                amount = amounts[np.asarray(batch.column(2)), np.arange(len(n_words))].astype(float)  # by the half that a text isn't in
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(amount), *lists], names=["y", "amount", "index", "count"])

        kept = sample.mapInArrow(rows, "y int, amount double, index array<int>, count array<int>").toPandas()
    finally:
        sample.unpersist()
    y = kept["y"].to_numpy(np.int64)
    if len(words.hashes) == 0 or len(set(y)) < 2:
        warnings.warn("no wording stands out among the toxic texts: nothing will be rejected", stacklevel=2)
        return Model(words, np.zeros(len(words.hashes)), np.full(GRADES - 1, 40.0))
    size = kept["index"].map(len).to_numpy()
    row = np.repeat(np.arange(len(kept)), size)
    index, count = np.concatenate(kept["index"].to_list()).astype(np.int64), np.concatenate(kept["count"].to_list())
    amount = kept["amount"].to_numpy()
    cuts = np.quantile(amount[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, amount, "right"), 0)
    return Model(words, *_ordinal(row, index, np.log1p(count), grade, len(words.hashes)))


def _ordinal(row: np.ndarray, index: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the cumulative-link likelihood; classes weigh alike."""
    n = len(grade)
    w, first, gaps = np.zeros(width), np.zeros(1), np.zeros(GRADES - 2)
    weight = (n / 2 / np.where(grade > 0, (grade > 0).sum(), (grade == 0).sum())) / n
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, first, gaps)]
    for t in range(1, rounds + 1):
        thetas = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weights=w[index] * x, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - thetas, -30, 30)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)
        slope = np.pad(p * (1 - p), ((0, 0), (1, 1)))
        d_z = -weight * (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / mass
        d_theta = np.zeros((n, GRADES - 1))
        for k in range(GRADES - 1):
            d_theta[:, k] = weight * slope[:, k + 1] * ((grade == k + 1).astype(float) - (grade == k)) / mass
        by_theta = d_theta.sum(axis=0)
        tail = np.cumsum(by_theta[::-1])[::-1]
        grads = [np.bincount(index, weights=d_z[row] * x, minlength=width) + l2 * w / n**0.5, tail[:1], tail[1:] * np.exp(gaps)]
        for v, g, (m, s) in zip((w, first, gaps), grads, state, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w, first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def score(docs: DataFrame, model: Model, reject_at: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` -> row (struct of the input's columns, or of ``keep``), severity (expected grade, 0 to 3), grade, rejected.

    Null, empty and wordless texts hold no feature and get the model's severity of such a text. A text is rejected if
    P(grade > 0) is at least ``reject_at``. Whole texts are scored; nothing is shuffled.
    """

    def make(raw, offsets):
        above = model.above(raw, offsets)
        return [pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0] >= reject_at)]

    return appended(docs, make, "severity double, grade int, rejected boolean", keep=keep)
