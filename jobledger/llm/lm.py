"""Scoring texts with a hashed maximum-entropy language model.

P(word | context) = P(class | context) * P(member | class, context) * P(group | class, context) * P(word | group). A word's class comes from its
ending, so unseen words have one; endings are clustered by the endings that they stand beside. The most frequent words
of a class are members of their own (:class:`Shape` says how many). All others share one member and fall into groups of the class by a hash, so that
every word, known or not, is predicted from context; within its group a word has its smoothed training count. The softmaxes sum weight rows of hashed features of the
context: word and word-pair n-grams, pairs of neighbouring classes, and pairs that skip two words. Every factor is normalised.

Counting, training and scoring are separate passes over all documents:

1. counts: batches send their distinct words with counts, by hash bucket; the totals are a table in the shared folder;
2. training: texts are dealt into shards by a hash, however they are stored; each shard takes gradient steps from the same
   start in the order of that hash, and the weights are averaged by tokens in Spark;
3. scoring: texts are dealt into batches, each asks the count table for its distinct words once, and is scored in
   numpy from the answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.shared import saved

U64 = np.uint64
CLASSES, GROUPS = 32, 32
ENDING, MARKS = 31, 30  # classes of the end of a text and of words without letters or digits
SUFFIXES = 1024  # hashed word endings; the last two are those of the classes above
END = U64(0x2545F4914F6CDD1D)
BESIDE = 16  # pieces of the table of neighbouring endings
_LETTER = tb.ALNUM_WORDS


@dataclass(frozen=True)
class Shape:
    """Size of the model: members of a class (the last ``members`` - 1 are words of their own), bits of hashed feature rows."""

    members: int = 32
    hashed_bits: int = 12

    @property
    def class_rows(self) -> int:
        return 2 * CLASSES * CLASSES + 2 * (1 << self.hashed_bits)

    @property
    def member_rows(self) -> int:
        return CLASSES * CLASSES + (1 << self.hashed_bits)


def token_stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, hashed endings, n + 1 offsets) of the words of each text and its end."""
    starts, ends, first = tb.word_bounds(raw, offsets, tb.BLANK_WORDS)
    n = len(offsets) - 1
    bounds = first + np.arange(n + 1)
    h, c = np.full(bounds[-1], END, dtype=U64), np.full(bounds[-1], SUFFIXES - 1, dtype=np.uint16)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    h[at] = tb.word_hashes(raw, starts, ends)
    if len(starts):
        e = ends.copy()
        for _ in range(4):
            e -= (e - 1 > starts) & ~_LETTER[raw[e - 1]]
        low = tb._LOWER[raw[e - 1]].astype(U64)
        low |= np.where(e - 2 >= starts, tb._LOWER[raw[np.maximum(e - 2, 0)]], 0).astype(U64) << U64(8)
        c[at] = np.where(_LETTER[raw[e - 1]], (tb.mix(low + U64(77)) >> U64(32)) % U64(SUFFIXES - 2), U64(SUFFIXES - 2)).astype(np.uint16)
    return h, c, bounds


def group_of(h: np.ndarray) -> np.ndarray:
    """The group of each word that isn't a member of its own."""
    return (tb.mix(h ^ U64(0x6A09E667F3BCC909)) >> U64(32)).astype(np.int64) * GROUPS >> 32


def context_rows(h: np.ndarray, c: np.ndarray, bounds: np.ndarray, shape: Shape, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the contexts of the tokens in ``part``, for classes (4 of them) and for members (2)."""
    begin, end, _ = part.indices(len(h))
    at = np.arange(begin, end)
    place = at - bounds[np.searchsorted(bounds, at, "right") - 1]

    def back(x: np.ndarray, k: int, pad) -> np.ndarray:
        out = np.full(end - begin, pad, dtype=x.dtype)
        low = max(begin - k, 0)
        out[low - begin + k :] = x[low : max(end - k, low)]
        out[place < k] = pad
        return out

    c1, c2, c3, c4 = (back(c, k, ENDING).astype(np.int32) for k in (1, 2, 3, 4))
    h1, h2 = back(h, 1, U64(0)), back(h, 2, U64(0))
    top = lambda x: (tb.mix(x) >> U64(64 - shape.hashed_bits)).astype(np.int32)
    pairs, hashed = CLASSES * CLASSES, 1 << shape.hashed_bits
    rows = np.stack([
        c1 * CLASSES + c2, pairs + c3 * CLASSES + c4, 2 * pairs + top(h1 ^ U64(0x1D8E4E27C47D124F)),
        2 * pairs + hashed + top(h1 * U64(0xD6E8FEB86659FD93) + h2),
    ])
    mine = c[begin:end].astype(np.int32)
    members = np.stack([mine * CLASSES + c1, pairs + top(h1 ^ (mine.astype(U64) + U64(1)) * U64(0x9E6C63D0876A9A99))])
    narrow = np.uint16 if shape.class_rows < 1 << 16 else np.int32  # 16 bits sort faster
    return rows.astype(narrow), members.astype(narrow)


def cluster_endings(beside: np.ndarray, rounds: int = 25, dims: int = 24) -> np.ndarray:
    """A class for each hashed ending, from counts of endings that follow each other: weighted k-means on a low-rank view."""
    of = np.full(SUFFIXES, ENDING, dtype=np.uint8)
    of[SUFFIXES - 2] = MARKS
    words = np.arange(SUFFIXES - 2)
    of[words] = words % MARKS
    weight = beside.sum(axis=1)[words].astype(float)
    live = np.flatnonzero(weight > 0)
    if len(live) <= MARKS:
        of[live] = np.arange(len(live))
        return of
    both = np.concatenate([beside[live], beside[:, live].T], axis=1).astype(float)
    share = both / np.maximum(both.sum(axis=1, keepdims=True), 1)
    usual = (both.sum(axis=0) + 0.5) / both.sum()
    x = (np.sqrt(share) - np.sqrt(usual)) * np.sqrt(weight[live] / (weight[live] + 50))[:, None]
    u, sv, _ = np.linalg.svd(x, full_matrices=False)
    x = u[:, :dims] * sv[:dims]
    mass = np.sqrt(weight[live])
    centers = [int(np.argmax(mass))]
    far = ((x - x[centers[0]]) ** 2).sum(axis=1)
    for _ in range(MARKS - 1):
        centers.append(int(np.argmax(far * mass)))
        far = np.minimum(far, ((x - x[centers[-1]]) ** 2).sum(axis=1))
    c = x[centers]
    for _ in range(rounds):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(MARKS):
            if (near == k).any():
                c[k] = np.average(x[near == k], axis=0, weights=mass[near == k])
    of[live] = near
    return of


@dataclass
class Heads:
    """The frequent words that are members of their own: sorted hashes, and the member number of each (1 and up)."""

    of_suffix: np.ndarray
    hashes: np.ndarray
    member: np.ndarray
    closed: np.ndarray  # classes x members: 0, or a large negative number where there is no such member

    def of(self, h: np.ndarray) -> np.ndarray:
        if len(self.hashes) == 0:
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.member[at], 0)


def _gathered(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(w, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(w, r, axis=0)
    return z


def _row_max(z: np.ndarray) -> np.ndarray:
    """The largest of each row, by halving the columns."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        m = np.maximum(z[:, :half], z[:, half : 2 * half])
        if z.shape[1] % 2:
            m[:, 0] = np.maximum(m[:, 0], z[:, -1])
        z = m
    return z


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _run_sums(g: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of the rows of ``g`` in ``order``. Pairs of columns are added as complex numbers, which is twice as fast."""
    x = np.take(g, order, axis=0)
    if x.shape[1] % 2:
        return np.add.reduceat(x, at, axis=0)
    return np.add.reduceat(x.view(np.complex64), at, axis=0).view(np.float32)


def _target_logs(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log softmax at each row's target; ``z`` is used up."""
    z -= _row_max(z)
    hit = z[np.arange(len(z)), target]
    return hit - np.log(_row_sums(np.exp(z, out=z)))


def _step(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, z: np.ndarray, target: np.ndarray, rate: float) -> None:
    """A gradient step on a batch; each weight row has its own step size (AdaGrad by row)."""
    z -= _row_max(z)
    g = np.exp(z, out=z)
    g /= _row_sums(g)[:, None]
    g[np.arange(len(g)), target] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        at = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        used = sorted_rows[at]
        s = _run_sums(g, order, at)
        seen[used] += np.einsum("ij,ij->i", s, s)
        w[used] -= rate * s / np.sqrt(seen[used])[:, None]


def _train(heads: Heads, shape: Shape, start: tuple[np.ndarray, ...], batch_tokens: int, rate: float, blocks: int):
    """Texts of a shard -> its weights after one pass, with its tokens, in blocks."""

    def run(batches):
        w, u, v = (x.copy() for x in start)
        seen_w, seen_u, seen_v = (np.full(len(x), 1.0, np.float32) for x in start)
        choice_of = heads.closed[:, 1] == 0
        tokens = 0
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(0))
            for i, j in tb.row_groups(offsets):
                h, c, bounds = token_stream(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                c = heads.of_suffix[c]
                for a in range(0, len(h), batch_tokens):
                    part = slice(a, a + batch_tokens)
                    rows, members = context_rows(h, c, bounds, shape, part)
                    mine = c[part]
                    _step(w, seen_w, rows, _gathered(w, rows), mine.astype(np.int64), rate)
                    member = heads.of(h[part])
                    own = np.flatnonzero(choice_of[mine])
                    if len(own):
                        z = _gathered(u, members[:, own]) + heads.closed[mine[own]]
                        _step(u, seen_u, members[:, own], z, member[own], rate)
                    rest = np.flatnonzero((member == 0) & (mine != ENDING))
                    if len(rest):
                        _step(v, seen_v, members[:, rest], _gathered(v, members[:, rest]), group_of(h[part][rest]), rate)
                tokens += len(h)
        if tokens:
            cut = np.array_split(np.concatenate([x.reshape(-1) for x in (w, u, v)]), blocks)
            task = [TaskContext.get().partitionId()] * blocks
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(task, pa.int32()), pa.array([tokens] * blocks, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in cut], pa.binary())], names=["block", "task", "tokens", "weights"])

    return run


AVERAGED = "block int, task int, tokens long, weights binary"
FAN_IN = 64


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    total = group["tokens"].sum()
    mean = sum(np.frombuffer(b, np.float32).astype(np.float64) * (t / total) for b, t in zip(group["weights"], group["tokens"], strict=True))
    return pd.DataFrame({"block": [int(group["block"].iloc[0])], "task": [int(group["task"].iloc[0])], "tokens": [int(total)], "weights": [mean.astype(np.float32).tobytes()]})


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _slices(h: np.ndarray, buckets: int):
    """(bucket, begin, end) of sorted hashes, for the buckets that they lie in."""
    of = _bucket(h, buckets)
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[cut].tolist(), cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=True)) if len(of) else []


def _counted(buckets: int, flush: int = 3_000_000):
    """Training texts -> distinct words of several batches with counts and classes, by bucket."""

    def rows(parts: list):
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, index, count = np.unique(h, return_index=True, return_counts=True)
        c = c[index]
        got = _slices(names, buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int32()), pa.array([names[a:b].tobytes() for _, a, b in got], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for _, a, b in got], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in got], pa.binary())],
            names=["bucket", "h", "n", "c"],
        )

    def neighbours(beside: np.ndarray):
        """Counts of neighbouring endings, as rows of buckets below zero."""
        out = []
        for b, part in enumerate(np.split(beside, BESIDE)):
            at = np.flatnonzero(part)
            out.append((-1 - b, at.astype(U64).tobytes(), part[at].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary()), pa.array([b""] * len(out), pa.binary())], names=["bucket", "h", "n", "c"])

    def run(batches):
        parts, held = [], 0
        beside = np.zeros(SUFFIXES * SUFFIXES, np.int64)
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(0))
            for i, j in tb.row_groups(offsets):
                h, c, _ = token_stream(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((h, c))
                pair = c[:-1].astype(np.int64) * SUFFIXES + c[1:]
                beside += np.bincount(pair[c[:-1] != SUFFIXES - 1], minlength=SUFFIXES * SUFFIXES)
                held += len(h)
                if held >= flush:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)
        yield neighbours(beside)

    return run


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """The words of a bucket with their counts over all batches; below zero, pairs of endings."""
    h = np.concatenate([np.frombuffer(b, U64) for b in group["h"]])
    n = np.concatenate([np.frombuffer(b, np.uint32) for b in group["n"]])
    c = np.concatenate([np.frombuffer(b, np.uint16) for b in group["c"]]) if group["bucket"].iloc[0] >= 0 else np.zeros(len(h), np.uint16)
    order = np.argsort(h, kind="stable")
    h, n, c = h[order], n[order].astype(np.int64), c[order]
    if len(h) == 0:
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "h": [b""], "n": [b""], "c": [b""]})
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "h": [h[at].tobytes()], "n": [np.add.reduceat(n, at).tobytes()], "c": [c[at].tobytes()]})


def _group_totals(of_suffix: np.ndarray):
    """Tokens and words of each class and group in a bucket."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                n, place = np.frombuffer(r.n, np.int64), of_suffix[np.frombuffer(r.c, np.uint16)].astype(np.int64) * GROUPS + group_of(np.frombuffer(r.h, U64))
                yield pd.DataFrame({"place": np.arange(CLASSES * GROUPS), "tokens": np.bincount(place, weights=n, minlength=CLASSES * GROUPS).astype(np.int64), "words": np.bincount(place, minlength=CLASSES * GROUPS)})

    return run


def _frequent(of_suffix: np.ndarray, members: int):
    """The most frequent words of each class in a bucket."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                h, n, c = np.frombuffer(r.h, np.int64), np.frombuffer(r.n, np.int64), of_suffix[np.frombuffer(r.c, np.uint16)]
                order = np.lexsort((h, -n, c))
                first = np.searchsorted(c[order], np.arange(CLASSES))
                take = order[np.arange(len(order)) - first[c[order]] < members - 1]
                yield pd.DataFrame({"h": h[take], "n": n[take], "c": c[take].astype(np.int32)})

    return run


@dataclass
class Model:
    heads: Heads
    shape: Shape
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    tokens: int  # N
    words: int  # V
    rest: np.ndarray  # by class and group: log10 of its (tokens + words + 1)


def start_weights(tokens: np.ndarray, held: np.ndarray, rest: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with which the softmaxes give the plain shares of classes, of their members and of their groups, whatever the context."""
    share = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
    w, u, v = np.zeros((shape.class_rows, CLASSES), np.float32), np.zeros((shape.member_rows, shape.members), np.float32), np.zeros((shape.member_rows, GROUPS), np.float32)
    w[: CLASSES * CLASSES] = share(tokens)
    u[: CLASSES * CLASSES] = np.repeat(share(held), CLASSES, axis=0)
    v[: CLASSES * CLASSES] = np.repeat(share(rest), CLASSES, axis=0)
    return w, u, v


def fit(texts: DataFrame, buckets: int, shards: int, shape: Shape, rounds: int = 1, batch_tokens: int = 8192, rate: float = 0.3) -> tuple[Model, DataFrame]:
    """``texts(doc_id, text)`` to learn from -> the model and the table of counts (bucket, h, n, c: one row for each bucket)."""
    counts = saved(texts.select("text").mapInArrow(_counted(buckets), "bucket int, h binary, n binary, c binary").groupBy("bucket").applyInPandas(_totals, "bucket int, h binary, n binary, c binary"))
    beside = np.zeros(SUFFIXES * SUFFIXES, np.int64)
    for r in counts.where("bucket < 0").select("bucket", "h", "n").collect():  # at most SUFFIXES ** 2 numbers
        beside[(-1 - r["bucket"]) * (SUFFIXES * SUFFIXES // BESIDE) + np.frombuffer(r["h"], np.int64)] = np.frombuffer(r["n"], np.int64)
    of_suffix = cluster_endings(beside.reshape(SUFFIXES, SUFFIXES))
    counts = counts.where("bucket >= 0")
    tokens, words = np.zeros((CLASSES, GROUPS), np.int64), np.zeros((CLASSES, GROUPS), np.int64)
    for place, n, distinct in counts.mapInPandas(_group_totals(of_suffix), "place int, tokens long, words long").groupBy("place").agg(F.sum("tokens"), F.sum("words")).collect():  # a row for each class and group
        tokens[divmod(place, GROUPS)], words[divmod(place, GROUPS)] = n, distinct
    best = Window.partitionBy("c").orderBy(F.desc("n"), "h")
    head = counts.mapInPandas(_frequent(of_suffix, shape.members), "h long, n long, c int").withColumn("m", F.row_number().over(best)).where((F.col("m") < shape.members) & (F.col("c") != ENDING) & (F.col("n") > 1)).toPandas()
    closed = np.full((CLASSES, shape.members), -1e9, dtype=np.float32)
    closed[:, 0] = 0
    closed[head["c"], head["m"]] = 0
    by = np.argsort(head["h"].to_numpy(np.int64).view(U64))
    heads = Heads(of_suffix, head["h"].to_numpy(np.int64).view(U64)[by], head["m"].to_numpy(np.int64)[by], closed)
    rest_tokens, rest_words = tokens.copy(), words.copy()
    place = (head["c"].to_numpy(np.int64), group_of(head["h"].to_numpy(np.int64).view(U64)))
    np.subtract.at(rest_tokens, place, head["n"].to_numpy(np.int64))
    np.subtract.at(rest_words, place, 1)
    held = np.zeros((CLASSES, shape.members))
    held[head["c"], head["m"]] = head["n"]
    held[:, 0] = rest_tokens.sum(axis=1)
    weights = start_weights(tokens.sum(axis=1), held, rest_tokens, shape)
    if tokens.sum():
        place = F.xxhash64("doc_id", "text")
        dealt = texts.select("text", place.alias("place")).repartition(shards, "place").sortWithinPartitions("place").select("text")
        for _ in range(rounds):
            blocks = 16
            mean = dealt.mapInArrow(_train(heads, shape, weights, batch_tokens, rate, blocks), AVERAGED)
            tasks = shards
            while tasks > FAN_IN:  # a tree, so that no task reads more than FAN_IN pieces of weights
                mean = mean.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("block", "task").applyInPandas(_mean, AVERAGED)
                tasks = -(-tasks // FAN_IN)
            mean = mean.groupBy("block").applyInPandas(_mean, AVERAGED).collect()
            flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["block"])])
            weights = tuple(x.reshape(w.shape).copy() for x, w in zip(np.split(flat, np.cumsum([w.size for w in weights])[:-1]), weights, strict=True))
    return Model(heads, shape, *weights, int(tokens.sum()), int(words.sum()), np.log10(rest_tokens + rest_words + 1.0)), counts


def _streams(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    raw, offsets = tb.text_buffer(pa.array(group["text"], pa.large_string()))
    return [token_stream(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tb.row_groups(offsets)]


def _distinct(streams: list) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(h) for h, _, _ in streams]))


def _ask(buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h = _distinct(_streams(group))
        got = _slices(h, buckets)
        return pd.DataFrame({"g": int(group["g"].iloc[0]), "bucket": [b for b, _, _ in got], "h": [h[a:b].tobytes() for _, a, b in got]})

    return run


def _reply(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    h = np.concatenate([np.frombuffer(b, U64) for b in counts["h"]]) if len(counts) else np.zeros(0, U64)
    n = np.concatenate([np.frombuffer(b, np.int64) for b in counts["n"]]) if len(counts) else np.zeros(0, np.int64)
    out = []
    for b in asked["h"]:
        q = np.frombuffer(b, U64)
        at = np.minimum(np.searchsorted(h, q), max(len(h) - 1, 0))
        found = np.where(h[at] == q, n[at], 0) if len(h) else np.zeros(len(q), np.int64)
        out.append((found if found.max(initial=0) > 0xFFFFFFFF else found.astype(np.uint32)).tobytes())
    return pd.DataFrame({"g": asked["g"], "bucket": asked["bucket"], "size": [len(b) // 8 for b in asked["h"]], "n": out})


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(model: Model):
    def run(group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if len(group) == 0:
            return pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        replies = replies.sort_values("bucket")
        n = np.concatenate([np.frombuffer(b, np.uint32 if len(b) == 4 * s else np.int64).astype(np.int64) for b, s in zip(replies["n"], replies["size"], strict=True)])
        streams = _streams(group)
        names = _distinct(streams)
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for h, c, bounds in streams:
            c = model.heads.of_suffix[c]
            count = n[np.searchsorted(names, h)]
            logs = np.log10(count + 1.0)
            base = logs - np.log10(model.tokens + model.words + 1.0)
            for x, v in zip(columns, (np.diff(bounds), np.add.reduceat(count > 0, bounds[:-1], dtype=np.int64), np.add.reduceat(base, bounds[:-1]), np.add.reduceat(_token_scores(model, h, c, bounds, logs), bounds[:-1])), strict=True):
                x.append(v)
        tokens, known, base, score = (np.concatenate(x) for x in columns)
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").to_numpy(dtype=object), "held_out": group["held_out"].to_numpy(), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})

    return run


def _token_scores(model: Model, h: np.ndarray, c: np.ndarray, bounds: np.ndarray, logs: np.ndarray, step: int = 8192) -> np.ndarray:
    """log10 P of each token in its context."""
    out = np.empty(len(h))
    choice_of = model.heads.closed[:, 1] == 0
    for a in range(0, len(h), step):
        part = slice(a, a + step)
        rows, members = context_rows(h, c, bounds, model.shape, part)
        mine, member = c[part], model.heads.of(h[part])
        got = np.zeros(len(mine))
        rest = np.flatnonzero((member == 0) & (mine != ENDING))  # the end is the only one of its class
        if len(rest):
            group = group_of(h[part][rest])
            got[rest] = logs[part][rest] - model.rest[mine[rest], group] + _target_logs(_gathered(model.v, members[:, rest]), group) / np.log(10)
        got += _target_logs(_gathered(model.w, rows), mine.astype(np.int64)) / np.log(10)
        own = np.flatnonzero(choice_of[mine])
        if len(own):
            got[own] += _target_logs(_gathered(model.u, members[:, own]) + model.heads.closed[mine[own]], member[own]) / np.log(10)
        out[part] = got
    return out


def score_texts(docs: DataFrame, held_out_rest: int = 2, of: int = 7, batch_bytes: int = 8 << 20, shard_bytes: int = 32 << 20, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """``docs(doc_id, text)`` -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Texts whose crc32(doc_id as text) mod ``of`` is ``held_out_rest`` are held out of counting and training; a null
    doc_id is not. Tokens are the words of the whole text, A-Z lower-cased, and one end; a null or empty text is one
    end. Scores are log10 probabilities. Without any text to learn from, every token is unseen and the softmaxes are uniform. Rows that
    repeat a doc_id are scored each. Words are told apart by 64-bit hashes.

    Batches and shards are dealt by a hash and grow in number with the corpus, as do the buckets of the count table: rows
    and splits of the stored table change nothing but the last digits of a score. ``shape`` sets how many words are predicted from context and
    how many rows their features have; the model is sent to every task, so it is a parameter and doesn't grow by itself.
    """
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", F.coalesce(rest == held_out_rest, F.lit(False)))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    buckets = max(8, batches // 2)
    model, counts = fit(texts.where("not held_out").select("doc_id", "text"), buckets, max(1, -(-total // shard_bytes)), shape)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")).repartition(n, "g")
    asked = placed.groupBy("g").applyInPandas(_ask(buckets), "g int, bucket int, h binary")
    replies = asked.groupBy("bucket").cogroup(counts.select("bucket", "h", "n").groupBy("bucket")).applyInPandas(_reply, "g int, bucket int, size long, n binary")
    out = placed.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(_scores(model), RESULT)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
