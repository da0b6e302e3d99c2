"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which recursive bisection cuts into equal parts (spectral order, then
balanced swaps that lower the cut). A softmax classifier learns which parts a vector's neighbours lie in. It places
every row of the table in its likeliest part and routes each query to its several likeliest ones, where all rows are
scored in double precision. Parts grow in number with the rows: where they would be too large, each is parted once more by a
classifier of its own, and queries are routed in two steps.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobledger.llm.labelled import hash_sample
from jobledger.llm.shared import saved


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others by inner product, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, k), dtype=np.int64)
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def bisect(graph: np.ndarray, nodes: np.ndarray, rng: np.random.Generator, swaps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` with few links between them."""
    n = len(nodes)
    inside = np.full(graph.shape[0], -1)
    inside[nodes] = np.arange(n)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = inside[graph[nodes].reshape(-1)]
    a, b = a[b >= 0], b[b >= 0]
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    walk = lambda v: (np.bincount(a, weights=v[b], minlength=n) + np.bincount(b, weights=v[a], minlength=n)) / degree
    v = rng.normal(size=n)
    for _ in range(60):
        v = v + walk(v)
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(swaps):  # as many of each side change over, those that gain most
        other = walk(np.where(side, 1.0, -1.0)) * degree
        gain = np.where(side, -other, other)
        left, right = np.flatnonzero(~side & (gain > 0)), np.flatnonzero(side & (gain > 0))
        m = min(len(left), len(right), max(1, n // 50))
        if m == 0:
            break
        side[left[np.argsort(-gain[left], kind="stable")[:m]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:m]]] = False
    return nodes[~side], nodes[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node; sizes differ by one at most on each halving."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, g, rng)]
    out = np.zeros(len(graph), dtype=np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)) @ self.weights + self.bias

    def likeliest(self, x: np.ndarray, m: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :m]


def fit_router(x: np.ndarray, parts: int, k: int = 20, rounds: int = 250, recall: float = 0.97) -> Router:
    """Graph, parts and classifier of a sample; the probes are as many as reach ``recall`` of the sample's own neighbours."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm > 0, norm, 1)
    n, d = x.shape
    while parts > 1 and n < 8 * parts:
        parts //= 2
    if parts <= 1 or n < 3:
        return Router(np.zeros((d, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, parts)
    # what is to be predicted: the parts of a vector and its neighbours
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].reshape(-1)), 1)
    np.add.at(target, (np.arange(n), part), graph.shape[1])
    target /= target.sum(axis=1, keepdims=True)
    w, b = np.zeros((d, parts)), np.zeros(parts)
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
    for t in range(1, rounds + 1):
        z = unit @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target) / n
        for v, g, (m, s) in zip((w, b), (unit.T @ e + 1e-6 * w, e.sum(axis=0)), state, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    router = Router(w, b, parts)
    home = router.likeliest(x, 1)[:, 0]
    ask = np.arange(0, n, max(1, n // 2000))
    order = router.likeliest(x[ask], parts)
    place = np.argsort(order, axis=1)  # rank of each part for each asked vector
    needed = np.take_along_axis(place, home[graph[ask]], axis=1)
    for m in range(1, parts + 1):
        if (needed < m).mean() >= recall:
            break
    router.probes = m
    return router


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (array<double>) of rows that take part: not null, not zero, all components finite, the usual length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).first()
    return rows.where(F.size("vec") == (usual["n"] if usual else 0))


@dataclass
class Tree:
    """Routers of one or two levels. A leaf's number is its part's number times ``width`` plus its place in it."""

    top: Router
    width: int
    inner: dict[int, Router]

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        part = self.top.likeliest(x, 1)[:, 0]
        out = part * self.width
        for p in np.unique(part):
            if p in self.inner:
                rows = np.flatnonzero(part == p)
                out[rows] += self.inner[p].likeliest(x[rows], 1)[:, 0]
        return out

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The leaves to look into for each vector."""
        found: list[list[np.ndarray]] = [[] for _ in x]
        parts = self.top.likeliest(x, self.top.probes)
        for p in np.unique(parts):
            rows = np.flatnonzero((parts == p).any(axis=1))
            inside = self.inner[p].likeliest(x[rows], self.inner[p].probes) if p in self.inner else np.zeros((len(rows), 1), np.int64)
            for row, leaves in zip(rows, inside, strict=True):
                found[row].append(p * self.width + leaves)
        return [np.concatenate(f) for f in found]


def levels(rows: int, parts: int, part_rows: int, most_parts: int) -> tuple[int, bool]:
    """(parts of a level, a power of two; two levels?) for so many rows."""
    leaves = -(-rows // part_rows)
    return (parts, False) if leaves <= parts else (min(most_parts, max(parts, 1 << math.isqrt(leaves - 1).bit_length())), True)


def fit_tree(entries: DataFrame, parts: int, part_rows: int, most_parts: int, sample: int) -> Tree | None:
    """A router fitted on ``sample`` of the ``entries(vec, h, g)``, and where parts are large one for each on a sample of its rows."""
    width, two = levels(entries.count(), parts, part_rows, most_parts)
    chosen = hash_sample(entries.select("vec", "h", "g"), sample, "h", "g").select("vec").toPandas()
    if chosen.empty:
        return None
    top = fit_router(np.stack(chosen["vec"].to_list()), width)
    if not two:
        return Tree(top, 1, {})

    def homes(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(part=top.likeliest(np.stack(batch["vec"].to_list()), 1)[:, 0].astype(np.int32))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "g"])
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "router": [pickle.dumps(fit_router(np.stack(group["vec"].to_list()), width))]})

    placed = saved(entries.select("vec", "h", "g").mapInPandas(homes, "vec array<double>, h long, g long, part int"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))  # a number for each of at most ``most_parts`` parts
    few = placed.join(F.broadcast(sizes), "part").where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("rows")).drop("rows")
    inner = {r["part"]: pickle.loads(r["router"]) for r in few.groupBy("part").applyInPandas(learn, "part int, router binary").collect()}  # noqa: S301  what this job has made
    return Tree(top, width, inner)


def nearest(embeddings: DataFrame, query_step: int = 20, top: int = 20, parts: int = 32, sample: int = 8192, block_rows: int = 16_384, part_rows: int = 131_072, most_parts: int = 256, block_queries: int = 65_536) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> query_id, rank, vec_id, score: the ``top`` nearest found of each query, by inner product.

    Queries are the rows whose vec_id is divisible by ``query_step``; candidates are all other rows. Vectors that are null,
    zero, hold null or non-finite components or have an unusual length take no part. Equal vectors are one entry with
    its ``top`` + 1 smallest ids, which is all that can be returned of them; ties go to the smaller vec_id. Rows that
    repeat a vec_id with the same vector count once; a vec_id with several vectors is a candidate with each, and as a query asks
    with the least of them (by components).

    Each router is fitted on ``sample`` vectors or about as many; every row is indexed. There are ``parts`` parts, or beyond
    ``part_rows`` rows for each about rows / ``part_rows`` in two levels of up to ``most_parts`` each, whose routers (at most ``most_parts`` + 1) all tasks get.
    A part is scored in blocks of about ``block_rows`` rows for about ``block_queries`` queries each, so a popular part still spreads by
    either, and a query's work follows the rows of the parts it probes.
    """
    spark = embeddings.sparkSession
    rows = usable_vectors(embeddings).withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(3), "vec"))
    same = Window.partitionBy("h", "g").orderBy("vec_id")
    # distinct vectors: dense_rank bounds what is kept of each before the shuffle
    few = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= top + 1)
    entries = saved(few.groupBy("h", "g").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("ids")))
    tree = fit_tree(entries, parts, part_rows, most_parts, sample)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def indexed(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(part=tree.homes(np.stack(batch["vec"].to_list())).astype(np.int32))

    def routed(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=[p.astype(np.int32) for p in tree.probes(np.stack(batch["vec"].to_list()))])

    placed = entries.select("vec", "ids").mapInPandas(indexed, "vec array<double>, ids array<long>, part int")
    # a number for each of at most ``most_parts`` ** 2 parts
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    index = placed.join(F.broadcast(blocks), "part").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int"))
    asked = rows.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    queries = asked.mapInPandas(routed, "vec_id long, vec array<double>, parts array<int>").select("vec_id", "vec", F.explode("parts").alias("part"))
    queries = saved(queries)
    # a number for each part again
    chunks = queries.groupBy(F.col("part").alias("q_part")).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("chunks"))
    q_blocks = blocks.toDF("q_part", "q_blocks").join(F.broadcast(chunks), "q_part")
    queries = queries.join(F.broadcast(q_blocks), F.col("part") == F.col("q_part")).withColumn("q_chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    queries = queries.select("vec_id", "vec", F.col("part").alias("q_part"), "q_chunk", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))
    # parts that no query probes are left out; each block meets every chunk of its part's queries
    index = index.join(F.broadcast(chunks), F.col("part") == F.col("q_part")).select("vec", "ids", "part", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    found = queries.groupBy("q_part", "q_block", "q_chunk").cogroup(index.groupBy("part", "block", "chunk")).applyInPandas(_rerank(top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _rerank(top: int):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(index):
            v = np.stack(index["vec"].to_list())
            ids = index["ids"].to_list()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q = np.stack(part["vec"].to_list())
                s = q @ v.T
                kth = np.partition(s, len(v) - min(top + 1, len(v)), axis=1)[:, len(v) - min(top + 1, len(v))]
                a, b = np.nonzero(s >= kth[:, None] - 1e-9 * np.abs(kth[:, None]))
                exact = np.zeros(len(a))
                for j in range(v.shape[1]):  # one order of summation for every block
                    exact += q[a, j] * v[b, j]
                n = np.array([len(ids[i]) for i in b])
                rows = pd.DataFrame({"query_id": np.repeat(part["vec_id"].to_numpy()[a], n), "vec_id": np.concatenate([ids[i] for i in b]), "score": np.repeat(exact, n)})
                rows = rows[rows["query_id"] != rows["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                out.append(rows.groupby("query_id", sort=False).head(top))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run
