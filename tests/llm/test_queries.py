"""Registered queries against their SQL, or against what the contract says, on a small folder."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from jobledger.llm import queries
from tests.oracle import check

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def documents(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def removed(docs, length=50):
    """By dictionary: (n_bytes, n_removed, n_spans, digest) of each (doc_id, bytes), in doc_id order."""
    first, out = {}, {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, b in docs:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_shared_passages(spark, sf_dir):
    want = removed([(i, t.encode()) for i, t in documents(spark, sf_dir)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_shared_passages(spark, sf_dir).collect()}
    assert got == want


def test_lm_counts_and_base(spark, sf_dir):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0d]+", t.translate(UPPER)), None] for i, t in documents(spark, sf_dir)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = {}
    for i, ws in tokens.items():
        for w in ws if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    assert set(rows) == set(tokens)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_nearest_finds_them(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op8_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == min(20, len(ids) - 1)
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True) and ids[q] not in {m[1] for m in mine}
        for _, v, score in mine:
            assert score == pytest.approx(float(x[np.flatnonzero(ids == v)[0]] @ x[q]), abs=1e-12)
        hit, total = hit + len(best & {m[1] for m in mine}), total + 20
    assert hit / total >= 0.9


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op3_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_toxicity_separates(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    assert np.mean([r.rejected for r in rows if r.toxic == 1]) > 0.7
    assert np.mean([r.rejected for r in rows if r.toxic == 0]) < 0.03
    assert all(0 <= r.severity <= 3 for r in rows)


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        rows = out.collect()
        out = spark.createDataFrame(rows, out.schema)
        assert 0 < len(rows) <= docs.count()
        docs = out
    assert {"doc_id", "text", "mix_taken"} <= set(docs.columns)
