"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns; operators against brute force at random."""

import hashlib
import math
import os
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobledger.llm import ann, chat, decontam, lm, mixing, near_dedup, quality, shared, substring_dedup, textbytes, toxicity
from jobledger.llm.components import components
from jobledger.llm.line_dedup import dedupe_lines
from tests.llm.test_queries import UPPER, removed

DOCS = "doc_id long, text string, source string, row string, component_id string, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_documents(spark):
    """Rows that operators must take as they are, with columns named like their results."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t\n"), (4, "one"), (5, "One two"), (6, "naïve café \U0001f600 déjà vu"), (7, long), (8, long), (9, long), (9, long), (10, "x" * 500), (None, "one two three four"), (None, None), (11, "a\n" * 300), (12, "one")]
    return spark.createDataFrame([(i, t, s, "r", "c", "w") for (i, t), s in zip(rows, [None, "a", "b", "a", "", None, "b", "b", "a", "a", "c", None, "c", "d", "a"], strict=True)], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, items):
    return spark.createDataFrame(items, "doc_id long, text string")


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    docs = []
    for g in range(12):
        base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.choice([2, 4, 30, 120]))]
        for _ in range(r.choice([1, 2, 9])):
            t = list(base)
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = "changed" + str(r.randrange(9))
            docs.append(" ".join(t))
    r.shuffle(docs)
    sets = [shingles(d, 3) for d in docs]
    want = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    for blocks in (4096, 2):  # whole classes, and classes cut into many blocks
        got = {x.doc_id: x for x in near_dedup.near_duplicates(texts(spark, list(enumerate(docs))), k=3, percent=85, sketch_docs=blocks).collect()}
        assert [got[i].component_id for i in range(len(docs))] == want
        assert [got[i].n_shingles for i in range(len(docs))] == [len(s) for s in sets]


def test_a_chained_class_moves_few_full_sets(spark, monkeypatch):
    """Texts that chain through common wording, each unlike almost all others: one candidate class of many blocks."""
    n, words = 1200, [f"w{i}" for i in range(8_500)]
    docs = [" ".join(words[7 * i : 7 * i + 60]) for i in range(n)]
    copies = {n + j: 100 * j for j in range(12)}
    docs += [docs[i][:-1] + "x" for i in copies.values()]
    sent = []
    comparisons = near_dedup.comparisons

    def counted(classes, *args):
        out = comparisons(classes, *args)
        largest = classes.groupBy("component").count().agg(F.max("count")).first()[0]
        sent.append((largest, out.select(F.explode("list")).count()))
        return out

    monkeypatch.setattr(near_dedup, "comparisons", counted)
    got = near_dedup.near_duplicates(texts(spark, list(enumerate(docs))), k=3, percent=85, sketch_docs=64).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: copies.get(i, i) for i in range(len(docs))}
    largest, sets = sent[0]
    assert largest > 1000 and sets < 4 * len(docs)  # 19 blocks of 64: comparing all of them would send each set to some twenty tasks


def test_several_texts_of_one_id_each_count(spark):
    base = " ".join(f"w{i}" for i in range(110))
    rows = [(1, " ".join(f"v{i}" for i in range(1000))), (1, base), (2, base + " more"), (3, " ".join(f"v{i}" for i in range(1001)))]
    for blocks in (512, 1):
        got = near_dedup.near_duplicates(texts(spark, rows), k=3, percent=85, sketch_docs=blocks).collect()
        assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1)}


def test_agreeing_is_a_tail_bound():
    least = near_dedup.agreeing(0.85, 128)
    draws = np.random.default_rng(5).binomial(128, 0.85, 200_000)
    assert 64 < least <= draws.min()


def test_words_in_pieces_are_the_same(monkeypatch):
    r = random.Random(3)
    long = [" ".join("".join(r.choices("aBcé,.", k=r.randrange(1, 9))) for _ in range(4000)), "", "x" * 9000, "one"]
    raw = np.frombuffer("".join(long).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in long)])
    whole = textbytes.word_bounds(raw, offsets, textbytes.BLANK_WORDS)
    hashes, found = textbytes.word_hashes(raw, *whole[:2]), sorted(zip(*toxicity.occurrences(raw, offsets)[:2], strict=True))
    monkeypatch.setattr(textbytes, "CHUNK", 1000)
    pieces = textbytes.word_bounds(raw, offsets, textbytes.BLANK_WORDS)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert (textbytes.span_sums(raw, *whole[:2], limit=1000) == textbytes.span_sums(raw, *whole[:2])).all() and (textbytes.word_hashes(raw, *pieces[:2]) == hashes).all()
    assert sorted(zip(*toxicity.occurrences(raw, offsets)[:2], strict=True)) == found


def test_a_long_text_needs_a_small_multiple_of_its_size():
    """What each operator holds while it works on one text of 6 MB, in multiples of the text."""
    r = random.Random(16)
    common = [w + str(i) for w in WORDS for i in range(50)]
    text = " ".join(r.choices(common, k=900_000))[: 6 << 20]
    raw, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 6 << 20])
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text]), pa.array([0], pa.int64())], names=["doc_id", "text", "tag"])
    asked = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([0], pa.int32()), pa.array([text])], names=["doc_id", "tag", "text"])
    index = decontam.ItemIndex([1], [" ".join(common[:200])], 10, 5)
    words = toxicity.Vocabulary(np.sort(np.array([textbytes.hash_word(w) for w in common[:50]], np.uint64)))
    textbytes.powers(10), textbytes.powers(10, inverse=True)  # tables that stay
    work = {
        "toxicity": (lambda: words.rows(raw, offsets), 30), "near_dedup": (lambda: list(near_dedup._sketch_rows(5, 51, 8)([batch])), 25), "quality": (lambda: quality.features(raw, offsets), 25),
        "passages": (lambda: list(substring_dedup._ask(substring_dedup.Shape())([asked])), 25), "decontamination": (lambda: decontam._scan(index)(raw, offsets), 25), "language model": (lambda: lm.token_stream(raw, offsets), 20),
    }
    peaks = {}
    for name, (f, _) in work.items():
        tracemalloc.start()
        f()
        peaks[name] = tracemalloc.get_traced_memory()[1] / len(raw)
        tracemalloc.stop()
    assert all(peaks[name] < most for name, (_, most) in work.items()), peaks


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    sets = [h[:1], h[:3], h[:600], h[300:900], h[:0]]
    bounds = np.cumsum([0, *map(len, sets)])
    s = near_dedup.sketches(np.concatenate(sets), bounds, 408)
    top = np.iinfo(np.uint64).max
    assert (s[:4] != top).all() and (s[4] == top).all()
    assert abs((s[2] == s[3]).mean() - 1 / 3) < 0.1


def test_near_duplicates_on_odd_rows(spark):
    got = near_dedup.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 15
    by = {x.doc_id: x for x in got if x.doc_id is not None}
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3))
    assert by[8].component_id == by[9].component_id == 7 and not by[9].kept and by[12].component_id == 4
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_lines_on_odd_rows(spark):
    line = "This line is long enough to count as one, indeed."
    rows = [(i, f"{i}\n  {line.upper() if i % 2 else line}\t\nend") for i in range(5)] + [(5, None), (6, ""), (None, f"{line}\nx"), (4, f"{line}\n{line}")]
    got = {(x.row.doc_id, x.row.text): x for x in dedupe_lines(texts(spark, rows)).collect()}
    assert [got[rows[i]].kept_text for i in range(4)] == [f"{i}\nend" for i in range(4)]
    assert got[rows[4]].n_dropped == 0 and got[rows[8]].n_dropped == 0
    assert got[(None, f"{line}\nx")].kept_text == "x"
    assert (got[(5, None)].n_lines, got[(5, None)].kept_text) == (1, "") and got[(6, "")].n_lines == 1
    out = dedupe_lines(odd_documents(spark))
    assert out.count() == 15 and {x.n_lines for x in out.where("row.doc_id = 11").collect()} == {301}
    assert dedupe_lines(no_documents(spark)).count() == 0


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [" ".join(r.choices(WORDS, k=n)) for n in (3, 9, 10, 11, 40, 40)] + [None, "", "...", "Ärger-über 7"]
    docs = []
    for _ in range(60):
        w = r.choices(WORDS, k=r.randrange(60))
        if r.random() < 0.6:
            src = r.choice(items[:6]).split()
            a = r.randrange(len(src))
            w[r.randrange(len(w) + 1) : 0] = src[a : a + r.randrange(1, 30)]
        docs.append(r.choice(", |\n").join(w).title())
    docs += ["", None, "ärger ÜBER 7 Ärger über 7"]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block_bytes in (32 << 20, 120):
        got = {x.row.doc_id: x for x in decontam.decontaminate(texts(spark, list(enumerate(docs))), bench, block_bytes=block_bytes, keep=["doc_id"]).collect()}
        for i, t in enumerate(docs):
            w, hit, found = split(t), set(), set()
            for item, s in enumerate(items):
                v = split(s)
                n = min(len(v), 10)
                for a in range(len(v) - n + 1) if n else ():
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == v[a : a + n]:
                            hit.update(range(p, p + n))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))
            assert sum(s["end"] - s["begin"] for s in got[i].spans) == len(hit)


def test_decontamination_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = decontam.decontaminate(odd_documents(spark), bench).collect()
    assert len(got) == 15 and sum(x.n_hit for x in got) == 4
    assert decontam.decontaminate(no_documents(spark), bench).count() == 0
    assert decontam.decontaminate(odd_documents(spark), bench.where("false")).where("n_hit > 0").count() == 0


def test_repeated_words_cost_no_more(spark):
    """20,000 and 2,000 times the same word: neither their product nor the repeats of a row take part."""
    words = ["same"] * 20_000
    index = decontam.ItemIndex([1, 2, 3], [" ".join(words[:2000]), " ".join(words[:2000]) + " end", "other"], 10, 5)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, first = textbytes.word_bounds(raw, np.array([0, len(raw)]), textbytes.ALNUM_WORDS)
    hashes = textbytes.word_hashes(raw, starts, ends)
    tracemalloc.start()
    begin, end, held = index.matches(hashes, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(begin) == 19_991 and (end - begin == 10).all() and held.tolist() == [0, 1] and peak < 20 << 20
    bench = spark.createDataFrame([(1, " ".join(words[:40]))] * 50, "item_id long, text string")
    got = decontam.decontaminate(texts(spark, [(1, " ".join(words)), (2, "same " * 9)]), bench, block_bytes=300).collect()
    assert [(x.n_hit, x["items"]) for x in sorted(got, key=lambda x: x.row.doc_id)] == [(20_000, ["1"]), (0, [])]


def test_blocks_of_items_are_bounded(spark):
    r = random.Random(5)
    items = spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=12))) for i in range(200)] + [(900, " ".join(r.choices(WORDS, k=400)))], "item_id long, text string")
    blocks = decontam.item_blocks(items, 1500)
    sizes = [b.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first() for b in blocks]
    assert all(n is None or n <= 1500 or longest > 1500 for n, longest in sizes) and sum(n or 0 for n, _ in sizes) == items.agg(F.sum(F.octet_length("text"))).first()[0]


def test_winnowing_guarantee():
    grams = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    chosen = decontam.winnow(grams, 6)
    assert all((chosen[i : i + 6] & (grams[i : i + 6] == grams[i : i + 6].min())).any() for i in range(395))


def test_passages_equal_brute_force(spark):
    r = random.Random(9)
    shared = ["".join(r.choices("abcdé \n", k=n)) for n in (30, 49, 50, 51, 80, 300)]
    docs = []
    for _ in range(40):
        parts = [r.choice([*shared, "".join(r.choices("abcdefgh", k=r.randrange(120)))]) for _ in range(r.randrange(6))]
        if parts and r.random() < 0.5:
            p = r.choice(shared)
            parts.append(p[r.randrange(10) : len(p) - r.randrange(10)])
        docs.append("".join(parts))
    docs += ["z" * 400, "y" + "z" * 120, docs[3], docs[3], ""]
    want = removed([(i, d.encode()) for i, d in enumerate(docs)])
    for bucket_bytes in (8 << 20, 1 << 10):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.remove_shared(texts(spark, list(enumerate(docs))), bucket_bytes=bucket_bytes).collect()}
        assert got == want


def test_hot_anchors_take_their_own_way(spark, monkeypatch):
    r = random.Random(10)
    passage = "".join(r.choices("abcdefghij ", k=90))
    docs = ["".join(r.choices("klmnop", k=60)) + passage + "".join(r.choices("klmnop", k=60)) for _ in range(30)]
    want = removed([(i, d.encode()) for i, d in enumerate(docs)])
    answer = substring_dedup._answer
    monkeypatch.setattr(substring_dedup, "_answer", lambda hot_from, groups: answer(1, groups))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.remove_shared(texts(spark, list(enumerate(docs))).repartition(5)).collect()}
    assert got == want


def test_hot_anchors_are_sent_as_windows():
    r = random.Random(10)
    passage = "".join(r.choices("abcdefghij ", k=90))
    docs = ["".join(r.choices("klmnop", k=60)) + passage + "".join(r.choices("klmnop", k=60)) for _ in range(30)]
    shape = substring_dedup.Shape()
    columns = [pa.array(range(30), pa.int64()), pa.array([0] * 30, pa.int32()), pa.array(docs)]
    asked = pa.Table.from_batches(substring_dedup._ask(shape)([pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "text"])])).to_pandas()
    shared = pd.concat([substring_dedup._answer(2, shape.groups)(group) for _, group in asked.groupby("bucket")])
    hot = np.array(sorted(x for v in shared["hot"].dropna() for x in v), dtype=np.int64).view(np.uint64)
    places = pd.concat([substring_dedup._places(group) for _, group in shared[shared["hot"].isna()].groupby("g")]).set_index("doc_id")["pos"]
    assert len(hot) and len(places) == 30
    marked = pa.RecordBatch.from_arrays([*columns, pa.array([places[i] for i in range(30)], pa.binary())], names=["doc_id", "tag", "text", "pos"])
    for known in (hot, hot[:0]):
        group = pa.Table.from_batches(substring_dedup._contexts(shape, known)([marked])).to_pandas()
        whole, parts = (substring_dedup._join(substring_dedup._decide(shape, share)(group)).sort_values("doc_id").to_dict("records") for share in (100_000, 3))
        assert whole == parts and len(whole) == 29
    sent = [x for b in substring_dedup._contexts(shape, hot)([marked]) for x in b.to_pylist() if x["h"] is not None]
    assert sent
    for x in sent:
        h, c = np.frombuffer(x["h"], np.uint64), substring_dedup._unpacked(x["bytes"], np.uint8).reshape(-1, shape.context)
        assert (h == substring_dedup._row_hashes(c[:, shape.reach :])).all() and (substring_dedup._unpacked(x["left"], np.uint8) == 0).all()


def test_hot_windows_keep_memory_bounded():
    """Many documents with one hot passage and near-equal contexts around it: what one step holds doesn't follow their number."""
    r = random.Random(12)
    passage = "".join(r.choices("abcdefghij ", k=80))
    shape = substring_dedup.Shape()
    n = 8000
    docs = ["".join(r.choices("klmnop", k=40)) + passage + "".join(r.choices("klmnop", k=40)) for _ in range(n)]
    raw = np.frombuffer("".join(docs).encode(), np.uint8)
    at, h = substring_dedup.anchors(raw, np.arange(n + 1) * 160, shape)
    inside = (at % 160 >= 20) & (at % 160 < 120)
    pos = [(at[(at // 160 == i) & inside] % 160).astype(np.uint32).tobytes() for i in range(20)]
    pos += [pos[i % 20] for i in range(n - 20)]
    columns = [pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array(docs), pa.array(pos, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "text", "pos"])
    hot = np.unique(h[inside]) & substring_dedup._LOW
    peaks = []
    for rows in (n // 4, n):
        tracemalloc.start()
        for _ in substring_dedup._contexts(shape, hot)([batch.slice(0, rows)]):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 150 << 20 and peaks[1] < 3 * peaks[0]


def test_very_long_texts_in_pieces(spark):
    r = random.Random(13)
    long = "".join(r.choices("abcdefgh ", k=3_000_000))
    docs = [(1, long[500_000:500_400]), (2, long), (3, "x" * 100 + long[262_100:262_200]), (4, long[1_000_000:] + "end")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in substring_dedup.remove_shared(texts(spark, docs)).drop("kept").collect()}
    assert got == {1: (400, 0, 0), 2: (3_000_000, 400, 1), 3: (200, 100, 1), 4: (2_000_003, 2_000_000, 1)}


def test_suffix_sort():
    rng = np.random.default_rng(6)
    c = rng.integers(97, 99, (500, 82)).astype(np.uint8)
    c[100:160] = c[40:100]
    s = substring_dedup.Suffixes(c, 32, 50)
    h = rng.integers(0, 3, 500).astype(np.uint64)
    order = s.sort(h)
    keys = [(int(h[i]), c[i, 32:].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert (s.common(np.arange(100, 160), np.arange(40, 100)) == 50).all()


def test_passages_on_odd_rows(spark):
    got = substring_dedup.remove_shared(odd_documents(spark)).collect()
    assert len(got) == 15
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert by[1][0].n_bytes == 0 and by[7][0].n_removed == 0 and by[8][0].n_removed == by[8][0].n_bytes and len(by[9]) == 2 and all(x.kept == b"" for x in by[9])
    assert by[10][0].n_removed == 0 and all(x.n_removed == 0 for x in by[None])
    assert substring_dedup.remove_shared(no_documents(spark)).count() == 0


def mix_documents(spark, n=600):
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * r.choice([0, 3, 30, 30, 300])), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_targets_and_takes(spark):
    docs = mix_documents(spark)
    got = mixing.taken_words(docs, buckets=16).collect()
    by = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        s = by.setdefault(x.source, [x.target, x.source_size, 0])
        s[2] += x.taken
    total = sum(s[1] for s in by.values())
    assert sum(s[0] for s in by.values()) == pytest.approx(1.5 * total) and sum(s[2] for s in by.values()) == int(1.5 * total)
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 2 * 128
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs.repartition(7), buckets=16).collect()))


@pytest.mark.parametrize("budget", [None, 20_000, 0])
def test_mix_is_a_queue_by_finish_time(spark, budget):
    """One queue served in order of virtual finish time until the budget is spent."""
    docs = mix_documents(spark)
    placed, mix = mixing.mix_sources(docs, buckets=16, budget=budget)
    rows = placed.collect()
    served = [(x["rank"], x.start, x["repeat"], x.begin, x.words, x.mix_start) for x in mix.orderBy("mix_start").collect()]
    queue = []
    for x in rows:
        for repeat in range(2):
            for at in range(0, x["size"], 128):
                begin, n = x.start + repeat * x.source_size + at, min(128, x["size"] - at)
                queue.append(((begin + n) / x.target, x["rank"], begin, x.start, repeat, n))
    left, want, begun = int(1.5 * sum(x["size"] for x in rows)) if budget is None else budget, [], 0
    assert left < sum(q[-1] for q in queue)  # so the budget cuts
    for _, rank, begin, start, repeat, n in sorted(queue):
        if left > 0:
            want.append((rank, start, repeat, begin, min(n, left), begun))
            begun, left = begun + n, left - n
    assert served == want


def test_the_mix_is_range_sorted(spark, monkeypatch):
    plans = []
    write = mixing.saved

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return write(df)

    monkeypatch.setattr(mixing, "saved", seen)
    mixing.mix_sources(mix_documents(spark, 50))
    assert any("rangepartitioning(finish" in p for p in plans)


def test_mix_on_odd_rows(spark):
    got = mixing.taken_words(odd_documents(spark)).collect()
    assert len(got) == 15 and all(x.taken <= 2 * x.size for x in got)
    assert mixing.taken_words(no_documents(spark)).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 0, "message", 0, "user", "hel"), (1, 1, "delta", 0, None, "lo"), (1, 2, "message", 1, "assistant", "bad "), (1, 3, "delta", 1, None, "answer"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "good "), (1, 6, "delta", 1, None, "answer"), (1, 7, "edit", 0, None, "hello!"), (2, 0, "delta", 0, "user", "<|im_end|>"), (None, 0, "message", None, None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(4)
    got = {x.conv_id: [(m.turn, m.role, m.text) for m in x.messages] for x in chat.reconstruct(events, ["seq"]).collect()}
    assert got == {1: [(0, "user", "hello!"), (1, "assistant", "good answer")], 2: [(0, "user", "<|im_end|>")], None: [(None, "", "")]}


@pytest.mark.parametrize("text", ["", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|x<|", "<\\\\|im_start|>", "<", "|", "\n\n<|", "%0A", "naïve \U0001f600"])
def test_chat_round_trip(spark, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    rows = spark.createDataFrame([(1, [(0, "a\nb<|", text), (1, "assistant", text), (2, "assistant", "|" + text)])], chat.MESSAGES)
    x = chat.read_back(chat.render(rows)).first()
    assert [(t.role, t.text) for t in x.turns] == [("a\nb<|", text), ("assistant", text), ("assistant", "|" + text)] and x.loss_text == text + "|" + text


def test_chat_of_odd_stored_rows(spark):
    long = "".join(random.Random(6).choices("ab<|\\ \U0001f600", k=300_000))
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, "assistant", "late", "x"), (None, 0, "user", "lost", "x"), (None, 1, None, "too", "x"), (2, 0, "assistant", long, "x"), (3, 1, "b", "same", "x"), (3, 1, "a", "same", "x")]
    stored = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string").withColumn("messages", F.lit("y"))
    events = chat.message_events(stored)
    assert {x.kind for x in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {x.conv_id: ([(t.role, t.text) for t in x.turns], x.loss_text) for x in chat.read_back(chat.render(chat.reconstruct(events, ["turn", "nth", "part"]))).collect()}
    assert got == {1: ([("assistant", "late"), ("user", ""), ("user", "")], "late"), None: ([("user", "lost"), ("", "too")], ""), 2: ([("assistant", long)], long), 3: ([("a", "same"), ("b", "same")], "")}
    assert chat.message_events(stored.where("false")).count() == 0


def test_saved_tables_are_removed(spark):
    df, path = shared.saved_at(spark.range(3))
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    shared.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_chat_without_rows(spark):
    events = spark.createDataFrame([], "conv_id long, seq long, kind string, turn long, role string, text string")
    assert chat.reconstruct(events, ["seq"]).count() == 0


def test_models_on_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(7, 1, 1), (10, 0, 0), (None, 1, 1), (4, None, None), (5, 3, 3), (7, 1, 1)], "doc_id long, quality int, toxic int")
    for names in (labels, labels.where("false"), labels.where("doc_id = 7")):
        t = toxicity.score(docs, toxicity.fit(docs, names)).collect()
        q = quality.score(docs, quality.fit(docs, names)).collect()
        assert len(t) == len(q) == 15 and all(0 <= x.severity <= 3 for x in t) and all(0 <= x.score <= 1 for x in q)
    model = toxicity.fit(docs, labels.where("false"))
    assert not any(x.rejected for x in toxicity.score(docs, model).collect())
    assert toxicity.score(no_documents(spark), model).count() == 0


def plain_hash(data, more):
    """The polynomial hash of some bytes, by big integers."""
    total = sum(int(textbytes._BYTE[b]) * pow(int(textbytes.BASE), n, 1 << 64) for n, b in enumerate(data))
    return int(textbytes.mix(np.array([(total + len(data) * 0xA24BAED4963EE407 + more) % (1 << 64)], np.uint64))[0])


def plain_features(text):
    """Words and their prefixes of four, five and six bytes, with counts."""
    out = {}
    for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(UPPER)):
        b = w.encode()
        for h in [plain_hash(b, 0)] + [plain_hash(b[:p], 0x632BE59BD9B4E019) for p in (4, 5, 6) if len(b) > p]:
            out[h] = out.get(h, 0) + 1
    return out


def test_toxicity_equals_a_plain_model(spark):
    r = random.Random(14)
    bad = ["vile", "vileness", "nastiest", "grim"]
    docs = [(i, " ".join(r.choices(WORDS, k=20) + (r.choices(bad, k=r.randrange(1, 5)) if i % 2 else []))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(texts(spark, docs), labels)
    counts = {}
    for i, t in docs:
        for h in plain_features(t):
            counts.setdefault(h, [0, 0])[i % 2] += 1
    want = set()
    for h, (neg, pos) in counts.items():
        share = (pos + neg) / 120
        z = (pos / 60 - neg / 60) / math.sqrt(share * (1 - share) * (2 / 60) + 1e-12)
        if pos + neg >= 5 and z > toxicity.LEAST_Z and pos / 60 >= toxicity.LEAST_LIFT * neg / 60:
            want.add(h)
    assert want and set(model.words.hashes.tolist()) == want
    weight = dict(zip(model.words.hashes.tolist(), model.weights.tolist(), strict=True))
    for x in toxicity.score(texts(spark, [*docs, (900, ""), (901, None), (902, "vile " * 3000)]), model).collect():
        z = sum(weight[h] * math.log1p(n) for h, n in plain_features(x.row.text or "").items() if h in weight)
        above = [1 / (1 + math.exp(-max(-40, min(40, z - t)))) for t in model.thetas]
        assert x.severity == pytest.approx(sum(above)) and x.rejected == (above[0] >= 0.5) and x.grade == sum(a >= 0.5 for a in above)
    assert (np.diff(model.thetas) > 0).all()


def test_severity_follows_the_amount(spark):
    r = random.Random(17)
    bad = ["vile", "nastiest", "grim", "foul"]
    docs = [(i, " ".join(r.choices(WORDS, k=30) + (r.choices(bad, k=1 + 4 * (i % 3)) if i % 2 else []))) for i in range(400)]
    model = toxicity.fit(texts(spark, docs), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    got = {x.row.doc_id: x.severity for x in toxicity.score(texts(spark, docs), model).collect()}
    means = [np.mean([got[i] for i, _ in docs if i % 2 and i % 3 == k]) for k in range(3)] + [np.mean([got[i] for i, _ in docs if i % 2 == 0])]
    assert means[3] < means[0] < means[1] < means[2]


def test_quality_equals_plain_features_and_ranking(spark):
    r = random.Random(15)
    docs = [(i, (" ".join(r.choices(WORDS, k=30)) + ".") if i % 2 else " ".join(r.choices(["BUY", "now!!", "click", "$$$"], k=30))) for i in range(80)]
    docs += [(100, ""), (101, "one"), (102, "One one, two\nthr\u00e9e  7 7 7!")]
    ranker = quality.fit(texts(spark, docs), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"))
    got = {x.row.doc_id: x for x in quality.score(texts(spark, docs), ranker).collect()}
    marks = [chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    kinds = [lambda b: 48 <= b < 58, lambda b: 65 <= b < 91, lambda b: 97 <= b < 123, lambda b: b == 32, lambda b: b == 10, lambda b: b >= 128]
    for i, text in docs:
        raw = text.encode()
        of = [1 + marks.index(chr(b)) if b < 128 and chr(b) in marks else next((len(marks) + 1 + n for n, k in enumerate(kinds) if k(b)), 0) for b in raw]
        rates = [of.count(n) / max(1, len(raw)) for n in range(len(marks) + 7)]
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0d]+", text)]
        low = [x.decode().translate(UPPER) for x in w]
        n = max(1, len(w))
        mean = sum(map(len, w)) / n
        again = sum(a == b for a, b in zip(low[1:], low[:-1], strict=True)) / n
        one, two = len(set(low)), len(shingles(text, 2))
        dense = [math.log1p(len(w)), mean / 10, math.sqrt(max(0, sum(len(x) ** 2 for x in w) / n - mean**2)) / 10, again, math.sqrt(again), one / n, two / n, min(1, one / max(1, 12 * math.sqrt(len(w)))), sum(chr(x[-1]) in marks for x in w if x[-1] < 128) / n, float(bool(w))]
        x = np.array([*rates, *[math.log1p(200 * v) for v in rates], *dense])
        z = float(np.clip((x - ranker.center) / ranker.scale, -8, 8) @ ranker.weights)
        want = 1 / (1 + math.exp(-max(-40, min(40, z - ranker.threshold + math.log(0.3 / 0.7)))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3)
        if i < 80:
            assert got[i].predicted == i % 2


def test_quality_learns_from_every_label(spark):
    """Of 9,000 good texts only 40 are of a second kind: with all rows read, center is the mean over all and the threshold the rank of the last bad one."""
    docs = spark.range(9_600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, F.concat(F.lit("BUY now!! $$$ "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("a quiet word or two about the sea "), F.repeat(F.lit("and sky "), (F.col("id") % 7).cast("int")))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= 600).cast("int").alias("quality"))
    ranker = quality.fit(docs, labels)
    raw, offsets = textbytes.text_buffer(pa.array([r.text for r in docs.orderBy("doc_id").collect()]))
    x = quality.features(raw, offsets)
    assert np.allclose(ranker.center, x.mean(axis=0), atol=1e-5)
    z = np.sort(ranker.latent(x))
    assert ranker.threshold == pytest.approx((z[599] + z[600]) / 2, abs=1e-3)
    assert [quality._nth(spark.range(1000).selectExpr("double(pmod(id * 7919, 1000)) as z"), n, most=10) for n in (0, 499, 999)] == [0, 499, 999]


def test_lm_on_odd_rows(spark):
    got = lm.score_texts(odd_documents(spark)).collect()
    assert len(got) == 15 and all(x.n_tokens >= 1 and np.isfinite(x.score) and np.isfinite(x.base_score) for x in got)
    assert {x.n_tokens for x in got if x.doc_id in (1, 2, 3)} == {1}
    assert lm.score_texts(no_documents(spark)).count() == 0


def test_lm_is_a_distribution():
    rng = np.random.default_rng(2)
    shape = lm.Shape(members=9, hashed_bits=10)
    w, u, v = (rng.normal(size=size).astype(np.float32) for size in ((shape.class_rows, lm.CLASSES), (shape.member_rows, shape.members), (shape.member_rows, lm.GROUPS)))
    vocab = 200
    h = np.sort(rng.integers(0, 2**63, vocab, dtype=np.uint64))
    suffix = rng.integers(0, lm.SUFFIXES - 1, vocab)
    of = lm.cluster_endings(np.zeros((lm.SUFFIXES, lm.SUFFIXES), np.int64))
    count, c = rng.integers(1, 9, vocab), of[suffix]
    closed = np.full((lm.CLASSES, shape.members), -1e9, np.float32)
    closed[:, 0] = 0
    heads = np.unique([np.flatnonzero(c == k)[0] for k in np.unique(c)])
    closed[c[heads], 1] = 0
    head = lm.Heads(of, h[heads], np.ones(len(heads), np.int64), closed)
    rest = np.ones(vocab, dtype=bool)
    rest[heads] = False
    place = c[rest].astype(int) * lm.GROUPS + lm.group_of(h[rest])
    tokens = np.bincount(place, weights=count[rest], minlength=lm.CLASSES * lm.GROUPS).reshape(lm.CLASSES, -1)
    words = np.bincount(place, minlength=lm.CLASSES * lm.GROUPS).reshape(lm.CLASSES, -1)
    model = lm.Model(head, shape, w, u, v, int(count.sum()), vocab, np.log10(tokens + words + 1))
    total = 0.0
    context_h, context_c = h[[3, 5]], c[[3, 5]]
    strange = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    unseen = [(strange[lm.group_of(strange) == g][0], k, 0) for k in range(lm.CLASSES - 1) for g in range(lm.GROUPS)]  # one of each group
    for x, cls, n in [*zip(h, c, count, strict=True), *unseen, (lm.END, lm.ENDING, 1)]:
        hs, cs = np.append(context_h, x).astype(np.uint64), np.append(context_c, cls).astype(np.uint8)
        total += 10 ** lm._token_scores(model, hs, cs, np.array([0, 3]), np.log10(np.array([1, 1, n]) + 1.0))[2]
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_slices_are_those_that_hold_hashes():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    got = lm._slices(h, 1 << 28)  # many more buckets than hashes
    assert [b for b, _, _ in got] == np.unique(lm._bucket(h, 1 << 28)).tolist() and sum(b - a for _, a, b in got) == 500
    assert lm._slices(h[:0], 8) == []


def test_lm_scores_equal_a_plain_model(spark):
    """Word by word: class, then member, then share of the common member, by plain sums over the trained rows."""
    r = random.Random(8)
    docs = [(i, " ".join(r.choices(WORDS + ["rare" + str(i)], k=r.randrange(1, 40)))) for i in range(120)]
    fitted = []
    fit = lm.fit

    def kept(*args, **kw):
        fitted.append(fit(*args, **kw))
        return fitted[0]

    lm.fit = kept
    try:
        got = {x.doc_id: x.score for x in lm.score_texts(texts(spark, docs), shape=lm.Shape(members=5, hashed_bits=8)).collect()}
    finally:
        lm.fit = fit
    model, counts = fitted[0]
    count = {}
    for b in counts.collect():
        count.update(zip(np.frombuffer(b.h, np.uint64).tolist(), np.frombuffer(b.n, np.int64).tolist(), strict=True))
    heads = dict(zip(model.heads.hashes.tolist(), model.heads.member.tolist(), strict=True))

    def softmax(z):
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    for i, text in docs[:25]:
        raw = np.frombuffer(text.encode(), np.uint8)
        h, endings, bounds = lm.token_stream(raw, np.array([0, len(raw)]))
        c = model.heads.of_suffix[endings]
        rows, members = lm.context_rows(h, c, bounds, model.shape)
        total = 0.0
        for t in range(len(h)):
            p = softmax([sum(float(model.w[x, k]) for x in rows[:, t]) for k in range(lm.CLASSES)])[c[t]]
            open_members = np.flatnonzero(model.heads.closed[c[t]] == 0)
            if len(open_members) > 1:
                p *= softmax([sum(float(model.u[x, m]) for x in members[:, t]) for m in open_members])[open_members.tolist().index(heads.get(int(h[t]), 0))]
            if int(h[t]) not in heads and c[t] != lm.ENDING:
                group = lm.group_of(h[t : t + 1])[0]
                p *= softmax([sum(float(model.v[x, g]) for x in members[:, t]) for g in range(lm.GROUPS)])[group]
                p *= (count.get(int(h[t]), 0) + 1) / 10 ** model.rest[c[t], group]
            total += math.log10(p)
        assert got[i] == pytest.approx(total, rel=1e-4)
    again = {x.doc_id: x.score for x in lm.score_texts(texts(spark, docs).repartition(7), shape=lm.Shape(members=5, hashed_bits=8)).collect()}
    assert all(again[i] == pytest.approx(got[i], rel=1e-5) for i in got)  # file layout changes nothing


def test_lm_contexts_in_parts():
    r = np.random.default_rng(4)
    h, c, bounds = r.integers(0, 2**63, 50, dtype=np.uint64), r.integers(0, 32, 50).astype(np.uint8), np.array([0, 1, 20, 23, 50])
    whole = lm.context_rows(h, c, bounds, lm.Shape())
    for a in range(0, 50, 7):
        part = lm.context_rows(h, c, bounds, lm.Shape(), slice(a, a + 7))
        assert all((x[:, a : a + 7] == y).all() for x, y in zip(whole, part, strict=True))


def test_nearest_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for x in ann.nearest(df, top=3).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 0.5)], 20: [(3, 0.5), (0, 0.0), (1, 0.0)]}
    assert ann.nearest(df.where("false")).count() == 0


def test_nearest_ties_and_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    x[50:350] = x[50]
    rows = [(i, [float(v) for v in np.float32(x[i])]) for i in range(400)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), top=20, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(60, 340, 20):
        assert got[q] == [i for i in range(50, 72) if i != q][:20]


@pytest.mark.parametrize(("n", "part_rows", "two"), [(1500, 1 << 17, False), (6000, 100, True)])
def test_nearest_recall_at_two_sizes(spark, n, part_rows, two):
    """One level of parts, and as many rows as need two."""
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(60, 16))
    x = np.float32(centers[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 16))).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.levels(n, 8, part_rows, 256) == ((8, True) if two else (8, False))
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), parts=8, part_rows=part_rows, sample=3000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == -(-n // 20) and hit / (20 * len(got)) >= 0.9


def test_parts_grow_with_rows():
    assert [ann.levels(n, 32, 1 << 17, 256)[0] ** (1 + ann.levels(n, 32, 1 << 17, 256)[1]) for n in (10**5, 10**7, 10**9, 10**12)] == [32, 1024, 16384, 65536]


def test_parts_are_balanced():
    x = np.random.default_rng(4).normal(size=(1000, 8))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(x, 10), 16))
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 4


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_popular_parts_are_split_by_queries_too(spark):
    """Small chunks of queries give what large ones do; a query id with several vectors asks with the least."""
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, (x[40] + 5).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, cut = (sorted(map(tuple, ann.nearest(df, parts=4, block_queries=n).collect())) for n in (65_536, 3))
    assert whole == cut
    asked = min(x[40].tolist(), (x[40] + 5).tolist())
    scores = [s for q, _, _, s in whole if q == 40]
    best = sorted((float(v @ np.array(asked)) for i, v in enumerate(x) if i != 40), reverse=True)[:20]
    assert len(scores) == 20 and scores[0] == pytest.approx(best[0])


@pytest.mark.parametrize("two_sides", [False, True])
def test_partners_equal_all_pairs(two_sides):
    r = np.random.default_rng(3)
    least, rows = near_dedup.agreeing(0.85, 128), near_dedup.rows_within(0.85)
    for _ in range(6):
        base = r.integers(0, 256, (12, 128))
        x = base[r.integers(0, 12, 150)]
        noise = r.random(x.shape) < r.choice([0.0, 0.1, 0.3, 0.6], (150, 1))
        x = np.where(noise, r.integers(0, 256, x.shape), x).astype(np.uint8)
        side = r.integers(0, 2, 150) if two_sides else np.zeros(150, np.int64)
        near = ((x[:, None] == x[None]).sum(axis=2) >= least) & ~np.eye(150, dtype=bool)
        if two_sides:
            near &= side[:, None] != side[None]
        assert (near_dedup.partnered(x, side, least, rows)[0] == near.any(axis=1)).all()
    assert near_dedup.partnered(np.zeros((0, 128), np.uint8), np.zeros(0, np.int64), least, rows)[0].tolist() == []


def test_compared_pairs_grow_with_a_templated_class():
    """Texts of one template (a third alike), and groups of copies: twice as many need about twice the comparisons."""
    r = np.random.default_rng(4)
    least, rows = near_dedup.agreeing(0.85, 128), near_dedup.rows_within(0.85)

    def compared(n, alike):
        base = r.integers(0, 256, 128)
        x = np.where(r.random((n, 128)) < alike, base, r.integers(0, 256, (n, 128))).astype(np.uint8)
        return near_dedup.partnered(x, np.zeros(n, np.int64), least, rows)[1]

    for alike in (0.3, 0.97):
        few, many = compared(1000, alike), compared(4000, alike)
        assert many < 5 * few + 4000 * 32 and many < 4000 * 4000 / 8, (few, many)
