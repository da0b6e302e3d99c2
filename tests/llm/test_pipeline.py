"""Each stage of the pipeline on its own input against a brute-force version, and on odd rows."""

import hashlib
import re

import corpus_pipeline as cp
from jobledger.llm import toxicity
from tests.llm.test_cases import shingles
from tests.llm.test_queries import UPPER

BLANKS = " \t\n\x0b\x0c\r"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_lines(rows):
    """Texts without lines of 40 or more characters that five documents hold, but in the largest of them."""
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(r["doc_id"])
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return {r["doc_id"]: "\n".join(line for line in (r["text"] or "").split("\n") if gone.get(key(line), r["doc_id"]) == r["doc_id"]) for r in rows}


def by_pairs(rows):
    """The smallest document of each class of sets linked at 80 %."""
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def without_windows(rows, items):
    windows = set()
    for text in items:
        w = words(text)
        n = min(len(w), 10)
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    return {r["doc_id"] for r in rows if not any(tuple(w[a : a + n]) in windows for w in [words(r["text"])] for n in sizes for a in range(len(w) - n + 1))}


def by_queue(rows, weights=(5, 2, 1), quantum=128):
    """Words taken of each document, by serving one slice after the other."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(sources)}
    target, left = {}, 1.5 * sum(total.values())
    while True:  # share what is left, cap, share again
        free = [s for s in sources if s not in target]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] >= 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        if len(over) == len(free):
            break
    queue = []
    for n, s in enumerate(sources):
        start = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest()):
            for repeat in range(2):
                for at in range(0, size[r["doc_id"]], quantum):
                    length = min(quantum, size[r["doc_id"]] - at)
                    begin = start + repeat * total[s] + at
                    queue.append(((begin + length) / target[s], n, begin, length, r["doc_id"]))
            start += size[r["doc_id"]]
    taken, budget = dict.fromkeys(size, 0), int(round(sum(target.values()), 3))
    for _, _, _, length, doc in sorted(queue):
        got = min(length, budget)
        taken[doc] += got
        budget -= got
    return taken


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for name, stage in cp.STAGES:
        before, out = rows_of(docs), stage(spark, docs, sf_dir)
        after = rows_of(out)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept, was = {r["doc_id"]: r for r in after}, {r["doc_id"]: r for r in before}
        assert 0 < len(kept) == len(after)
        if name == "toxicity":
            scored = toxicity.score(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"), model)
            assert set(kept) == {r.row.doc_id for r in scored.collect() if not r.rejected}
        elif name == "line_dedup":
            want = by_lines(before)
            assert {i: r["text"] or "" for i, r in kept.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        elif name == "near_dedup":
            assert set(kept) == by_pairs(before)
        elif name == "decontamination":
            assert set(kept) == without_windows(before, items)
        else:
            want = by_queue(before)
            assert {i: r["mix_taken"] for i, r in kept.items()} == {i: n for i, n in want.items() if n}
        if name != "mixing":
            assert list(after[0]) == list(before[0])
        if name not in ("line_dedup", "mixing"):
            assert all(r == was[i] for i, r in kept.items())


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, an empty table: each stage gives the columns of documents."""
    schema = documents(spark, sf_dir).schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27), (None, "one two three four five six seven", "de", "a", 33), (None, None, None, None, None), (4, "x" * 300, "en", "b", 300), (5, " \n\t", "en", "b", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(schema)] == schema.names
            got = out.collect()
            assert len(got) <= len(given)
            if name == "mixing":
                assert sum(r.mix_taken for r in got) == int(1.5 * sum(len((r.text or "").split()) for r in docs.collect()))
            docs = spark.createDataFrame(got, out.schema)


def test_equal_rows_share_what_the_mix_takes(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "x y z", "s"), (2, "q " * 40, "s")], "doc_id long, text string, source string")
    got = cp.mix(spark, docs, sf_dir).collect()
    assert sum(r.mix_taken for r in got) == int(1.5 * 49) and all(r.mix_taken <= 2 * r.mix_size for r in got)
