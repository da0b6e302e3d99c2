"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item. From every window the least hash of its k-grams is a
fingerprint, on both sides; two equal windows choose the same one, so every shared window shares a fingerprint at the
same place. Fingerprints of documents are joined with those of items; every window that a hit can extend to is looked up among the
windows of the items and compared word by word, once for each place of the document however often its words repeat. Items with fewer
words are one window of all their words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.appended import appended
from jobledger.llm.shared import saved

U64 = np.uint64
TOP = np.iinfo(np.uint64).max
_BITS = 20


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Mask of grams that are the least of some ``span`` neighbouring ones; all of equal least ones count."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, dtype=bool)
    if n <= span:
        return grams == grams.min()
    least = grams[: n - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : n - span + 1 + k], out=least)
    most = np.zeros(n, dtype=U64)
    for k in range(span):
        np.maximum(most[k : n - span + 1 + k], least, out=most[k : n - span + 1 + k])
    return most == grams


class Windows:
    """Distinct windows of one length: sorted hashes, a place of each in the items' words, and the items that hold it."""

    def __init__(self, length: int, hashes: np.ndarray, places: np.ndarray, items: np.ndarray):
        self.length = length
        order = np.lexsort((items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])])
        hashes, places, self.items = hashes[new], places[new], items[new]
        self.begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.count = np.diff(np.append(self.begin, len(hashes)))
        self.hashes, self.places = hashes[self.begin], places[self.begin]

    def find(self, words: np.ndarray, at: np.ndarray, of_items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of windows) of those of the places ``at`` where a window stands; words are compared one by one."""
        h = tb.ngram_hashes_at(words, at, self.length)
        n = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[n] == h
        at, n = at[same], n[same]
        same = np.ones(len(at), dtype=bool)
        for j in range(self.length):
            same &= words[at + j] == of_items[self.places[n] + j]
        return at[same], n[same]

    def holders(self, text: np.ndarray, n: np.ndarray, width: int, most: int = 1 << 20) -> np.ndarray:
        """Distinct text * width + item over windows found in texts; about ``most`` are spelled out at a time."""
        pair = np.unique(text * len(self.hashes) + n)
        text, n = pair // len(self.hashes), pair % len(self.hashes)
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(np.cumsum(self.count[n]) // most, prepend=-1)), [len(n)]])) if len(n) else [0]
        out = np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            count = self.count[n[a:b]]
            out = np.unique(np.concatenate([out, np.repeat(text[a:b], count) * width + self.items[tb.ragged(self.begin[n[a:b]], count)]]))
        return out


class ItemIndex:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], window: int, k: int):
        self.window, self.k, self.ids = window, k, [str(i) for i in ids]
        raw, offsets = tb.text_buffer(pa.array([t or "" for t in texts], pa.large_string()))
        starts, ends, first = tb.word_bounds(raw, offsets, tb.ALNUM_WORDS)
        self.words = tb.word_hashes(raw, starts, ends)
        sizes = np.diff(first)
        prints = []
        at: dict[int, list[np.ndarray]] = {}
        item: dict[int, list[np.ndarray]] = {}
        for i, (begin, n) in enumerate(zip(first[:-1], sizes, strict=True)):
            if n:
                length = min(int(n), window)
                at.setdefault(length, []).append(begin + np.arange(n - length + 1))
                item.setdefault(length, []).append(np.full(n - length + 1, i))
            if n >= window:
                grams = tb.ngram_hashes(self.words[begin : begin + n], k)
                prints.append(np.unique(grams[winnow(grams, window - k + 1)]))
        #: by length; those of ``window`` words are found by fingerprints, shorter ones directly
        self.tables = {n: Windows(n, tb.ngram_hashes_at(self.words, np.concatenate(at[n]), n), np.concatenate(at[n]), np.concatenate(item[n])) for n in sorted(at)}
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.seen = {n: self._seen(t.hashes) for n, t in self.tables.items()} | {0: self._seen(self.prints)}

    @staticmethod
    def _seen(h: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << _BITS, dtype=bool)
        seen[(h >> U64(64 - _BITS)).astype(np.int64)] = True
        return seen

    def matches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends) of window occurrences in the words of texts, and distinct text * items + item of what they belong to.

        first: n + 1 offsets of the texts' words.
        """
        begins, ends, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, table in self.tables.items():
            at = self._candidates(words, text_of) if n == self.window else self._all(words, text_of, n)
            at, which = table.find(words, at, self.words)
            begins.append(at)
            ends.append(at + n)
            held.append(table.holders(text_of[at], which, max(1, len(self.ids))))
        return np.concatenate(begins), np.concatenate(ends), np.unique(np.concatenate(held))

    def _all(self, words: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        grams = tb.ngram_hashes(words, n)
        return np.flatnonzero(self.seen[n][(grams >> U64(64 - _BITS)).astype(np.int64)] & (text_of[: len(grams)] == text_of[n - 1 :])) if len(grams) else np.zeros(0, np.int64)

    def _candidates(self, words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Begins of the windows around fingerprints of the texts that items have too."""
        grams = tb.ngram_hashes(words, self.k)
        if len(grams) == 0 or len(words) < self.window:
            return np.zeros(0, np.int64)
        crossing = text_of[: len(grams)] != text_of[self.k - 1 :]
        grams[crossing] = TOP
        picked = winnow(grams, self.window - self.k + 1) & ~crossing
        q = np.flatnonzero(picked & self.seen[0][(grams >> U64(64 - _BITS)).astype(np.int64)])
        q = q[self.prints[np.minimum(np.searchsorted(self.prints, grams[q]), len(self.prints) - 1)] == grams[q]]
        around = np.zeros(len(words) + 1, np.int64)
        np.add.at(around, np.maximum(q - (self.window - self.k), 0), 1)
        np.add.at(around, q + 1, -1)
        at = np.flatnonzero(np.cumsum(around[:-1]) > 0)
        at = at[at + self.window <= len(words)]
        return at[text_of[at] == text_of[at + self.window - 1]]


def _scan(index: ItemIndex):
    def make(raw, offsets):
        starts, ends, first = tb.word_bounds(raw, offsets, tb.ALNUM_WORDS)
        words = tb.word_hashes(raw, starts, ends)
        begin, end, held = index.matches(words, first)
        n = len(first) - 1
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, end, -1)
        hit = np.cumsum(cover[:-1]) > 0
        # maximal runs of hit words within a text
        edge = np.zeros(len(words) + 1, dtype=bool)
        edge[first] = True
        before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
        after = np.concatenate([hit[1:], [False]]) if len(hit) else hit
        a = np.flatnonzero(hit & (~before | edge[:-1]))
        b = np.flatnonzero(hit & (~after | edge[1:])) + 1
        text = np.searchsorted(first, a, "right") - 1
        span_at = np.searchsorted(a, first).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(a - first[text], pa.int64()), pa.array(b - first[text], pa.int64())], names=["begin", "end"])
        width = max(1, len(index.ids))
        item_at = np.searchsorted(held // width, np.arange(n + 1)).astype(np.int32)
        items = pa.array([index.ids[i] for i in held % width], pa.string())
        return [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(span_at, spans), pa.ListArray.from_arrays(item_at, items)]

    return make


FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def _count_words(raw, offsets):
    return [pa.array(np.diff(tb.word_bounds(raw, offsets, tb.ALNUM_WORDS)[2]), pa.int64())]


def item_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """``items`` in blocks of at most ``block_bytes`` of text each; a longer item stands alone or with few others."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [items]
    blocks = 2 * -(-total // block_bytes)
    number = lambda: F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for _ in range(40):
        sizes = items.groupBy(number().alias("b")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest"))
        if sizes.where((F.col("bytes") > block_bytes) & (F.col("longest") <= block_bytes)).isEmpty():
            break
        blocks *= 2
    else:
        raise RuntimeError("items of the benchmark can't be told apart by their hash")
    return [items.where(number() == b) for b in range(blocks)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` and ``benchmark(item_id, text)`` -> row (struct of the input's columns, or of ``keep``), n_words, n_hit, spans, items.

    Words are lower-cased runs of digits, letters and non-ASCII characters. A word is hit if it lies inside an
    occurrence of a window of some item; spans are the maximal runs of hit words (begin, end), items the sorted distinct
    item_ids, as strings, with windows in the text. Null, empty and wordless texts have no words and no hits; null and
    wordless items have no window; repeated rows of the benchmark count once. A null item_id reads "None".

    The benchmark is small against the corpus but may grow: it is indexed in blocks of at most ``block_bytes`` of text
    (a longer item makes a larger one), whose size is summed before anything is gathered. One block is a single pass
    over the texts, which aren't shuffled. Several are scanned one after the other, one job and one resident index each; their
    hits are tables in the shared folder, keyed by 128 bits of the text, and meet the texts in one join.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    blocks = item_blocks(items, block_bytes)

    def index(part: DataFrame) -> ItemIndex:
        rows = part.orderBy("item_id", "text").collect()
        return ItemIndex([r[0] for r in rows], [r[1] for r in rows], window, k)

    if len(blocks) == 1:
        out = appended(docs, _scan(index(blocks[0])), FOUND, keep=keep)
    else:
        key = lambda c: [F.xxhash64(c).alias("ta"), F.xxhash64(c, F.lit(7)).alias("tb")]
        texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
        hits = []
        for part in blocks:
            scanned = appended(texts, _scan(index(part)), FOUND, keep=["text"]).where(F.size("items") > 0)
            hits.append(saved(scanned.select(*key("row.text"), "spans", "items").dropDuplicates(["ta", "tb"])))
        found = reduce(DataFrame.union, hits).groupBy("ta", "tb").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row from each block
        counted = appended(docs, _count_words, "n_words long").select("row", "n_words", F.xxhash64(F.col("row.text").cast("string")).alias("da"), F.xxhash64(F.col("row.text").cast("string"), F.lit(7)).alias("db"))
        met = counted.join(found, (F.col("da") == F.col("ta")) & (F.col("db") == F.col("tb")), "left")
        none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
        row = F.col("row") if keep is None else F.struct(*[F.col(f"row.`{c}`").alias(c) for c in keep])
        out = met.select(row.alias("row"), "n_words", F.coalesce(_merged(F.col("spans")), none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return out.select("row", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _merged(spans):
    """Union of word runs that may overlap."""
    start = F.struct(F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("done"), F.lit(None).cast("struct<begin:bigint,end:bigint>").alias("last"))
    step = lambda s, x: F.when(s["last"].isNull(), F.struct(s["done"].alias("done"), x.alias("last"))).when(x["begin"] <= s["last"]["end"], F.struct(s["done"].alias("done"), F.struct(s["last"]["begin"].alias("begin"), F.greatest(s["last"]["end"], x["end"]).alias("end")).alias("last"))).otherwise(F.struct(F.concat(s["done"], F.array(s["last"])).alias("done"), x.alias("last")))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))
