"""Passages that documents share, removed from all but the document with the smallest id: a hash-compared suffix sort.

Sorting every suffix of a corpus would move each byte many times over. What decides here are windows of ``length``
bytes, and any such window holds a winnowed anchor: a ``gram``-byte string of least hash. So

1. anchors are sampled (about one in 17 bytes); those that only one document has are dropped. A batch sends one entry
   for an anchor that several of its documents share, so copies are gathered before they are shuffled;
2. each anchor that is left comes with its context, the bytes that windows around it can reach. Equal contexts of a
   batch are sent once, with their smallest document;
3. the suffixes that start at the anchors are sorted by a merge sort whose comparisons find the common extension of
   two suffixes by binary search over prefix polynomial hashes: a logarithmic number of steps for each comparison.
   The order of suffixes that start a byte earlier follows by a stable sort on that byte alone;
4. neighbours whose windows have equal hashes are compared byte by byte, so a collision never removes anything.

Whole copies of a text go by their SHA-256 digest and need no contexts.

An anchor that very many documents share would gather its contexts in one place. Such anchors are found by count;
each of their windows is sent as a record of its own, keyed by the window, so they spread and still meet their equals.

Places and spans travel packed, by a hash of their document, and are gathered there: one row for each document.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm import textbytes as tb
from jobledger.llm.shared import saved

U64 = np.uint64
_LOW = U64((1 << 48) - 1)
HOT_SLICE = 4096


@dataclass(frozen=True)
class Shape:
    length: int = 50
    gram: int = 18
    buckets: int = 16

    @property
    def groups(self) -> int:
        """Into so many groups documents are dealt to have their spans joined."""
        return 2 * self.buckets

    @property
    def reach(self) -> int:
        """Bytes before and after an anchor that a window can take in."""
        return self.length - self.gram

    @property
    def context(self) -> int:
        return self.length + self.reach

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.int64)


def sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    """op over each run of ``span`` values, by doubling."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``raw``, hashes) of the anchors of each text that is long enough for a window."""
    k, span = shape.gram, shape.reach + 1
    if len(raw) < shape.length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    prefix = tb.prefix_hashes(tb._BYTE[raw])
    n = len(raw) - k + 1
    grams = tb.mix((prefix[k:] - prefix[:-k]) * tb.powers(n, inverse=True))
    key = (grams >> U64(32)).astype(np.uint32)
    crossing = np.zeros(n + k, dtype=np.int32)  # grams that run into the next text
    ends = offsets[1:-1]
    np.add.at(crossing, np.maximum(ends - k + 1, 0), 1)
    np.add.at(crossing, np.minimum(ends, n), -1)
    crossing = np.cumsum(crossing, dtype=np.int32)[:n] > 0
    key[crossing] = np.iinfo(np.uint32).max
    least = sliding(key, span, np.minimum)
    most = sliding(np.concatenate([np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)]), span, np.maximum)
    at = np.flatnonzero((most == key) & ~crossing)
    long = np.diff(offsets) >= shape.length
    at = at[long[np.searchsorted(offsets, at, "right") - 1]]
    return at, grams[at]


def _trim() -> None:
    """Give freed memory back to the system: a worker lives on through many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _pieces(offsets: np.ndarray, limit: int, overlap: int):
    """(first row, end row, begin byte, end byte) of groups of texts; a text beyond ``limit`` comes in pieces that overlap."""
    for i, j in tb.row_groups(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= limit:
            yield i, j, a, b
        else:
            for x in range(a, b, limit):
                yield i, j, x, min(b, x + limit + overlap)


def _blob(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _packed(*arrays: np.ndarray) -> list[bytes]:
    """As :func:`_blob`, compressed: most of what is shuffled here is small numbers and text."""
    out = []
    for b in _blob(*arrays):
        out.append(bytes(4) + b if len(b) < 256 else len(b).to_bytes(4, "little") + pa.compress(b, codec="zstd", asbytes=True))
    return out


def _unpacked(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:4], "little")
    if size == 0:  # too short to gain
        return np.frombuffer(b, dtype, offset=4)
    return np.frombuffer(pa.decompress(memoryview(b)[4:], size, codec="zstd", asbytes=True), dtype)


ASKED = "bucket int, g int, ids binary, tags binary, low binary, high binary, doc binary, pos binary, many binary"


def _ask(shape: Shape):
    """Texts -> for each batch and bucket the anchors it asks about, and what it knows to be shared already."""

    def run(batches):
        for batch in batches:
            raw_all, offsets_all = tb.text_buffer(batch.column(2))
            ids_all, tags_all = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = []
            for i, j, a, b in _pieces(offsets_all, 256 << 10, shape.length - 1):
                at, h = anchors(raw_all[a:b], np.clip(offsets_all[i : j + 1], a, b) - a, shape)
                doc = np.searchsorted(offsets_all, at + a, "right") - 1
                parts.append((h, doc, (at + a - offsets_all[doc])))
                if sum(len(p[0]) for p in parts) > 250_000:
                    yield from _asked(shape, parts, ids_all, tags_all)
                    parts = []
            if parts:
                yield from _asked(shape, parts, ids_all, tags_all)
            _trim()

    return run


def _asked(shape: Shape, parts: list, ids_all: np.ndarray, tags_all: np.ndarray):
    h, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(h) == 0:
        return
    lo, hi = doc.min(), doc.max() + 1
    order_of = np.argsort(ids_all[lo:hi], kind="stable")  # documents by id
    rank = np.empty(hi - lo, np.int64)
    rank[order_of] = np.arange(hi - lo)
    ids, tags, doc = ids_all[lo:hi][order_of], tags_all[lo:hi][order_of], rank[doc - lo]
    order = np.argsort(h, kind="stable")
    h, doc, pos = h[order], doc[order], pos[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(begin, len(h)))
    first, last = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    several = np.repeat(ids[first] < ids[last], size)
    rows = []
    if several.any():
        # known to be shared: passed on as they are
        d = doc[several]
        for g, (i, t, p) in _by_group(shape.groups, ids[d], tags[d], pos[several]):
            rows.append((g % shape.buckets, g, i, t, None, None, None, p, None))
    least = first[np.repeat(np.arange(len(begin)), size)]
    send = ~several
    if several.any():  # of a shared anchor the first entry of its smallest document
        cand = np.flatnonzero(several & (doc == least))
        grp = np.searchsorted(begin, cand, "right") - 1
        send[cand[np.concatenate([[True], grp[1:] != grp[:-1]])]] = True
    many = np.where(several, np.minimum(np.repeat(size, size), np.iinfo(np.uint32).max), 1).astype(np.uint32)
    h, doc, pos, many = h[send], doc[send], pos[send], many[send]
    bucket = shape.bucket(h)
    for b in np.unique(bucket):
        own = slice(*np.searchsorted(bucket, [b, b + 1]))  # bucket grows with h
        used = np.unique(doc[own])
        local = np.searchsorted(used, doc[own]).astype(np.uint32 if len(used) > 65_535 else np.uint16)
        delta = np.diff(ids[used], prepend=0)
        low, high = (h[own] & U64(0xFFFFFFFF)).astype(np.uint32), (h[own] >> U64(32) & U64(0xFFFF)).astype(np.uint16)
        rows.append((int(b), None, *_packed(delta), *_blob(tags[used], low), *_packed(high, local, pos[own].astype(np.uint32), np.minimum(many[own], 65_535).astype(np.uint16))))
    yield _record_batch(ASKED, rows)


SHARED = "g int, ids binary, tags binary, pos binary, hot array<long>, docs array<long>"


def _answer(hot_from: int, groups: int):
    """All that is asked about the anchors of a bucket -> places of shared anchors by group of documents; anchors of ``hot_from`` documents and more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["low"].isna()]
        out = [(int(r.g), r.ids, r.tags, r.pos, None, None) for r in known.itertuples(index=False)]
        asked = group[group["low"].notna()]
        if len(asked):
            h, ids, tags, pos, many = [], [], [], [], []
            for r in asked.itertuples(index=False):
                low, high = np.frombuffer(r.low, np.uint32), _unpacked(r.high, np.uint16)
                h.append(low.astype(U64) | high.astype(U64) << U64(32))
                table, tag = np.cumsum(_unpacked(r.ids, np.int64)), np.frombuffer(r.tags, np.int32)
                local = _unpacked(r.doc, np.uint32 if len(table) > 65_535 else np.uint16)
                ids.append(table[local])
                tags.append(tag[local])
                pos.append(_unpacked(r.pos, np.uint32))
                many.append(_unpacked(r.many, np.uint16))
            h, ids, tags, pos, many = (np.concatenate(x) for x in (h, ids, tags, pos, many))
            _trim()
            order = np.argsort(h)
            h = h[order]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(begin, len(h)))
            sorted_ids = ids[order]
            shared = (np.minimum.reduceat(sorted_ids, begin) < np.maximum.reduceat(sorted_ids, begin)) | (np.maximum.reduceat(many[order], begin) > 1)
            held = np.add.reduceat(many[order].astype(np.int64), begin)  # documents, not entries
            often = np.flatnonzero(held >= hot_from)
            if len(often):
                out.append((None, None, None, None, h[begin[often]].view(np.int64), held[often]))
            keep = order[np.repeat(shared, size)]
            out += [(g, *blobs, None, None) for g, blobs in _by_group(groups, ids[keep], tags[keep], pos[keep])]
        return pd.DataFrame({c: pd.array([r[i] for r in out], "Int32") if i == 0 else pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(("g", "ids", "tags", "pos", "hot", "docs"))})

    return run


def _places(group: pd.DataFrame) -> pd.DataFrame:
    """All places of shared anchors in a group of documents -> one row for each document."""
    ids, tags, pos = (np.concatenate([_unpacked(b, kind) for b in group[c]]) for c, kind in (("ids", np.int64), ("tags", np.int32), ("pos", np.uint32)))
    by = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[by], tags[by], pos[by]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
    _trim()
    return pd.DataFrame({"doc_id": ids[cut], "tag": tags[cut], "pos": [pos[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)]})


def _hot_anchors(shared: DataFrame, hot_from: int, most: int) -> np.ndarray:
    """Hashes of anchors that ``hot_from`` documents and more share, sorted; at most ``most`` reach the driver.

    Only where more anchors than that are as common, the bound doubles until no more are left.
    """
    found = shared.where("hot is not null").select(F.inline(F.arrays_zip("hot", "docs")))
    by_power = dict(found.groupBy(F.floor(F.log2(F.col("docs") / hot_from)).cast("int").alias("power")).agg(F.count("*").alias("n")).collect())  # a row for each power of two
    least = 0
    while sum(n for power, n in by_power.items() if power >= least) > most:
        least += 1
    rows = found.where(F.floor(F.log2(F.col("docs") / hot_from)) >= least).select("hot").collect() if by_power else []
    return np.array(sorted(r[0] for r in rows), dtype=np.int64).view(U64)


CONTEXTS = "bucket int, g int, ids binary, tags binary, h binary, doc binary, pos binary, left binary, right binary, bytes binary, begin binary, end binary"


def _contexts(shape: Shape, hot: np.ndarray):
    """Texts with the places of their shared anchors -> contexts by bucket, and spans that the batch itself decides."""
    reach, k, length, width = shape.reach, shape.gram, shape.length, shape.context

    def run(batches):
        for batch in batches:
            raw_all, offsets_all = tb.text_buffer(batch.column(2))
            ids_all, tags_all = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            marks = batch.column(3).to_pylist()
            parts: list[tuple] = []
            held = 0
            for i, places in enumerate(marks):
                n = int(offsets_all[i + 1] - offsets_all[i])
                p = np.unique(np.frombuffer(places, np.uint32)).astype(np.int64)
                p = p[p + k <= n]
                for a in range(0, len(p), 60_000):  # a very long text comes in several parts
                    some = p[a : a + 60_000]
                    parts.append((np.full(len(some), i), some))
                    held += len(some)
                    if held > 60_000:
                        yield from records(raw_all, offsets_all, *(np.concatenate(x) for x in zip(*parts, strict=True)), ids_all, tags_all)
                        parts, held = [], 0
            if parts:
                yield from records(raw_all, offsets_all, *(np.concatenate(x) for x in zip(*parts, strict=True)), ids_all, tags_all)
            _trim()

    def records(raw, offsets, doc, pos, ids_all, tags_all):
        if len(doc) == 0:
            return
        n = np.diff(offsets)[doc]
        left, right = np.minimum(pos, reach), np.minimum(n - pos - k, reach)
        fits = left + right >= reach
        doc, pos, left, right, n = doc[fits], pos[fits], left[fits], right[fits], n[fits]
        column = np.arange(width) - reach
        c = np.zeros((len(doc), width), np.uint8)
        for a in range(0, len(doc), 16_384):
            part = slice(a, a + 16_384)
            place = (offsets[doc[part]] + pos[part])[:, None] + column
            inside = (column >= -left[part, None]) & (column < (k + right[part])[:, None])
            c[part] = np.where(inside, raw[np.clip(place, 0, len(raw) - 1)], 0)
        if len(doc) == 0:
            return
        h = _row_hashes(c[:, reach : reach + k])
        lo, hi = doc.min(), doc.max() + 1
        by_id = np.argsort(ids_all[lo:hi], kind="stable")
        rank = np.empty(hi - lo, np.int64)
        rank[by_id] = np.arange(hi - lo)
        ids, tags, doc = ids_all[lo:hi][by_id], tags_all[lo:hi][by_id], rank[doc - lo]
        left_over = yield from known(ids, tags, doc, pos, left, right, h, c)
        often = np.isin(left_over[4] & _LOW, hot)  # hot ones come by their low bits only
        yield from sent(ids, tags, *(x[~often] for x in left_over))
        at = np.flatnonzero(often)
        at = at[np.argsort(left_over[4][at], kind="stable")]
        for a in range(0, len(at), HOT_SLICE):  # a context becomes up to reach + 1 windows
            part = yield from known(ids, tags, *windows(*(x[at[a : a + HOT_SLICE]] for x in left_over[:4]), left_over[5][at[a : a + HOT_SLICE]]))
            yield from sent(ids, tags, *part)

    def windows(doc, pos, left, right, c):
        """Every window of contexts as a record of its own, keyed by its hash; once where contexts of a document overlap."""
        o = np.arange(reach + 1)
        row, o = np.nonzero((o <= left[:, None]) & (reach - o <= right[:, None]))
        by = np.lexsort((pos[row] - o, doc[row]))
        row, o = row[by], o[by]
        d, begin = doc[row], pos[row] - o
        once = np.concatenate([[True], (d[1:] != d[:-1]) | (begin[1:] != begin[:-1])])
        row, o, d, begin = row[once], o[once], d[once], begin[once]
        w = np.zeros((len(row), width), np.uint8)
        for j in np.unique(o):
            mine = np.flatnonzero(o == j)
            w[mine, reach:] = c[row[mine], reach - j : reach - j + length]
        return d, begin, np.zeros(len(row), np.int64), np.full(len(row), reach), _row_hashes(w[:, reach:]), w

    def known(ids, tags, doc, pos, left, right, h, c):
        """Yields the spans of contexts that a smaller document of the batch has too; returns the other contexts."""
        # equal contexts: hashes bring them together, bytes confirm
        key = tb.mix(_row_hashes(c) + (left * 64 + right).astype(U64))
        order = np.lexsort((ids[doc], key))
        doc, pos, left, right, h, c, key = doc[order], pos[order], left[order], right[order], h[order], c[order], key[order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        equal = (c == c[first]).all(axis=1) & (left == left[first]) & (right == right[first])
        gone = equal & (ids[doc[first]] < ids[doc])
        begin, end = (pos - left)[gone], (pos + k + right)[gone]
        if len(begin):
            d = doc[gone]
            by = np.lexsort((begin, d))
            d, begin, end = _joined(d[by], begin[by], end[by])
            yield _record_batch(CONTEXTS, [(g % shape.buckets, g, *blobs[:2], None, None, None, None, None, None, *blobs[2:]) for g, blobs in _by_group(shape.groups, ids[d], tags[d], begin, end)])
        send = ~gone
        return doc[send], pos[send], left[send], right[send], h[send], c[send]

    def sent(ids, tags, doc, pos, left, right, h, c):
        if len(h) == 0:
            return
        bucket = shape.bucket(h)
        order = np.argsort(bucket, kind="stable")
        doc, pos, left, right, h, c, bucket = doc[order], pos[order], left[order], right[order], h[order], c[order], bucket[order]
        rows = []
        for b, x, y in _runs(bucket):
            used = np.unique(doc[x:y])
            rows.append((int(b), None, *_blob(ids[used], tags[used], h[x:y]), *_packed(np.searchsorted(used, doc[x:y]).astype(np.uint32), pos[x:y].astype(np.uint32), left[x:y].astype(np.uint8), right[x:y].astype(np.uint8), c[x:y]), None, None))
        yield _record_batch(CONTEXTS, rows)

    return run


def _record_batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c < 2 else pa.binary()) for c in range(len(names))], names=names)


def _by_group(groups: int, ids: np.ndarray, tags: np.ndarray, *places: np.ndarray):
    """Places in documents by the group that a document is dealt to: (group, packed [ids, tags, *places])."""
    g = ((tb.mix(ids.view(U64) + tags.astype(U64)) >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
    by = np.lexsort((ids, g))
    ids, tags, places = ids[by], tags[by].astype(np.int32), [x[by].astype(np.uint32) for x in places]
    for x, a, b in _runs(g[by]):
        yield x, _packed(ids[a:b], tags[a:b], *(p[a:b] for p in places))


def _runs(x: np.ndarray):
    """(value, begin, end) of runs of equal values."""
    if len(x) == 0:
        return iter(())
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return zip(x[cut].tolist(), cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True)


def _joined(d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans sorted by (document, begin)."""
    if len(d) == 0:
        return d, begin, end
    shift = (d - d.min()).astype(np.int64) * (int(end.max()) + 2)
    top = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (begin + shift)[1:] > top[:-1]])
    at = np.flatnonzero(new)
    return d[at], begin[at], (np.append(top[at[1:] - 1], top[-1]) - shift[at])


def _row_hashes(c: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row; for ``gram`` bytes the same value as of an anchor."""
    out = np.zeros(len(c), dtype=U64)
    power = tb.powers(c.shape[1])
    for j in range(c.shape[1]):
        out += tb._BYTE[c[:, j]] * power[j]
    return tb.mix(out)


class Suffixes:
    """Contexts of anchors with prefix polynomial hashes of every row."""

    def __init__(self, c: np.ndarray, reach: int, length: int):
        self.c, self.reach, self.length = c, reach, length
        self.prefix = np.zeros((len(c), c.shape[1] + 1), dtype=U64)
        for a in range(0, len(c), 4096):
            np.cumsum(tb._BYTE[c[a : a + 4096]] * tb.powers(c.shape[1]), axis=1, out=self.prefix[a : a + 4096, 1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at the anchors of rows x and y, by binary search on prefix hashes."""
        s = self.reach
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        a, b = self.prefix[x, s], self.prefix[y, s]
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.prefix[x, s + mid] - a == self.prefix[y, s + mid] - b
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        m = self.common(x, y)
        end = m >= self.length
        at = self.reach + np.minimum(m, self.length - 1)
        return np.where(end, or_equal, self.c[x, at] < self.c[y, at])

    def sort(self, h: np.ndarray) -> np.ndarray:
        """Rows by anchor hash, then by suffix: a bottom-up merge sort of all groups of equal anchors at once."""
        order = np.argsort(h, kind="stable")
        hs = h[order]
        start = np.concatenate([[True], hs[1:] != hs[:-1]])
        base = np.flatnonzero(start)
        size = np.diff(np.append(base, len(h)))
        group = np.cumsum(start) - 1
        run = 1
        while run < size.max(initial=0):
            live = np.flatnonzero(size[group] > run)
            b, n = base[group[live]], size[group[live]]
            i = live - b
            mine = i // run
            other = (mine ^ 1) * run
            has = other < n
            live, b, n, i, mine, other = live[has], b[has], n[has], i[has], mine[has], other[has]
            lo, hi = np.zeros(len(live), np.int64), np.minimum(run, n - other)
            right = mine % 2 == 1  # equal ones of the left run go first
            me = order[live]
            for _ in range(run.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                if len(open_) == 0:
                    break
                mid = (lo[open_] + hi[open_]) // 2
                before = self.less(order[b[open_] + other[open_] + mid], me[open_], right[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            out = order.copy()
            out[b + (mine // 2) * 2 * run + i % run + lo] = me
            order = out
            run *= 2
        return order


def covered(h, c, doc, left, right, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the smallest and largest offset of a window around its anchor that a smaller document has.

    Offsets count bytes of the window before the anchor; where there is none the first is above the second.
    """
    n, reach = len(h), shape.reach
    low, high = np.full(n, reach + 1), np.full(n, -1)
    suffixes = Suffixes(c, reach, shape.length)
    order = suffixes.sort(h)
    prefix = suffixes.prefix
    anchor = np.empty(n, np.int64)
    hs = h[order]
    anchor[order] = np.cumsum(np.concatenate([[True], hs[1:] != hs[:-1]])) if n else 0
    for o in range(reach + 1):
        if o:  # one byte earlier: a stable sort by that byte within each anchor
            by = np.argsort(c[order, reach - o], kind="stable")
            order = order[by]
            order = order[np.argsort(anchor[order], kind="stable")]
        rows = order[(o <= left[order]) & (reach - o <= right[order])]
        if len(rows) < 2:
            continue
        s = reach - o
        hashes = prefix[rows, s + shape.length] - prefix[rows, s]
        same = (hashes[1:] == hashes[:-1]) & (anchor[rows][1:] == anchor[rows][:-1])
        at = np.flatnonzero(same)
        same[at] = (c[rows[at], s : s + shape.length] == c[rows[at + 1], s : s + shape.length]).all(axis=1)
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.repeat(np.minimum.reduceat(doc[rows], begin), np.diff(np.append(begin, len(rows))))
        hit = rows[least < doc[rows]]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


SPANS = "g int, ids binary, tags binary, begin binary, end binary"
JOINED = "doc_id long, tag int, begin binary, end binary"


def _share(asked: pd.DataFrame, shape: Shape, least: np.uint64, beyond: np.uint64 | None) -> list[np.ndarray]:
    """h, bytes, ids, tags, pos, left and right of the contexts whose hashes are from ``least`` to before ``beyond``."""
    got: list[list[np.ndarray]] = [[] for _ in range(7)]
    for r in asked.itertuples(index=False):
        h = np.frombuffer(r.h, U64)
        mine = np.flatnonzero(h >= least if beyond is None else (h >= least) & (h < beyond))
        if len(mine):
            local = _unpacked(r.doc, np.uint32)[mine]
            for x, v in zip(got, (h[mine], _unpacked(r.bytes, np.uint8).reshape(-1, shape.context)[mine], np.frombuffer(r.ids, np.int64)[local], np.frombuffer(r.tags, np.int32)[local], _unpacked(r.pos, np.uint32)[mine].astype(np.int64), _unpacked(r.left, np.uint8)[mine].astype(np.int64), _unpacked(r.right, np.uint8)[mine].astype(np.int64)), strict=True):
                x.append(v)
    return [np.concatenate(x) for x in got]


def _decide(shape: Shape, share: int = 100_000):
    """Contexts of a bucket -> spans to remove, packed by group of documents. About ``share`` contexts are unpacked at a time."""
    names = ["g", "ids", "tags", "begin", "end"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["h"].isna()]
        out = [(int(r[0]), *r[1:]) for r in known[names].itertuples(index=False, name=None)]
        asked = group[group["h"].notna()]
        if len(asked):
            # anchors with equal hashes stay together; each share of them unpacks its own contexts only
            every = np.sort(np.concatenate([np.frombuffer(b, U64) for b in asked["h"]]))
            edges = np.unique(every[::share])
            found = []
            for n, least in enumerate(edges):
                h, c, ids, tags, pos, left, right = _share(asked, shape, least, edges[n + 1] if n + 1 < len(edges) else None)
                # parts keep the prefix hashes small
                order = np.argsort(h, kind="stable")
                cuts = [0]
                while cuts[-1] < len(h):
                    end = min(cuts[-1] + 20_000, len(h))
                    while end < len(h) and h[order[end]] == h[order[end - 1]]:
                        end += 1
                    cuts.append(end)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = order[a:b]
                    low, high = covered(h[part], c[part], ids[part], left[part], right[part], shape)
                    hit = np.flatnonzero(high >= low)
                    rows = part[hit]
                    found.append((ids[rows], tags[rows], pos[rows] - high[hit], pos[rows] - low[hit] + shape.length))
                del h, c, left, right
            _trim()
            ids, tags, begin, end = _joined_by_document(*(np.concatenate(x) for x in zip(*found, strict=True)))
            out += [(g, *blobs) for g, blobs in _by_group(shape.groups, ids, tags, begin, end)]
        return pd.DataFrame(out, columns=names)

    return run


def _joined_by_document(ids, tags, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each (id, tag), sorted."""
    by = np.lexsort((begin, tags, ids))
    ids, tags, begin, end = ids[by], tags[by], begin[by].astype(np.int64), end[by].astype(np.int64)
    if len(ids) == 0:
        return ids, tags, begin, end
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    heads = np.flatnonzero(new)
    d, begin, end = _joined(np.cumsum(new) - 1, begin, end)
    return ids[heads[d]], tags[heads[d]], begin, end


def _join(group: pd.DataFrame) -> pd.DataFrame:
    """All spans of a group of documents -> one row for each document."""
    kinds = {"ids": np.int64, "tags": np.int32, "begin": np.uint32, "end": np.uint32}
    ids, tags, begin, end = _joined_by_document(*(np.concatenate([_unpacked(b, kind) for b in group[c]]) for c, kind in kinds.items()))
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) if len(ids) else np.zeros(0, np.int64)
    runs = [*zip(cut, np.append(cut[1:], len(ids)), strict=True)] if len(ids) else []
    _trim()
    return pd.DataFrame({"doc_id": ids[cut], "tag": tags[cut].astype(np.int32), "begin": [begin[a:b].tobytes() for a, b in runs], "end": [end[a:b].tobytes() for a, b in runs]})


def _cut_out():
    """Texts with the spans to remove -> what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]

    def run(batches):
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            begins, ends, wholes = (batch.column(c).to_pylist() for c in (2, 3, 4))
            n_removed, n_spans, kept, digest = [], [], [], []
            for i, (b, e, whole) in enumerate(zip(begins, ends, wholes, strict=True)):
                text = raw[offsets[i] : offsets[i + 1]]
                if whole:
                    n_removed.append(len(text))
                    n_spans.append(1)
                    left = b""
                elif not b:
                    n_removed.append(0)
                    n_spans.append(0)
                    left = text.tobytes()
                else:
                    begin, end = np.frombuffer(b, np.int64), np.frombuffer(e, np.int64)
                    edge = np.concatenate([[0], np.stack([begin, end], axis=1).reshape(-1), [len(text)]])
                    left = b"".join(text[edge[j] : edge[j + 1]].tobytes() for j in range(0, len(edge), 2))
                    n_removed.append(len(text) - len(left))
                    n_spans.append(len(begin))
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            _trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=names)

    return run


def remove_shared(docs: DataFrame, length: int = 50, gram: int = 18, bucket_bytes: int = 4 << 20, hot_from: int = 8192, most_hot: int = 1 << 20) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256: one row per input row.

    Every byte goes that is covered by a ``length``-byte string of the text's UTF-8 bytes which also starts in a document
    with a smaller doc_id. Strings are judged on the input and don't cross documents; spans are maximal removed
    runs. ``kept`` can end inside a character, hence bytes. Null texts are empty; texts shorter than ``length`` lose nothing. Rows
    that repeat a doc_id are judged each for itself against smaller ids. A row with a null doc_id loses nothing and is no
    one's source. Very long texts are worked on in overlapping pieces.

    Buckets grow with the corpus: one for ``bucket_bytes`` of text. Anchors of ``hot_from`` documents and more are split by
    windows, so that is the most contexts of one anchor that a task gets, whatever the corpus; only where more than ``most_hot``
    anchors are so common (their hashes reach the driver and every task) does the bound double.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.hash("text").alias("tag"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape(length, gram, max(16, -(-total // bucket_bytes)))

    asked = texts.where("doc_id is not null and text is not null").mapInArrow(_ask(shape), ASKED)
    shared = saved(asked.groupBy("bucket").applyInPandas(_answer(hot_from, shape.groups), SHARED))
    hot = _hot_anchors(shared, hot_from, most_hot)
    digests = texts.where("doc_id is not null").where(F.octet_length("text") >= length).select("doc_id", "tag", F.sha2("text", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copies = saved(digests.join(first, "digest").where("doc_id > first").select("doc_id", "tag").distinct())
    marks = shared.where("hot is null").groupBy("g").applyInPandas(_places, "doc_id long, tag int, pos binary").join(copies, ["doc_id", "tag"], "left_anti")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.repartition(n, "doc_id", "tag")
    marked = placed.join(marks.withColumnsRenamed({"doc_id": "m_id", "tag": "m_tag"}), (F.col("doc_id") == F.col("m_id")) & (F.col("tag") == F.col("m_tag"))).select("doc_id", "tag", "text", "pos")
    contexts = marked.mapInArrow(_contexts(shape, hot), CONTEXTS)
    spans = contexts.groupBy("bucket").applyInPandas(_decide(shape), SPANS).groupBy("g").applyInPandas(_join, JOINED)
    spans = spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    met = placed.join(spans.withColumnsRenamed({"doc_id": "s_id", "tag": "s_tag"}), (F.col("doc_id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left")
    return met.select("doc_id", "text", "begin", "end", "whole").mapInArrow(_cut_out(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
