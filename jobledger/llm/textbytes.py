"""Vectorised work on the UTF-8 bytes of an Arrow batch of texts.

Words are judged on bytes: every separator used here is an ASCII byte and every byte of a multi-byte
character is 0x80 or more, so byte classes and code point classes agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Separators of `[^\x20\x09-\x0D]+` words.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that are worked on at a time: temporaries are about 60 times this.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A code for each byte after A-Z became a-z.
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64, or of its inverse."""
    key = "inverse" if inverse else "plain"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        base = U64(_inverse(int(BASE))) if inverse else BASE
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK + 1024:
            _powers[key] = have
    return have[:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[k] * BASE ** k for i <= k < j."""
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same value for equal spans wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - at[0]


def row_groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and 32,768 rows; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, i + 32_768, max(i + 1, j))
        yield i, j
        i = j


def table_of(separators: bytes) -> np.ndarray:
    """Byte to bool: part of a word."""
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


BLANK_WORDS = table_of(BLANKS)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[:0x80] = False
ALNUM_WORDS[ord("0") : ord("9") + 1] = True
ALNUM_WORDS[ord("a") : ord("z") + 1] = True
ALNUM_WORDS[ord("A") : ord("Z") + 1] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``raw``, and for each text the index of its first word (n + 1 values).

    Bytes are looked at in pieces, so a very long text costs little more than its words.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # edge[i]: a text begins at byte i
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts, ends = [], []
    for a in range(0, n, 4 * CHUNK):
        b = min(n, a + 4 * CHUNK)
        word = inside[raw[a:b]]
        before = np.concatenate([[a > 0 and bool(inside[raw[a - 1]])], word[:-1]])
        starts.append(np.flatnonzero(word & (~before | edge[a:b])) + a)
        after = np.concatenate([word[1:], [b < n and bool(inside[raw[b]])]])
        ends.append(np.flatnonzero(word & (~after | edge[a + 1 : b + 1])) + 1 + a)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_runs(starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of words that lie within ``limit`` bytes; a longer word stands alone."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        yield i, j
        i = j


def span_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> np.ndarray:
    """:func:`span_hashes` of spans of bytes with A-Z lower-cased; starts and ends grow. At most ``limit`` bytes are worked on at a time."""
    out = np.empty(len(starts), dtype=U64)
    for i, j in word_runs(starts, ends, limit):
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= limit:
            out[i:j] = span_hashes(prefix_hashes(_BYTE_LOWER[raw[a:b]]), starts[i:j] - a, ends[i:j] - a)
        else:
            total = 0
            for x in range(a, b, limit):
                part = _BYTE_LOWER[raw[x : min(b, x + limit)]]
                total += int((part * powers(len(part))).sum(dtype=U64)) * pow(int(BASE), x - a, 1 << 64)
            out[i] = total % (1 << 64)
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    return mix(span_sums(raw, starts, ends) + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def hash_word(word: str) -> int:
    """The value that :func:`word_hashes` gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words: len(words) - n + 1 values."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def ngram_hashes_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Values of :func:`ngram_hashes` at some places."""
    out = words[at]
    for k in range(1, n):
        out *= U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
        out += words[at + k]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def per_batch(work: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]], column: str = "text", limit: int = CHUNK):
    """A mapInArrow function that calls ``work(bytes, offsets, rows)`` on groups of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
            for i, j in row_groups(offsets, limit):
                yield from work(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], batch.slice(i, j - i))

    return run
