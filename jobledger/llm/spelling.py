"""Words one edit apart, by finite-state composition, and the common form of each."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobledger.llm.acceptor import Acceptor, OneEdit
from jobledger.llm.line_dedup import lower_ascii
from jobledger.llm.shared import saved

#: Words that start in one state, at most: a state with more gives way to its successors.
MOST = 4096


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, alter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n) over whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of ``min_chars`` code points or more.

    ``alter(doc_id as text, run)`` gives the word of a run; it must not make it longer. Null texts have no words; a null doc_id is
    an empty text. Words that occur less than ``min_count`` times are left out. Counts are combined before the shuffle.
    """
    runs = F.explode(F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(rf"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("word"))
    if alter is not None:
        words = words.select(alter(F.col("doc"), F.col("word")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _half(m: Column, backward: Column) -> Column:
    """Symbols that fix the initial state: a pair whose shorter word has m symbols shares m - 1 at least, so either so many at its front or so many at its back."""
    front = F.floor((m - 1) / 2).cast("int")
    return F.when(backward, m - 1 - front).otherwise(front)


def initial_states(words: DataFrame, min_chars: int, most: int) -> DataFrame:
    """``words(word, n)`` -> (backward, m, state, arc, spelled, n): a row for each composition that a word takes part in.

    ``m`` is the length of the shorter word of the pairs sought: a word of L symbols is with its like (m = L) and with shorter
    ones (m = L - 1). ``state`` is the beginning that leads from the start to the initial state of the composition, of the
    word or, ``backward``, of the word spelled from its end.

    A state where more than ``most`` words start is taken one step of the composition further: copying leads to its
    successors (one symbol longer), and the edit's arc at the state itself leads to rows with ``arc`` set, whose key is
    all that is left of the word after the edit, so that words meet only if they differ there: no more than the alphabet has symbols. Steps end when
    no state has too many words.
    """
    length = F.char_length("word")
    ways = F.array(*[F.struct(F.lit(b).alias("backward"), (length - k).alias("m")) for b in (False, True) for k in (0, 1)])
    rows = words.select("word", "n", F.inline(ways)).where(F.col("m") >= min_chars)
    rows = rows.select("backward", "m", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("spelled"), "n")
    rows = rows.withColumn("state", F.left("spelled", _half(F.col("m"), F.col("backward"))))
    key, done = ["backward", "m", "state"], []
    while True:
        hot = saved(rows.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > most).select(*key))
        if hot.isEmpty():
            break
        rows = saved(rows)
        done.append(rows.hint("merge").join(hot, key, "left_anti").withColumn("arc", F.lit(None).cast("string")))
        rows = rows.hint("merge").join(hot, key, "left_semi")
        at = F.char_length("state")
        after, here = F.substr("spelled", at + 2), F.substr("spelled", at + 1)
        # another symbol in place of this one; one symbol more: the longer word's rest after it, the shorter word's rest from here
        arcs = F.when(F.char_length("spelled") == F.col("m"), F.array(F.concat(F.lit("="), after), F.concat(F.lit("+"), here))).otherwise(F.array(F.concat(F.lit("+"), after)))
        done.append(rows.select(*rows.columns, F.explode(arcs).alias("arc")))
        rows = rows.withColumn("state", F.left("spelled", at + 1))
    out = rows.withColumn("arc", F.lit(None).cast("string"))
    for part in done:
        out = out.unionByName(part)
    return out


def _pairs(backward: bool, m: int, state: str, arc: str | None, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of one edit whose first difference is at the end of ``state`` or later (at its end, for an arc), each once."""
    short, long = [w for w in words if len(w) == m], [w for w in words if len(w) > m]
    skip = len(state)
    if arc is not None:
        if arc[0] == "=":
            found = ((a, b) for i, a in enumerate(short) for b in short[i + 1 :])
        else:
            found = ((a, b) for a in short for b in long if a[skip : skip + 1] != b[skip])
    else:
        acceptor = Acceptor()
        start, more = acceptor.add(short, skip), acceptor.add(long, skip) if long else None
        edit = OneEdit(acceptor)
        found = [(state + a, state + b) for a, b in edit.replaced(start)]
        if more is not None and short:
            found += [(state + a, state + b) for a, b in edit.inserted(start, more)]
    if not backward:
        yield from found
        return
    front = (m - 1) // 2
    for a, b in found:  # those that begin alike are found from the front
        a, b = a[::-1], b[::-1]
        if a[:front] != b[:front]:
            yield a, b


def near_words(words: DataFrame, min_chars: int = 7, most: int = MOST) -> DataFrame:
    """``words(word, n)``, words distinct -> (a, a_n, b, b_n): every pair that differs by one inserted, deleted or replaced code point, once.

    The vocabulary is cut by the state from which a composition starts; the words of a state make a minimal acceptor, which
    is composed with the one-edit transducer and itself, and accepted pairs are enumerated. At most ``most`` words meet in
    a task at a time. No candidates are dropped. Words shorter than ``min_chars`` take no part; ``min_chars`` is 2 at least.
    """
    if min_chars < 2:
        raise ValueError("min_chars must be 2 at least")
    states = initial_states(words.where(F.char_length("word") >= min_chars), min_chars, most)
    groups = states.groupBy("backward", "m", "state", "arc").agg(F.sort_array(F.collect_list(F.struct("spelled", "n"))).alias("words")).where(F.size("words") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: tuple[list, ...] = ([], [], [], [])
            for row in range(batch.num_rows):
                backward, m, state, arc, members = (batch.column(c)[row].as_py() for c in range(5))
                n = {w["spelled"][::-1] if backward else w["spelled"]: w["n"] for w in members}
                for a, b in _pairs(backward, m, state, arc, [w["spelled"] for w in members]):
                    for side, value in zip(sides, (a, n[a], b, n[b]), strict=True):
                        side.append(value)
                if len(sides[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(s, t) for s, t in zip(sides, types, strict=True)], names=names)
                    sides = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(s, t) for s, t in zip(sides, types, strict=True)], names=names)

    types, names = (pa.string(), pa.int64(), pa.string(), pa.int64()), ["a", "a_n", "b", "b_n"]
    return groups.select("backward", F.col("m").cast("int"), "state", "arc", "words").mapInArrow(run, "a string, a_n long, b string, b_n long")


def roots(links: DataFrame, most_links: int) -> DataFrame:
    """``links(word, form)`` without cycles -> (word, root): the end of each chain of at most ``most_links`` forms, by pointer jumping."""
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, most_links))))):
        now = saved(now)
        ahead = now.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        now = now.hint("merge").join(ahead, F.col("root") == F.col("a_word"), "left").select("word", F.coalesce("a_root", "root").alias("root"))
    return now


def variants(words: DataFrame, min_chars: int = 7, times: int = 10, most: int = MOST) -> DataFrame:
    """``words(word, n)`` -> (word, form, root, n, n_near, form_n), a row for each word.

    ``form``: the near word (one edit away) of largest n, ties to the smallest in code point order, if that n is at least ``times``
    the word's own (``times`` > 1); else null. ``root``: where following forms ends, the word itself if it has none. n grows by ``times``
    with each form, which bounds the chains. ``n_near``: near words, 0 if none. An empty table gives none.
    """
    words = saved(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_words(words, min_chars, most)
    ends = F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("w"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    per_word = pairs.select(F.inline(ends)).groupBy("w").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= F.col("n") * times
    found = saved(words.join(per_word, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    ))
    spread = words.agg(F.max("n"), F.min("n")).first()  # two numbers
    longest = 0 if spread[0] is None else int(math.log(max(1, spread[0] / max(1, spread[1])), times) + 1e-9) + 1
    ends_at = roots(found.where("form is not null").select("word", "form"), longest).select(F.col("word").alias("r_word"), F.col("root").alias("r_root"))
    met = found.join(ends_at, F.col("word") == F.col("r_word"), "left")
    return met.select("word", "form", F.coalesce("r_root", "word").alias("root"), "n", "n_near", "form_n")
