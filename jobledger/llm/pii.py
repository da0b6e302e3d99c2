"""Personal data in texts: fixed rules, and spans that a character model learned from what the rules label."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobledger.llm.bilstm import BiLstmCrf, encode
from jobledger.llm.shared import saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a look back spares retries within a run of digits, where no match can begin
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What every span holds, as :func:`plausible` asks for it: a digit, an at sign, or at between others than letters A-Z; and spelt-out signs of an address.
TRIGGER = r"[0-9@]|(?:^|[^A-Za-z])[Aa][Tt](?:[^A-Za-z]|$)|[\[({<] ?(?:dot|DOT) ?[\])}>]"
_TRIGGER = re.compile(TRIGGER.replace("[0-9@]|", "[0-9@]+|", 1))
#: Width of a window and the step from one to the next: a span of WIDTH - STEP characters lies whole in one.
WIDTH, STEP = 80, 40
#: Text read on either side of a trigger.
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one at sign to the next: linear, since no run before an at sign is looked at twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(_LOCAL))
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
        done = tail.end() if tail else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted: leftmost non-overlapping matches of each kind that pass its test; failing ones aren't tried otherwise."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if "0" <= c <= "9")
            if 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def windows_of(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, cut before, cut after) of overlapping windows over all that lies within REACH of a trigger."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        at = a
        while True:
            end = min(b, at + WIDTH)
            out.append((at, end, at > a, end < b))
            if end == b:
                break
            at += STEP
    return out


def label_row(spans: list[tuple[int, int, int]], start: int, end: int) -> np.ndarray:
    """Labels of the window [start, end). A span that began before the window begins anew; where spans overlap, the one that starts first counts."""
    out = np.zeros(WIDTH, np.int64)
    free = start
    for s, kind, e in spans:
        s, e = max(s, free), min(e, end)
        if s < e:
            out[s - start : e - start] = 2 * kind + 2
            out[s - start] = 2 * kind + 1
            free = e
    return out


def _shuffled_digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def rewritten(r: random.Random, kind: int, span: str) -> str:
    """The same datum in a form that the rules don't know."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), ("@", "(dot)"), (" AT ", " DOT ")])
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return r.choice(["[.]", "(.)", " . ", "[dot]"]).join(span.split("."))
    if kind == 2:
        by = r.choice([".", "/", "  ", " - "])
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return r.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", f"1-{last[:3]}-{last[3:6]}-{last[6:]}", f"001 {last[:3]} {last[3:6]} {last[6:]}"])


def decoy(r: random.Random) -> str:
    """Digits and signs that are nobody's."""
    d = lambda n: _shuffled_digits(r, n)
    return r.choice([
        f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(24):02}:{d(2)}:{d(2)}", f"{r.randrange(10)}.{r.randrange(20)}.{r.randrange(20)}", f"{d(1)}.{d(2)}", d(r.randrange(1, 8)), f"{d(1)},{d(3)},{d(3)}.{d(2)}",
        f"#{d(5)}", f"v{d(1)}.{d(1)}", f"{d(2)}%", f"${d(3)}.{d(2)}", f"[{d(1)}]", f"{d(4)}/{d(2)}/{d(2)}", "".join(r.choices("0123456789abcdef", k=r.choice([8, 32, 40]))), f"{d(4)}-{d(4)}", f"pp. {d(3)}-{d(3)}", f"@{r.choice(['home', 'work', 'user'])}", f"{d(3)} {d(3)}", f"{d(9)}{d(9)}{d(5)}",
    ])


@dataclass
class Detector:
    """``net``: None where no text gave a labelled span; then the rules stand alone. ``least``: mean probability of the labels of a span that is taken."""

    net: BiLstmCrf | None
    least: float = 0.8

    def spans(self, texts: list[tuple[str, list[tuple[int, int, bool, bool]]]], batch: int = 512) -> list[list[tuple[int, int, int, float, bool]]]:
        """(start, kind, end, score, cut) found in the windows of each text."""
        out: list[list] = [[] for _ in texts]
        if self.net is None:
            return out
        flat = [(i, w) for i, (_, ws) in enumerate(texts) for w in ws]
        for k in range(0, len(flat), batch):
            part = flat[k : k + batch]
            labels, sure = self.net.decode(encode([texts[i][0][a:b] for i, (a, b, _, _) in part], WIDTH))
            for (i, (a, b, before, after)), row, by in zip(part, labels, sure, strict=True):
                row = row[: b - a]
                if not row.any():
                    continue
                first = np.flatnonzero((row > 0) & (row % 2 == 1))
                ends = np.flatnonzero((row > 0) & (np.append(row[1:], 0) != row + row % 2)) + 1
                for s in first:
                    e = int(ends[np.searchsorted(ends, s, side="right")])
                    cut = bool((before and s == 0) or (after and e == b - a))
                    out[i].append((a + int(s), int(row[s]) // 2, a + e, float(by[s:e].mean()), cut))
        return out


def plausible(kind: int, span: str) -> bool:
    """Whether a span can be of its kind in any spelling: a sign or word for at; four numbers to 255; 12 to 19 digits that pass Luhn's test; 9 to 15 digits."""
    if kind == 0:
        return "@" in span or re.search(r"(?i)(?<![a-z])at(?![a-z])", span) is not None
    numbers = re.findall("[0-9]+", span)
    if kind == 1:
        return len(numbers) == 4 and all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in numbers)
    digits = "".join(numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def reconciled(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float, bool]], least: float) -> list[tuple[int, int, int, float]]:
    """Spans to add to the rules' own, over the whole text: (start, kind, end, score), sorted, without overlaps.

    Windows overlap, so a span that a window's edge cuts is replaced by the whole one of the next window; where no window holds
    it whole, its pieces of one kind are joined. Blanks at the ends go, and spans that can't be of their kind. Spans that touch one of the rules' are dropped, since
    those stay. Of the rest, the set without overlaps of largest total score is taken.
    """
    whole = sorted((s, e, k, v) for s, k, e, v, cut in found if not cut)
    starts, ends = [w[0] for w in whole], sorted(w[1] for w in whole)
    pieces: dict[int, list[list]] = {}
    for s, k, e, v, cut in sorted(found):
        if cut and bisect_left(starts, e) == bisect_right(ends, s):  # no whole one overlaps it
            row = pieces.setdefault(k, [])
            if row and s <= row[-1][1]:
                row[-1] = [row[-1][0], max(e, row[-1][1]), k, max(v, row[-1][3])]
            else:
                row.append([s, e, k, v])
    best: dict[tuple[int, int, int], float] = {}
    for s, e, k, v in [*whole, *(tuple(p) for row in pieces.values() for p in row)]:
        part = text[s:e]
        e -= len(part) - len(part.rstrip(" \t\r\n.,;:!?"))
        s += len(part) - len(part.lstrip(" \t\r\n.,;:!?"))
        if s < e and v >= least and plausible(k, text[s:e]):
            best[s, e, k] = max(v, best.get((s, e, k), v))
    fixed = sorted((s, e) for s, _, e in base)
    reach, far = [], 0  # the rules' own may overlap each other
    for _, e in fixed:
        far = max(far, e)
        reach.append(far)
    rest = []
    for (s, e, k), v in best.items():
        i = bisect_left(fixed, (e, -1))
        if i == 0 or reach[i - 1] <= s:
            rest.append((e, s, k, v))
    rest.sort()
    stops, total, take = [r[0] for r in rest], [0.0], []
    for i, (_, s, _, v) in enumerate(rest):
        j = bisect_right(stops, s, 0, i)
        use = total[j] + v > total[i]
        take.append(j if use else -1)
        total.append(total[j] + v if use else total[i])
    out, i = [], len(rest)
    while i:
        if take[i - 1] >= 0:
            e, s, k, v = rest[i - 1]
            out.append((s, k, e, v))
            i = take[i - 1]
        else:
            i -= 1
    return sorted(out)


def _hits(column: pa.Array) -> np.ndarray:
    """Rows with a trigger."""
    found = pc.match_substring_regex(column, TRIGGER).fill_null(False)
    return np.flatnonzero(found.to_numpy(zero_copy_only=False))


def fit(docs: DataFrame, per_kind: int = 1500, steps: int = 220, seed: int = 0) -> Detector:
    """A detector trained on windows whose spans the rules label.

    Of all windows of ``docs``, at most ``per_kind`` that hold a span of each kind and as many that hold none are taken,
    those of least hash of their text: the same in every run. Each window with spans is used as it is, thrice with its spans in
    forms that the rules don't know (same labels), and with numbers that are no personal data in their place (no labels).
    Training is a fixed number of steps on the driver, whatever the table's size.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts, kinds, spans = batch.column(0), [], [], []
            for i in _hits(column):
                text = column[int(i)].as_py()
                base = base_spans(text)
                for a, b, _, _ in windows_of(text):
                    own = [(s - a, k, e - a) for s, k, e in base if s < b and a < e]
                    if all(0 <= s and e <= b - a for s, _, e in own):
                        texts.append(text[a:b])
                        kinds.append(own[0][1] if own else -1)
                        spans.append(",".join(f"{s}:{k}:{e}" for s, k, e in own))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(kinds, pa.int32()), pa.array(spans, pa.string())], names=["text", "kind", "spans"])

    found = saved(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(label, "text string, kind int, spans string").distinct())
    order = Window.partitionBy("kind").orderBy(F.xxhash64("text"), "text", "spans")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_kind).drop("n").orderBy("kind", F.xxhash64("text"), "text", "spans").collect()  # at most (kinds + 1) * per_kind short texts
    if not any(r.kind >= 0 for r in rows):
        return Detector(None)
    r, texts, labels = random.Random(seed), [], []
    for row in rows:
        spans = [tuple(map(int, s.split(":"))) for s in row.spans.split(",") if s]
        versions = [None, rewritten, rewritten, rewritten, decoy] if spans else [None]
        for version in versions:
            out, at, moved = "", 0, []
            for s, k, e in spans:
                if s < at:
                    continue
                out += row.text[at:s]
                new = row.text[s:e] if version is None else version(r, k, row.text[s:e]) if version is rewritten else version(r)
                if version is not decoy:
                    moved.append((len(out), k, len(out) + len(new)))
                out, at = out + new, e
            out += row.text[at:]
            texts.append(out[:WIDTH])
            labels.append(label_row(moved, 0, min(len(out), WIDTH)))
    net = BiLstmCrf(len(KINDS), seed=seed).fit(encode(texts, WIDTH), np.array(labels), steps, seed=seed)
    return Detector(net)


SPANS = "array<struct<start:int,kind:string,end:int,base:boolean,score:double>>"


def detect(docs: DataFrame, detector: Detector, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) as a struct ``row``, with ``spans``: personal data of the whole text, by start and then kind in the order of KINDS.

    Offsets count code points, ends are exclusive. ``base``: found by the rules; these all stay. Others are the model's: the
    text within reach of a digit, an at sign or a word for one is read in overlapping windows, each is decoded, and what they give is
    reconciled over the whole text. Other text can't hold these kinds. Null and empty texts have no spans. No shuffle.
    """
    names = docs.columns if keep is None else keep
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([inner.schema["row"], *T.StructType.fromDDL(f"spans {SPANS}").fields])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), [[] for _ in range(batch.num_rows)]
            hits = _hits(column)
            for k in range(0, len(hits), 256):
                part = [column[int(i)].as_py() for i in hits[k : k + 256]]
                found = detector.spans([(t, windows_of(t)) for t in part])
                for i, text, mine in zip(hits[k : k + 256], part, found, strict=True):
                    base = base_spans(text)
                    both = [(s, k, e, True, None) for s, k, e in base] + [(s, k, e, False, v) for s, k, e, v in reconciled(text, base, mine, detector.least)]
                    out[int(i)] = [{"start": s, "kind": KINDS[k], "end": e, "base": b, "score": v} for s, k, e, b, v in sorted(both, key=lambda x: x[:3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=["row", "spans"])

    return inner.mapInArrow(run, schema)
