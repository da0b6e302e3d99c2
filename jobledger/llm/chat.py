"""Chat formatting from event logs.

A log row is an event of a conversation: ``message`` starts a message, ``delta`` appends streamed text to the latest
message of its turn, ``edit`` replaces that message's text, ``regenerate`` empties it for the deltas that follow.
Logs are partitioned by conversation, sorted, and folded as a stream, one conversation's messages at a time.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside texts and roles every ``<`` + n backslashes
+ ``|`` gets one more backslash, so no text can hold a control string, and taking one away restores it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
MESSAGES = "conv_id long, messages array<struct<turn:long,role:string,text:string>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Fold:
    """Messages of one conversation, event by event."""

    def __init__(self) -> None:
        self.messages: list[list] = []  # turn, role, pieces
        self.latest: dict = {}

    def add(self, kind: str, turn, role: str | None, text: str | None) -> None:
        at = self.latest.get(turn)
        if kind == "message" or at is None:
            at = [turn, role or "", []]
            self.messages.append(at)
            self.latest[turn] = at
        if kind in ("edit", "regenerate"):
            at[2].clear()
        if kind != "regenerate":
            at[2].append(text or "")

    def result(self) -> list[dict]:
        return [{"turn": t, "role": r, "text": "".join(p)} for t, r, p in self.messages]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted events -> conversations; a conversation may run over several batches."""
    now, fold = None, None
    out: list[tuple] = []
    for batch in batches:
        null = batch["conv_id"].isna().to_numpy()
        ids = batch["conv_id"].astype("object").to_numpy()
        turns = batch["turn"].astype("object").where(batch["turn"].notna(), None)
        for missing, conv, kind, turn, role, text in zip(null, ids, batch["kind"], turns, batch["role"], batch["text"], strict=True):
            key = None if missing else int(conv)
            if fold is None or key != now:
                if fold is not None:
                    out.append((now, fold.result()))
                now, fold = key, Fold()
            fold.add(kind, None if turn is None else int(turn), role, text)
        if len(out) >= 500:
            yield pd.DataFrame({"conv_id": pd.array([c for c, _ in out], "Int64"), "messages": [m for _, m in out]})
            out = []
    if fold is not None:
        out.append((now, fold.result()))
    if out:
        yield pd.DataFrame({"conv_id": pd.array([c for c, _ in out], "Int64"), "messages": [m for _, m in out]})


def reconstruct(events: DataFrame, order: list[str]) -> DataFrame:
    """``events(conv_id, kind, turn, role, text, ...)`` -> conv_id, messages (turn, role, text) in the order they began.

    ``order`` names the columns that sequence a conversation's events. Null texts are empty, null roles too; an unknown
    turn's delta, edit or regenerate starts its message; events with a null conv_id make one conversation of their own;
    equal events apply each. A conversation's events go through one task as a sorted stream, in which only its final
    messages are held: its output is one row.
    """
    cols = ["conv_id", *dict.fromkeys([*order, "kind", "turn", "role", "text"])]
    return events.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInPandas(_fold, MESSAGES)


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, messages -> conv_id, formatted, loss (begin, end code points of assistant texts in it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, losses = [], []
            for messages in batch["messages"]:
                parts, spans, at = [], [], 0
                for m in messages:
                    head, body = START + escape_role(m["role"]) + "\n", escape(m["text"])
                    if m["role"] == "assistant":
                        spans.append({"begin": at + len(head), "end": at + len(head) + len(body)})
                    parts += [head, body, END]
                    at += len(head) + len(body) + len(END)
                texts.append("".join(parts))
                losses.append(spans)
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "formatted": texts, "loss": losses})

    return conversations.mapInPandas(run, "conv_id long, formatted string, loss array<struct<begin:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, parsed from the formatted text alone: conv_id, turns (role, text), loss_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [[{"role": unescape_role(r), "text": unescape(t)} for r, t in _TURN.findall(f)] for f in batch["formatted"]]
            loss = ["".join(unescape(f[int(s["begin"]) : int(s["end"])]) for s in spans) for f, spans in zip(batch["formatted"], batch["loss"], strict=True)]
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "turns": turns, "loss_text": loss, "formatted_chars": [len(f) for f in batch["formatted"]]})

    return formatted.mapInPandas(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


def message_events(conversations: DataFrame, piece: int = 400) -> DataFrame:
    """Stored turns as a log that could have written them, in pieces of ``piece`` characters: conv_id, turn, nth, part, kind, role, text.

    By a hash, a turn is streamed at once (``message``, then ``delta``), or after a draft that was dropped (``message``,
    ``regenerate``, ``delta``), or with a draft that was corrected (``message``, ``edit``, ``delta``). Rows of a conversation
    follow each other by turn, then role and text; ``nth`` tells rows of one turn apart. Null texts are empty; null ids and turns
    are values of their own; repeated rows are messages each.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))  # one pass over the text
    way = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(3))
    event = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    draft = event(F.lit("message"), F.lit("a draft"))
    before = F.when(way == 1, F.array(draft, event(F.lit("regenerate"), F.lit(None).cast("string")))).when(way == 2, F.array(draft)).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    first = F.when(way == 1, "delta").when(way == 2, "edit").otherwise("message")
    whole = F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)
    stream = F.transform(whole, lambda p, i: event(F.when(i == 0, first).otherwise("delta"), p))
    parts = rows.select("conv_id", "turn", "nth", "role", F.posexplode(F.concat(before, stream)).alias("part", "e"))
    return parts.select("conv_id", "turn", "nth", "part", "e.kind", "role", "e.text")
