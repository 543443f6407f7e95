"""Conversations as training windows of a token budget, cut between turns on prefix sums of their tokens."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released

BUDGET = 1024
#: Share of the budget that history, told again, may take at the start of a window.
HISTORY = 0.25

# The template. A turn is OPEN + NEW or OLD + role + MID + text + CLOSE.
OPEN, NEW, OLD, MID, CLOSE = "[INST ", "+", "=", "]", "</s>"
# Escaped inside roles and texts, so that no marker, ours or another template's, can arise there. Fixed values.
ESCAPES = {"\\": "\\\\", "[": "\\(", "]": "\\)", "<": "\\{", ">": "\\}"}
_BACK = {v: k for k, v in ESCAPES.items()}
_TURN = re.compile(re.escape(OPEN) + r"([+=])([^\]]*)\](.*?)" + re.escape(CLOSE), re.S)

WINDOW_SCHEMA = "conv_id long, window long, formatted string, mask array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return text.translate(str.maketrans(ESCAPES))


def unescape(text: str) -> str:
    return re.sub(r"\\[\\(){}]", lambda m: _BACK[m[0]], text)


def count_tokens(text: str) -> int:
    """A turn's tokens for the budget: runs of letters and digits, and every other mark."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def formatted_turn(sign: str, role: str, text: str) -> str:
    return OPEN + sign + escape(role) + MID + escape(text) + CLOSE


def windows(turns, budget: int = BUDGET, history: float = HISTORY, count=count_tokens):
    """Windows of a conversation's (role, text) turns, in order: (formatted text, spans under the loss mask).

    Spans are found on the prefix sums of the tokens of formatted turns, marks included. A leading system turn is kept in
    every window. A window takes as many whole new turns as the budget holds beside it and the whole history, one at
    least; history is the longest run of turns before them within its share of the budget and within what the new turns
    leave. So no window is over the budget but where the system turn and a single new turn are. What is repeated, targets
    too, is outside the mask. Every turn is new in exactly one window. Turns are taken from an iterator; only a window's
    worth and its history are held.
    """
    share = int(budget * history)
    system, kept = None, 0  # the system turn and its tokens, once it is repeated
    held, sums, start = [], [0], 0  # turns, their prefix sums, the first new one

    def told():
        """The first turn of the history that fits beside the new turns."""
        left = min(share, budget - kept - (sums[-1] - sums[start]))
        return bisect.bisect_left(sums, sums[start] - left, 0, start) if left > 0 else start

    def close():
        text, mask = "", []
        for sign, (role, body) in [*((OLD, t) for t in ([system] if kept else []) + held[told() : start]), *((NEW, t) for t in held[start:])]:
            if sign == NEW and role == "assistant":
                at = len(text) + len(OPEN + sign + escape(role) + MID)
                mask.append((at, at + len(escape(body))))
            text += formatted_turn(sign, role, body)
        return text, mask

    for k, (role, text) in enumerate(turns):
        size = count(formatted_turn(NEW, role, text))
        before = sums[start] - sums[bisect.bisect_left(sums, sums[start] - share, 0, start)]
        if start < len(held) and kept + before + sums[-1] - sums[start] + size > budget:
            yield close()
            first = 0
            if system and not kept:
                kept, first = sums[1], 1
            # what may be history later on
            first = max(first, bisect.bisect_left(sums, sums[-1] - share))
            held, sums = held[first:], [x - sums[first] for x in sums[first:]]
            start = len(held)
        if k == 0 and role == "system":
            system = (role, text)
        held.append((role, text))
        sums.append(sums[-1] + size)
    if start < len(held):
        yield close()


def read_window(formatted: str):
    """(is new, role, text) of each turn of a formatted window."""
    return [(s == NEW, unescape(r), unescape(t)) for s, r, t in _TURN.findall(formatted)]


def _by_conversation(batches, width: int):
    """(conv_id, iterator of its rows' other columns) from batches sorted by conversation."""
    rows = ((r[0], r[1:]) for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(width)), strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: float = HISTORY) -> DataFrame:
    """Windows (conv_id, window, formatted, mask) of conversations (conv_id, turn, role, text).

    Turns go by ``turn`` (null first), ties by role and text; repeated rows are turns of their own. Null texts and roles
    are empty; rows of null conv_id are one conversation. A turn over the budget is a window of its own (with the system
    turn), never cut: the only windows over it. Other columns are not read; an empty table gives no rows. A conversation is streamed, so its length is bounded by nothing.
    """
    prepare(conversations.sparkSession)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for conv, rows in _by_conversation(batches, 4):
            for n, (text, mask) in enumerate(windows(((r[1], r[2]) for _, r in rows), budget, history)):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "window": n, "formatted": text, "mask": [{"start": a, "end": b} for a, b in mask]}], schema=_ARROW)

    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(released(run), WINDOW_SCHEMA)


_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows alone."""

    def run(batches):
        out = []
        for conv, rows in _by_conversation(batches, 4):
            turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, (_, text, mask) in rows:
                length += len(text)
                for is_new, role, body in read_window(text):
                    if is_new:
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for m in mask:
                    under = unescape(text[m["start"] : m["end"]])
                    chars += len(under)
                    loss.update(under.encode("utf-8", "surrogatepass"))
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))
            if len(out) >= 4096:
                yield _digest_batch(out)
                out = []
        if out:
            yield _digest_batch(out)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(released(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


