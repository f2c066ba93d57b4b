r"""Chat formatting in budgeted windows: turn-aligned spans, a kept system turn, limited history, a loss mask.

A turn is written as `### <role>: <text></turn>` and a line break. Control strings inside roles and texts are
escaped, reversibly: `\` as `\\`, `###` as `\h`, `</turn>` as `\t`, and `:` in roles as `\c`.

A conversation's turns are cut into windows of up to `budget` tokens: prefix sums of the turns' tokens give the
last turn that still fits. A window that doesn't start the conversation begins with its system turn (its first
turn, if that has the role `system`) and up to `history` turns from before, of `history_tokens` at most; the
oldest go if the first new turn wouldn't fit otherwise. The loss mask covers the texts of new assistant turns
only, so every one is a target once, however often it is repeated as history. A turn over the budget has a
window of its own, marked over_budget: spans never cut a turn.

Long conversations are dealt by blocks of `block` turn numbers, so that one of a third of all rows is spread over
tasks; windows don't cross blocks, history and system turn do. A `system` turn after a gap of a whole block counts as a
first turn for its block.

Defined results: turns go by number (null first), then role and text; null roles and texts are empty; repeated
rows are turns of their own; a null conv_id is one conversation; a text of any length stays whole; an empty table
gives no window; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
_CODES = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HELD = 4096  # turns that a task lays out at once

WINDOWS = "conv_id bigint, block bigint, window int, n_context int, n_new int, tokens bigint, over_budget boolean, text string, loss array<struct<start:bigint,end:bigint>>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _CODES[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where in that its text starts and ends."""
    head = HEAD + escape(role).replace(":", "\\c") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise ValueError(f"no turn at {at}")
        middle = text.index(MIDDLE, at)
        end = text.index(END, middle)
        turns.append((unescape(text[at + len(HEAD) : middle]), unescape(text[middle + len(MIDDLE) : end])))
        at = end + len(END)
    return turns


def turn_tokens(role: Column, text: Column) -> Column:
    """Words, numbers and other characters of a turn, and four for its marks: the count where no tokenizer is given."""
    return F.regexp_count(F.concat(role, F.lit(" "), text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 4


class _Writer:
    """Windows of one block of a conversation, from its turns in order."""

    def __init__(self, key: tuple, budget: int, history: int, history_tokens: int):
        self.key, self.budget, self.history, self.history_tokens = key, budget, history, history_tokens
        self.system: tuple | None = None  # (role, text, tokens, whether it is of this block)
        self.before: list[tuple] = []  # turns that may be repeated, the latest last
        self.held: list[tuple] = []
        self.window, self.fresh = 0, True
        self.apart: tuple | None = None  # the system turn among those of the block before

    def add(self, kind: int, number: int | None, role: str, text: str, tokens: int) -> Iterator[tuple]:
        """kind: 0 for the system turn and 1 for turns of the block before, 2 for a turn of this block."""
        turn = (role, text, tokens, False)
        if kind == 0:
            self.system, self.apart = turn, (number, *turn)
        elif kind == 1:
            if self.apart == (number, *turn):
                self.apart = None  # is kept anyway; a repeated row of it is a turn like others
            else:
                self.before.append(turn)
        else:
            if self.fresh and self.system is None and not self.before and role == "system":
                turn = self.system = (role, text, tokens, True)  # the first turn of all
            self.fresh = False
            self.held.append(turn)
            if len(self.held) > _HELD:
                yield from self._write(False)

    def finish(self) -> Iterator[tuple]:
        yield from self._write(True)

    def _write(self, last: bool) -> Iterator[tuple]:
        """Windows of the held turns; unless they are the last, the final window may still grow and is kept."""
        sums = np.concatenate([[0], np.cumsum([t[2] for t in self.held])])
        start = 0
        while start < len(self.held):
            context = [] if self.system is None or self.held[start][3] else [self.system]
            past = self._past(start)
            need = sum(t[2] for t in context) + self.held[start][2]
            while past and need + sum(t[2] for t in past) > self.budget:
                past.pop(0)
            context += past
            spare = self.budget - sum(t[2] for t in context)
            end = max(start + 1, int(np.searchsorted(sums, sums[start] + spare, side="right")) - 1)
            if end >= len(self.held) and not last:
                break
            yield self._window(context, self.held[start:end])
            start = end
        self.before = self._past(start, self.history + 1)
        self.held = self.held[start:]

    def _past(self, start: int, most: int | None = None) -> list[tuple]:
        """The turns before held[start] that a window may repeat."""
        turns = [t for t in (self.before + self.held[max(0, start - self.history - 1) : start]) if not t[3]]
        turns = turns[len(turns) - min(len(turns), self.history if most is None else most) :]
        if most is None:
            while turns and sum(t[2] for t in turns) > self.history_tokens:
                turns.pop(0)
        return turns

    def _window(self, context: list[tuple], new: list[tuple]) -> tuple:
        text, loss, at = [], [], 0
        for k, turn in enumerate([*context, *new]):
            written, start, end = format_turn(turn[0], turn[1])
            if k >= len(context) and turn[0] == "assistant":
                loss.append({"start": at + start, "end": at + end})
            text.append(written)
            at += len(written)
        tokens = sum(t[2] for t in [*context, *new])
        self.window += 1
        return (*self.key, self.window - 1, len(context), len(new), tokens, tokens > self.budget, "".join(text), loss)


def windows(
    chats: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128, block: int = 256, tokens: Column | None = None
) -> DataFrame:
    """One row a window of the conversations (conv_id, turn, role, text), see WINDOWS; `tokens` counts a turn's tokens."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = chats.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (turn_tokens(role, text) if tokens is None else tokens).cast("bigint").alias("tokens"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens", "block")).alias("first"), F.max("block").alias("last"))
    system = first.where((F.col("first.role") == "system") & (F.col("last") != F.col("first.block"))).select(F.col("conv_id").alias("of"), "first")
    later = turns.select("conv_id", "block").distinct().join(system, F.col("conv_id").eqNullSafe(F.col("of"))).where(F.col("block") != F.col("first.block"))
    past = turns.where(F.pmod("turn", F.lit(block)) >= block - history)
    rows = (
        turns.select("conv_id", "block", F.lit(2).alias("kind"), "turn", "role", "text", "tokens")
        .union(past.select("conv_id", F.col("block") + 1, F.lit(1), "turn", "role", "text", "tokens"))
        .union(later.select("conv_id", "block", F.lit(0), *(F.col(f"first.{c}") for c in ("turn", "role", "text", "tokens"))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), _LOSS]
        names = "conv_id block window n_context n_new tokens over_budget text loss".split()
        writer: _Writer | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        out: list[tuple] = []
        for batch in batches:
            for conv, part, kind, number, role, text, count in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.key != (conv, part):
                    if writer is not None:
                        out += writer.finish()
                    writer = _Writer((conv, part), budget, history, history_tokens)
                out += writer.add(kind, number, role, text, count)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if writer is not None:
            out += writer.finish()
        if out:
            yield batch_of(out)

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    return dealt.mapInArrow(run, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation as its windows hold it, read back from their texts alone, see DIGESTS.

    New turns and masked texts are hashed in order as they pass, so a conversation needs no more memory than a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: list | None = None

        def closed() -> tuple:
            conv, turns, n, loss, loss_chars, chars = state
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            for conv, skip, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(closed())
                    state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse(text)[skip:]:
                    state[1].update(f"{role}\n{body}\n".encode())
                    state[2] += 1
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    state[3].update(body.encode())
                    state[4] += len(body)
                state[5] += len(text)
        if state is not None:
            out.append(closed())
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split(" ")[0] for f in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return dealt.select("conv_id", "n_context", "text", "loss").mapInArrow(run, DIGESTS)
