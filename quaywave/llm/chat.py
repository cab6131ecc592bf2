"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Fixed template: a turn is OPEN role NEWLINE text CLOSE. BAR never stands unescaped inside a role or text.
BAR, ESCAPE = "|", "\\"
OPEN, CLOSE = "<|turn ", "<|end|>\n"


def escape(text: str) -> str:
    """Reversible: a backslash doubles, a bar becomes backslash-b; so no text can hold a control string."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(BAR, ESCAPE + "b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BAR if m[1] == "b" else m[1], text, flags=re.S)


def frame(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, what stands after it."""
    return f"{OPEN}{escape(role).replace(chr(10), ESCAPE + 'n')}|>\n", escape(text), CLOSE


@dataclass
class Example:
    """One formatted example. start and end are code points of the trainable span; both 0 where none is."""

    target: int
    text: str
    start: int
    end: int


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[Example]:
    """An example for each assistant turn: all turns before it as context, only that reply trainable.

    A conversation that doesn't end in an assistant turn gets one more example, without a target, so
    that the output holds every turn."""
    context, size, last, k = [], 0, False, -1
    for k, (role, text) in enumerate(turns):
        head, body, tail = frame(role, text)
        context.append(head + body + tail)
        last = role == "assistant"
        if last:
            context = ["".join(context)]
            yield Example(k, context[0], size + len(head), size + len(head) + len(body))
        size += len(head) + len(body) + len(tail)
    if k >= 0 and not last:
        yield Example(-1, "".join(context), 0, 0)


_TURN = re.compile(r"<\|turn ([^|]*)\|>\n([^|]*)<\|end\|>\n")


def read_turns(text: str, at: int = 0) -> list[tuple[str, str]]:
    """The turns that a formatted text holds from position `at` on."""
    out = []
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(.)", lambda x: {"b": BAR, "n": "\n"}.get(x[1], x[1]), m[1], flags=re.S)
        out.append((role, unescape(m[2])))
        at = m.end()
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Consecutive rows of one conversation, streamed: one batch is in memory."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

    feed = rows()
    row = next(feed, None)
    while row is not None:
        conv = row[0]

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[0] == conv:
                role, text = row[1], row[2]
                row = next(feed, None)
                yield role, text

        part = turns()
        yield conv, part
        for _ in part:  # what the reader left
            pass


def _in_order(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (position of the trainable turn, -1: none), text, loss_start, loss_end.

    turns: conv_id, turn, role, text. Turns stand in order of turn; ties in order of role, then text;
    repeated rows are turns of their own. Null roles and texts are empty. Rows stream through a task
    sorted, so a long conversation never sits in memory as a group; an example holds its own context."""
    kind = pa.schema([("conv_id", pa.int64()), ("target", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, part in _conversations(batches):
            for x in expand(part):
                held.append((conv, x.target, x.text, x.start, x.end))
                size += len(x.text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)

    ship(turns.sparkSession)
    return _in_order(turns).mapInArrow(run, "conv_id long, target long, text string, loss_start long, loss_end long")


def digest_chats(examples: DataFrame) -> DataFrame:
    """What format_chats wrote, read back: one row per conversation with n_turns, turns_sha256 (role, newline,
    text, newline of each turn), loss_chars, loss_sha256 (the unescaped text under the loss masks, in order)
    and formatted_chars (of all its examples). Takes the examples as format_chats leaves them: a
    conversation's rows together and in order; no further exchange."""
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def finish(conv: int | None, text: str, loss: "hashlib._Hash", loss_chars: int, chars: int) -> tuple:
        turns = read_turns(text)
        told = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
        return conv, len(turns), told.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or state[0] != conv:
                    done += [finish(*state)] if state else []
                    state = [conv, "", hashlib.sha256(), 0, 0]
                said = unescape(text[start:end])
                state[2].update(said.encode("utf-8", "surrogatepass"))
                state[1], state[3], state[4] = text, state[3] + len(said), state[4] + len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kind.types)], schema=kind)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(finish(*state), kind.types)], schema=kind)

    ship(examples.sparkSession)
    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
