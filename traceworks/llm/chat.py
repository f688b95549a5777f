"""Chat formatting with a grammar round trip.

    conversation = { turn }
    turn         = "<turn>" role NL "### " NL text NL "</turn>" NL

A rendered turn is parsed again by a deterministic parser; as long as what it recovers differs from the source, the
turn is rendered at the next level of escaping: nothing, the control strings inside the text, and control strings
inside the role too. An escaped control string carries one more backslash than the source has in front of it, so
the escape is undone by taking one away, whatever the text holds.

Turns are rendered and checked one by one, and conversations are read back as a stream of sorted turns, so the length
of a conversation does not bear on memory.

Defined results: null text and null role are empty; turns with equal numbers are ordered by role and text, null
numbers first; repeated rows are turns of their own; rows without conversation id form one conversation; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MARK, CLOSE = "<turn>", "### ", "</turn>"
_CONTROL = re.compile(r"(\\*)(<turn>|</turn>|### )")
_ESCAPED = re.compile(r"\\(\\*(?:<turn>|</turn>|### ))")
_BREAKS = {"\\": "\\\\", "\n": "\\n"}

TURNS = ("conv_id long, turn long, role string, formatted string, escapes int, loss_start long, loss_end long")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape("".join(_BREAKS.get(c, c) for c in role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m.group(1) == "n" else "\\", unescape(role))


def _bare(text: str, control: str, at: int) -> int:
    """Where ``control`` stands next without a backslash before it, or -1."""
    at = text.find(control, at)
    while at > 0 and text[at - 1] == "\\":
        at = text.find(control, at + 1)
    return at


class Grammar(ValueError):
    """The text is no sequence of turns."""


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end are where the escaped text stands."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise Grammar(f"no turn at {at}")
        line = rendered.find("\n", at)
        if line < 0 or not rendered.startswith(MARK + "\n", line + 1):
            raise Grammar(f"no mark after {at}")
        start = line + 2 + len(MARK)
        close = _bare(rendered, CLOSE, start)
        if close < start + 1 or rendered[close - 1] != "\n" or not rendered.startswith("\n", close + len(CLOSE)):
            raise Grammar(f"no end after {start}")
        text = rendered[start : close - 1]
        for control in (OPEN, MARK):
            if _bare(text, control, 0) >= 0:
                raise Grammar(f"{control} inside the turn at {at}")
        turns.append((unescape_role(rendered[at + len(OPEN) : line]), unescape(text), start, close - 1))
        at = close + len(CLOSE) + 1
    return turns


def _render(role: str, text: str, level: int) -> str:
    role = escape_role(role) if level > 1 else role
    text = escape(text) if level > 0 else text
    return f"{OPEN}{role}\n{MARK}\n{text}\n{CLOSE}\n"


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, escape level, start and end of the text in it): the first level that parses back."""
    for level in range(3):
        rendered = _render(role, text, level)
        try:
            turns = parse(rendered)
        except Grammar:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, level, turns[0][2], turns[0][3]
    raise Grammar(f"turn cannot be rendered: {role!r}")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            out = [format_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            learn = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                 pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] if m else None for o, m in zip(out, learn)], pa.int64()),
                 pa.array([o[3] if m else None for o, m in zip(out, learn)], pa.int64())],
                ["conv_id", "turn", "role", "formatted", "escapes", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per turn: the rendered turn, its escape level, and the loss mask as a span of the rendered text.

    The rendered turns of a conversation in order are its formatted text; the span is null outside assistant turns.
    """
    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                text(role_col).alias("role"), text(text_col).alias("text"))
    return rows.mapInArrow(_formatted, TURNS)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "escaped_turns long")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest every conversation from its rendered turns, which arrive in order."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, state, done = None, None, []

    def closed() -> tuple:
        return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "escapes", "loss_start", "loss_end")]
        for conv, rendered, level, start, end in zip(*columns):
            if now != (conv,):
                if now is not None:
                    done.append(closed())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(rendered):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                learnt = unescape(rendered[start:end])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(rendered)
            state[5] += level > 0
        if done:
            yield rows()
            done.clear()
    if now is not None:
        done.append(closed())
        yield rows()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered turns of ``format_turns``."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").mapInArrow(
        _folded, DIGESTS)
