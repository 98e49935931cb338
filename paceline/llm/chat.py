"""Chat formatting with a grammar round trip.

A turn is written as its role's opening mark, the text, and the closing mark:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     [ROLE name] text [/ROLE]

A deterministic parser reads rendered text back. A turn is first rendered as it is; if the parser doesn't return it,
control strings in it get a backslash in front, the backslashes before them being doubled, and it is parsed again.
Turns delimit themselves, so a conversation is the turns one after the other, and turns of one long conversation
are rendered and verified by different tasks. The loss mask covers the texts of assistant turns.

Nulls: a null role or text is an empty one. Ties in turn go by role, then text; repeated rows are repeated turns.
A null conversation is a conversation of its own. Empty tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from paceline.llm.store import text_batches

MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE", "[/ROLE]"]
_ANY = "|".join(map(re.escape, CONTROL))
# runs of backslashes are taken whole, from their start: linear on long ones
_CONFLICT = re.compile(rf"(?<!\\)(\\*+)({_ANY})")
_ESCAPED = re.compile(rf"(?<!\\)(\\++)({_ANY})")
_ROLE_OPEN = re.compile(r"\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.S)
#: A control string that no odd run of backslashes stands before.
_FREE = re.compile(rf"(?<!\\)(?:\\\\)*+({_ANY})")


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def _marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return "[ROLE " + re.sub(r"([\\\]\[<>])", r"\\\1", role) + "] ", " [/ROLE]"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the (escaped) text stands, of each turn; ValueError if it is none of the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        for role, (opening, closing) in MARKS.items():
            if rendered.startswith(opening, at):
                begin = at + len(opening)
                break
        else:
            m = _ROLE_OPEN.match(rendered, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            role, begin, closing = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end(), " [/ROLE]"
        m = _FREE.search(rendered, begin)
        if not m or m[1] != closing[1:] or m.start(1) <= begin - 1 or rendered[m.start(1) - 1] != " ":
            raise ValueError(f"the turn at {at} does not end")
        end = m.start(1) - 1
        if end < begin:
            raise ValueError(f"the turn at {at} has no room for its text")
        turns.append((role, unescape(rendered[begin:end]), begin, end))
        at = m.end(1)
    return turns


def render(role: str, text: str) -> str:
    """The turn as a string that parses back to it; content is escaped only where it conflicts."""
    opening, closing = _marks(role)
    for content in (text, escape(text)):
        rendered = opening + content + closing
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise ValueError(f"a turn of role {role!r} does not survive the round trip")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and rendered, loss_start, loss_end of each row; concatenated by turn, rendered is the conversation.

    loss_start and loss_end are the code points of rendered under the loss mask, equal where there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                r = render(role, text)
                begin, end = parse(r)[0][2:] if role == "assistant" else (0, 0)
                rows.append((r, begin, end))
            r, begin, end = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=[*batch.schema.names, "rendered", "loss_start", "loss_end"])

    x = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    kinds = dict(x.dtypes)
    return text_batches(x).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, rendered string, loss_start long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from rendered alone.

    Rows stream by conversation and turn; only hash states are held, whatever the length of a conversation.
    """
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        done: list[tuple] = []

        def close() -> None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(rendered)
            if len(done) > 5000:
                yield batch_of(key_type)
        if state is not None:
            close()
            yield batch_of(key_type)

    x = turns.select("conv_id", "turn", "role", "text", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return text_batches(x.select("conv_id", "rendered")).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
