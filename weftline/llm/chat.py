r"""Chat formatting with a grammar that is read back before it is believed.

A user turn is written ``<s>[INST] text [/INST]``, an assistant turn `` text </s>`` after the marker
``[OUT]``, any other role ``<s>[ROLE name] text [/ROLE]``. A turn is first written with its text as it is. The
deterministic parser takes no bare control string inside a text and reads the escape sign as one, so it refuses or
misreads a turn with conflicting content; then the control strings and the sign inside are escaped, and the turn is
read back again. Turns close themselves, so a conversation reads back turn by turn.

Nulls: a null text is empty, a null role an empty name; rows with a null conv_id form one conversation; a null
turn comes first. Rows that tie in (conv_id, turn) are ordered by role and text, and all are kept. Empty tables
give no rows; other columns of the input are ignored. Long conversations are streamed: one worker holds one
turn and running digests, never a whole conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that the grammar gives a meaning; each is escaped by a sign before it, as is the sign itself.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE ", "[/ROLE]")
SIGN = "\\"
_find = regex.compile("|".join(regex.escape(x) for x in (SIGN, *CONTROL)))
_find_role = regex.compile("|".join(regex.escape(x) for x in (SIGN, *CONTROL, "]")))
_frames = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}


def escape(text: str) -> str:
    return _find.sub(lambda m: SIGN + m[0], text)


def frame(role: str) -> tuple[str, str]:
    return _frames.get(role) or (f"<s>[ROLE {escape(role).replace(']', SIGN + ']')}] ", " [/ROLE]")


def _content(raw: str, at: int, closing: str) -> tuple[str, int]:
    """Unescaped text from `at` to the closing string, and where that string ends. Raises ValueError for a bare control
    string before it, or if it does not come."""
    out, mark = [], closing.lstrip(" ")
    space = len(closing) - len(mark)
    find = _find if mark in CONTROL else _find_role
    while m := find.search(raw, at):
        if m[0] == SIGN:
            out.append(raw[at : m.start()])
            step = find.match(raw, m.end())
            taken = step[0] if step else raw[m.end() : m.end() + 1]
            out.append(taken)
            at = m.end() + len(taken)
        elif m[0] == mark and m.start() - space >= at and raw.endswith(" " * space, 0, m.start()):
            out.append(raw[at : m.start() - space])
            return "".join(out), m.end()
        else:
            raise ValueError("a control string stands inside a text")
    raise ValueError("a turn is not closed")


def parse(raw: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; raises ValueError where the grammar does not hold."""
    turns, at = [], 0
    while at < len(raw):
        for role, (head, tail) in _frames.items():
            if raw.startswith(head, at):
                break
        else:
            if not raw.startswith("<s>[ROLE ", at):
                raise ValueError("no turn starts here")
            role, end = _content(raw, at + len("<s>[ROLE "), "]")
            head, tail, at = " ", " [/ROLE]", end
            if not raw.startswith(head, at):
                raise ValueError("no text follows the role")
        text, at = _content(raw, at + len(head), tail)
        turns.append((role, text))
    return turns


def render(role: str, text: str) -> str:
    """The turn as written; escaped only if it does not read back as it is."""
    head, tail = frame(role)
    for content in (text, escape(text)):
        raw = head + content + tail
        try:
            if parse(raw) == [(role, text)]:
                return raw
        except ValueError:
            pass
    raise ValueError("a turn can't be written reversibly")


def _ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, chunk): the chunks of a conversation in order of n, from 0, make its formatted text."""

    def run(batches):
        last, n = (), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                n = n + 1 if last == (conv,) else 0
                last = (conv,)
                out.append((conv, n, render(role, text)))
            cols = list(zip(*out)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=["conv_id", "n", "chunk"])

    return _ordered(conversations).mapInArrow(run, "conv_id long, n long, chunk string")


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation with digests of what the parser reads from its chunks; assistant turns are under the loss mask.

    chunks: as format_turns gives them, in its partitions and order; raises ValueError if a conversation's chunks are
    not in the order of n."""

    def run(batches):
        now, state = (), None
        done = []

        def close():
            if state:
                n, turns, chars, loss, size, _ = state
                done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, n, chunk in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "n", "chunk"))):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if n != state[5]:
                    raise ValueError(f"chunk {state[5]} of conversation {conv} is missing")
                state[5] += 1
                for role, text in parse(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(chunk)
            yield _rows(done)
            done = []
        close()
        yield _rows(done)

    def _rows(done):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = list(zip(*done)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=names)

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
