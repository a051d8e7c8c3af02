"""Chat formatting from event logs.

A conversation is the fold of its events in order of sequence: messages, streamed deltas, edits, regenerations.
The final messages are rendered with a template whose control strings cannot occur in escaped text, so the
output can be read back exactly, and with the places of assistant text (the loss mask).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template of a turn.
HEAD, COLON, END = "### ", ": ", " </turn>\n"
#: Escapes: each control string has a character of these, so none is left in escaped text.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
DELTA_CHARS = 4096
_ESCAPE = str.maketrans(ESCAPES)
_UNESCAPE = re.compile(r"\\([\\hlc])")
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
_SEGMENT = "conv_id long, position long, role string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = f"{HEAD}{escape(role)}{COLON}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, _, rest = turn[len(HEAD) :].partition(COLON)
    return unescape(role), unescape(rest[: -len(END)])


def fold(messages: list[list], op: str, target: int | None, role: str, text: str) -> None:
    """Apply one event to the messages [id, role, pieces] so far.

    message: a new message.  delta: text after that of message ``target`` (null: the last).  edit: ``target`` (null: the last) gets this text.
    regenerate: ``target`` and all after it go, a new message takes their place.  Events on messages that are
    not there, and unknown ones, change nothing.
    """
    at = len(messages) - 1
    if target is not None:
        at = next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == target), -1)
    if op == "message":
        messages.append([target, role, [text]])
    elif op == "delta" and at >= 0:
        messages[at][2].append(text)
    elif op == "edit" and at >= 0:
        messages[at][2] = [text]
    elif op == "regenerate" and at >= 0:
        del messages[at:]
        messages.append([target, role, [text]])


def message_events(rows: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Events (conv_id, seq, tie, message_id, part, op, role, text) of finished conversations (conv_id, turn, role, text).

    Long texts become a message and deltas of at most ``delta_chars`` characters.  Null roles and texts are empty.
    Rows of the same turn keep an order by role and by the hash of the text; repeated rows are turns of their own.
    """
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    pieces = F.when(F.length("body") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))
    return (
        clean.withColumn("tie", F.xxhash64("body")).withColumn("message_id", F.monotonically_increasing_id())
        .select("conv_id", "seq", "role", "tie", "message_id", F.posexplode(pieces).alias("part", "text"))
        .withColumn("op", F.when(F.col("part") == 0, "message").otherwise("delta"))
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """One row for each final message: conv_id, position (from 0), role, formatted, loss_start, loss_end.

    ``events`` has conv_id, seq, op, role, text and, if there are any, message_id (what an event is about), tie
    and part (order among equal seq).  A conversation's formatted text is its rows' ``formatted`` joined in order
    of position; a conversation's rows stand together and in order in their partition.  loss_start and loss_end
    bound the assistant's text in ``formatted`` (null for other roles).  A task holds one conversation at a time.
    """
    have = set(events.columns)
    order = [F.col(c) for c in ("seq", "role", "tie", "message_id", "part") if c in have and (c != "role" or "tie" in have)]
    picked = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("op").cast("string").alias("op"),
        (F.col("message_id").cast("long") if "message_id" in have else F.lit(None).cast("long")).alias("target"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("who"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
        *[c.alias(f"_{i}") for i, c in enumerate(order)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        messages: list[list] = []
        now, begun = None, False

        def close() -> None:
            nonlocal size
            for i, (_, role, pieces) in enumerate(messages):
                formatted, a, b = render(role, "".join(pieces))
                loss = role == "assistant"
                rows.append((now, i, role, formatted, a if loss else None, b if loss else None))
                size += len(formatted)
            messages.clear()

        def flush() -> pa.RecordBatch:
            nonlocal size
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", "position", "role", "formatted", "loss_start", "loss_end"])
            rows.clear()
            size = 0
            return batch

        for batch in batches:
            for conv, op, target, who, said in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not begun or conv != now:
                    close()
                    now, begun = conv, True
                    if size > 4_000_000 or len(rows) > 10_000:
                        yield flush()
                fold(messages, op, target, who, said)
        close()
        if rows:
            yield flush()

    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", *[f"_{i}" for i in range(len(order))])
    return dealt.mapInArrow(run, _SEGMENT)


def read_back(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of conversations, read from ``formatted`` and the loss mask as format_conversations gives them.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256,
    formatted_chars.  The digests run along; no conversation is held whole.  A conversation's rows may lie anywhere;
    ``in_order``: they stand together and in order, as format_conversations leaves them, and need no shuffle.  Rows
    without conv_id are one conversation.  A digest over a conversation's turns in order is one task's work, however
    long the conversation; it takes the memory of one turn.
    """
    if not in_order:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    picked = segments.select("conv_id", "position", "role", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, position, formatted, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if state is None or position == 0 or conv != state[0]:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(formatted)
                if a is not None:
                    masked = unescape(formatted[a:b])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
            if len(done) > 10_000:
                yield _digests(done)
                done.clear()
        close()
        if done:
            yield _digests(done)

    return picked.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
