"""Chat formatting by event-sourced reconstruction (operator 7).

A log of events makes conversations. Each event belongs to a conversation and, in it, to the message at ``turn``; ``seq``
orders the events of a conversation. ``op`` is

- ``message``: a message begins with this role and text; a turn may hold several, and later events go to its last,
- ``delta``: the text is put at the message's end,
- ``edit``: the text replaces the message's,
- ``regenerate``: the text replaces the message's, and messages of later turns that began before this event are dropped.

Events are folded message by message, so a long conversation is spread over many tasks; then each conversation's
messages are read in order and rendered one at a time. No task holds more than a message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's control strings.
USER = ("<s>[INST] ", " [/INST]")
ASSISTANT = (" ", " </s>")
SYSTEM = ("<<SYS>>\n", "\n<</SYS>>\n\n")
OTHER = ("[ROLE]", "[SAYS] ", " [/ROLE]")
CONTROLS = ("<<SYS>>", "<</SYS>>", "</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]")

_tails = "|".join(re.escape(c) for c in CONTROLS)
_ESCAPE = re.compile(rf"\\|{_tails}")
_UNESCAPE = re.compile("|".join([r"\\\\", *(re.escape(c[0]) + r"\\" + re.escape(c[1:]) for c in CONTROLS)]))


def escape(text: str) -> str:
    """A backslash is doubled; one is put behind the first character of a control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[0] == "\\\\" else m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and where its loss span begins and ends; they are equal for all roles but the assistant."""
    if role == "assistant":
        out = ASSISTANT[0] + escape(text) + ASSISTANT[1]
        return out, len(ASSISTANT[0]), len(out) - len(ASSISTANT[1])
    if role == "user":
        return USER[0] + escape(text) + USER[1], 0, 0
    if role == "system":
        return SYSTEM[0] + escape(text) + SYSTEM[1], 0, 0
    return OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2], 0, 0


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts from rendered messages; texts hold no control string, so the next one found ends them."""
    at = 0

    def upto(control: str, skip: int) -> str:
        nonlocal at
        end = formatted.index(control, at)
        out, at = formatted[at : end - skip], end + len(control)
        return unescape(out)

    while at < len(formatted):
        if formatted.startswith(USER[0], at):
            at += len(USER[0])
            yield "user", upto("[/INST]", 1)
        elif formatted.startswith(SYSTEM[0], at):
            at += len(SYSTEM[0])
            yield "system", upto("<</SYS>>", 1)
            at += 2
        elif formatted.startswith(OTHER[0], at):
            at += len(OTHER[0])
            role = upto("[SAYS]", 0)
            at += 1
            yield role, upto("[/ROLE]", 1)
        elif formatted.startswith(ASSISTANT[0], at):
            at += 1
            yield "assistant", upto("</s>", 1)
        else:
            raise ValueError(f"not in the template at {at}: {formatted[at : at + 40]!r}")


def fold(events: Iterable[tuple[int, str, str, str]]) -> tuple[str, str, int | None, int | None]:
    """Role, text, first seq and last seq of a regeneration from one message's (seq, op, role, text) in order."""
    role, parts, first, again = "", [], None, None
    for seq, op, who, text in events:
        first = seq if first is None else first
        if who:
            role = who
        if op == "delta":
            parts.append(text)
        elif op in ("message", "edit"):
            parts = [text]
        elif op == "regenerate":
            parts, again = [text], seq
        else:
            raise ValueError(f"no such event: {op}")
    return role, "".join(parts), first, again


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, first, again) from events (conv_id, seq, turn, op, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done(out: list) -> None:
            if held:
                out.append((*key, *fold(held)))
                held.clear()

        for batch in batches:
            out: list = []
            for conv, turn, seq, op, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, turn) != key or op == "message":
                    done(out)
                    key = (conv, turn)
                held.append((seq, op, role, text))
                if len(held) >= 4096:  # a long run of deltas is folded as it goes
                    if all(x[1] == "delta" for x in held[1:]):
                        held[:] = [(held[0][0], held[0][1], held[0][2] or next((x[2] for x in held if x[2]), ""), "".join(x[3] for x in held))]
            yield _messages(out)
        out = []
        done(out)
        yield _messages(out)

    clean = events.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "op", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, turn long, role string, text string, first long, again long")


def _messages(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["conv_id", "turn", "role", "text", "first", "again"])


def _in_order(events: DataFrame) -> DataFrame:
    return messages(events).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "first", "role", "text")


def _living(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, int | None, str, str]]]:
    """For each batch the (conv_id, turn, role, text) that no earlier message's regeneration has dropped."""
    conv, now, cut, coming = object(), None, None, None
    for batch in rows:
        out = []
        for c, turn, role, text, first, again in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                conv, now, cut, coming = c, turn, None, None
            if turn != now:
                now, cut = turn, coming
            if cut is None or first is None or first > cut:
                out.append((c, turn, role, text))
                if again is not None:
                    coming = again if coming is None else max(coming, again)
        yield out


def formatted(events: DataFrame) -> DataFrame:
    """One row for each final message, to be put together by (conv_id, turn): conv_id, turn, piece, loss_start, loss_end.

    The loss span is in characters of the piece, empty but for the assistant's. Null texts and roles are empty; a null
    conv_id is a conversation of its own, a null turn comes first; events that repeat are applied each, in the order of
    op, role and text where seq is equal; an empty log gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for living in _living(batches):
            done = [(c, t, *render(role, text)) for c, t, role, text in living]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 5, kinds)], names=["conv_id", "turn", "piece", "loss_start", "loss_end"])

    return _in_order(events).mapInArrow(run, "conv_id long, turn long, piece string, loss_start long, loss_end long")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, start: int, end: int) -> None:
        for role, text in parse(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        said = unescape(piece[start:end])
        self.loss.update(said.encode("utf-8", "replace"))
        self.loss_chars += len(said)
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(events: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the rendered pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def emit(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

        for batch in batches:
            out = []
            for conv, _, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                now.add(piece, start, end)
            yield emit(out)
        yield emit([now.row()] if now is not None else [])

    # each conversation lies in one partition in the order of its turns, as ``formatted`` has left them
    return formatted(events).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as a log: each row is a message, also where rows repeat a turn."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), "role", "text")
    return rows.select("conv_id", F.col("at").alias("seq"), F.col("at").alias("turn"), F.lit("message").alias("op"), "role", "text")


def control_case(spark: SparkSession) -> DataFrame:
    """Conversation -7: both sides say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def op7(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(as_events(rows.union(control_case(conversations.sparkSession))))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|/s>|s>|INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\])', '\1\\\2', 'g') AS esc,
  regexp_replace(replace(role, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|/s>|s>|INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\])', '\1\\\2', 'g') AS esc_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(esc) + CASE role WHEN 'assistant' THEN 6 WHEN 'user' THEN 18 WHEN 'system' THEN 19 ELSE 21 + length(esc_role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
