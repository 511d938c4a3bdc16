"""Chat formatting from event logs: messages folded from deltas, edits and regenerations, then rendered and read back."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width

#: Tags of the known roles; any other role is written between ``[ROLE]`` and ``[/ROLE]``.
TAGS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"(?=/?(?:s>|INST\]|SYS\]|ANS\]|ROLE\]))"
_ESCAPE = re.compile(r"([<\[]\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[]\\*)\\" + _CONTROL)
_ROLES = {v: k for k, v in TAGS.items()}
EVENTS = "conv_id bigint, message bigint, part int, seq bigint, kind string, role string, text string"


def escape(text: str) -> str:
    """Put one more backslash after the first character of every control string, escaped or not, so that none is left."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text starts and ends in it."""
    head = OPEN + (f"[{TAGS[role]}]" if role in TAGS else f"[ROLE]{escape(role)}[/ROLE]")
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for piece in formatted.split(CLOSE)[:-1]:
        tag, body = piece[len(OPEN) + 1 :].split("]", 1)
        if tag in _ROLES:
            out.append((_ROLES[tag], unescape(body)))
        else:
            role, body = body.split("[/ROLE]", 1)
            out.append((unescape(role), unescape(body)))
    return out


#: Deltas that a streamed answer is cut in.
DELTAS = 4


def events_of(turns: DataFrame) -> DataFrame:
    """An event log that leads to the rows of ``conv_id, turn, role, text``, as a chat service would have written it.

    An assistant's text comes as a draft that is dropped by ``regenerate`` and then as ``DELTAS``
    deltas; a user's as a first version that an ``edit`` replaces; any other as one delta.
    Rows that share a turn are messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("part", F.row_number().over(order))
    none, text = F.lit(None).cast("string"), F.col("text")
    event = lambda seq, kind, text=none, role=none: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    piece = F.ceil(F.length("text") / DELTAS).cast("int")
    streamed = [event(3 + k, "delta", F.substring(text, F.lit(k) * piece + 1, piece)) for k in range(DELTAS)]
    start = event(0, "start", role=F.col("role"))
    log = F.when(F.col("role") == "assistant", F.array(start, event(1, "delta", F.reverse(text)), event(2, "regenerate"), *streamed))
    log = log.when(F.col("role") == "user", F.array(start, event(1, "delta", F.lit("a first version")), event(2, "edit", text))).otherwise(F.array(start, event(1, "delta", text)))
    return rows.select("conv_id", F.col("turn").alias("message"), "part", F.inline(log)).select("conv_id", "message", "part", "seq", "kind", "role", "text")


def fold_messages(events: DataFrame) -> DataFrame:
    """The final messages of an event log: ``conv_id, message, part, role, text``.

    Events of a message, by ``seq`` (ties: kind, then text): ``start`` names the role, ``delta``
    appends, ``edit`` replaces all before it, ``regenerate`` drops all before it, ``delete``
    removes the message unless a later ``edit`` or ``regenerate`` brings it back.  Null texts
    append nothing; the last role given stands, else ``""``.  Messages are folded one by one, so
    a conversation of many events is spread by its messages; repeated events apply twice.
    """
    logs = events.groupBy("conv_id", "message", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i))
    last = F.coalesce(F.array_max(resets), F.lit(-1))
    rest = F.filter(F.col("log"), lambda e, i: (i >= last) & e["kind"].isin("delta", "edit"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    gone = F.coalesce(F.get("log", last)["kind"] == "delete", F.lit(False))
    text = F.array_join(F.transform(rest, lambda e: e["text"]), "")
    return logs.where(~gone).select("conv_id", "message", "part", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), text.alias("text"))


def _render(batches):
    now, parts, spans, size, began = None, [], [], 0, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if began and conv != now:
                yield row()
                parts, spans, size = [], [], 0
            now, began = conv, True
            turn, start, end = render_turn(role, text)
            if role == "assistant":
                spans.append([size + start, size + end])
            parts.append(turn)
            size += len(turn)
    if began:
        yield row()


def format_chats(events: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id, formatted, loss_spans`` (from and to, in code points, of each assistant text).

    Every turn is ``<s>[TAG]text</s>``; control strings inside texts and roles are escaped
    reversibly.  Folded messages are sorted by conversation and streamed, so a task holds one
    conversation's output at a time.  Rows of a null conversation form one; a null message number comes first.
    """
    turns = fold_messages(events).select("conv_id", "role", "text", "message", "part")
    ordered = turns.repartition(shuffle_width(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message", "part")
    return ordered.mapInArrow(_render, "conv_id bigint, formatted string, loss_spans array<array<bigint>>")


def _read(batches):
    for batch in batches:
        rows = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns, all_turns, loss, chars = read_turns(formatted), hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in spans:
                text = unescape(formatted[a:b])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            for k, v in zip(rows, (len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(formatted)), strict=True):
                rows[k].append(v)
        arrays = [pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in rows.items()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", *rows])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from the formatted text and the loss spans alone."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
