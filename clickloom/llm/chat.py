"""Operator 5: conversations rebuilt from event logs, and rendered for training."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<</?TURN"
_IN_TEXT = re.compile(rf"\\*(?:{_CONTROL})")
_ESCAPED = re.compile(rf"\\+(?:{_CONTROL})")
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_OPENER = re.compile(r"<<SYS>>|\[INST\]|<s>|<<TURN(?: ([^>]*))?>>")
_CLOSER = re.compile(r" (?:<</SYS>>|\[/INST\]|</s>|<</TURN>>)\n")
_ROLE_OF = {opener: role for role, (opener, _) in _MARKS.items()}


def escape(text: str) -> str:
    """One more backslash before every control string of the template, so that it is text."""
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of it that the loss covers: the assistant's texts.

    A turn is ``opener text closer`` and a line end.  Roles that the template does not know are named in the opener.
    """
    out, at, loss = [], 0, []
    for role, text in turns:
        named = "" if role is None else " " + quote(role, safe="")
        opener, closer = _MARKS.get(role, (f"<<TURN{named}>>", "<</TURN>>"))
        body = escape(text)
        start = at + len(opener) + 1
        out.append(f"{opener} {body} {closer}\n")
        if role == "assistant":
            loss.append((start, start + len(body)))
        at += len(out[-1])
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        opener = _OPENER.match(formatted, at)
        closer = _CLOSER.search(formatted, opener.end())
        role = _ROLE_OF.get(opener[0], None if opener[1] is None else unquote(opener[1]))
        turns.append((role, unescape(formatted[opener.end() + 1 : closer.start()])))
        at = closer.end()
    return turns


def fold(events: Iterator[tuple]) -> list[tuple[str | None, str]]:
    """Final turns of one conversation from its events (kind, message, role, text), in order.

    start opens a message; delta adds to its text (and opens it, if need be); edit replaces its text; regenerate
    empties it and drops every message after it.  Other kinds, and edits of a message that is not there, do nothing.
    """
    turns: list[list] = []
    place: dict[int, int] = {}
    for kind, message, role, text in events:
        at = place.get(message)
        if kind in ("start", "delta") and at is None:
            at = place[message] = len(turns)
            turns.append([role, []])
        if kind == "delta":
            turns[at][1].append(text)
        elif kind == "edit" and at is not None:
            turns[at][1] = [text]
        elif kind == "regenerate" and at is not None:
            del turns[at + 1 :]
            turns[at][1] = []
            place = {m: i for m, i in place.items() if i <= at}
    return [(role, "".join(parts)) for role, parts in turns]


def _value(x):
    """None for a missing value of a pandas column."""
    return None if x is None or x != x else x


def formatted(events: DataFrame, *order: Column | str, conv: str = "conv_id") -> DataFrame:
    """Fold every conversation's event log and render it.

    ``events`` has (conv, kind, message, role, text) and the columns it is ordered by.  Logs are partitioned by
    conversation and sorted; a task folds them as they stream by and holds one conversation at a time, which is one
    row of the result.  Returns (conv, n_turns, formatted, loss: array of spans).  Null texts are empty, null roles
    and a null conversation id are values like others, other columns are ignored, an empty log gives no row.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("_conv", T.StringType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss", T.ArrayType(span)),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(conversation, log):
            turns = fold(log)
            whole, loss = render(turns)
            return conversation, len(turns), whole, [{"start": a, "end": b} for a, b in loss]

        current, log, started = None, [], False
        for frame in frames:
            done = []
            columns = ("_conv", "kind", "message", "role", "text")
            for conversation, kind, message, role, text in zip(*(frame[c].tolist() for c in columns), strict=True):
                if started and conversation != current:
                    done.append(row(current, log))
                    log = []
                current, started = conversation, True
                log.append((kind, message, _value(role), _value(text) or ""))
            yield pd.DataFrame(done, columns=schema.names)
        if started:
            yield pd.DataFrame([row(current, log)], columns=schema.names)

    keyed = events.withColumn("_conv", F.col(conv).cast("string"))
    logs = (
        keyed.repartition("_conv")
        .sortWithinPartitions("_conv", *order)
        .select("_conv", "kind", F.col("message").cast("long").alias("message"), "role", "text")
    )
    back = F.col("_conv").cast(events.schema[conv].dataType).alias(conv)
    return logs.mapInPandas(run, schema).select(back, *schema.names[1:])


def events_of_turns(turns: DataFrame, delta: int = 256) -> tuple[DataFrame, list[str]]:
    """The event log of a table (conv_id, turn, role, text): each turn opens a message and streams its text in deltas.

    As in a chat's own log, half of the turns (by a hash of their content) are not right at once: a draft is streamed
    first, and then edited away, or for a quarter of the turns dropped by a regeneration, before the text comes.
    Returns the log and the columns it is ordered by.  Rows that share a turn stay apart, ordered by content.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("text", F.lit("")).alias("_text"),
        F.xxhash64("role", "text").alias("tie"),
        F.monotonically_increasing_id().alias("message"),
    )
    # Part -2 opens the message, -1 is the draft and 0 what takes it away; the text follows from 1.
    parts = F.sequence(F.lit(-2), F.ceil(F.length("_text") / delta).cast("int"))
    drafted = F.pmod("tie", F.lit(2)) == 0
    undo = F.when(F.pmod("tie", F.lit(4)) == 0, "regenerate").otherwise("edit")
    text = (
        F.when(F.col("part") == -1, F.concat(F.lit("Draft: "), F.substring("_text", 1, 64)))
        .when(F.col("part") == 0, F.when(undo == "edit", ""))
        .when(F.col("part") > 0, F.substring("_text", (F.col("part") - 1) * delta + 1, F.lit(delta)))
    )
    events = rows.withColumn("part", F.explode(parts)).where(~F.col("part").isin(-1, 0) | drafted)
    log = events.select(
        "conv_id",
        "turn",
        "tie",
        "message",
        "part",
        F.when(F.col("part") == -2, "start").when(F.col("part") == 0, undo).otherwise("delta").alias("kind"),
        "role",
        text.alias("text"),
    )
    return log, ["turn", "tie", "message", "part"]


def digests(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: turns, the text under the loss, and lengths."""
    schema = T.StructType(
        [
            T.StructField("_conv", T.StringType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for whole, spans in zip(frame["formatted"], frame["loss"], strict=True):
                turns = parse(whole)
                said = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(whole[s["start"] : s["end"]]) for s in spans)
                rows.append(
                    (
                        len(turns),
                        sha256(said.encode()).hexdigest(),
                        len(loss),
                        sha256(loss.encode()).hexdigest(),
                        len(whole),
                    )
                )
            out = pd.DataFrame(rows, columns=schema.names[1:])
            out.insert(0, "_conv", frame["_conv"].to_numpy())
            yield out

    rows = conversations.select(F.col(conv).cast("string").alias("_conv"), "formatted", "loss")
    back = F.col("_conv").cast(conversations.schema[conv].dataType).alias(conv)
    return rows.mapInPandas(run, schema).select(back, *schema.names[1:])
