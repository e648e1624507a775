"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered array of parts ``struct<kind, text, ref, units>``. The
visitor flattens it: text parts give their escaped text, image, audio and
document parts give one placeholder each, and their references are recorded with
the place of the placeholder and the token count it expands to (units times the
rate of the kind, rounded up). Turns are framed by control strings; inside texts
every control string is broken by a backslash after its first character, and
backslashes are doubled, so the text can be read back. Roles are percent-coded.

Output of ``format_chats``: the formatted string, the loss mask as code-point
spans over it (one for each trained turn's body), the attachments, and the
expanded token count of all attachments.

Defined results: null text or a null part array is empty text; an unknown part
kind counts as text; a null role is an empty role; a null conversation id is a
conversation of its own; turns go by (turn, role, body), nulls first, so
repeated rows keep their number and ties have one order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's frame, and the control strings of common chat templates.
TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = [TURN, END, *PLACEHOLDER.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>"]
# Expanded tokens for one unit: an image tile, a second of audio, a page.
RATES = {"image": 256.0, "audio": 25.0, "document": 1024.0}
PART = "struct<kind:string,text:string,ref:string,units:double>"

_FIND = "(?s)(?=" + "|".join(re.escape(c) for c in CONTROLS) + ")(.)"


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string after its first character."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _FIND, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


_ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"), ("\\", "%5C")]


def encode_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for plain, code in _ROLE_CODES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def decode_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*PLACEHOLDER), F.lit(False))


def _flat(part: Column) -> Column:
    shown = escape(part["text"])
    for kind, mark in PLACEHOLDER.items():
        shown = F.when(part["kind"] == kind, F.lit(mark)).otherwise(shown)
    return shown


def _tokens(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, r in RATES.items():
        rate = F.when(part["kind"] == kind, F.lit(r)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("long")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, n_attachment_tokens.

    A conversation's rows meet in one task because its result is one string; ids
    spread the conversations over the partitions.
    """
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), encode_role(F.col(role_col)).alias("role"), parts.alias("parts"))
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.array_join(F.transform("parts", _flat), "").alias("body"),
            F.transform(F.filter("parts", _is_attachment), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"),
        ).alias("m"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    shown = lambda m: F.concat(F.lit(TURN), m["role"], F.lit("\n"), m["body"], F.lit(END + "\n"))
    head = len(TURN) + 1
    # A running end of turn in code points gives each body's span.
    spans = F.aggregate(
        "ms",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(shown(m))).cast("long").alias("at"),
            F.when(m["role"] == trained_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + head + F.length(m["role"])).cast("long").alias("start"), F.length(m["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select(
        "conv_id",
        F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.transform("ms", shown), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m, i: F.transform(m["attachments"], lambda a: F.struct(i.cast("long").alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ms", lambda m: m["attachments"])), F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as an array of struct<role, text>."""
    pieces = F.split(formatted, re.escape(TURN))
    body = lambda p: F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(decode_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
