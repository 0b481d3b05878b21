"""Chat formatting with typed content parts, by DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, units).  A visitor maps each part by its kind: text is
escaped, an image, audio clip or document becomes an ordered placeholder, its reference is recorded, and it counts
``units`` times the kind's tokens when a model expands it.  Turns stand between control strings; the output is a list
of segments, each under the loss mask or not, whose concatenation is the formatted conversation.

All control strings begin with ``<`` or ``[``.  Inside roles and texts a backslash follows each such character and
each backslash is doubled, so no text, nor two texts side by side, can form a control string; ``unescape`` undoes it.

Defined cases: a null text is empty; a null role is empty; null or empty parts give an empty turn; a part of an
unknown kind is shown by its text; null units count as one; turns with the same number stand in the order of role and
parts, repeated rows are turns of their own; rows with a null conv_id form one conversation; other columns are
ignored; an empty table gives no rows.  A conversation is one output row, so all its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that a unit of a kind expands to: an image's tile, an audio clip's second, a document's page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, safe in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def _by_kind(part: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for kind, value in cases.items():
        out = F.when(part["kind"] == kind, value).otherwise(out)
    return out


def _shown(part: Column) -> Column:
    """The visitor: escaped text, or the placeholder of an attachment."""
    return _by_kind(part, {kind: F.lit(f"<|{kind}|>") for kind in EXPANSION}, escape(part["text"]))


def _tokens(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1))
    return _by_kind(part, {kind: units * each for kind, each in EXPANSION.items()}, F.lit(0).cast("long"))


def text_parts(text: str) -> Column:
    """A plain text column as content: one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias(
        "ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation: segments (text, loss), formatted,
    attachments (turn_no, part_no, kind, ref, tokens) in order, and expanded_tokens."""
    role, parts = F.coalesce("role", F.lit("")), F.coalesce("parts", F.array().cast(PARTS))
    rows = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))

    def segments(turn: Column) -> Column:
        is_text = lambda p: ~F.coalesce(p["kind"], F.lit("")).isin(*EXPANSION)
        fixed = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        body = F.transform(turn["parts"], lambda p: F.struct(
            _shown(p).alias("text"), ((turn["role"] == "assistant") & is_text(p)).alias("loss")))
        head = F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT))
        return F.concat(F.array(fixed(head)), body, F.array(fixed(F.lit(END))))

    def attached(turn: Column, number: Column) -> Column:
        noted = F.transform(turn["parts"], lambda p, i: F.struct(
            number.alias("turn_no"), i.alias("part_no"), p["kind"].alias("kind"), p["ref"].alias("ref"),
            _tokens(p).alias("tokens")))
        return F.filter(noted, lambda a: F.coalesce(a["kind"], F.lit("")).isin(*EXPANSION))

    chats = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"),
                         F.flatten(F.transform("turns", attached)).alias("attachments"))
    return chats.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "attachments",
                        F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias(
                            "expanded_tokens"))


def parse(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation: role and text, unescaped, placeholders as they stand."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.lit(1 << 30))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def loss_text() -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
