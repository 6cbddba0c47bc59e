"""Brackets in linear time: what encloses, what closes, and what stands before a slash.

Patterns that look for a bracket from every blank or opening read a text again and again.
The patterns here begin at most once in a run of blanks, take what they read for good
(possessive), or go through the text piece by piece, each up to the next closing bracket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let, strip, sub

W = P.WS

#: Blanks in front of a bracket or word: tried once a run.
LEAD = rf"(?:(?<!{W}){W}++)?+"
BLANKS = rf"(?<!{W}){W}++"
#: Blanks behind a closing bracket that ends the text or the part before a slash.
BEFORE_SLASH = rf"{W}*+(?=/|\z)"

HAS_BRACKET = r"[(（\[［【]"
_LINE_END = r"\n\r\x{85}\x{2028}\x{2029}"
_NOTE_AT_END = rf"[)）]{BEFORE_SLASH}"
# one piece of the text: up to the next closing round bracket, from its first opening on
_PIECE = (
    rf"((?:{W}*+[^(（)）{P.WS_SET}]++)*+){W}*+[(（](?=[^)）{P.WS_SET}|]*+[{P.WS_SET}|])[^)）]*+{_NOTE_AT_END}"
    r"|([^(（)）]*+(?:[(（][^)）]*+[)）]?+|[)）]|\z))"
)


def drop_notes(c: Column, guard: str) -> Column:
    """Remove round brackets that hold a blank or a bar and end the text or stand before a slash.

    A bracket reaches from the first opening behind the last closing one to the next
    closing one. Openings that ``guard`` follows on the same line are none.
    """

    def hide(line: Column) -> Column:
        return let(
            F.regexp_extract(line, rf"(?i)^(.*){guard}", 1),
            lambda head: F.concat(
                F.translate(head, "(（", "\x03\x04"), F.substring(line, F.length(head) + 1, F.length(line))
            ),
        )

    def hidden(t: Column) -> Column:
        lines = F.split(t, rf"(?<=[{_LINE_END}])")
        marked = F.array_join(F.transform(lines, hide), "")
        return F.when(t.rlike(rf"(?im)^[^(（{_LINE_END}]*+[(（].*{guard}"), marked).otherwise(t)

    cut = lambda t: F.translate(sub(hidden(t), _PIECE, "$1$2"), "\x03\x04", "(（")
    return let(c, lambda t: F.when(t.rlike(_NOTE_AT_END), cut(t)).otherwise(t))


# --- the bracket that ends a text --------------------------------------------------------

_PAIRS = ((r"\(", r"\)"), ("（", "）"), (r"\[", r"\]"), ("［", "］"))
_CLOSED = r"[)）\]］]$"


def _nested(o: str, z: str) -> str:
    """Content of a bracket, read from its end; three levels deep."""
    level = rf"[^{o}{z}]*+"
    for _ in range(3):
        level = rf"(?:[^{o}{z}]++|{z}{level}{o})*+"
    return level


# read from the end of the text, so that the closing bracket is where the pattern begins
_SPACED = "(?s)^(?:" + "|".join(rf"{z}({_nested(o, z)}){o}" for o, z in _PAIRS) + rf")({W}.*)$"
_TIGHT = (
    "(?s)^(?:" + "|".join(rf"{z}([^()（）\[\]［］]{{1,120}}){o}" for o, z in _PAIRS) + ")(.*)$"
)


def _cut_deep(raw: Column) -> Column:
    """The same for any depth: counts brackets of the closing one's kind from the end."""

    def partner(kind: Column) -> Column:
        def step(s: Column, piece: Column) -> Column:
            depth = s["depth"] + F.when(piece == kind["close"], 1).when(piece == kind["open"], -1).otherwise(0)
            before = s["before"] - F.length(piece)
            found = s["at"].isNull() & (piece == kind["open"]) & (depth == 0)
            return F.struct(
                depth.alias("depth"), before.alias("before"),
                F.when(found, before).otherwise(s["at"]).alias("at"),
            )

        start = F.struct(
            F.lit(0).alias("depth"), kind["size"].alias("before"), F.lit(None).cast("int").alias("at")
        )
        pieces = F.reverse(F.split(raw, r"(?<=[()（）\[\]［］])|(?=[()（）\[\]［］])"))
        return F.aggregate(pieces, start, step, lambda s: s["at"])

    def cut(at: Column) -> Column:
        before = F.substring(raw, F.lit(1), at)
        content = F.substring(raw, at + 2, F.length(raw) - at - 2)
        return F.when(before.rlike(rf"{W}\z"), F.concat(content, F.lit("\x02"), before)).otherwise(raw)

    close = F.right(raw, F.lit(1))
    kind = F.struct(
        close.alias("close"), F.translate(close, ")）]］", "(（[［").alias("open"), F.length(raw).alias("size")
    )
    return let(let(kind, partner), cut)


def closing_brackets(raw: Column, use) -> Column:
    """``use`` of the readings of the bracket that closes ``raw`` (stripped), or ``raw``.

    Readings are structs ``before, content``: with a blank before the bracket and any
    content, and without brackets in it whatever stands before; both parts are stripped, and
    ``before`` is empty where there is no such reading.
    """

    def reading(cut: Column) -> Column:
        return let(
            cut,
            lambda p: F.struct(
                F.when(p.contains("\x02"), strip(F.substring_index(p, "\x02", -1))).otherwise("").alias("before"),
                strip(F.substring_index(p, "\x02", 1)).alias("content"),
            ),
        )

    def readings(back: Column) -> Column:
        spaced, tight = (F.reverse(sub(back, p, "$5\x02$1$2$3$4")) for p in (_SPACED, _TIGHT))
        deep = F.regexp_count(raw, F.lit(r"[(（\[［]")) > 3
        return F.array(
            reading(F.when(deep, _cut_deep(raw)).otherwise(spaced)), reading(tight)
        )

    return F.when(raw.rlike(_CLOSED), use(let(F.reverse(raw), readings))).otherwise(raw)
