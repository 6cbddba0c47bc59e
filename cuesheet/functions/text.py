"""Column functions on one text value: strip, normalise, split, times, brackets."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times without repeating its tree.

    A fold over nothing: the start value goes straight to the finishing lambda.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(P.WS_CHARS))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def markers(c: Column) -> Column:
    """Full-width digits and the marks used around numbers, to ASCII."""
    ascii = lambda t: F.translate(t, "０１２３４５６７８９：．＃", "0123456789:.#")
    return let(c, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(ascii(t)))


def _uniform(c: Column) -> Column:
    """Text with uniform line ends and blanks, its lines not yet trimmed."""
    # most texts are spared the steps that look at every character
    def when_any(t: Column, marks: str, step: Callable[[Column], Column]) -> Column:
        any_of = lambda v: functools.reduce(Column.__or__, [v.contains(m) for m in marks.split("|")])
        return let(t, lambda v: F.when(any_of(v), step(v)).otherwise(v))

    c = F.coalesce(c, F.lit(""))
    c = when_any(c, "\r", lambda t: sub(t, r"\r\n?", "\n"))
    c = when_any(c, "\u00a0|\u200b", lambda t: F.translate(t, "\u00a0\u200b", " "))
    return when_any(c, "\t|  ", lambda t: sub(t, r"[ \t]+", " "))


def _trimmed_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda l: l != "")


def clean_lines(c: Column) -> Column:
    """Array of trimmed, non-empty lines."""
    return _trimmed_lines(_uniform(c))


def normalize(c: Column) -> Column:
    return F.array_join(clean_lines(c), "\n")


def valid_seconds(label: Column) -> Column:
    """``seconds_of`` a label that is known to be a valid one in ASCII."""
    parts = lambda p: F.when(
        F.size(p) == 3,
        F.get(p, F.lit(0)).try_cast("int") * 3600
        + F.get(p, F.lit(1)).try_cast("int") * 60
        + F.get(p, F.lit(2)).try_cast("int"),
    ).otherwise(
        F.get(p, F.lit(0)).try_cast("int") * 60 + F.get(p, F.lit(1)).try_cast("int")
    )
    return let(F.split(label, ":"), parts)


def seconds_of(label: Column) -> Column:
    """``H:MM:SS`` or ``M:SS`` to seconds; null when malformed or out of range."""
    return let(
        markers(label), lambda t: F.when(t.rlike(rf"^{P.TS_VALID}$"), valid_seconds(t))
    )


# --- collapsed lines -------------------------------------------------------------

_CUT = "\x01"
_TS_IN_LINE = (
    rf"(^|[^0-9])((?:{P.TS_OPEN}{P.WS}*)?{P.TS}(?:{P.WS}*{P.TS_CLOSE})?)(?![0-9])"
)
_CUT_OFF_INVALID = rf"{_CUT}(?!(?:{P.TS_OPEN}{P.WS}*)?{P.TS_VALID})"
# on one line of the text
_TWO_TIMES = r"[0-9]:[0-9]{2}(?::[0-9]{2})?+[^\n]*?[0-9]:[0-9]{2}"
# "Nth song 38:12~43:24 title" keeps both times on one line
INLINE_RANGE_KEEP = (
    rf"(?s)^第?{P.WS}*[0-9]{{1,3}}{P.WS}*(?:曲目|曲)[：:{P.WS_SET}]*{P.TS}{P.WS}*"
    rf"{P.RANGE_MARK}{P.WS}*{P.TS}{P.WS}*(?:{P.QUOTE_OPEN}|.*[{P.DELIMS}]).+$"
)


def _split_line(line: Column) -> Column:
    cut = lambda l: sub(sub(l, _TS_IN_LINE, f"$1{_CUT}$2"), _CUT_OFF_INVALID)
    # translate looks up every character, replace searches for bytes
    whole = lambda marked: F.replace(marked, F.lit(_CUT), F.lit(""))
    pieces = lambda marked: F.when(
        F.octet_length(marked) - F.octet_length(whole(marked)) >= 2,
        F.filter(F.transform(F.split(marked, _CUT), strip), lambda s: s != ""),
    ).otherwise(F.array(whole(marked)))
    return let(
        line,
        # most lines hold one time at most
        lambda l: F.when(~l.rlike(_TWO_TIMES), F.array(l))
        .when(l.rlike(INLINE_RANGE_KEEP), F.array(l))
        .otherwise(let(cut(l), pieces)),
    )


def logical_lines(c: Column) -> Column:
    """Lines of a text, with several timed entries on one line cut apart."""
    cut = lambda lines: F.filter(F.flatten(F.transform(lines, _split_line)), lambda l: l != "")
    return let(
        markers(_uniform(c)),
        # in most texts no line is cut
        lambda t: F.when(~t.rlike(_TWO_TIMES), _trimmed_lines(t)).otherwise(cut(_trimmed_lines(t))),
    )


def logical_text(c: Column) -> Column:
    """The logical lines of a text, normalised and joined."""
    # pieces are trimmed and hold no blank twice, unless the mark of the cut stood between blanks
    return let(
        F.array_join(logical_lines(c), "\n"),
        lambda t: F.when(F.contains(c, F.lit(_CUT)), normalize(t)).otherwise(t),
    )


# --- bracket depth -------------------------------------------------------------

_HIDDEN = "\x02"


def outside_brackets(
    c: Column, opens: str = P.BRACKETS_OPEN, closes: str = P.BRACKETS_CLOSE
) -> Column:
    """Same-length copy of ``c`` in which delimiters inside brackets are hidden.

    All bracket kinds share one depth, and the depth never falls below zero.  Texts
    without nested or unclosed brackets need one pattern; the others are folded
    bracket by bracket.
    """
    o, z = P.char_set(opens), P.char_set(closes)
    other = P.other_set(opens + closes)
    side_by_side = rf"(?s)^{other}*+(?:{o}{other}*+{z}{other}*+)*+$"
    inside = rf"[{P.DELIMS}](?={other}*+{z})"

    def step(state: Column, piece: Column) -> Column:
        opening, closing = piece.rlike(rf"^{o}"), piece.rlike(rf"^{z}")
        depth = (
            F.when(opening, state["depth"] + 1)
            .when(closing, F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        hide = opening | closing | (state["depth"] > 0)
        shown = F.when(hide, F.repeat(F.lit(_HIDDEN), F.length(piece))).otherwise(piece)
        return F.struct(depth.alias("depth"), F.concat(state["mask"], shown).alias("mask"))

    # pieces are single brackets and what stands between them
    bracket = P.char_set(opens + closes)
    fold = lambda t: F.aggregate(
        F.split(t, rf"(?<={bracket})|(?={bracket})"),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("mask")),
        step,
        lambda s: s["mask"],
    )
    return let(
        c,
        lambda t: F.when(~t.rlike(o), t)
        .when(t.rlike(side_by_side), sub(t, inside, _HIDDEN))
        .otherwise(fold(t)),
    )


# --- character width ---------------------------------------------------------------

# from the compatibility forms of the block U+FF01 to U+FF9F, by rule
_WIDTH = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFA0)}
_SINGLE = {a: b for a, b in _WIDTH.items() if len(b) == 1 and a not in "ﾞﾟ"}
_VOICED = [
    (a + mark, joined)
    for a, b in _SINGLE.items() for mark in "ﾞﾟ"
    if len(joined := unicodedata.normalize("NFKC", a + mark)) == 1
]


def fold_width(c: Column) -> Column:
    """Full-width letters and half-width kana in their usual width."""
    voiced = c
    for pair, joined in _VOICED:
        voiced = F.replace(voiced, F.lit(pair), F.lit(joined))
    t = F.when(c.rlike("[ﾞﾟ]"), voiced).otherwise(c)
    folded = F.translate(t, "".join(_SINGLE) + "　", "".join(_SINGLE.values()) + " ")
    return F.when(c.rlike(r"[\x{FF01}-\x{FF9F}\x{3000}]"), folded).otherwise(c)


# blocks whose characters are their own compatibility form and join with none before them
_OWN_FORM = (
    r"\x00-\x7F\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2190}-\x{21FF}\x{2500}-\x{27BF}"
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{1F300}-\x{1F64F}"
)


def with_nfkc(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name``: the Unicode compatibility form of ``value``; Spark has no function for it.

    Widths are folded in the JVM. Only texts that are left with a character outside the plain
    blocks go to Python, the others as nulls.
    """

    def fold(texts):
        import unicodedata

        import pyarrow as pa

        return pa.array(
            [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()],
            pa.string(),
        )

    wide = df.withColumn(name, fold_width(value))
    other = F.when(F.col(name).rlike(f"[^{_OWN_FORM}]"), F.col(name))
    return wide.withColumn(name, F.coalesce(F.arrow_udf(fold, StringType())(other), F.col(name)))


# --- loose comparison --------------------------------------------------------------


def loose_key(c: Column) -> Column:
    """Spelling-independent key of a title or performer."""
    return F.lower(F.translate(c, "“”‘’\"'`，,、｡。!！?？~～.．…" + P.WS_CHARS, ""))


def annotation_key(c: Column) -> Column:
    return F.lower(
        F.translate(c, "“”‘’\"'`.．。｡、,，:：;；!！?？~～-—–−_" + P.DELIMS + P.WS_CHARS, "")
    )


def section_key(c: Column) -> Column:
    return F.lower(F.translate(c, "_-—–−" + P.DELIMS + ":：;；,，.。!！?？~～・･" + P.WS_CHARS, ""))
