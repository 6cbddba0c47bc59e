"""Join multi-line entries to "time title / performer" lines.

Each line of a text becomes ``<tag><payload>\\n`` with a one-character tag for its
class.  One regular expression with the merge forms as alternatives then walks the
tagged text from left to right; every alternative eats whole lines, so its order is the
priority and its length is what the merge uses up.  No shuffle, no Python, linear time.

Tags: A inline range, T/U title line (without/with time), N number, S time only,
P placeholder, Q open range, C closed range (lower case: time out of range),
t translation, D/d not a song (as is/after the tree mark), L title and performer,
W other line with a time, X anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.memo import per_context
from ..functions.rows import explode_rows
from ..functions.text import let, strip, sub
from .text import SURE_LINES, line_flags, with_lines

_SEP = "\x02"
_ANY = r"[^\n]*\n"
_GET = r"([^\n]*)\n"

# a title line: the parsed text, a separator, the line itself
_TITLE = rf"[TU]([^{_SEP}\n]*){_SEP}[^\n]*\n(?:[tDspqc]{_ANY}){{0,5}}" \
         rf"(?:[SPQ]{_GET}(?:[Ss]{_ANY})?|C{_GET})"
# number or range, times, translations, then a song within eight lines
_BLOCK_BODY = (
    rf"(?=(?:{_ANY}){{0,7}}[LT])(?:[Ntspqc]{_ANY}){{0,7}}[SPQC]{_GET}"
    rf"(?:[SPQCspqct]{_ANY}){{0,7}}(?:L|T[^{_SEP}\n]*{_SEP}){_GET}"
)
_BLOCK = rf"(?:N{_ANY}(?=[NtspqcSPQC])|(?=[QCqc])){_BLOCK_BODY}"
_RAW = rf"(?:[TU][^{_SEP}\n]*{_SEP}|[^TUDdSsPp\n]){_GET}"
_PLACEHOLDER = rf"[Pp]{_GET}{_RAW}"
_SONG_THEN_TIME = rf"(?:L|T[^{_SEP}\n]*{_SEP}){_GET}[Ss]{_GET}"
_TIME_THEN_TEXT = rf"[Ss]{_GET}(?:T[^{_SEP}\n]*{_SEP}|[NLXtqc]){_GET}"
_ALONE = rf"(?:[AW]|U[^{_SEP}\n]*{_SEP}){_GET}"

# groups: 1 title text, 2/3 its time; 4 time, 5 text; 6 time, 7 text; 8 text, 9 time;
# 10 time, 11 text; 12 the line itself.  Groups of other alternatives are empty.
_WALK = "|".join(
    [_TITLE, _BLOCK, _PLACEHOLDER, _SONG_THEN_TIME, _TIME_THEN_TEXT, _ALONE, _ANY]
)
_MERGED = "$2$3$4$6$9$10 $1$5$7$8$11$12\n"


def _tagged(f: Column) -> Column:
    joined = F.concat(f["fields"]["song"], F.lit(" / "), f["fields"]["artist"])
    valid = f["time"] != ""

    def timed(tag: str) -> Column:
        label = F.when(valid, f["time"]).otherwise(f["raw_time"])
        return F.concat(F.when(valid, F.lit(tag)).otherwise(F.lit(tag.lower())), label)

    tag = (
        F.when(f["is_inline_range"], F.concat(F.lit("A"), f["inline_label"], F.lit(" "), joined))
        .when(f["is_number"], F.concat(F.lit("N"), f["line"]))
        .when(f["is_placeholder"], timed("P"))
        .when(f["is_range"], F.when(f["is_open_range"], timed("Q")).otherwise(timed("C")))
        .when(f["is_time_only"], timed("S"))
        .when(
            f["is_title"],
            F.concat(
                F.when(valid, F.lit("U")).otherwise(F.lit("T")), joined, F.lit(_SEP), f["line"]
            ),
        )
        .when(f["is_translation"], F.concat(F.lit("t"), f["line"]))
        .when(f["is_non_song"], F.concat(F.lit("D"), f["line"]))
        .when(f["is_non_song_tree"], F.concat(F.lit("d"), f["line"]))
        .when(valid, F.concat(F.lit("W"), f["line"]))
        .when(f["is_song_artist"], F.concat(F.lit("L"), f["line"]))
        .otherwise(F.concat(F.lit("X"), f["line"]))
    )
    return F.concat(tag, F.lit("\n"))


def tagged_line(l: Column, strict_range: bool = False) -> Column:
    """Tag, payload and line end; lines known by their shape are not parsed."""
    chain = F
    for pattern, form, _ in SURE_LINES:
        whole = form[1:] == "$0"
        text = F.concat(F.lit(form[0]), l) if whole else sub(l, pattern, form)
        chain = chain.when(l.rlike(pattern), F.concat(text, F.lit("\n")))
    return chain.otherwise(let(line_flags(l, strict_range), _tagged))


def merged_lines(lines: Column, strict_range: bool = False) -> Column:
    """Array of merged lines; lines that can never become a track are dropped."""
    tagged = F.array_join(F.transform(lines, lambda l: tagged_line(l, strict_range)), "")
    walked = F.split(sub(tagged, _WALK, _MERGED), "\n")
    return F.filter(F.transform(walked, strip), lambda l: l != "")


@per_context
def _merged_of(lines: str, strict_range: bool) -> Column:
    return merged_lines(F.col(lines), strict_range)


def merge_timeline_lines(
    comments: DataFrame, text: str = "text", strict_range: bool = False
) -> DataFrame:
    """One row per merged line, with its position from 1."""
    src = comments if "lines" in comments.columns else with_lines(comments, text)
    keep = [c for c in comments.columns if c not in (text, "lines")]
    return explode_rows(src, _merged_of("lines", strict_range), keep, "line", "item_pos")
