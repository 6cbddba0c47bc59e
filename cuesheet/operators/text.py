"""Text to lines: normalise, cut, find times, classify, rank.

Every operator works on one text per row; nothing here groups lines of one text
through a shuffle.  Comment tables carry ``video_id, source, source_pos, comment_id,
text``; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import skew
from ..functions.memo import per_context
from ..functions.rows import explode_rows
from ..session import written
from ..functions.text import (
    clean_lines, let, logical_lines, markers, normalize, section_key, seconds_of,
    strip, sub, with_nfkc,
)
from ..functions.titles import (
    PLAIN_PAIR, drop_line_lead, drop_quotes, drop_tree, drop_trailing_marks, drop_weird_lead, first_time,
    is_non_song, split_fields,
)

W = P.WS


def normalize_comments(comments: DataFrame, text: str = "text") -> DataFrame:
    """Add ``norm_text``: line ends, blanks and number marks made uniform."""
    return comments.withColumn("norm_text", markers(normalize(F.col(text))))


@per_context
def lines_of(text: str) -> Column:
    lines = F.transform(logical_lines(F.col(text)), drop_weird_lead)
    return F.filter(lines, lambda l: l != "")


def with_lines(comments: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines``, the logical lines of the text as an array."""
    return comments.withColumn("lines", lines_of(text))


def explode_lines(comments: DataFrame, text: str = "text") -> DataFrame:
    """One row per logical line, with its position from 1."""
    keep = [c for c in comments.columns if c not in (text, "lines")]
    src = comments if "lines" in comments.columns else with_lines(comments, text)
    return explode_rows(src, F.col("lines"), keep, "line", "line_pos")


_DIGIT = "[0-9０-９]"
_TIME_IN_TEXT = rf"(^|[^0-9０-９])({_DIGIT}{{1,2}}:{_DIGIT}{{2}}(?::{_DIGIT}{{2}})?)(?!{_DIGIT})"


def times_in(c: Column) -> Column:
    """Distinct valid time labels of a text, in order of first appearance."""
    found = F.regexp_extract_all(normalize(c), F.lit(_TIME_IN_TEXT), F.lit(2))
    return F.array_distinct(F.filter(found, lambda t: seconds_of(t).isNotNull()))


#: The same in texts whose digits are plain; the group of times out of range is empty.
_PLAIN_TIME = rf"(?<![0-9])(?:({P.TS_VALID})|{P.TS})(?![0-9])"


def times_in_plain(c: Column) -> Column:
    """``times_in`` of a text that is normalised and holds no full-width digits or colons."""
    found = F.regexp_extract_all(c, F.lit(_PLAIN_TIME), F.lit(1))
    return F.array_remove(F.array_distinct(found), "")


def extract_timestamps(comments: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct time label: ``pos, label, secs``."""
    keep = [c for c in comments.columns if c != text]
    rows = explode_rows(comments, times_in(F.col(text)), keep, "label", "pos")
    return rows.withColumn("secs", seconds_of(F.col("label")))


# --- line classes ------------------------------------------------------------------

_ICON_LEAD = rf"^(?:[{P.LEAD_SET}]*(?:{P.EMOJI}|{P.TIME_ICONS}))*{W}*"
_TIME_ONLY = rf"{_ICON_LEAD}{P.TS}(?:{W}+{P.TS})*{W}*$"
_PLACEHOLDER = rf"{_ICON_LEAD}{P.TS}{W}*[;；]+{W}*$"
_RANGE_HEAD = (
    rf"^(?:[#＃]?{W}*[0-9]{{1,3}}{W}*[.)．。、,，：:]?{W}*)?{P.TS}{W}*"
)
_NUMBER_LINE = rf"^[#＃]?{W}*[0-9①-⑨]{{1,3}}{W}*[.)．。、,，：:]?{W}*$"
_BRACKET_LINE = (
    r"^[(（\[［](?=[^()（）\[\]［］]{1,140}[)）\]］]$)(?=[^A-Za-z]*[A-Za-z])"
    rf"{W}*{P.LATIN_INNER}+{W}*[)）\]］]$"
)
_TITLE_HEAD = rf"^第?{W}*[0-9]{{1,3}}{W}*(?:曲目|曲){W}*[：:]"
_INLINE_RANGE = (
    rf"(?s)^第?{W}*[0-9]{{1,3}}{W}*(?:曲目|曲)[：:{P.WS_SET}]*({P.TS}){W}*{P.RANGE_MARK}{W}*"
    rf"(?:{P.TS})?{W}*(.+)$"
)


def range_pattern(strict: bool = False) -> str:
    mark = P.RANGE_MARK if strict else P.RANGE_MARK_WIDE
    return rf"{_RANGE_HEAD}{mark}{W}*(?:{P.TS})?{W}*$"


def title_body(line: Column) -> Column:
    """Text of an "Nth song: title / performer" line."""
    body = sub(line, rf"^第?{W}*[0-9]{{1,3}}{W}*曲目{W}*[：:]{W}*")
    body = sub(body, rf"^第?{W}*[0-9]{{1,3}}{W}*曲{W}*[：:]{W}*")
    body = strip(sub(body, rf"{W}+{P.TS}{W}*{P.RANGE_MARK}{W}*{P.TS}{W}*$"))
    return drop_trailing_marks(drop_quotes(body))


def inline_body(line: Column) -> Column:
    """Text of an "Nth song 38:12~43:24 title / performer" line."""
    body = strip(F.regexp_extract(line, _INLINE_RANGE, 2))
    body = strip(sub(body, rf"{W}+{P.TS}{W}*{P.RANGE_MARK}{W}*(?:{P.TS})?{W}*$"))
    return drop_trailing_marks(drop_quotes(body))


def line_flags(line: Column, strict_range: bool = False) -> Column:
    """Struct of all line classes; the title/performer split runs once per line."""

    def flags(l: Column) -> Column:
        tree = drop_tree(l)
        time = first_time(l)
        inline_label = F.regexp_extract(l, _INLINE_RANGE, 1)
        inline = (inline_label != "") & seconds_of(inline_label).isNotNull()
        title = l.rlike(_TITLE_HEAD)
        body = (
            F.when(inline, inline_body(l))
            .when(title, title_body(l))
            .when(time == "", drop_line_lead(l))
        )
        fields = let(body, lambda b: F.when(~is_non_song(b), split_fields(b)))
        return F.struct(
            l.alias("line"), time.alias("time"), inline_label.alias("inline_label"),
            tree.rlike(rf"{_TIME_ONLY}|{_PLACEHOLDER}").alias("time_only"),
            tree.rlike(_PLACEHOLDER).alias("placeholder"),
            l.rlike(range_pattern(strict_range)).alias("range_like"),
            l.rlike(rf"^{P.TS}{W}*{P.RANGE_MARK_WIDE}{W}*$").alias("open_range"),
            l.rlike(_NUMBER_LINE).alias("number_only"),
            ((tree == "") | tree.rlike(_BRACKET_LINE)).alias("translation_only"),
            is_non_song(l).alias("non_song"),
            is_non_song(tree).alias("non_song_tree"),
            inline.alias("inline_shape"), title.alias("title_shape"),
            F.regexp_extract(l, P.TS, 0).alias("raw_time"),
            fields.alias("fields"),
        )

    def derived(f: Column) -> Column:
        has = f["fields"].isNotNull()
        return F.struct(
            f["line"].alias("line"), f["time"].alias("time"), f["raw_time"].alias("raw_time"),
            f["inline_label"].alias("inline_label"), f["fields"].alias("fields"),
            f["time_only"].alias("is_time_only"), f["placeholder"].alias("is_placeholder"),
            f["range_like"].alias("is_range"), f["open_range"].alias("is_open_range"),
            f["number_only"].alias("is_number"),
            f["translation_only"].alias("is_translation"),
            f["non_song"].alias("is_non_song"), f["non_song_tree"].alias("is_non_song_tree"),
            (f["title_shape"] & ~f["inline_shape"] & has).alias("is_title"),
            (f["inline_shape"] & has).alias("is_inline_range"),
            (has & (f["time"] == "") & ~f["inline_shape"]).alias("is_song_artist"),
        )

    return let(let(line, flags), derived)


FLAG_COLUMNS = (
    "is_time_only", "is_placeholder", "is_range", "is_number", "is_translation", "is_non_song",
    "is_title", "is_inline_range", "is_song_artist",
)


_AT = rf"{P.TS_VALID}(?![:0-9])"
# no word that ends or starts a notice
_NO_NOTICE = f"(?!.*{P.NOTICE})"
_PAIR = PLAIN_PAIR.removeprefix("^").removesuffix("$")
#: Lines whose classes follow from their shape: pattern, tagged form for the merge, classes.
#: A valid time in front and two letters in a row behind it leave no class; a time in round or
#: square brackets needs both of them, as one around the line makes it a translation.
SURE_LINES = (
    (rf"^{_NO_NOTICE}(?:[0-9]{{1,3}}\. )?(?:[【『]?{_AT}|{P.TS_OPEN}{P.TS_VALID}{P.TS_CLOSE})"
     rf".*?(?:[A-Za-z]{{2}}|{P.JAPANESE}{{2}})", "W$0", ()),
    (rf"^{_NO_NOTICE}{_PAIR}$", "L$0", ("is_song_artist",)),
    (rf"^{_AT}$", "S$0", ("is_time_only",)),
    (r"^[0-9]{1,3}[.)]?$", "N$0", ("is_number",)),
    (rf"^({_AT}) *~$", "Q$1", ("is_range",)),
    (rf"^({_AT}) *~ *{_AT}$", "C$1", ("is_range",)),
    (rf"^({_AT}) *;$", "P$1", ("is_time_only", "is_placeholder")),
    (rf"^[▶►] *({_AT})$", "S$1", ("is_time_only",)),
    (r"^\([A-Za-z][A-Za-z ]{0,100}\)$", "t$0", ("is_translation",)),
    (rf"^{_NO_NOTICE}[0-9]{{1,3}}曲目[：:]{_PAIR}$", "T$1 / $2\x02$0", ("is_title", "is_song_artist")),
    (rf"^{_NO_NOTICE}[0-9]{{1,3}}曲目 ({_AT})~{_AT}「{_PAIR}」$", "A$1 $2 / $3", ("is_inline_range",)),
)


def line_classes(line: Column, strict_range: bool = False) -> Column:
    """Struct of the classes in ``FLAG_COLUMNS``; lines known by their shape are not parsed."""

    def classes(l: Column) -> Column:
        long_way = let(
            line_flags(l, strict_range), lambda f: F.struct(*[f[c].alias(c) for c in FLAG_COLUMNS])
        )
        found = [
            (l.rlike(pattern), F.struct(*[F.lit(c in true).alias(c) for c in FLAG_COLUMNS]))
            for pattern, _, true in SURE_LINES
        ]
        chain = F.when(*found[0])
        for known in found[1:]:
            chain = chain.when(*known)
        return chain.otherwise(long_way)

    return let(line, classes)


@per_context
def _flags_of(line: str, strict_range: bool) -> Column:
    return line_classes(F.col(line), strict_range)


def classify_lines(lines: DataFrame, strict_range: bool = False) -> DataFrame:
    """Add one boolean column per line class."""
    flagged = lines.withColumn("_f", _flags_of("line", strict_range))
    return flagged.select(*lines.columns, *[F.col("_f")[c].alias(c) for c in FLAG_COLUMNS])


# --- which texts are setlists ---------------------------------------------------------

# digits one by one are one set of bits, a range with another character is not
_TIME_LOOSE = rf"(?:^|[^0123456789:])({P.TS})(?![0-9])"


def setlist_line_count(c: Column, marker_words=P.MARKER_WORDS) -> Column:
    """Timed lines with a rest that holds no marker word; 0 for texts of one line."""
    marker = P.holds_word(marker_words)
    lines = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), P.LINE_BREAK), strip), lambda l: l != ""
    )
    rest_ok = lambda rest: (rest != "") & ~rest.rlike(marker)
    # only a line without a time stays as it is
    timed = lambda l: let(
        sub(l, _TIME_LOOSE),
        lambda rest: F.when(rest != l, let(strip(rest), rest_ok)).otherwise(F.lit(False)),
    )
    return let(
        lines, lambda a: F.when(F.size(a) >= 2, F.size(F.filter(a, timed))).otherwise(F.lit(0))
    )


def classify_songlist_comments(
    comments: DataFrame, text: str = "text", marker_words=P.MARKER_WORDS,
    normalize_first: bool = False,
) -> DataFrame:
    """Add ``song_ts_lines`` and ``is_songlist`` (two or more such lines)."""
    value = markers(normalize(F.col(text))) if normalize_first else F.col(text)
    return comments.withColumn(
        "song_ts_lines", setlist_line_count(value, marker_words)
    ).withColumn("is_songlist", F.col("song_ts_lines") >= 2)


# --- setlist section -----------------------------------------------------------------


_HEADING_LEAD = rf"^(?:[{P.LEAD_SET}]*(?:{P.EMOJI}|{P.ICON_MARKS}))+{W}*"


def _heading_key(head: Column) -> Column:
    key = section_key(drop_tree(sub(head, _HEADING_LEAD)))
    return strip(sub(key, rf"[【】\[\]［］()（）<>＜＞《》〈〉「」『』#＃&＆＋+]|{P.EMOJI}"))


def section_lines(lines: Column, heads: Column) -> Column:
    """Lines after the last setlist heading, up to the next other heading.

    ``heads``: the same lines in their compatibility form, without icons at their beginning;
    empty for lines with a time.
    """
    named = lambda head, words: (head != "") & _heading_key(head).rlike(rf"(?i)^{P.words(words)}$")
    setlist = lambda l, head: named(head, P.SETLIST_HEADINGS) & split_fields(drop_tree(l)).isNull()
    other = lambda head: named(head, P.OTHER_HEADINGS)
    start = F.array_max(
        F.transform(lines, lambda l, i: F.when(setlist(markers(l), F.get(heads, i)), i))
    )

    def until_stop(tail: Column, first: Column) -> Column:
        stop = F.array_min(
            F.transform(
                tail, lambda l, i: F.when((i > 0) & other(F.get(heads, first + i)), i)
            )
        )
        return let(
            F.coalesce(stop, F.size(tail)),
            lambda n: F.when(n > 0, F.slice(tail, F.lit(1), n)).otherwise(lines),
        )

    return let(
        start,
        lambda s: F.when(s.isNull(), lines).otherwise(
            let(F.slice(lines, s + 2, F.size(lines)), lambda tail: until_stop(tail, s + 1))
        ),
    )


@per_context
def _section_of(lines: str, heads: str) -> Column:
    return section_lines(F.col(lines), F.split(F.col(heads), "\n"))


def select_setlist_section(comments: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines`` cut down to the preferred section."""
    src = comments if "lines" in comments.columns else with_lines(comments, text)
    # one text, as functions in Python cannot be called for elements of an array
    head = lambda l: F.when(first_time(l) == "", sub(l, _HEADING_LEAD)).otherwise("")
    heads = F.array_join(F.transform("lines", lambda l: let(markers(l), head)), "\n")
    named = with_nfkc(src, "_heads", heads)
    return named.withColumn("lines", _section_of("lines", "_heads")).drop("_heads")


# --- ranking --------------------------------------------------------------------------


def rank_comments(comments: DataFrame, text: str = "text") -> DataFrame:
    """Rank comments of a video: more times first, then the original order."""
    keep = [c for c in comments.columns if c != text]
    counted = written(
        comments.select(*keep, F.size(times_in(F.col(text))).alias("ts_count")), "ts-count"
    )
    return skew.ranked(counted, ["video_id"], [-F.col("ts_count"), "source_pos"], "rank")
