"""Lines to tracks.

A *setlist* row is one source text with ``tracks``, the array of its entries.  A list
never spans rows, so everything that looks at a whole list runs inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.memo import per_context
from ..functions.rows import explode_rows, keep_found
from ..functions.text import clean_lines, first_match, let, logical_lines, markers, outside_brackets
from ..functions.text import seconds_of, strip, sub
from ..functions.titles import (
    NOISE_LINE, TRACK_TYPE, _ICONS, _TIME_LEAD, clean_artist, clean_field, clean_field_light,
    drop_line_lead, drop_performance_notes, drop_release_date, drop_release_tail, drop_weird_lead,
    first_time, is_bad_field, is_section_pair, multi_fields, parse_line, parse_plain_text,
    performer_with_note, plain_numbered, split_fields, track,
)
from .merge import merged_lines

W = P.WS
TRACK_FIELDS = ("item_pos", "num", "secs", "label", "song", "artist")


def renumber(tracks: Column) -> Column:
    """Positions from 1 in array order."""
    return F.transform(tracks, lambda t, i: t.withField("item_pos", (i + 1).cast("int")))


def merged_tracks(text: Column, strict_range: bool = False) -> Column:
    """Tracks of the merged lines of a text, without positions."""
    lines = F.filter(F.transform(logical_lines(text), drop_weird_lead), lambda l: l != "")
    parsed = F.transform(merged_lines(lines, strict_range), parse_line)
    return F.filter(parsed, lambda t: t.isNotNull())


@per_context
def plain_tracks(text: str, strict_range: bool = False) -> Column:
    return renumber(parse_plain_text(F.col(text), merged_tracks(F.col(text), strict_range)))


def parse_setlists(
    comments: DataFrame, text: str = "text", strict_range: bool = False
) -> DataFrame:
    """Text to ``tracks`` in one pass over the rows: normalise, cut, merge, split, clean."""
    keep = [c for c in comments.columns if c not in (text, "lines")]
    return comments.select(*keep, plain_tracks(text, strict_range).alias("tracks"))


def explode_tracks(setlists: DataFrame) -> DataFrame:
    """One row per track."""
    keep = [c for c in setlists.columns if c != "tracks"]
    return explode_rows(setlists, F.col("tracks"), keep, "t").select(
        *keep, *[F.col("t")[f].alias(f) for f in TRACK_FIELDS]
    )


@per_context
def _parsed_line(line: str) -> Column:
    return parse_line(F.col(line))


def split_tracks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Timed lines to rows with ``num, secs, label, song, artist``; others are dropped."""
    keep = [c for c in lines.columns if c != line]
    parsed = keep_found(lines, _parsed_line(line), keep, "t")
    return parsed.select(*keep, *[F.col("t")[f].alias(f) for f in TRACK_FIELDS[1:]])


# --- filters and performer cleanup -----------------------------------------------------


def drop_noise(
    tracks: DataFrame, noise_lines: bool = True, titles: tuple[str, ...] = ()
) -> DataFrame:
    """Remove rows that are no songs: bad fields, section pairs, closing words, titles."""
    artist = F.coalesce(F.col("artist"), F.lit(""))
    bad = is_bad_field(F.col("song")) | ((artist != "") & is_bad_field(artist))
    bad = bad | is_section_pair(F.col("song"), artist)
    if noise_lines:
        bad = bad | strip(F.col("song")).rlike(NOISE_LINE)
    if titles:
        bad = bad | F.col("song").isin(*titles)
    return tracks.where(~bad)


def clean_artist_metadata(tracks: DataFrame, artist: str = "artist") -> DataFrame:
    """Performers without dates, work titles, notes and Latin aliases."""
    return tracks.withColumn(artist, clean_artist(F.col(artist)))


def split_multifield(lines: DataFrame, line: str = "line") -> DataFrame:
    """Records ``title／performer／more…``: the first two fields, other lines dropped."""
    keep = [c for c in lines.columns if c != line]
    fields = let(
        strip(F.col(line)),
        lambda raw: F.when(
            raw.contains("／"), let(outside_brackets(raw), lambda m: multi_fields(raw, m))
        ),
    )
    cleaned = let(
        fields,
        lambda f: F.when(
            f.isNotNull(),
            let(
                F.struct(
                    clean_field_light(F.get(f, F.lit(0))).alias("song"),
                    performer_with_note(drop_release_tail(F.get(f, F.lit(1)))).alias("artist"),
                ),
                lambda s: F.when(~is_bad_field(s["song"]) & ~is_bad_field(s["artist"]), s),
            ),
        ),
    )
    return keep_found(lines, cleaned, keep, "_s").select(*keep, "_s.song", "_s.artist")


# --- numbered lists ---------------------------------------------------------------------

_NUM = "([0-9]{1,3})"
_NUMBER_STYLES = (
    rf"#{W}*{_NUM}{W}+",
    rf"【{W}*{_NUM}{W}*】{W}*",
    rf"[⟦〚]{W}*{_NUM}{W}*[⟧〛]{W}*",
    rf"\[{W}*{_NUM}{W}*\]{W}*",
    rf"\({W}*{_NUM}{W}*\){W}*",
    rf"{_NUM}{W}*曲{W}*[/／]{W}*",
    rf"{_NUM}{W}+(?={P.TS}{W}+.)",
    rf"{_NUM}{W}*[,，]{W}*",
    rf"{_NUM}{W}*[{P.DASHES}]{W}*",
    rf"{_NUM}{W}*[.)．。、,，：:]{W}*",
)
_NUMBERED = rf"(?s)^(?:{'|'.join(_NUMBER_STYLES)})(.+)$"
_LATIN_TAIL = r"(?s)^(.+)[ \t\x{3000}]+([A-Za-z0-9][A-Za-z0-9 .,'’\"!?&+_\-]*)$"
_TIMES_AND_TREES = rf"^(?:{P.TREE})?(?:{W}*(?:{_TIME_LEAD})?(?:{P.TREE})?){{0,8}}{W}*"


def _performer_fields(body: Column) -> Column:
    """Split with performer metadata cleanup, then "Japanese title + Latin performer"."""

    def loose(raw: Column) -> Column:
        return F.when(
            raw.rlike(_LATIN_TAIL),
            let(
                F.struct(
                    clean_field_light(first_match(raw, _LATIN_TAIL, 1)).alias("song"),
                    clean_artist(first_match(raw, _LATIN_TAIL, 2)).alias("artist"),
                ),
                lambda s: F.when(
                    s["song"].rlike(P.JAPANESE) & ~is_bad_field(s["song"])
                    & ~is_bad_field(s["artist"]), s,
                ),
            ),
        )

    core = lambda raw: F.coalesce(
        split_fields(raw, clean_field_light, clean_artist, extended=True), loose(raw)
    )
    return let(drop_performance_notes(drop_release_date(strip(body))), core)


def numbered_line(line: Column) -> Column:
    """Numbered line to a track struct, or null."""
    return plain_numbered(line, numbered_any_line)


def numbered_any_line(line: Column) -> Column:
    """``numbered_line`` without the short cut."""

    def parse(t: Column) -> Column:
        rest = sub(strip(sub(t, _TIMES_AND_TREES)), rf"^{_ICONS}")
        rest = strip(sub(strip(sub(rest, rf"^{P.TREE}")), rf"(?i)^Re{W}*[:：]{W}*"))
        canonical = sub(rest, _NUMBERED, "$1$2$3$4$5$6$7$8$9$10\x02$11")

        def build(c: Column) -> Column:
            num = F.substring_index(c, "\x02", 1).cast("int")
            fields = _performer_fields(drop_line_lead(F.substring_index(c, "\x02", -1)))
            label = first_time(t)
            return F.when(
                c.contains("\x02"),
                let(
                    fields,
                    lambda f: F.when(
                        f.isNotNull() & ~is_section_pair(f["song"], f["artist"]),
                        track(F.lit(None), num, seconds_of(label), label, f["song"], f["artist"]),
                    ),
                ),
            )

        return let(canonical, build)

    return let(markers(drop_weird_lead(line)), parse)


def first_by_key(items: Column, key) -> Column:
    """Items whose ``key`` was not seen earlier in the array; a null key is always kept.

    Sorts (key, position) pairs, keeps the head of each run, and sorts back: n log n.
    Keys that are all different need none of it.
    """
    pairs = F.sort_array(
        F.transform(
            items,
            lambda t, i: F.struct(
                F.coalesce(key(t), F.concat(F.lit("\x02"), i.cast("string"))).alias("k"),
                i.alias("i"),
            ),
        )
    )

    def heads(p: Column) -> Column:
        first = F.filter(
            p, lambda x, j: (j == 0) | (x["k"] != F.get(p, F.greatest(j - 1, F.lit(0)))["k"])
        )
        return F.transform(
            F.sort_array(F.transform(first, lambda x: x["i"])), lambda i: F.get(items, i)
        )

    return let(
        F.size(items) == F.size(F.array_distinct(F.transform(items, key))),
        lambda different: F.when(different, items).otherwise(let(pairs, heads)),
    )


@per_context
def numbered_tracks(text: str) -> Column:
    parsed = F.filter(
        F.transform(clean_lines(F.col(text)), numbered_line), lambda t: t.isNotNull()
    )
    return let(
        parsed, lambda p: renumber(first_by_key(p, lambda t: t["num"].cast("string")))
    )


def extract_numbered(comments: DataFrame, text: str = "text") -> DataFrame:
    """Numbered entries of each text; the first entry per number is kept."""
    keep = [c for c in comments.columns if c != text]
    return comments.select(*keep, numbered_tracks(text).alias("tracks"))


def is_contiguous(tracks: Column) -> Column:
    nums = F.array_sort(F.transform(tracks, lambda t: t["num"]))
    return let(
        nums,
        lambda n: (F.size(n) > 0)
        & F.forall(F.transform(n, lambda x, i: x == i + 1), lambda ok: F.coalesce(ok, F.lit(False))),
    )


def is_ascending(tracks: Column) -> Column:
    def steps(n: Column) -> Column:
        gaps = F.transform(
            F.slice(n, F.lit(2), F.size(n)), lambda x, i: (x - F.get(n, i)).between(1, 2)
        )
        return (F.size(n) >= 2) & (F.get(n, F.lit(0)) == 1) & F.forall(gaps, lambda ok: ok)

    nums = F.filter(F.transform(tracks, lambda t: t["num"]), lambda x: x.isNotNull())
    return let(nums, steps)


def setlist_shape(numbered: DataFrame) -> DataFrame:
    """Count of entries and whether the numbers are 1..n / rise by one or two."""
    keep = [c for c in numbered.columns if c != "tracks"]
    return numbered.select(
        *keep, F.size("tracks").alias("n"), is_contiguous(F.col("tracks")).alias("is_contiguous"),
        is_ascending(F.col("tracks")).alias("is_ascending"),
    )


def extract_both(comments: DataFrame, text: str = "text") -> DataFrame:
    """Numbered and plain extraction side by side."""
    keep = [c for c in comments.columns if c != text]
    return comments.select(
        *keep, numbered_tracks(text).alias("numbered"), plain_tracks(text).alias("plain")
    )


def choose_extraction(both: DataFrame) -> DataFrame:
    """Numbered when it is 1..n and not shorter, else the longer one, plain on a tie."""
    keep = [c for c in both.columns if c not in ("numbered", "plain")]
    n, p = F.size("numbered"), F.size("plain")
    numbered_wins = (is_contiguous(F.col("numbered")) & (n >= p)) | (n > p)
    return both.select(
        *keep,
        F.when(numbered_wins, F.lit("numbered")).otherwise(F.lit("plain")).alias("extraction"),
        F.when(numbered_wins, F.col("numbered")).otherwise(F.col("plain")).alias("tracks"),
    )
