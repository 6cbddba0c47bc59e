"""Operators on whole track lists and on published messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import skew
from ..functions.text import clean_lines, let, loose_key, markers, seconds_of, strip, sub
from ..session import written
from .tracks import first_by_key

W = P.WS
# the first characters of all are in the range, which passes over other characters
_HONORIFIC = rf"(?=[\x{{3055}}-\x{{6C0F}}])(?:さん|様|氏){W}*$"


def _replace_tracks(setlists: DataFrame, tracks: Column) -> DataFrame:
    return setlists.select(
        *[tracks.alias(c) if c == "tracks" else F.col(c) for c in setlists.columns]
    )


def without_honorifics(tracks: Column, least: int = 3, share: float = 0.6) -> Column:
    named = F.filter(tracks, lambda t: strip(F.coalesce(t["artist"], F.lit(""))) != "")
    polite = F.filter(tracks, lambda t: F.coalesce(t["artist"], F.lit("")).rlike(_HONORIFIC))
    habit = let(F.size(polite), lambda n: (n >= least) & (n >= share * F.size(named)))
    plain = lambda t: t.withField("artist", strip(sub(t["artist"], _HONORIFIC)))
    return F.when(habit, F.transform(tracks, plain)).otherwise(tracks)


def strip_honorifics(setlists: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Drop a closing honorific when it is the writing habit of the whole list."""
    return _replace_tracks(setlists, without_honorifics(F.col("tracks"), least, share))


def squeezed(tracks: Column) -> Column:
    # a name in ASCII holds no kanji
    plain = lambda a: F.octet_length(a) == F.length(a)
    joined = lambda a: F.when(plain(a), a).otherwise(sub(a, rf"(?<={P.KANJI}){W}+(?={P.KANJI})"))
    tight = lambda t: t.withField("artist", strip(joined(t["artist"])))
    return F.transform(tracks, tight)


def squeeze_kanji(setlists: DataFrame) -> DataFrame:
    """Remove blanks between two kanji of a performer name."""
    return _replace_tracks(setlists, squeezed(F.col("tracks")))


def _identity(t: Column) -> Column:
    song, artist = loose_key(t["song"]), loose_key(t["artist"])
    return F.when(
        (song != "") & (artist != "") & t["secs"].isNotNull(),
        F.concat_ws("|", t["secs"].cast("string"), song, artist),
    )


def deduped(tracks: Column) -> Column:
    # entries at different times are different, so most lists need no keys
    apart = lambda ts: F.size(ts) == F.size(F.array_distinct(F.transform(ts, lambda t: t["secs"])))
    return let(tracks, lambda ts: F.when(apart(ts), ts).otherwise(first_by_key(ts, _identity)))


def dedupe_tracks(setlists: DataFrame) -> DataFrame:
    """Keep the first of entries with equal time, title and performer."""
    return _replace_tracks(setlists, deduped(F.col("tracks")))


def dedupe_near(setlists: DataFrame, tol: int = 2) -> DataFrame:
    """Among entries at nearly the same moment keep the first numbered one.

    Moments chain: each entry within ``tol`` seconds of the one before it belongs to
    the same moment.  A moment without a numbered entry is left as it is, and so are
    entries without a time.
    """

    def losers(ts: Column) -> Column:
        # a moment starts where the entry before it is further away than tol
        starts = F.filter(
            F.transform(
                ts,
                lambda t, j: F.when(
                    (j == 0) | (t["secs"] - F.get(ts, F.greatest(j - 1, F.lit(0)))["secs"] > tol), j
                ),
            ),
            lambda j: j.isNotNull(),
        )

        def moment(s: Column) -> Column:
            spans = F.transform(
                s, lambda j, k: F.slice(ts, j + 1, F.coalesce(F.get(s, k + 1), F.size(ts)) - j)
            )
            lost = lambda span, first: F.when(
                first.isNotNull(),
                F.filter(F.transform(span, lambda t: t["i"]), lambda i: i != first),
            )
            first = lambda span: F.get(
                F.filter(span, lambda t: t["numbered"]), F.lit(0)
            )["i"]
            return F.flatten(
                F.filter(
                    F.transform(spans, lambda span: lost(span, first(span))),
                    lambda l: l.isNotNull(),
                )
            )

        return let(starts, moment)

    def survivors(tracks: Column) -> Column:
        timed = F.array_sort(
            F.filter(
                F.transform(
                    tracks,
                    lambda t, i: F.struct(
                        t["secs"].alias("secs"), i.alias("i"), t["num"].isNotNull().alias("numbered")
                    ),
                ),
                lambda x: x["secs"].isNotNull(),
            )
        )
        every = F.transform(tracks, lambda t, i: i)
        return F.transform(
            F.array_except(every, let(timed, losers)), lambda i: F.get(tracks, i)
        )

    return _replace_tracks(setlists, survivors(F.col("tracks")))


def normalize_display(setlists: DataFrame) -> DataFrame:
    """Honorifics, kanji blanks and exact duplicates, in that order."""
    tracks = let(
        without_honorifics(F.col("tracks")), lambda t: deduped(squeezed(t))
    )
    return _replace_tracks(setlists, tracks)


# --- best source per video ------------------------------------------------------------


#: More than any two places of a source are apart.
_PLACES = "20000000000000000000"


#: What the lists are compared by.
COUNTS = ("_n", "_a", "_row")


def counted_lists(setlists: DataFrame) -> DataFrame:
    """The lists, written, with what :func:`select_best_source` compares: ``COUNTS``."""
    with_artist = F.size(F.filter("tracks", lambda t: F.coalesce(t["artist"], F.lit("")) != ""))
    return written(
        setlists.select(
            "video_id", "source", "source_pos", "comment_id", "tracks", F.size("tracks").alias("_n"),
            with_artist.alias("_a"), F.monotonically_increasing_id().alias("_row"),
        ),
        "lists",
    )


def select_best_source(setlists: DataFrame) -> DataFrame:
    """One list per video: most entries, most performers, then the first source.

    The lists are written once, unless they come from :func:`counted_lists`. What is compared is
    one number per list, so the winners come from a hash aggregate of fixed width, and only their
    lists are read again.
    """
    rows = setlists if set(COUNTS) <= set(setlists.columns) else counted_lists(setlists)
    comment = (F.col("source") != "description").cast("bigint")
    counts = F.col("_n").cast("bigint") * (1 << 31) + F.col("_a").cast("bigint") * 2 + comment
    # places before zero and null ones have their order too
    place = F.coalesce(F.col("source_pos").cast("bigint"), F.lit((1 << 63) - 1)).cast("decimal(20,0)")
    score = counts.cast("decimal(18,0)") * F.lit(_PLACES).cast("decimal(20,0)") - place
    scored = rows.where("_n > 0").select("video_id", "_row", score.cast("decimal(38,0)").alias("_score"))
    winners = scored.groupBy("video_id").agg(F.max_by("_row", "_score").alias("_row"))
    best = rows.join(written(winners.select("_row"), "winners"), "_row", "left_semi")
    return best.select("video_id", "source", "source_pos", "comment_id", "tracks")


# --- rendering ----------------------------------------------------------------------


def render_time(secs: Column, style: str = "long", hours: Column | None = None) -> Column:
    """``H:MM:SS``; style ``short`` drops the hour unless ``hours`` or an hour is needed."""
    total = F.greatest(secs, F.lit(0))
    h = (total / 3600).cast("int")
    m = ((total % 3600) / 60).cast("int")
    s = total % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))
    if style == "long":
        return long
    return F.when(hours | (h > 0), long).otherwise(
        F.concat(m.cast("string"), F.lit(":"), two(s))
    )


def ordered_tracks(tracks: Column) -> Column:
    """By time, entries without a time last, then in list order."""
    by_time = F.array_sort(
        F.transform(
            tracks,
            lambda t: F.struct(
                t["secs"].isNull().alias("late"), t["secs"].alias("s"),
                t["item_pos"].alias("p"), t.alias("t"),
            ),
        )
    )
    return F.transform(by_time, lambda x: x["t"])


def rendered_lines(tracks: Column, style: str = "long", timed: bool = True) -> Column:
    def render(ts: Column) -> Column:
        width = F.when(F.size(ts) >= 100, 3).otherwise(2)
        hours = F.exists(
            ts,
            lambda t: (F.coalesce(t["secs"], F.lit(0)) >= 3600)
            | F.coalesce(t["label"], F.lit("")).rlike(r"^[0-9]+:[0-9]+:[0-9]+$"),
        )

        def line(t: Column, i: Column) -> Column:
            artist = F.coalesce(t["artist"], F.lit(""))
            body = F.concat(
                F.lpad((i + 1).cast("string"), width, F.lit("0")), F.lit(". "), t["song"],
                F.when(artist != "", F.concat(F.lit(" - "), artist)).otherwise(F.lit("")),
            )
            if not timed:
                return body
            secs = F.coalesce(t["secs"], seconds_of(t["label"]))
            return F.when(secs.isNull(), body).otherwise(
                F.concat(render_time(secs, style, hours), F.lit(" "), body)
            )

        return F.transform(ts, line)

    return let(ordered_tracks(tracks), render)


def format_setlists(setlists: DataFrame, style: str = "long", timed: bool = True) -> DataFrame:
    """Numbered text of each list as ``message``, with ``song_count``."""
    keep = [c for c in setlists.columns if c != "tracks"]
    return setlists.select(
        *keep,
        F.array_join(rendered_lines(F.col("tracks"), style, timed), "\n").alias("message"),
        F.size("tracks").alias("song_count"),
    )


_RENDERED = rf"^({P.TS}){W}+(.+)$"


def parse_rendered(messages: DataFrame) -> DataFrame:
    """Timed lines of messages back to ``line_no, label, secs, body``."""
    keep = [c for c in messages.columns if c not in ("message", "song_count")]
    lines = messages.select(*keep, F.posexplode(F.split("message", "\n")).alias("line_no", "raw"))
    parsed = lines.select(
        *keep, (F.col("line_no") + 1).alias("line_no"),
        F.regexp_extract(strip(markers(F.col("raw"))), _RENDERED, 1).alias("label"),
        F.regexp_extract(strip(markers(F.col("raw"))), _RENDERED, 2).alias("body"),
    ).withColumn("secs", seconds_of(F.col("label")))
    return parsed.where(F.col("secs").isNotNull())


# --- equal messages ------------------------------------------------------------------


def with_nfkc(df: DataFrame, text: str) -> DataFrame:
    """Replace a column by its Unicode compatibility form; Spark has no function for it.

    Arrow batches go through one map, so the optimiser cannot run it twice.
    """

    def fold(batches):
        import unicodedata

        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text)
            folded = pa.array(
                [None if t is None else unicodedata.normalize("NFKC", t)
                 for t in batch.column(at).to_pylist()],
                batch.schema.field(at).type,
            )
            columns = list(batch.columns)
            columns[at] = folded
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(fold, df.schema)


def unnumbered(message: Column) -> Column:
    """Lines of a message without their numbers."""
    lines = F.filter(
        F.transform(clean_lines(message), lambda l: strip(sub(l, r"^[0-9]{1,3}\.\s*"))),
        lambda l: l != "",
    )
    return F.array_join(lines, "\n")


def with_signature(messages: DataFrame, timed: str = "message", plain: str | None = None):
    """Add ``sig``; the timed form counts, the plain form only where it is empty."""
    text = F.col(timed)
    if plain:
        text = F.when(strip(F.coalesce(text, F.lit(""))) != "", text).otherwise(F.col(plain))
    folded = with_nfkc(messages.withColumn("_s", unnumbered(text)), "_s")
    key = sub(F.lower("_s"), rf"{W}+")
    return folded.withColumn("sig", F.when(key != "", F.sha2(key, 256))).drop("_s")


def dedupe_setlists(
    messages: DataFrame, order: str, timed: str = "message", plain: str | None = None
) -> DataFrame:
    """Mark equal messages of the corpus: ``kept`` and ``dup_of`` (the first by ``order``).

    The result has the columns of ``messages`` without the texts.  Only hashes move; a
    signature shared by very many messages does not make a hot task.
    """
    keep = [c for c in messages.columns if c not in (timed, plain)]
    signed = written(with_signature(messages, timed, plain).select(*keep, "sig"), "signatures")
    groups = (
        signed.where(F.col("sig").isNotNull())
        .groupBy("sig")
        .agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
    )
    joined = skew.attach_groups(signed, groups, ["sig"], "_copies", [order])
    kept = F.col("sig").isNull() | (F.col("_first") == F.col(order))
    return joined.select(
        *keep, "sig", kept.alias("kept"),
        F.when(~kept, F.col("_first")).alias("dup_of"),
    )
