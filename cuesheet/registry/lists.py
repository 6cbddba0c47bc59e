"""Queries for track lists, messages and the whole text-to-setlist path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.titles import TRACK_TYPE
from ..operators import sets, text, tracks
from . import query
from .lines import HMS, I, agg

MERGED_ITEMS = f"({I})"


def setlists_of(rows: DataFrame, *more: str) -> DataFrame:
    """Item rows of the fixture as setlists (an order has at most seven line numbers)."""
    entry = F.struct(
        "item_no", F.col("item_no").cast("int").alias("item_pos"),
        (F.col("num") if "num" in rows.columns else F.lit(None)).cast("int").alias("num"),
        F.col("secs").cast("int").alias("secs"), fx.hms(F.col("secs")).alias("label"), "song", "artist",
    )
    packed = rows.groupBy("video_id", "comment_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_e")
    )
    return packed.select(
        "video_id", F.lit("comment").alias("source"), F.col("comment_id").alias("source_pos"),
        "comment_id",
        F.transform("_e", lambda e: e.dropFields("item_no")).cast(f"array<{TRACK_TYPE}>").alias("tracks"),
    )


# --- numbered lists -------------------------------------------------------------------

NUMBER_FORMS = (
    "#{n} ", "【{n}】", "⟦{n}⟧ ", "[{n}] ", "({n}) ", "{n}曲/", "{n}, ", "{n} - ", "{n}. ", "{n}。",
)


def _numbered_comments(spark, sf) -> DataFrame:
    """Each item numbered in one of ten styles; every line stands there twice."""
    lead = F.lit("")
    for i, form in enumerate(NUMBER_FORMS):
        a, b = form.split("{n}")
        lead = F.when(
            F.col("comment_id") % 10 == i,
            F.concat(F.lit(a), F.col("item_no").cast("string"), F.lit(b)),
        ).otherwise(lead)
    line = F.concat(fx.hms(F.col("secs")), F.lit(" "), lead, F.col("song"), F.lit(" / "), F.col("artist"))
    twice = F.concat(line, F.lit("\n"), line, F.lit("x"))
    return fx.as_comments(fx.items(spark, sf), twice)


@query(
    "t14_extract_numbered",
    f"""SELECT comment_id, item_no AS num, secs, song, artist FROM {MERGED_ITEMS}""",
)
def t14(spark, sf):
    """Ten numbering styles; the first row per number is kept."""
    lists = tracks.extract_numbered(_numbered_comments(spark, sf))
    return tracks.explode_tracks(lists).select("comment_id", "num", "secs", "song", "artist")


@query(
    "t14_title_without_delimiter",
    f"""SELECT comment_id, item_no AS num, '曲' || song AS song, artist FROM {MERGED_ITEMS}""",
)
def t14_loose(spark, sf):
    """Numbered "Japanese title, Latin performer" without a delimiter."""
    rows = fx.items(spark, sf)
    line = F.concat(
        F.col("item_no").cast("string"), F.lit(". 曲"), F.regexp_replace("song", " ", "　"),
        F.lit(" "), F.regexp_replace("artist", "#", "_"),
    )
    lists = tracks.extract_numbered(fx.as_comments(rows, line))
    flat = tracks.explode_tracks(lists)
    return flat.select(
        "comment_id", "num", F.regexp_replace("song", "　", " ").alias("song"),
        F.regexp_replace("artist", "_", "#").alias("artist"),
    )


@query(
    "t15_setlist_shape",
    f"""WITH g AS (SELECT comment_id, item_no, item_no - lag(item_no) OVER
               (PARTITION BY comment_id ORDER BY item_no) AS step FROM {MERGED_ITEMS})
        SELECT comment_id, CAST(count(*) AS INT) AS n, max(item_no) = count(*) AS is_contiguous,
               count(*) >= 2 AND min(item_no) = 1 AND coalesce(max(step), 0) <= 2 AS is_ascending
        FROM g GROUP BY comment_id""",
)
def t15(spark, sf):
    lists = tracks.extract_numbered(_numbered_comments(spark, sf))
    return tracks.setlist_shape(lists).select("comment_id", "n", "is_contiguous", "is_ascending")


@query(
    "t16_choose_extraction",
    f"""WITH c AS (SELECT comment_id, CAST(count(*) AS INT) AS n_all,
               CAST(count(*) FILTER (item_no % 3 <> 0) AS INT) AS n_num,
               max(item_no) FILTER (item_no % 3 <> 0) AS top FROM {MERGED_ITEMS} GROUP BY comment_id)
        SELECT comment_id, CASE WHEN n_num = n_all AND top = n_num THEN 'numbered' ELSE 'plain' END
        AS extraction, n_all AS n FROM c""",
)
def t16(spark, sf):
    """Every third item has no number, so only short lists are numbered throughout."""
    n = F.col("item_no")
    lead = F.when(n % 3 != 0, F.concat(n.cast("string"), F.lit(". "))).otherwise(F.lit(""))
    line = F.concat(fx.hms(F.col("secs")), F.lit(" "), lead, F.col("song"), F.lit(" / "), F.col("artist"))
    both = tracks.extract_both(fx.as_comments(fx.items(spark, sf), line))
    return tracks.choose_extraction(both).select(
        "comment_id", "extraction", F.size("tracks").alias("n")
    )


# --- list operators ---------------------------------------------------------------------


@query(
    "g01_strip_honorifics",
    f"""WITH p AS (SELECT *, item_no % 4 <> 0 AS polite FROM {MERGED_ITEMS}),
             l AS (SELECT comment_id, count(*) FILTER (polite) AS k, count(*) AS n FROM p GROUP BY 1)
        SELECT comment_id, item_no, CASE WHEN polite AND NOT (k >= 3 AND k >= 0.6 * n)
               THEN artist || 'さん' ELSE artist END AS artist FROM p JOIN l USING (comment_id)""",
)
def g01(spark, sf):
    polite = F.when(F.col("item_no") % 4 != 0, F.concat("artist", F.lit("さん"))).otherwise(
        F.col("artist")
    )
    lists = sets.strip_honorifics(setlists_of(fx.items(spark, sf).withColumn("artist", polite)))
    return tracks.explode_tracks(lists).select(
        "comment_id", F.col("item_pos").alias("item_no"), "artist"
    )


@query(
    "g02_squeeze_kanji",
    f"SELECT comment_id, item_no, '奥華子 ' || artist AS artist FROM {MERGED_ITEMS}",
)
def g02(spark, sf):
    rows = fx.items(spark, sf).withColumn("artist", F.concat(F.lit("奥 華　子 "), "artist"))
    return tracks.explode_tracks(sets.squeeze_kanji(setlists_of(rows))).select(
        "comment_id", F.col("item_pos").alias("item_no"), "artist"
    )


@query(
    "g03_dedupe_tracks",
    f"SELECT comment_id, item_no, secs, song, artist FROM {MERGED_ITEMS}",
)
def g03(spark, sf):
    """Every entry three times: as it is, in capitals, with loose marks."""
    rows = fx.items(spark, sf)
    copies = rows.withColumn("_c", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "video_id", "comment_id", (F.col("item_no") * 3 + F.col("_c")).alias("item_no"), "secs",
        F.when(F.col("_c") == 1, F.upper("song")).when(F.col("_c") == 2, F.concat("song", F.lit(" !")))
        .otherwise(F.col("song")).alias("song"), "artist",
    )
    flat = tracks.explode_tracks(sets.dedupe_tracks(setlists_of(copies)))
    return flat.select(
        "comment_id", (F.col("item_pos") / 3).cast("int").alias("item_no"), "secs", "song", "artist"
    )


@query(
    "g04_dedupe_near",
    f"""SELECT comment_id, item_no, secs + CASE WHEN item_no % 2 = 0 THEN 2 ELSE 0 END AS secs,
               CASE WHEN item_no % 2 = 0 THEN song ELSE song || ' ' || c END AS song
        FROM {MERGED_ITEMS}, (VALUES ('a'), ('b')) v(c) WHERE item_no % 2 = 1 OR c = 'b'""",
)
def g04(spark, sf):
    """Two entries two seconds apart; in even moments the second one has a number."""
    rows = fx.items(spark, sf)
    even = F.col("item_no") % 2 == 0
    pairs = rows.withColumn("_c", F.explode(F.array(F.lit("a"), F.lit("b")))).select(
        "video_id", "comment_id",
        (F.col("item_no") * 2 + F.when(F.col("_c") == "b", 1).otherwise(0)).alias("item_no"),
        (F.col("secs") + F.when(even & (F.col("_c") == "b"), 2).otherwise(0)).alias("secs"),
        F.when(even & (F.col("_c") == "b"), F.col("song")).otherwise(
            F.concat_ws(" ", "song", "_c")
        ).alias("song"),
        "artist", F.when(even & (F.col("_c") == "b"), F.col("item_no")).alias("num"),
    )
    flat = tracks.explode_tracks(sets.dedupe_near(setlists_of(pairs)))
    return flat.select(
        "comment_id", (F.col("item_pos") / 2).cast("int").alias("item_no"), "secs", "song"
    )


# --- best source and rendering ------------------------------------------------------------


def extracted(spark, sf) -> DataFrame:
    """The whole path from raw texts: classify, extract, normalise, per text."""
    comments = text.classify_songlist_comments(fx.comments(spark, sf))
    candidates = comments.where("is_songlist").drop("is_songlist", "song_ts_lines")
    every = candidates.unionByName(fx.descriptions(spark, sf))
    return sets.normalize_display(tracks.parse_setlists(every))


# comments that pass the classifier, with the entries they yield, and the descriptions
SOURCES_SQL = f"""
  SELECT video_id, comment_id, false AS is_description, item_no, secs, song, artist
  FROM (SELECT *, count(*) OVER (PARTITION BY comment_id) AS n, comment_id % 10 AS style FROM ({I}))
  WHERE (style IN (0, 1, 5, 6) AND n >= 2) OR style = 7
  UNION ALL
  SELECT video_id, -1, true, item_no, min(secs), min(song), min(artist)
  FROM ({I}) GROUP BY video_id, item_no
"""
# style 6 keeps the honorific when it is not the habit of a list of three or more
SOURCES_FULL_SQL = f"""
  SELECT video_id, comment_id, is_description, item_no, secs, song,
         CASE WHEN NOT is_description AND comment_id % 10 = 6 AND count(*) OVER
              (PARTITION BY video_id, comment_id, is_description) < 3
              THEN artist || 'さん' ELSE artist END AS artist
  FROM ({SOURCES_SQL})
"""
BEST_SQL = f"""
  SELECT s.* FROM ({SOURCES_FULL_SQL}) s JOIN (
    SELECT video_id, comment_id, is_description, row_number() OVER (PARTITION BY video_id
           ORDER BY count(*) DESC, is_description, comment_id) AS rn
    FROM ({SOURCES_FULL_SQL}) GROUP BY video_id, comment_id, is_description) b
  ON s.video_id = b.video_id AND s.comment_id = b.comment_id
     AND s.is_description = b.is_description AND b.rn = 1
"""


@query(
    "g05_select_best_source",
    f"""SELECT video_id, CASE WHEN is_description THEN 'description' ELSE 'comment' END AS source,
               comment_id, CAST(count(*) AS INT) AS n, {agg("song || ' - ' || artist")} AS content
        FROM ({BEST_SQL}) GROUP BY video_id, is_description, comment_id""",
)
def g05(spark, sf):
    best = sets.select_best_source(extracted(spark, sf))
    said = F.array_join(F.transform("tracks", lambda t: F.concat_ws(" - ", t["song"], t["artist"])), "\n")
    return best.select("video_id", "source", "comment_id", F.size("tracks").alias("n"), said.alias("content"))


NUMBERED_SQL = f"""
  SELECT video_id, item_no, secs, song, artist, row_number() OVER (PARTITION BY video_id
         ORDER BY secs, item_no) AS rn FROM ({BEST_SQL})
"""


@query(
    "flagship_setlists",
    f"""SELECT video_id, {agg(HMS + " || printf(' %02d. ', rn) || song || ' - ' || artist", 'rn')}
        AS message, CAST(count(*) AS INT) AS song_count FROM ({NUMBERED_SQL}) GROUP BY video_id""",
)
def flagship(spark, sf):
    """Raw texts to one numbered message per video."""
    best = sets.select_best_source(extracted(spark, sf))
    return sets.format_setlists(best).select("video_id", "message", "song_count")


MIX_SQL = f"""
  SELECT comment_id // {fx.MIX} AS video_id, (comment_id % {fx.MIX}) * 7 + item_no AS item_no,
         secs, song, artist FROM ({I})
"""
MIX_NUMBERED_SQL = f"""
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY secs, item_no) AS rn,
         count(*) OVER (PARTITION BY video_id) AS n FROM ({MIX_SQL})
"""
_LINE_BODY = """ || CASE WHEN n >= 100 THEN printf('%03d. ', rn) ELSE printf('%02d. ', rn) END
         || song || ' - ' || artist"""
MIX_LINE = HMS + " || ' '" + _LINE_BODY


def mix_messages(spark, sf, style: str = "long") -> DataFrame:
    lists = setlists_of(fx.mix_items(spark, sf))
    return sets.format_setlists(lists, style=style).select("video_id", "message", "song_count")


@query(
    "g06_format_setlists",
    f"""SELECT video_id, {agg(MIX_LINE, 'rn')} AS message, CAST(count(*) AS INT) AS song_count
        FROM ({MIX_NUMBERED_SQL}) GROUP BY video_id""",
)
def g06(spark, sf):
    """Long lists with three-digit numbers."""
    return mix_messages(spark, sf)


_SHORT = "printf('%d:%02d', secs // 60, secs % 60)"


@query(
    "g07_format_short",
    f"""WITH s AS (SELECT comment_id, secs - 900 AS secs, song, artist, row_number() OVER
               (PARTITION BY comment_id ORDER BY secs) AS rn, max(secs) OVER
               (PARTITION BY comment_id) >= 4500 AS hours FROM ({I}))
        SELECT comment_id, {agg("CASE WHEN hours THEN " + HMS + " ELSE " + _SHORT
        + " END || printf(' %02d. ', rn) || song || ' - ' || artist", 'rn')} AS message
        FROM s GROUP BY comment_id""",
)
def g07(spark, sf):
    """M:SS unless an entry of the list is past the hour."""
    rows = fx.items(spark, sf).withColumn("secs", F.col("secs") - 900)
    lists = setlists_of(rows)
    bare = F.transform("tracks", lambda t: t.withField("label", F.lit("")))
    lists = lists.withColumn("tracks", bare)
    return sets.format_setlists(lists, style="short").select("comment_id", "message")


@query(
    "g07_parse_rendered",
    f"""SELECT video_id, CAST(rn AS INT) AS line_no, secs, CASE WHEN n >= 100 THEN printf('%03d. ', rn)
        ELSE printf('%02d. ', rn) END || song || ' - ' || artist AS body FROM ({MIX_NUMBERED_SQL})""",
)
def g07_parse(spark, sf):
    parsed = sets.parse_rendered(mix_messages(spark, sf))
    return parsed.select("video_id", "line_no", "secs", "body")


def _noisy_messages(spark, sf) -> DataFrame:
    """Messages of single comments; every third in full-width capitals."""
    lists = setlists_of(fx.items(spark, sf).withColumn("secs", F.col("item_no").cast("int") * 60))
    plain = sets.format_setlists(lists, timed=False).select("video_id", "comment_id", "message")
    wide = F.translate(F.upper("message"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    first = F.regexp_replace("message", r"(?s)^([^\n]*- )[^\n]*.*$", "$1")
    # performers are dropped, so that many comments share one list
    return plain.select(
        "video_id", "comment_id",
        F.when(F.col("comment_id") % 3 == 0, wide).otherwise(F.col("message")).alias("full"),
        F.when(F.col("comment_id") % 3 == 0, F.regexp_replace(wide, r"(?m) - .*$", ""))
        .otherwise(F.regexp_replace("message", r"(?m) - .*$", "")).alias("message"),
    )


@query(
    "g08_dedupe_setlists",
    f"""WITH m AS (SELECT comment_id, {agg('song')} AS sig FROM ({I}) GROUP BY comment_id)
        SELECT comment_id, min(comment_id) OVER (PARTITION BY sig) = comment_id AS kept,
               CASE WHEN min(comment_id) OVER (PARTITION BY sig) <> comment_id
               THEN min(comment_id) OVER (PARTITION BY sig) END AS dup_of FROM m""",
)
def g08(spark, sf):
    messages = _noisy_messages(spark, sf).drop("full")
    return sets.dedupe_setlists(messages, order="comment_id").select(
        "comment_id", "kept", "dup_of"
    )


@query(
    "g09_rank_comments",
    f"""WITH c AS (SELECT video_id, comment_id, CAST(count(*) FILTER (comment_id % 10 <> 3 AND
               (comment_id % 10 <> 8 OR item_no = 1)) AS INT) AS ts_count FROM ({I}) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts_count DESC, comment_id)
        AS rank FROM c""",
)
def g09(spark, sf):
    ranked = text.rank_comments(fx.comments(spark, sf))
    return ranked.select("video_id", "comment_id", "ts_count", "rank")
