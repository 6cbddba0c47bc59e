"""Queries for text, line and title operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.patterns import WS_CHARS
from ..operators import merge, rules, text, tracks
from . import query

I = fx.ITEMS_SQL
HMS = "printf('%d:%02d:%02d', secs // 3600, (secs % 3600) // 60, secs % 60)"


def agg(line: str, order: str = "item_no") -> str:
    return f"string_agg({line}, chr(10) ORDER BY {order})"


# --- text ----------------------------------------------------------------------------


@query(
    "t01_normalize_comments",
    f"SELECT comment_id, {agg(HMS + chr(32).join(['||', repr(' '), '||']) + 'song || ' + repr(' / ') + ' || artist')}"
    f" AS norm_text FROM ({I}) GROUP BY comment_id",
)
def t01(spark, sf):
    """Full-width numbers, CRLF, tabs, no-break and zero-width blanks."""
    t = F.translate(fx.hms(F.col("secs")), *fx._WIDE)
    noisy = F.concat(
        F.lit("\t "), t, F.lit("  \t"), "song", F.lit("​ / "), "artist", F.lit("  \r\n\r")
    )
    c = fx.as_comments(fx.items(spark, sf), noisy)
    return text.normalize_comments(c).select("comment_id", "norm_text")


_WS_SQL = "||".join(f"chr({ord(c)})" for c in WS_CHARS)


@query(
    "t01_normalize_documents",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(
          replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' '),
                  chr(8203), ''), '[ \\t]+', ' ', 'g'), chr(10)),
          lambda x: trim(x, {_WS_SQL})), lambda x: x <> '') AS lines FROM documents)
        SELECT doc_id, CAST(len(lines) AS INT) AS n_lines, md5(translate(array_to_string(lines, chr(10)),
          '０１２３４５６７８９：．＃', '0123456789:.#')) AS digest FROM l""",
)
def t01_documents(spark, sf):
    docs = text.normalize_comments(fx.table(spark, sf, "documents"))
    n = F.when(F.col("norm_text") == "", 0).otherwise(F.size(F.split("norm_text", "\n")))
    return docs.select("doc_id", n.alias("n_lines"), F.md5("norm_text").alias("digest"))


@query(
    "t02_explode_lines",
    f"""SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no) AS INT)
        AS line_pos, {HMS} || ' ' || song || ' / ' || artist AS line FROM ({I})""",
)
def t02(spark, sf):
    """All entries of a comment on one line, cut at their times."""
    c = fx.comments(spark, sf, styles=(4,))
    return text.explode_lines(c).select("comment_id", "line_pos", "line")


@query(
    "t03_extract_timestamps",
    f"""SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no) AS INT)
        AS pos, {HMS} AS label, secs FROM ({I})
        WHERE comment_id % 10 <> 3 AND (comment_id % 10 <> 8 OR item_no = 1)""",
)
def t03(spark, sf):
    """Full-width colons are no time; repeated labels count once."""
    c = fx.comments(spark, sf)
    return text.extract_timestamps(c).select("comment_id", "pos", "label", "secs")


_MS = fx.style_sql(fx.MERGE_STYLES)
_FALSE = ("is_time_only is_placeholder is_range is_number is_translation is_non_song is_title "
          "is_inline_range is_song_artist").split()


def _flag_row(style: int, part: int, *true: str) -> str:
    cols = ", ".join(f"{'true' if f in true else 'false'}" for f in _FALSE)
    return f"({style}, {part}, {cols})"


@query(
    "t04_classify_lines",
    f"""WITH kinds(style, part, {', '.join(_FALSE)}) AS (VALUES
          {_flag_row(0, 1)}, {_flag_row(2, 1, 'is_time_only')}, {_flag_row(2, 2, 'is_song_artist')},
          {_flag_row(10, 1, 'is_time_only', 'is_placeholder')}, {_flag_row(10, 2, 'is_song_artist')},
          {_flag_row(11, 1, 'is_number')}, {_flag_row(11, 2, 'is_range')},
          {_flag_row(11, 3, 'is_time_only')}, {_flag_row(11, 4, 'is_translation')},
          {_flag_row(11, 5, 'is_song_artist')},
          {_flag_row(12, 1, 'is_title', 'is_song_artist')}, {_flag_row(12, 2, 'is_range')},
          {_flag_row(12, 3, 'is_time_only')}, {_flag_row(13, 1, 'is_inline_range')},
          {_flag_row(14, 1, 'is_song_artist')}, {_flag_row(14, 2, 'is_time_only')})
        SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no, part)
               AS INT) AS line_pos, {', '.join(_FALSE)}
        FROM ({I}) JOIN kinds ON style = {_MS}""",
)
def t04(spark, sf):
    c = fx.comments(spark, sf, styles=fx.MERGE_STYLES)
    lines = text.explode_lines(c).select("comment_id", "line_pos", "line")
    return text.classify_lines(lines).drop("line")


@query(
    "t05_classify_songlist_comments",
    f"""SELECT comment_id, CAST(CASE WHEN comment_id % 10 IN (0, 1, 5, 6) AND count(*) >= 2 THEN count(*)
          WHEN comment_id % 10 = 7 THEN 2 * count(*)
          WHEN comment_id % 10 = 8 AND count(*) >= 2 THEN count(*) FILTER (item_no = 1)
          ELSE 0 END AS INT) AS song_ts_lines, song_ts_lines >= 2 AS is_songlist
        FROM ({I}) GROUP BY comment_id""",
)
def t05(spark, sf):
    c = text.classify_songlist_comments(fx.comments(spark, sf))
    return c.select("comment_id", "song_ts_lines", "is_songlist")


@query(
    "t05_classify_documents",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text,
          '\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, """ + _WS_SQL + r""")),
          lambda x: x <> '') AS lines FROM documents)
        SELECT doc_id, CAST(CASE WHEN len(lines) >= 2 THEN len(list_filter(lines,
          lambda x: regexp_matches(x, '(?:^|[^0-9:])([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)(?:[^0-9]|$)')))
          ELSE 0 END AS INT) AS song_ts_lines FROM l""",
)
def t05_documents(spark, sf):
    """The classifier on whole documents of prose."""
    docs = text.classify_songlist_comments(fx.table(spark, sf, "documents"))
    return docs.select("doc_id", "song_ts_lines")


@query(
    "t06_select_setlist_section",
    f"""SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no) AS INT)
        AS line_pos, {HMS} || ' ' || song || ' / ' || artist AS line FROM ({I})""",
)
def t06(spark, sf):
    """A chat timeline before the setlist heading and talk after it."""
    c = fx.comments(spark, sf, styles=(4,))
    body = F.regexp_replace("text", r" (\d{1,2}:\d{2}:\d{2})", "\n$1")
    wrapped = F.concat(
        F.lit("タイムライン\n0:00:05 intro / host\n【セトリ】\n"), body,
        F.lit("\n雑談\n9:59:59 outro / host"),
    )
    cut = text.select_setlist_section(c.withColumn("text", wrapped))
    return text.explode_lines(cut).select("comment_id", "line_pos", "line")


@query(
    "t07_merge_timeline_lines",
    f"""SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no) AS INT)
        AS item_pos, {HMS} || ' ' || CASE WHEN {_MS} = 0 THEN printf('%02d. ', item_no) ELSE '' END
        || song || ' / ' || artist AS line FROM ({I})""",
)
def t07(spark, sf):
    """Six multi-line forms come back as one line per entry."""
    c = fx.comments(spark, sf, styles=fx.MERGE_STYLES)
    return merge.merge_timeline_lines(c).select("comment_id", "item_pos", "line")


_SPLIT_STYLES = (0, 1, 3, 5, 6)


@query(
    "t08_split_tracks",
    f"""SELECT comment_id, CAST(row_number() OVER (PARTITION BY comment_id ORDER BY item_no) AS INT)
        AS line_pos, CASE WHEN {fx.style_sql(_SPLIT_STYLES)} = 0 THEN item_no END AS num, secs,
        {HMS} AS label, song, artist || CASE WHEN {fx.style_sql(_SPLIT_STYLES)} = 6 THEN 'さん'
        ELSE '' END AS artist FROM ({I})""",
)
def t08(spark, sf):
    lines = text.explode_lines(fx.comments(spark, sf, styles=_SPLIT_STYLES))
    return tracks.split_tracks(lines).select(
        "comment_id", "line_pos", "num", "secs", "label", "song", "artist"
    )


# --- titles ----------------------------------------------------------------------------

# each pair: how a title is written, and which rules bring it back
TITLE_FORMS = (
    ("{}", ""), ("07. {}", "R02"), ("〔10〕 {}", "R03"), ("└ {}", "R04"), ("'{}'", "R05"),
    ("{}（少し）", "R07"), ("{}（かなで）", "R14"), ("{} (2019/05/05)", "R15"),
    ("{} (Zetchou Sanka)", "R06"), ("１２： {}", "R01,R13"), ("3. {} (練習)", "R02,R07"),
)


def _title_form() -> F.Column:
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(TITLE_FORMS)
    expr = F.lit(None)
    for i, (form, _) in enumerate(TITLE_FORMS):
        a, b = form.split("{}")
        expr = F.when(at == i, F.concat(F.lit(a), F.col("p_name"), F.lit(b))).otherwise(expr)
    return expr


_FIRED_SQL = "([" + ", ".join(f"'{r}'" for _, r in TITLE_FORMS) + \
    f"])[(l_orderkey * 7 + l_linenumber) % {len(TITLE_FORMS)} + 1]"


def _written_titles(spark, sf):
    return fx.spread(fx.table(spark, sf, "lineitem")).join(
        fx.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select("l_orderkey", "l_linenumber", "p_partkey", _title_form().alias("song"))


@query(
    "t09_apply_title_rules",
    f"""SELECT l_orderkey, l_linenumber, p_partkey, p_name AS song_clean, {_FIRED_SQL} AS fired
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def t09(spark, sf):
    cleaned = rules.apply_title_rules(_written_titles(spark, sf))
    return cleaned.select(
        "l_orderkey", "l_linenumber", "p_partkey", "song_clean",
        F.array_join("fired", ",").alias("fired"),
    )


@query(
    "t10_rule_stats",
    f"""WITH w AS (SELECT p_name, {_FIRED_SQL} AS fired,
               (l_orderkey * 7 + l_linenumber) % {len(TITLE_FORMS)} AS form
               FROM lineitem JOIN part ON l_partkey = p_partkey),
             r AS (SELECT p_name, form, unnest(string_split(fired, ',')) AS rule_id FROM w
                   WHERE fired <> '')
        SELECT rule_id, count(*) AS hits, count(DISTINCT (p_name, form)) AS titles,
               round(count(*) / (SELECT count(*) FROM w), 6) AS share FROM r GROUP BY rule_id""",
)
def t10(spark, sf):
    cleaned = rules.apply_title_rules(_written_titles(spark, sf))
    return rules.rule_stats(cleaned).withColumn("share", F.round("share", 6))


_NOISE_SQL = "(l_orderkey + l_linenumber) % 6"


@query(
    "t11_drop_noise",
    f"""SELECT l_orderkey, l_linenumber, p_partkey,
               CASE WHEN {_NOISE_SQL} = 4 THEN 'リクエスト' ELSE p_name END AS song
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_NOISE_SQL} IN (0, 4)""",
)
def t11(spark, sf):
    """Closing words, request counts, section pairs and bad fields go; titles stay."""
    at = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    song = (
        F.when(at == 1, "締め").when(at == 2, "1,2曲リクエスト").when(at == 3, "幕開け")
        .when(at == 4, "リクエスト").when(at == 5, "10:15").otherwise(F.col("p_name"))
    )
    artist = F.when(at == 3, "Opening").otherwise(F.col("p_brand"))
    rows = fx.spread(fx.table(spark, sf, "lineitem")).join(
        fx.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select("l_orderkey", "l_linenumber", "p_partkey", song.alias("song"), artist.alias("artist"))
    return tracks.drop_noise(rows).drop("artist")


ARTIST_FORMS = (
    "{}", "{} (1999/04/23)", "{} 1999/04/23 アニメ オープニング", "{}【作品名】", "{} 弾き語り",
    "{} Original Song", "{} [2018年]", "{}//",
)


@query(
    "t12_clean_artist_metadata",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, s_name || CASE
          WHEN (l_orderkey + l_linenumber) % {len(ARTIST_FORMS)} = {len(ARTIST_FORMS) - 1}
          THEN '//' ELSE '' END AS artist
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def t12(spark, sf):
    at = (F.col("l_orderkey") + F.col("l_linenumber")) % len(ARTIST_FORMS)
    artist = F.lit(None)
    for i, form in enumerate(ARTIST_FORMS):
        a, b = form.split("{}")
        artist = F.when(at == i, F.concat(F.lit(a), F.col("s_name"), F.lit(b))).otherwise(artist)
    rows = fx.spread(fx.table(spark, sf, "lineitem")).join(
        fx.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select("l_orderkey", "l_linenumber", "l_suppkey", artist.alias("artist"))
    return tracks.clean_artist_metadata(rows)


@query(
    "t13_split_multifield",
    f"""SELECT comment_id, item_no, song, artist FROM ({I}) WHERE item_no % 3 <> 2""",
)
def t13(spark, sf):
    """Four fields, three with metadata, and three without (no record)."""
    form = F.col("item_no") % 3
    line = F.when(
        form == 0, F.concat_ws("／", "song", "artist", F.lit("album"), F.lit("note"))
    ).when(form == 1, F.concat_ws("／", "song", "artist", F.lit("TVアニメ「x／y」主題歌"))).otherwise(
        F.concat_ws("／", "song", "artist", F.lit("word"))
    )
    rows = fx.items(spark, sf).select("comment_id", "item_no", line.alias("line"))
    return tracks.split_multifield(rows)
