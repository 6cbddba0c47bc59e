"""Queries for the planning and publication tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans import publish, run
from ..session import shared_dir, written
from . import query
from .lines import HMS, I, agg
from .lists import BEST_SQL, MIX_LINE, MIX_NUMBERED_SQL, SOURCES_SQL, mix_messages, setlists_of

V = fx.VIDEOS_SQL
OWNER = "42"


@query(
    "p01_resolve_source",
    f"""SELECT video_id, CASE WHEN vid % 3 = 2 THEN yt_id ELSE printf('zz%09d', vid + CASE WHEN vid % 3 = 1
               THEN 0 ELSE 1 END) END AS yt_id, vid % 3 <> 2 AND yt_id <> '' AS id_mismatch FROM ({V})""",
)
def p01(spark, sf):
    """The link may stand on any line; lines that only mention one do not count."""
    vid = F.col("video_id").cast("bigint")
    short = F.format_string("intro\n  https://youtu.be/zz%09d?t=1", vid + 1)
    long = F.format_string("a https://youtu.be/xxxxxxxxxxx\r\nhttps://www.youtube.com/watch?v=zz%09d&x", vid)
    text = F.when(vid % 3 == 0, short).when(vid % 3 == 1, long).otherwise(F.lit("see https://youtu.be/xxxxxxxxxxx"))
    v = fx.videos(spark, sf).withColumn("description", text)
    return publish.resolve_source(v).select("video_id", "yt_id", "id_mismatch")


@query("p02_detect_new", f"SELECT video_id, part_date, title FROM ({V}) WHERE vid % 5 = 0")
def p02(spark, sf):
    v = fx.videos(spark, sf)
    return publish.detect_new(v, fx.snapshot(v)).select("video_id", "part_date", "title")


@query(
    "p03_candidates_incremental",
    f"SELECT video_id, part_date FROM ({V}) WHERE vid % 5 = 0 OR vid % 3 <> 0",
)
def p03(spark, sf):
    v = fx.videos(spark, sf)
    twice = v.withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2))))
    picked = publish.select_candidates(twice, fx.snapshot(v), fx.published(v))
    return picked.select("video_id", "part_date")


@query(
    "p03_candidates_top",
    f"SELECT video_id, part_date FROM ({V}) WHERE vid % 3 <> 0 ORDER BY part_date DESC, video_id LIMIT 50",
)
def p03_top(spark, sf):
    v = fx.videos(spark, sf)
    picked = publish.select_candidates(v, published=fx.published(v), mode="full", limit=50)
    return picked.select("video_id", "part_date")


@query("p03_candidates_specific", f"SELECT video_id, part_date FROM ({V}) WHERE vid % 4 = 1")
def p03_specific(spark, sf):
    v = fx.videos(spark, sf)
    wanted = v.where(F.col("video_id").cast("bigint") % 4 == 1)
    return publish.select_candidates(v, mode="specific", wanted=wanted).select("video_id", "part_date")


_HAS_LIST = f"""
  SELECT video_id AS vid, bool_or((style IN (0, 1, 5, 6) AND n >= 2) OR style = 7) AS listed FROM (
    SELECT video_id, comment_id % 10 AS style, count(*) AS n FROM ({I}) GROUP BY video_id, comment_id)
  GROUP BY video_id
"""


@query(
    "p04_plan_refetch",
    f"""SELECT video_id, CASE WHEN vid % 11 = 0 THEN true WHEN vid % 3 = 0 THEN (vid % 4) * 1800 >= 3600
               ELSE NOT coalesce(listed, false) END AS refetch FROM ({V}) LEFT JOIN ({_HAS_LIST}) USING (vid)""",
)
def p04(spark, sf):
    """One video in eleven has no cache; every third is an upgrade candidate."""
    vid = F.col("video_id").cast("bigint")
    v = fx.videos(spark, sf).select("video_id", F.col("video_id").alias("yt_id"), (vid % 3 == 0).alias("upgrade"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cached = v.where(vid % 11 != 0).select(
        "yt_id", F.timestamp_seconds(F.unix_timestamp(now) - (vid % 4) * 1800).alias("fetched_at")
    )
    said = fx.comments(spark, sf).select(F.col("video_id").cast("string").alias("yt_id"), "text")
    return publish.plan_refetch(v, cached, said, now).select("video_id", "refetch")


def published_comments(videos):
    """Two comments per video; the own one has ``video_id % 7`` list rows."""
    vid = F.col("video_id").cast("bigint")
    rows = F.array_join(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < vid % 7),
            lambda i: F.format_string("0:%02d:00 %02d. x - y", i, i + 1),
        ),
        "\n",
    )
    v = videos.select("video_id", "title", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("pos"))
    own = F.col("pos") >= 2
    return v.select(
        "video_id", "pos", F.concat_ws("-", "video_id", F.col("pos").cast("string")).alias("rpid"),
        F.when(own & (vid % 10 != 9), OWNER).otherwise("7").alias("mid"), F.lit("u").alias("uname"),
        F.lit(0).cast("bigint").alias("ctime"), F.lit(0).alias("likes"),
        F.when(F.col("pos") == 2, F.concat(rows, F.lit("\n0:17:27 old form / no number")))
        .otherwise(F.lit("0:00:01 01. a - b\n0:00:02 02. c - d")).alias("message"),
    )


@query(
    "p05_own_state",
    f"SELECT video_id, video_id || '-2' AS rpid, CAST(vid % 7 AS INT) AS own_count FROM ({V}) WHERE vid % 10 <> 9",
)
def p05(spark, sf):
    return publish.own_state(published_comments(fx.videos(spark, sf)), OWNER)


@query(
    "p06_admit",
    f"SELECT comment_id, item_no FROM ({I}) WHERE item_no % 3 <> 0 AND item_no % 4 <> 0",
)
def p06(spark, sf):
    rows = fx.items(spark, sf).select(
        "comment_id", "item_no", F.when(F.col("item_no") % 3 != 0, F.col("secs")).alias("secs"),
        F.when(F.col("item_no") % 4 == 0, "").otherwise(F.col("artist")).alias("artist"),
    )
    return publish.admit(rows, require_artist=True).select("comment_id", "item_no")


def _results(spark, sf, dry_run=True):
    """Lists come from the descriptions; errors, ignored and unknown ids by key."""
    from ..operators import tracks

    vid = F.col("video_id").cast("bigint")
    v = fx.videos(spark, sf)
    lists = tracks.parse_setlists(
        fx.descriptions(spark, sf).where(F.col("video_id") % 13 != 0)
    ).select(F.col("video_id").cast("string").alias("video_id"), "source", "tracks")
    errors = v.where(vid % 31 == 0).select("video_id", F.lit("timeout").alias("error"))
    ignore = v.where(vid % 97 == 0)
    own = publish.own_state(published_comments(v), OWNER)
    return publish.decide(v, own, lists, ignore, errors, dry_run=dry_run, run_id="r1"), v


_RESULTS_SQL = f"""
  SELECT v.video_id, v.vid, v.yt_id, v.title, v.part_date, v.collection, own, n,
    CASE WHEN vid % 97 = 0 THEN 'ignored' WHEN own >= 3 THEN 'already_posted' WHEN yt_id = '' THEN 'no_yt_link'
         WHEN vid % 31 = 0 THEN 'error' WHEN n = 0 AND own IS NOT NULL THEN 'already_posted'
         WHEN n = 0 THEN 'skipped_no_songs' WHEN n < own + 3 THEN 'already_posted' ELSE 'POST' END AS status,
    CAST(CASE WHEN vid % 97 = 0 OR own >= 3 OR yt_id = '' OR vid % 31 = 0 THEN 0 ELSE n END AS INT) AS song_count
  FROM (SELECT v.*, CASE WHEN vid % 10 <> 9 THEN vid % 7 END AS own,
        CASE WHEN vid % 13 = 0 THEN 0 ELSE coalesce(n, 0) END AS n FROM ({V}) v LEFT JOIN
        (SELECT video_id AS vid, count(DISTINCT item_no) AS n FROM ({I}) GROUP BY 1) USING (vid)) v
"""


def detail_sql(note: str) -> str:
    """What a result says about itself; ``note`` is that of its list."""
    rpid = "'rpid=' || video_id || '-2 "
    return f"""CASE WHEN status = 'ignored' THEN '忽略列表（用户指定）'
      WHEN status = 'no_yt_link' THEN 'B 站简介首行没有 YouTube 链接' WHEN status = 'error' THEN ''
      WHEN own >= 3 THEN {rpid}已发 ' || own || ' 首（足量）'
      WHEN status = 'already_posted' AND n = 0 THEN {rpid}升级检查：YouTube 无更全歌单，保留原评论'
      WHEN status = 'already_posted' THEN {rpid}升级检查：新提取 ' || n || ' 首 vs 已发 ' || own
           || ' 首，未达升级阈值（需 +3），保留原评论'
      WHEN status = 'skipped_no_songs' THEN '未提取到有效歌曲（' || CASE WHEN {note} = '' THEN '本地与 AI 均无结果'
           ELSE {note} END || '）'
      WHEN own IS NOT NULL THEN '升级：删 rpid=' || video_id || '-2 后发 ' || n || ' 首（dry-run 不执行）'
      ELSE {note} END"""


@query(
    "p07_decide",
    f"""WITH d AS (SELECT video_id, item_no, min(secs) AS secs, min(song) AS song, min(artist) AS artist
               FROM ({I}) GROUP BY 1, 2),
             m AS (SELECT video_id AS vid, {agg(HMS + " || printf(' %02d. ', rn) || song || ' - ' || artist", 'rn')} AS m
               FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY secs, item_no) AS rn FROM d) GROUP BY 1)
        SELECT video_id, replace(status, 'POST', 'dry_run') AS status, song_count,
               CASE WHEN status = 'POST' THEN m ELSE '' END AS message,
               {detail_sql("''")} AS detail,
               CASE WHEN status = 'error' THEN 'timeout' ELSE '' END AS error
        FROM ({_RESULTS_SQL}) LEFT JOIN m USING (vid)""",
)
def p07(spark, sf):
    results, _ = _results(spark, sf)
    return results.select("video_id", "status", "song_count", "message", "detail", "error")


@query(
    "p08_segment_messages",
    f"""WITH RECURSIVE l AS (SELECT video_id, rn, {MIX_LINE} AS line FROM ({MIX_NUMBERED_SQL})),
        s(video_id, rn, seg_no, used) AS (
          SELECT video_id, rn, 0, CAST(length(line) + 1 AS BIGINT) FROM l WHERE rn = 1
          UNION ALL
          SELECT l.video_id, l.rn, CASE WHEN used + length(line) + 1 > 900 THEN seg_no + 1 ELSE seg_no END,
                 CASE WHEN used + length(line) + 1 > 900 THEN length(line) + 1 ELSE used + length(line) + 1 END
          FROM s JOIN l ON l.video_id = s.video_id AND l.rn = s.rn + 1)
        SELECT video_id, seg_no, string_agg(line, chr(10) ORDER BY rn) AS text, seg_no = 0 AS is_root
        FROM s JOIN l USING (video_id, rn) GROUP BY video_id, seg_no""",
)
def p08(spark, sf):
    return publish.segment_messages(mix_messages(spark, sf))


@query(
    "p09_notice_outbox",
    f"""SELECT video_id, replace(status, 'POST', 'posted') AS status, CASE WHEN status = 'POST' THEN
          '✅评论发送成功' || chr(10) || 'https://www.bilibili.com/video/' || video_id || chr(10) ||
          'https://youtu.be/' || yt_id || chr(10) || '2024-01-02 07:30:00' || chr(10) || '歌曲数量：' || song_count
          ELSE '❌评论发送失败' || chr(10) || 'https://www.bilibili.com/video/' || video_id || chr(10) ||
          '原因：timeout' || chr(10) || '时间：2024-01-02 07:30:00' END AS notice
        FROM ({_RESULTS_SQL}) WHERE status IN ('POST', 'error')""",
)
def p09(spark, sf):
    results, _ = _results(spark, sf, dry_run=False)
    at = F.lit("2024-01-01 23:30:00").cast("timestamp")
    return publish.notice_outbox(results, at)


@query(
    "p10_run_summary",
    f"""SELECT 'r1' AS run_id, replace(status, 'POST', 'posted') AS status, count(*) AS videos
        FROM ({_RESULTS_SQL}) GROUP BY status""",
)
def p10(spark, sf):
    results, v = _results(spark, sf, dry_run=False)
    return publish.close_run(results, fx.published(v), v)["runs"].select("run_id", "status", "videos")


@query(
    "p10_published",
    f"SELECT video_id FROM ({_RESULTS_SQL}) WHERE vid % 3 = 0 OR status IN ('POST', 'ignored')",
)
def p10_published(spark, sf):
    results, v = _results(spark, sf, dry_run=False)
    return publish.close_run(results, fx.published(v), v)["published"]


@query(
    "p11_scan_report",
    f"SELECT video_id, part_date, yt_id, collection, section, title, vid % 5 = 0 AS is_new FROM ({V})",
)
def p11(spark, sf):
    v = fx.videos(spark, sf)
    return publish.scan_report(v, fx.snapshot(v)).drop("raw_part")


# --- the stages as one run ---------------------------------------------------------------


def _answers(entries):
    """What the model said per video: a list, a wish for more, nothing finished, or nothing at all."""
    rows = entries.where(F.col("item_no") % 5 != 0).withColumn("comment_id", F.lit(0).cast("bigint"))
    line = F.concat(fx.hms(F.col("secs")), F.format_string(" %02d. ", "item_no"), "song", F.lit(" - "), "artist")
    kind = F.col("video_id") % 4
    said = F.when(kind == 2, "请提供歌手信息后再处理。").otherwise(F.col("text"))
    choice = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    broken = F.to_json(F.struct(F.lit("incomplete").alias("status"), said.alias("output_text")))
    return fx.as_comments(rows, line).where(kind != 0).select(
        F.col("video_id").cast("string").alias("video_id"), F.when(kind == 3, broken).otherwise(choice).alias("json")
    )


def run_inputs(spark, sf):
    """All tables of a run; what is rendered is stored, and the items are built once for all of them."""
    vid = F.col("video_id").cast("bigint")
    v = written(fx.videos(spark, sf), "videos")
    comments = written(fx.comments(spark, sf, with_items=True), "comments")
    entries = written(fx.entries(comments.select("video_id", F.inline("items"))), "entries")
    named = lambda df: df.withColumn("video_id", F.col("video_id").cast("string"))
    return run.Inputs(
        videos=v, snapshot=fx.snapshot(v), published=fx.published(v),
        comments=named(comments.drop("items")),
        descriptions=written(named(fx.described(entries).where(F.col("video_id") % 13 != 0)), "descriptions"),
        responses=written(_answers(entries), "responses"), published_comments=published_comments(v),
        ignore=v.where(vid % 97 == 0),
        errors=v.where(vid % 31 == 0).select("video_id", F.lit("timeout").alias("error")),
    )


def whole_run(inputs, path=None, dry_run=True):
    return run.run_once(
        inputs, owner=OWNER, run_id="r7", dry_run=dry_run, path=path,
        run_at=F.lit("2024-01-02 00:00:00").cast("timestamp"),
    )


_BEST_OF_RUN = BEST_SQL.replace(
    f"FROM ({I}) GROUP BY video_id, item_no", f"FROM ({I}) WHERE video_id % 13 <> 0 GROUP BY video_id, item_no"
)
_RUN_SQL = f"""
  WITH said AS (SELECT video_id, item_no, min(secs) AS secs, min(song) AS song, min(artist) AS artist
                FROM ({I}) WHERE item_no % 5 <> 0 GROUP BY 1, 2),
  listed AS (SELECT DISTINCT video_id AS vid FROM ({SOURCES_SQL}) WHERE NOT is_description),
  asked AS (SELECT DISTINCT video_id AS vid FROM said JOIN listed ON vid = video_id WHERE video_id % 4 <> 0),
  picked AS (
    SELECT video_id AS vid, item_no, secs, song, artist, true AS ai FROM said JOIN asked ON vid = video_id
    WHERE video_id % 4 = 1
    UNION ALL
    SELECT video_id, item_no, secs, song, artist, false FROM ({_BEST_OF_RUN})
    WHERE video_id NOT IN (SELECT vid FROM asked WHERE vid % 4 = 1)),
  m AS (SELECT vid, any_value(ai) AS ai, count(*) AS n,
               {agg(HMS + " || printf(' %02d. ', rn) || song || ' - ' || artist", 'rn')} AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY secs, item_no) AS rn FROM picked) GROUP BY vid),
  base AS (
    SELECT v.*, CASE WHEN vid % 10 <> 9 THEN vid % 7 END AS own, coalesce(n, 0) AS n, coalesce(ai, false) AS ai, m.message,
           CASE WHEN coalesce(ai, false) THEN '' ELSE '本地兜底（' || CASE WHEN a.vid IS NULL THEN
             '评论区无结构化歌单（不调 DS）' WHEN vid % 4 = 2 THEN 'AI 判定缺歌手' ELSE 'AI 整理失败: not completed' END || '）'
           END AS note
    FROM ({V}) v LEFT JOIN m USING (vid) LEFT JOIN asked a USING (vid) WHERE vid % 5 = 0 OR vid % 3 <> 0),
  decided AS (
    SELECT *, CASE WHEN vid % 97 = 0 THEN 'ignored' WHEN own >= 3 THEN 'already_posted' WHEN yt_id = '' THEN 'no_yt_link'
         WHEN vid % 31 = 0 THEN 'error' WHEN n = 0 AND own IS NOT NULL THEN 'already_posted'
         WHEN n = 0 THEN 'skipped_no_songs' WHEN n < own + 3 THEN 'already_posted' ELSE 'dry_run' END AS status
    FROM base)
"""
_EARLY = "(status IN ('ignored', 'no_yt_link', 'error') OR coalesce(own >= 3, false))"


@query(
    "p10_full_run",
    f"""{_RUN_SQL} SELECT video_id, status, CAST(CASE WHEN {_EARLY} THEN 0 ELSE n END AS INT) AS song_count,
               CASE WHEN {_EARLY} THEN '' WHEN ai THEN 'ai' ELSE 'local' END AS source,
               CASE WHEN status = 'dry_run' THEN message ELSE '' END AS message,
               {detail_sql("note")} AS detail, CASE WHEN status = 'error' THEN 'timeout' ELSE '' END AS error
        FROM decided""",
)
def p10_full_run(spark, sf):
    """Candidates, extraction, choice and decision of one run, with the texts to publish."""
    return whole_run(run_inputs(spark, sf))["results"].select(
        "video_id", "status", "song_count", "source", "message", "detail", "error"
    )


@query(
    "p10_full_run_written",
    f"""{_RUN_SQL}
        SELECT 'published' AS kind, video_id AS name, 1 AS n FROM ({V})
        WHERE vid % 3 = 0 OR vid IN (SELECT vid FROM decided WHERE status IN ('dry_run', 'ignored'))
        UNION ALL SELECT 'runs', replace(status, 'dry_run', 'posted'), count(*) FROM decided GROUP BY status
        UNION ALL SELECT 'segments', video_id, 1 FROM decided WHERE status = 'dry_run'
        UNION ALL SELECT 'notices', video_id, 1 FROM decided WHERE status IN ('dry_run', 'error')""",
)
def p10_full_run_written(spark, sf):
    """The tables of a run that was written twice, as they are read back."""
    path, inputs = shared_dir(spark, "run"), run_inputs(spark, sf)
    whole_run(inputs, path, dry_run=False)
    tables = whole_run(inputs, path, dry_run=False)
    of = lambda kind, name, n: spark.read.parquet(f"{path}/{kind}").select(
        F.lit(kind).alias("kind"), F.col(name).alias("name"), n.cast("int").alias("n")
    )
    one = F.lit(1)
    parts = [tables["published"].select(F.lit("published").alias("kind"), F.col("video_id").alias("name"), one.alias("n"))]
    parts += [of("runs", "status", F.col("videos")), of("segments", "video_id", one), of("notices", "video_id", one)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
