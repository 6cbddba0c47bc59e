"""Planning and publication tables: what is new, what to fetch, post, upgrade, report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.rows import explode_rows
from ..functions.text import strip
from ..operators.sets import rendered_lines
from ..operators.text import classify_songlist_comments

W = P.WS
UPGRADE_STEP = 3  # fixed value: an own list this long is final; an upgrade must add this many
CACHE_SECONDS = 3600  # fixed value
SEGMENT_LIMIT = 900  # fixed value

_VIDEO_LINK = r"^https?://(?:youtu\.be/|www\.youtube\.com/watch\?v=)([\p{L}\p{N}_\-]{11})"


def linked_id(description: Column) -> Column:
    """Id of the first line that starts with a video link, else the empty string."""
    lines = F.transform(F.split(F.coalesce(description, F.lit("")), P.LINE_BREAK), strip)
    ids = F.filter(
        F.transform(lines, lambda l: F.regexp_extract(l, _VIDEO_LINK, 1)), lambda i: i != ""
    )
    return F.coalesce(F.get(ids, F.lit(0)), F.lit(""))


def resolve_source(videos: DataFrame, description: str = "description") -> DataFrame:
    """Settle ``yt_id``: the id in the description wins over the one in the part name."""
    keep = [c for c in videos.columns if c not in ("yt_id", description)]
    found = videos.withColumn("_d", linked_id(F.col(description)))
    part = F.coalesce(F.col("yt_id"), F.lit(""))
    return found.select(
        *keep,
        F.when(F.col("_d") != "", F.col("_d")).otherwise(part).alias("yt_id"),
        ((part != "") & (F.col("_d") != "") & (part != F.col("_d"))).alias("id_mismatch"),
    )


def newest_first(videos: DataFrame, limit: int = 0) -> DataFrame:
    """Date descending (dates are strings, the empty one last); a limit is a top-k."""
    ordered = videos.orderBy(F.desc("part_date"), "video_id")
    return ordered.limit(limit) if limit > 0 else ordered


def detect_new(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Videos that the snapshot does not hold."""
    return newest_first(current.join(snapshot.select("video_id"), "video_id", "left_anti"))


def select_candidates(
    videos: DataFrame, snapshot: DataFrame | None = None, published: DataFrame | None = None,
    mode: str = "incremental", wanted: DataFrame | None = None, limit: int = 0,
) -> DataFrame:
    """Videos to work on in this run, newest first, one row per video.

    ``specific``: those in ``wanted``.  ``full``: not published yet.  ``incremental``:
    new since the snapshot, or known and not published yet.
    """
    if mode == "specific":
        picked = videos.join(wanted.select("video_id"), "video_id", "left_semi")
    elif mode == "full":
        picked = videos.join(published.select("video_id"), "video_id", "left_anti")
    elif mode == "incremental":
        known = snapshot.select("video_id").distinct().withColumn("_known", F.lit(True))
        posted = published.select("video_id").distinct().withColumn("_posted", F.lit(True))
        marked = videos.join(known, "video_id", "left").join(posted, "video_id", "left")
        picked = marked.where(F.col("_known").isNull() | F.col("_posted").isNull()).select(
            *videos.columns
        )
    else:
        raise ValueError(f"unknown mode {mode}")
    if "pos" in videos.columns:
        rest = [c for c in videos.columns if c != "video_id"]
        first = picked.groupBy("video_id").agg(F.min_by(F.struct(*rest), "pos").alias("_v"))
        picked = first.select("video_id", "_v.*").select(*videos.columns)
    else:  # without a place in the list, the smallest row: the same one in every run
        rest = [c for c in videos.columns if c != "video_id"]
        first = picked.groupBy("video_id").agg(F.min(F.struct(*rest)).alias("_v"))
        picked = first.select("video_id", "_v.*").select(*videos.columns)
    return newest_first(picked, limit)


def plan_refetch(
    videos: DataFrame, cached: DataFrame, cached_comments: DataFrame, now: Column,
    ttl: int = CACHE_SECONDS,
) -> DataFrame:
    """Add ``refetch`` per video.

    ``videos`` has ``yt_id, upgrade``; ``cached`` has ``yt_id, fetched_at``;
    ``cached_comments`` has ``yt_id, text``.  An upgrade candidate is fetched again when
    its cache is ``ttl`` seconds old, any other video while no cached comment is a setlist.
    """
    has_list = (
        classify_songlist_comments(cached_comments).groupBy("yt_id")
        .agg(F.bool_or("is_songlist").alias("_list"))
    )
    latest = cached.groupBy("yt_id").agg(F.max("fetched_at").alias("_at"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("_at").cast("timestamp"))
    joined = videos.join(latest, "yt_id", "left").join(has_list, "yt_id", "left")
    refetch = (
        F.when(F.col("_at").isNull(), True)
        .when(F.col("upgrade"), age >= ttl)
        .otherwise(~F.coalesce(F.col("_list"), F.lit(False)))
    )
    return joined.select(*videos.columns, refetch.alias("refetch"))


_OWN_LINE = rf"[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?{W}+[0-9]{{2,3}}\."


def own_lines(message: Column) -> Column:
    """Rows of a published list: time, two- or three-digit number, dot."""
    lines = F.split(F.coalesce(message, F.lit("")), P.LINE_BREAK)
    return F.size(F.filter(lines, lambda l: l.rlike(_OWN_LINE)))


def own_state(published_comments: DataFrame, owner: str) -> DataFrame:
    """First own comment per video, whatever it says, and its count of list rows."""
    own = published_comments.where(F.col("mid") == owner)
    first = own.groupBy("video_id").agg(F.min_by(F.struct("rpid", "message"), "pos").alias("c"))
    return first.select(
        "video_id", F.col("c.rpid").alias("rpid"), own_lines(F.col("c.message")).alias("own_count")
    )


def admitted(tracks: Column, require_artist: bool = False) -> Column:
    ok = lambda t: t["secs"].isNotNull()
    if require_artist:
        ok = lambda t: t["secs"].isNotNull() & (F.coalesce(t["artist"], F.lit("")) != "")
    return F.filter(tracks, ok)


def admit(tracks: DataFrame, require_artist: bool = False) -> DataFrame:
    """Rows with a time, and with a performer when one is required."""
    rows = tracks.where(F.col("secs").isNotNull())
    return rows.where(F.coalesce(F.col("artist"), F.lit("")) != "") if require_artist else rows


def decide(
    videos: DataFrame, own: DataFrame, lists: DataFrame, ignore: DataFrame,
    errors: DataFrame | None = None, dry_run: bool = True, require_artist: bool = False,
    run_id: str = "",
) -> DataFrame:
    """One result row per video; the first rule that applies sets the status.

    ``lists`` has ``video_id, source, tracks`` and may have ``note``, how its list came about;
    ``detail`` says why a video is kept, skipped or replaced, or repeats the note.  Of several
    errors of a video the smallest is told.  Every join is on the video key against a side
    with one row per video, so there is one shuffle key throughout.
    """
    ignored = ignore.select("video_id").distinct().withColumn("_ignored", F.lit(True))
    fetch = (
        errors.groupBy("video_id").agg(F.min("error").alias("_error"))
        if errors is not None else None
    )
    found = lists.select(
        "video_id", F.col("source").alias("_source"),
        admitted(F.col("tracks"), require_artist).alias("_tracks"),
        (F.col("note") if "note" in lists.columns else F.lit("")).alias("_note"),
    )
    df = videos.join(ignored, "video_id", "left").join(own, "video_id", "left")
    df = df.join(found, "video_id", "left")
    df = df.join(fetch, "video_id", "left") if fetch is not None else df.withColumn(
        "_error", F.lit(None).cast("string")
    )
    n = F.when(F.col("_tracks").isNull(), 0).otherwise(F.size("_tracks"))
    upgrade = F.col("own_count").isNotNull()
    status = (
        F.when(F.col("_ignored"), "ignored")
        .when(F.col("own_count") >= UPGRADE_STEP, "already_posted")
        .when(F.coalesce(F.col("yt_id"), F.lit("")) == "", "no_yt_link")
        .when(F.col("_error").isNotNull(), "error")
        .when((F.col("_n") == 0) & upgrade, "already_posted")
        .when(F.col("_n") == 0, "skipped_no_songs")
        .when(upgrade & (F.col("_n") < F.col("own_count") + UPGRADE_STEP), "already_posted")
        .otherwise("dry_run" if dry_run else "posted")
    )
    early = (
        F.coalesce(F.col("_ignored"), F.lit(False))
        | F.coalesce(F.col("own_count") >= UPGRADE_STEP, F.lit(False))
        | (F.coalesce(F.col("yt_id"), F.lit("")) == "") | F.col("_error").isNotNull()
    )
    df = df.withColumn("_n", n).withColumn("status", status).withColumn("_early", early)
    publish = F.col("status").isin("dry_run", "posted")
    return df.select(
        F.lit(run_id).alias("run_id"), "video_id", F.coalesce("yt_id", F.lit("")).alias("yt_id"),
        "title", "part_date", "collection", "status",
        F.when(F.col("_early"), 0).otherwise(F.col("_n")).cast("int").alias("song_count"),
        F.when(F.col("_early"), "").otherwise(F.coalesce("_source", F.lit("local"))).alias("source"),
        F.when(publish, F.array_join(rendered_lines(F.col("_tracks")), "\n"))
        .otherwise("").alias("message"),
        _detail(upgrade).alias("detail"),
        F.when(F.col("status") == "error", F.col("_error")).otherwise("").alias("error"),
    )


# fixed values: what a result says about itself
_IGNORED = "忽略列表（用户指定）"
_NO_LINK = "B 站简介首行没有 YouTube 链接"
_ENOUGH = "rpid=%s 已发 %d 首（足量）"
_NO_BETTER = "rpid=%s 升级检查：YouTube 无更全歌单，保留原评论"
_TOO_FEW = "rpid=%s 升级检查：新提取 %d 首 vs 已发 %d 首，未达升级阈值（需 +%d），保留原评论"
_REPLACES = "升级：删 rpid=%s 后发 %d 首（dry-run 不执行）"
_NOTHING, _NO_RESULT = "未提取到有效歌曲（%s）", "本地与 AI 均无结果"


def _detail(upgrade: Column) -> Column:
    """Why a video is kept, skipped or replaced; else the note of its list."""
    said = F.coalesce("_note", F.lit(""))
    note = F.when(said == "", F.lit(_NO_RESULT)).otherwise(said)
    status, own, rpid = F.col("status"), F.col("own_count"), F.col("rpid")
    kept = (
        F.when(own >= UPGRADE_STEP, F.format_string(_ENOUGH, rpid, own))
        .when(F.col("_n") == 0, F.format_string(_NO_BETTER, rpid))
        .otherwise(F.format_string(_TOO_FEW, rpid, "_n", own, F.lit(UPGRADE_STEP)))
    )
    return (
        F.when(status == "ignored", _IGNORED).when(status == "no_yt_link", _NO_LINK)
        .when(status == "already_posted", kept).when(status == "error", "")
        .when(status == "skipped_no_songs", F.format_string(_NOTHING, note))
        .when(upgrade & (status == "dry_run"), F.format_string(_REPLACES, rpid, "_n"))
        .when(upgrade, F.concat(F.lit("replaces "), rpid)).otherwise(said)
    )


def segment_messages(messages: DataFrame, limit: int = SEGMENT_LIMIT) -> DataFrame:
    """Cut messages at line ends into segments below ``limit``; number 0 is the root.

    A line costs its length plus one.  The pattern takes the longest run of whole lines
    that fits, or a single line that is too long on its own, from left to right.
    """
    keep = [c for c in messages.columns if c not in ("message", "song_count")]
    lines = F.filter(F.split("message", P.LINE_BREAK), lambda l: strip(l) != "")
    fits = rf"(?s)[^\n].{{0,{limit - 2}}}(?=\n|\z)|[^\n]+"
    cut = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(fits), F.lit(0))
    rows = explode_rows(messages, cut, keep, "text", "seg_no")
    return rows.select(
        *keep, (F.col("seg_no") - 1).alias("seg_no"), "text", (F.col("seg_no") == 1).alias("is_root")
    )


# fixed values: texts of the notices
_NOTICE_OK, _NOTICE_FAILED = "✅评论发送成功", "❌评论发送失败"
_COUNT_LABEL, _REASON_LABEL, _TIME_LABEL = "歌曲数量：", "原因：", "时间："


def notice_outbox(
    results: DataFrame, sent_at: Column, target_link: str = "https://www.bilibili.com/video/",
    source_link: str = "https://youtu.be/",
) -> DataFrame:
    """Texts to send for posted and failed videos; times in UTC+8."""
    at = F.date_format(F.from_utc_timestamp(sent_at, "+08:00"), "yyyy-MM-dd HH:mm:ss")
    link = F.concat(F.lit(target_link), F.col("video_id"))
    good = F.concat_ws(
        "\n", F.lit(_NOTICE_OK), link, F.concat(F.lit(source_link), F.col("yt_id")), at,
        F.concat(F.lit(_COUNT_LABEL), F.col("song_count").cast("string")),
    )
    bad = F.concat_ws(
        "\n", F.lit(_NOTICE_FAILED), link, F.concat(F.lit(_REASON_LABEL), F.col("error")),
        F.concat(F.lit(_TIME_LABEL), at),
    )
    told = results.where(F.col("status").isin("posted", "error"))
    return told.select(
        "video_id", "status", F.when(F.col("status") == "posted", good).otherwise(bad).alias("notice")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Videos per status."""
    return results.groupBy("run_id", "status").agg(F.count("*").alias("videos"))


def published_after(results: DataFrame, published: DataFrame) -> DataFrame:
    """Published keys after the run: the old ones, and what was posted or ignored."""
    done = results.where(F.col("status").isin("posted", "ignored")).select("video_id")
    return published.select("video_id").unionByName(done).distinct()


def close_run(
    results: DataFrame, published: DataFrame, videos: DataFrame, path: str | None = None,
    dry_run: bool = True, run_id: str | None = None, run_at: Column | None = None,
) -> dict[str, DataFrame]:
    """Tables of the finished run; with ``path`` they are written, one partition per run.

    A dry run writes its results and summary only, never the snapshot or published keys.
    Writing a run again replaces its own partition and nothing else, also where it has no rows
    any more. A partition of ``published`` holds the keys that no other run's has, so each key
    is stored once, however many runs there are.  Results are written first; summary and
    published keys are taken from what was written.
    """
    spark = results.sparkSession
    if run_id is None:
        first = results.select("run_id").first()
        run_id = first[0] if first else None
    if path and run_id is not None:
        write_run(results.drop("message"), f"{path}/video_results", run_id)
        stored = spark.read.schema(results.drop("message").schema).parquet(f"{path}/video_results")
        results = stored.where(F.col("run_id") == F.lit(run_id))
    total = F.sum("videos").over(Window.partitionBy("run_id"))  # a row per status
    tables = {
        "video_results": results.drop("message"),
        "runs": run_summary(results).withColumn("total", total).withColumn(
            "run_at", F.current_timestamp() if run_at is None else run_at
        ),
        "published": published_after(results, published),
        "video_snapshots": videos.drop("raw_part"),
    }
    if path and run_id is not None:
        write_run(tables["runs"], f"{path}/runs", run_id)
        if not dry_run:
            new = tables["published"].join(
                _stored_keys(spark, f"{path}/published", run_id), "video_id", "left_anti"
            )
            write_run(new, f"{path}/published", run_id)
            write_run(tables["video_snapshots"], f"{path}/video_snapshots", run_id)
    return tables


def _stored_keys(spark, path: str, run_id: str) -> DataFrame:
    """Published keys in the partitions of other runs; none while there is no table."""
    shape = "video_id string, run_id string"
    try:
        stored = spark.read.schema(shape).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], shape)
    return stored.where(F.col("run_id") != run_id).select("video_id").distinct()


def write_run(table: DataFrame, path: str, run_id: str) -> None:
    """Write a run's partition in place of what it was, also when it is empty now."""
    rest = table.drop("run_id")
    rest.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def scan_report(videos: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All videos, with a mark on those the snapshot does not hold."""
    known = snapshot.select("video_id").distinct().withColumn("_known", F.lit(True))
    return videos.join(known, "video_id", "left").select(
        *videos.columns, F.col("_known").isNull().alias("is_new")
    )
