"""Streaming queries: inputs are written from the tables, the run ends when all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..session import shared_dir, written
from ..streaming import streams
from . import query
from .lines import HMS, I, agg


def _payload_files(spark, sf, src):
    """Payloads by month of the order; of the orders by 13 one is cut off and one is no text at all."""
    c = fx.comments(spark, sf, styles=(0,))
    said = F.struct(
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.struct(F.col("text").alias("content")).alias("content")).alias("properties")
                ).alias("commentEntityPayload")
            )
        ).alias("mutations")
    )
    dates = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("comment_id"), F.month("o_orderdate").alias("month")
    )
    whole = F.to_json(said)
    json = F.when(F.col("comment_id") % 13 == 5, F.expr("left(json, length(json) - 2)")).otherwise(F.col("json"))
    raw = c.join(dates, "comment_id").withColumn("json", whole).select(
        F.format_string("yt%09d", "comment_id").alias("yt_id"), F.lit("comments").alias("part"),
        F.lit(0).alias("part_pos"), json.alias("json"), "month",
    )
    raw.repartition("month").drop("month").write.parquet(src)


def _ingested(spark, sf):
    src, out, ckpt = (shared_dir(spark, f"tracks-{n}") for n in ("in", "out", "ckpt"))
    _payload_files(spark, sf, src)
    return streams.stream_tracks(spark, src, out, ckpt, files_per_batch=3)


@query(
    "r01_stream_tracks",
    f"""SELECT printf('yt%09d', comment_id) AS yt_id, item_no, secs, song, artist FROM (
          SELECT *, count(*) OVER (PARTITION BY comment_id) AS n FROM ({I})) WHERE n >= 2 AND comment_id % 13 <> 5""",
)
def r01(spark, sf):
    """Payload files by month of the order, each read once; broken payloads give no tracks."""
    found, _ = _ingested(spark, sf)
    return found.select("yt_id", F.col("num").alias("item_no"), "secs", "song", "artist")


@query(
    "r01_stream_errors",
    f"""SELECT printf('yt%09d', comment_id) AS yt_id, 'comments' AS part, 0 AS part_pos, 'not valid JSON' AS error
        FROM ({I}) WHERE comment_id % 13 = 5 GROUP BY comment_id""",
)
def r01_errors(spark, sf):
    """Broken payloads of all batches."""
    return _ingested(spark, sf)[1].select("yt_id", "part", "part_pos", "error")


@query(
    "r02_stream_upgrades",
    f"""WITH v AS (SELECT video_id, comment_id AS version, CAST(count(*) AS INT) AS n FROM ({I}) GROUP BY 1, 2),
             a AS (SELECT video_id, min(version) AS v1 FROM v WHERE n >= 1 GROUP BY 1),
             f AS (SELECT v.* FROM v JOIN a ON v.video_id = a.video_id AND version = v1),
             s AS (SELECT v.video_id, min(v.version) AS v2 FROM v JOIN f ON v.video_id = f.video_id
                   WHERE f.n < 3 AND v.version > f.version AND v.n >= f.n + 3 GROUP BY 1)
        SELECT video_id, version, n AS song_count FROM f UNION ALL
        SELECT v.video_id, version, n FROM v JOIN s ON v.video_id = s.video_id AND version = v2""",
)
def r02(spark, sf):
    """Comments of a video in order are the versions of its list."""
    counts = fx.items(spark, sf).groupBy("video_id", F.col("comment_id").alias("version")).agg(
        F.count("*").cast("int").alias("song_count")
    )
    counts = written(counts, "versions")
    src, out, ckpt = (shared_dir(spark, f"upgrades-{n}") for n in ("in", "out", "ckpt"))
    # versions arrive in three deliveries, so the published count is read back from the state
    bounds = counts.agg(F.min("version").alias("a"), F.max("version").alias("b")).first()
    third = F.floor(3 * (F.col("version") - (bounds["a"] or 0)) / ((bounds["b"] or 0) - (bounds["a"] or 0) + 1))
    for k in range(3):
        counts.where(third == k).repartition(4, "video_id").write.mode("append").parquet(src)
    schema = streams.upgrade_schema(counts.schema["video_id"].dataType.simpleString())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(src)
    return streams.stream_upgrades(stream, out, ckpt)


def _copies(spark, sf):
    """Lists with one title order, in two writings, at the time of their order."""
    shout = F.when(F.col("comment_id") % 2 == 0, F.upper("song")).otherwise(F.col("song"))
    line = F.concat(F.format_string("%02d. ", "item_no"), shout)
    c = fx.as_comments(fx.items(spark, sf), line)
    dates = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("comment_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    return c.join(dates, "comment_id").select("video_id", "comment_id", F.col("text").alias("message"), "ts")


@query(
    "r03_stream_dedupe",
    f"""SELECT video_id, sig, count(*) AS kept FROM (SELECT DISTINCT video_id,
          md5({agg('song')}) AS sig FROM ({I}) GROUP BY video_id, comment_id) GROUP BY 1, 2""",
)
def r03(spark, sf):
    """Lists with one title order count once per video, whatever their writing."""
    rows = _copies(spark, sf).drop("comment_id")
    src, out, ckpt = (shared_dir(spark, f"dedupe-{n}") for n in ("in", "out", "ckpt"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    once = streams.stream_dedupe(stream, delay="36500 days")
    streams.run_available(once.writeStream.format("parquet").option("path", out), ckpt)
    plain = F.lower(F.regexp_replace("message", r"(?m)^[0-9]+\. ", ""))
    kept = spark.read.schema(once.schema).parquet(out)
    return kept.groupBy("video_id", F.md5(plain).alias("sig")).agg(F.count("*").alias("kept"))


#: Days of a batch.
_SPAN = 600
_LIST_DAYS = f"""
  SELECT video_id, comment_id, {agg('song')} AS body, o_orderdate::DATE AS day
  FROM ({I}) JOIN orders ON o_orderkey = comment_id GROUP BY video_id, comment_id, o_orderdate
"""


@query(
    "r03_stream_dedupe_bounded",
    f"""WITH m AS (SELECT *, (day - min(day) OVER ()) AS d FROM ({_LIST_DAYS}))
        SELECT video_id, md5(body) AS sig, count(*) AS kept FROM (
          SELECT DISTINCT video_id, body, d // {_SPAN} AS batch FROM m WHERE d % {_SPAN} < {_SPAN - 10})
        GROUP BY 1, 2""",
)
def r03_bounded(spark, sf):
    """Batches of 600 days under a bound of one day: a copy in a later batch is kept again.

    Ten days between batches hold only a mark that moves the watermark past all that was kept
    before. Every third list comes again half a day later in its batch and goes; every fifth
    comes once more two batches later with its old time, behind the watermark, and is late.
    """
    rows = _copies(spark, sf)
    low = rows.agg(F.min("ts").alias("low")).first()["low"]
    at = F.datediff("ts", F.lit(low))
    rows = rows.withColumn("batch", F.floor(at / _SPAN).cast("int")).where(at % _SPAN < _SPAN - 10)
    again = rows.where("comment_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    late = rows.where("comment_id % 5 = 0").withColumn("batch", F.col("batch") + 2)
    marks = rows.select("batch").distinct().select(
        F.lit(-1).cast("bigint").alias("video_id"), F.lit(-1).cast("bigint").alias("comment_id"),
        F.concat(F.lit("mark "), F.col("batch").cast("string")).alias("message"),
        F.timestamp_add("DAY", F.col("batch") * _SPAN + _SPAN - 1, F.lit(low)).alias("ts"), "batch",
    )
    sent = written(rows.unionByName(again).unionByName(late).unionByName(marks), "copies")
    src, out, ckpt = (shared_dir(spark, f"bounded-{n}") for n in ("in", "out", "ckpt"))
    batches = sorted(r["batch"] for r in sent.select("batch").distinct().collect())
    for b in batches:
        sent.where(F.col("batch") == b).write.mode("append").parquet(src)
        stream = spark.readStream.schema(sent.schema).parquet(src)
        once = streams.stream_dedupe(stream, delay="1 day")
        streams.run_available(once.writeStream.format("parquet").option("path", out), ckpt)
    plain = F.lower(F.regexp_replace("message", r"(?m)^[0-9]+\. ", ""))
    kept = spark.read.schema(once.schema).parquet(out).where("video_id >= 0")
    return kept.groupBy("video_id", F.md5(plain).alias("sig")).agg(F.count("*").alias("kept"))


@query(
    "r04_stream_status",
    """SELECT date_trunc('day', ts) AS window_start, 'c' || (user_id % 5) AS collection,
              event_type AS status, count(*) AS videos FROM events GROUP BY 1, 2, 3""",
)
def r04(spark, sf):
    """Five deliveries, rows of a day in several of them, the log merged every second batch."""
    events = fx.table(spark, sf, "events")
    src, out, ckpt = (shared_dir(spark, f"status-{n}") for n in ("in", "out", "ckpt"))
    keys = ["window_start", "collection", "status"]
    part = F.pmod(F.xxhash64(*events.columns), F.lit(5))
    for k in range(5):
        events.where(part == k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        results = stream.select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"),
            F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("collection"),
        )
        counts = streams.stream_status(results, delay="60 days")
        latest = streams.upsert_log(counts, keys, "videos", out, ckpt, merge_every=2)
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
