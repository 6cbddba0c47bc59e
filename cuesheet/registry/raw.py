"""Queries for raw payloads: the JSON is rendered from the base tables inside Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..sources import bronze
from ..session import shared_dir
from . import query
from .lines import HMS, I, agg

V = fx.VIDEOS_SQL


def collection_payloads(spark, sf):
    """One payload per market segment, nation and hundred customers."""
    v = fx.videos(spark, sf).withColumn("seq", F.floor(F.col("video_id").cast("bigint") / 100).cast("int"))
    episode = F.struct(
        F.col("video_id").alias("bvid"), "title", F.struct(F.col("raw_part").alias("part")).alias("page")
    )
    pages = v.groupBy("collection", "section", "seq").agg(F.collect_list(episode).alias("episodes"))
    season = F.struct(F.array(F.struct(F.col("section").alias("title"), "episodes")).alias("sections"))
    return pages.select(
        F.lower("collection").alias("source"), "seq",
        F.to_json(
            F.struct(F.lit(0).alias("code"), F.struct(season.alias("ugc_season")).alias("data"))
        ).alias("json"),
    )


@query(
    "s01_load_videos",
    f"""SELECT CASE WHEN collection = 'BUILDING' THEN 'Builders' ELSE 'collection-' || lower(collection) END
        AS collection, section, video_id, title, CASE WHEN yt_id = '' THEN '' ELSE part_date END AS part_date,
        yt_id FROM ({V})""",
)
def s01(spark, sf):
    v = bronze.load_videos(collection_payloads(spark, sf), {"building": "Builders"})
    return v.drop("raw_part", "pos")


@query(
    "s02_extract_embedded_json",
    """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN 'key' || page_id ELSE '' END AS api_key,
              CASE WHEN page_id % 2 = 0 THEN '2.1' ELSE '2.20260601.00.00' END AS client_version,
              CASE WHEN page_id % 5 IN (0, 1) THEN page_id END AS id,
              CASE WHEN page_id % 5 IN (0, 1) THEN md5(url) END AS digest,
              CASE page_id % 5 WHEN 2 THEN 'ytInitialData object start not found'
                   WHEN 3 THEN 'ytInitialData object end not found' WHEN 4 THEN 'ytInitialData not found'
              END AS error FROM pages""",
)
def s02(spark, sf):
    """Braces and quotes inside strings must not end the object."""
    pages = fx.table(spark, sf, "pages")
    kind = F.col("page_id") % 5
    body = F.to_json(
        F.struct(
            F.col("page_id").alias("id"), F.lit('a } " \\ { b').alias("odd"),
            F.struct(F.col("url").alias("u")).alias("in"), F.col("html").alias("page"),
        )
    )
    key = F.concat(F.lit('"INNERTUBE_API_KEY":"key'), F.col("page_id").cast("string"), F.lit('"'))
    version = F.when(F.col("page_id") % 2 == 0, F.lit('"INNERTUBE_CLIENT_VERSION":"2.1"')).otherwise(F.lit(""))
    script = (
        F.when(kind == 2, F.concat(key, F.lit(" ytInitialData = null")))
        .when(kind == 3, F.concat(key, F.lit(' ytInitialData = {"a": {"b": "}"'), F.lit(" ")))
        .when(kind == 4, F.lit(""))
        .otherwise(F.concat(key, F.lit(" var ytInitialData = "), body, F.lit("; x = {};")))
    )
    clean = F.regexp_replace("html", "ytInitialData|INNERTUBE", "")
    html = F.concat(clean, F.lit("<script>"), version, script)
    cut = bronze.extract_embedded_json(pages.select("page_id", html.alias("html")), "ytInitialData")
    parsed = F.from_json("json", "id BIGINT, in STRUCT<u: STRING>")
    return cut.select(
        "page_id", "api_key", "client_version", parsed["id"].alias("id"),
        F.md5(parsed["in"]["u"]).alias("digest"), "error",
    )


def raw_payloads(spark, sf):
    """Three payloads per order: first page, comments, one reply page.

    The reply part of an order holds its items with an odd number.
    """
    rows = fx.items(spark, sf)
    # only the names travel; the trees are built around them in each payload
    packed = rows.groupBy("comment_id").agg(
        F.array_sort(F.collect_list(F.struct("item_no", fx.hms(F.col("secs")).alias("at"), "song", "artist"))).alias("e")
    )
    odd = lambda x: x["item_no"] % 2 == 1
    said = lambda x: F.struct(
        F.struct(
            F.struct(
                F.struct(F.struct(F.concat(F.lit("c"), x["item_no"].cast("string"), F.lit(" "), x["song"]).alias("content")).alias("content")).alias("properties")
            ).alias("commentEntityPayload"),
        ).alias("payload"),
        F.struct(
            F.array(
                F.struct(
                    F.struct(
                        F.struct(
                            F.struct(
                                F.concat_ws("-", F.lit("tok"), F.col("comment_id").cast("string"), x["item_no"].cast("string")).alias("token")
                            ).alias("continuationCommand")
                        ).alias("continuationEndpoint")
                    ).alias("continuationItemRenderer")
                )
            ).alias("contents")
        ).alias("commentRepliesRenderer"),
    )
    runs = lambda x: F.struct(
        F.array(
            F.struct(x["at"].alias("text")),
            F.struct(F.concat(F.lit(" "), x["song"], F.lit(" / "), x["artist"]).alias("text")),
        ).alias("runs")
    )
    bare = lambda x: F.struct(x["at"].alias("simpleText"))
    yt = F.format_string("yt%09d", "comment_id")
    endpoint = lambda tok, note: F.struct(
        F.struct(F.struct(tok.alias("token")).alias("continuationCommand")).alias("continuationEndpoint"),
        F.lit(note).alias("label"),
    )
    initial = F.to_json(
        F.struct(
            F.struct(
                F.transform("e", runs).alias("z"),
                F.transform("e", bare).alias("b"),
                F.transform("e", runs).alias("a"),
            ).alias("z_first"),
            F.array(
                endpoint(F.concat(F.lit("other"), F.col("comment_id").cast("string")), "next"),
                endpoint(F.concat(F.lit("main"), F.col("comment_id").cast("string")), "Comments"),
            ).alias("tabs"),
        )
    )
    part = lambda keep: F.to_json(F.struct(F.transform(F.filter("e", keep), said).alias("mutations")))
    # parts first, so that a reader of one part renders no other
    parts = F.array(*[F.lit(p) for p in ("initial", "comments", "reply")])
    json = (
        F.when(F.col("part") == "initial", initial)
        .when(F.col("part") == "comments", part(lambda x: ~odd(x)))
        .otherwise(part(odd))
    )
    return packed.select("comment_id", "e", F.explode(parts).alias("part")).select(
        "comment_id", yt.alias("yt_id"), "part", F.lit(0).alias("part_pos"), json.alias("json")
    )


@query(
    "s03_extract_comments",
    f"""SELECT printf('yt%09d', comment_id) AS yt_id, row_number() OVER (PARTITION BY comment_id
               ORDER BY item_no % 2, item_no) AS comment_pos, 'c' || item_no || ' ' || song AS text FROM ({I})""",
)
def s03(spark, sf):
    return bronze.extract_comments(raw_payloads(spark, sf))


@query(
    "s04_extract_descriptions",
    f"""SELECT printf('yt%09d', comment_id) AS yt_id, string_agg({HMS} || ' ' || song || ' / ' || artist,
               chr(10) || chr(10) ORDER BY item_no) AS description FROM ({I}) GROUP BY comment_id""",
)
def s04(spark, sf):
    """Bare times are no description, and a repeated text counts once."""
    return bronze.extract_descriptions(raw_payloads(spark, sf))


@query(
    "s05_crawl_frontier",
    f"""WITH t AS (SELECT comment_id, item_no, row_number() OVER (PARTITION BY comment_id
               ORDER BY item_no % 2, item_no) AS pos FROM ({I}) WHERE item_no <> 2)
        SELECT printf('yt%09d', comment_id) AS yt_id, 'comments' AS kind, 'main' || comment_id AS token,
               1 AS pos FROM (SELECT DISTINCT comment_id FROM ({I})) UNION ALL
        SELECT printf('yt%09d', comment_id), 'reply', 'tok-' || comment_id || '-' || item_no,
               CAST(pos AS INT) FROM t JOIN (SELECT comment_id, count(*) FILTER (item_no = 2) AS used
               FROM ({I}) GROUP BY 1) USING (comment_id) WHERE pos <= 3 - used""",
)
def s05(spark, sf):
    """The token of item 2 was fetched before; at most three pages per video."""
    seen = fx.items(spark, sf).where(F.col("item_no") == 2).select(
        F.format_string("yt%09d", "comment_id").alias("yt_id"),
        F.concat(F.lit("tok-"), F.col("comment_id").cast("string"), F.lit("-2")).alias("token"),
    )
    return bronze.crawl_frontier(raw_payloads(spark, sf), seen, cap=3)


@query(
    "s06_pick_rendition",
    f"""SELECT comment_id, CASE WHEN comment_id % 2 = 0 THEN 'dom' ELSE 'full' END AS kind,
               {agg(HMS + " || ' ' || song || ' / ' || artist")} AS text FROM ({I}) GROUP BY comment_id""",
)
def s06(spark, sf):
    """A cut text, the text on one line, and the full text; ties go to the first."""
    flat = fx.comments(spark, sf, styles=(4,))
    even = F.col("comment_id") % 2 == 0
    full = F.regexp_replace("text", r" (\d{1,2}:\d{2}:\d{2})", "\n$1")
    cut = F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))
    kinds = F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("visible").alias("kind"), cut.alias("text")),
        F.struct(F.lit(2).alias("pos"), F.when(even, "dom").otherwise("full").alias("kind"),
                 F.when(even, F.col("text")).otherwise(full).alias("text")),
        F.struct(F.lit(3).alias("pos"), F.lit("late").alias("kind"), full.alias("text")),
        F.struct(F.lit(4).alias("pos"), F.lit("empty").alias("kind"), F.lit(" \n").alias("text")),
    )
    many = flat.select("video_id", "comment_id", F.explode(kinds).alias("k")).select(
        "video_id", "comment_id", "k.*"
    )
    return bronze.pick_rendition(many).select("comment_id", "kind", "text")


@query(
    "s07_latest_raw",
    """SELECT printf('yt%09d', o_custkey) AS yt_id, max(o_orderdate) AS fetched_at,
              arg_max('{"k":' || o_orderkey || '}', (o_orderdate, '{"k":' || o_orderkey || '}')) AS json
       FROM orders GROUP BY o_custkey""",
)
def s07(spark, sf):
    o = fx.table(spark, sf, "orders")
    raw = o.select(
        F.format_string("yt%09d", "o_custkey").alias("yt_id"), F.col("o_orderdate").alias("fetched_at"),
        F.lit("initial").alias("part"), F.lit(0).alias("part_pos"),
        F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("json"),
    )
    return bronze.latest_raw(raw).select("yt_id", "fetched_at", "json")


@query(
    "s07_read_latest",
    """SELECT printf('yt%09d', o_custkey) AS yt_id, max(t) AS fetched_at, arg_max('{"k":' || o_orderkey || '}', t) AS json
       FROM (SELECT *, o_orderdate::TIMESTAMP + to_microseconds(o_orderkey) AS t FROM orders)
       WHERE o_custkey % 10 = 7 GROUP BY o_custkey""",
)
def s07_read(spark, sf):
    """The cache as it was appended twice, read for a tenth of the videos."""
    o = fx.table(spark, sf, "orders")
    raw = o.select(
        F.format_string("yt%09d", "o_custkey").alias("yt_id"), F.lit("initial").alias("part"),
        F.lit(0).alias("part_pos"), F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("json"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("fetched_at"),
        "o_orderkey",
    )
    path = shared_dir(spark, "raw-cache")
    for k in range(2):
        bronze.append_raw(raw.where(F.col("o_orderkey") % 2 == k).drop("o_orderkey").coalesce(1), path, buckets=16)
    wanted = o.where("o_custkey % 10 = 7").select(F.format_string("yt%09d", "o_custkey").alias("yt_id"))
    found = bronze.read_latest(spark, path, wanted, buckets=16)
    return found.select("yt_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "json")


@query(
    "s08_load_published",
    """SELECT CAST(o_custkey AS VARCHAR) AS video_id, CAST(o_orderkey AS VARCHAR) AS rpid,
              CAST(o_custkey % 7 AS VARCHAR) AS mid, o_orderpriority AS message, rn AS seq FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn FROM orders)
       WHERE rn <= CASE WHEN o_custkey % 4 = 1 THEN 1 ELSE 3 END""",
)
def s08(spark, sf):
    """One comment per page; the second page of every fourth video is an error."""
    from pyspark.sql import Window

    o = fx.table(spark, sf, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    reply = F.struct(
        F.col("o_orderkey").alias("rpid"), F.struct((F.col("o_custkey") % 7).alias("mid")).alias("member"),
        F.struct(F.col("o_orderpriority").alias("message")).alias("content"),
    )
    bad = (F.col("o_custkey") % 4 == 1) & (F.col("seq") == 2)
    pages = o.withColumn("seq", nth).select(
        F.col("o_custkey").cast("string").alias("source"), "seq",
        F.to_json(
            F.struct(
                F.when(bad, 12002).otherwise(0).alias("code"),
                F.struct(F.array(reply).alias("replies")).alias("data"),
            )
        ).alias("json"),
    )
    found = bronze.load_published(pages, max_pages=3)
    return found.select(
        "video_id", "rpid", "mid", "message", (F.col("pos") / 1000).cast("int").alias("seq")
    )
