"""Comments, payloads and state tables rendered from the star-schema tables.

The given tables hold no timelines, so texts are rendered from relational rows inside
Spark; the expected result of an operator is then a plain query on the base tables.
One order is one comment, its customer is the video, ``o_orderkey`` keeps the order of
comments.  An order has at most seven line numbers, so no rendered text is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = """
SELECT CAST(o_custkey AS BIGINT) AS video_id, l_orderkey AS comment_id,
       l_linenumber AS item_no,
       CAST(l_linenumber * 900 + min(l_partkey) % 60 AS INT) AS secs,
       min(p_name) AS song, min(s_name) AS artist
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
     JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
GROUP BY o_custkey, l_orderkey, l_linenumber
"""
# the same rows for the comparison query
ITEMS_SQL = ITEMS.format(lineitem="lineitem", orders="orders", part="part", supplier="supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track: ``video_id, comment_id, item_no, secs, song, artist``."""
    names = ("lineitem", "orders", "part", "supplier")
    tables = {n: table(spark, sf_dir, n) for n in names}
    # dealt by comment before the names come, rows stay where they are up to the text of a comment
    tables["lineitem"] = tables["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    ).repartition("l_orderkey")
    return spark.sql(ITEMS.format(**{n: "{" + n + "}" for n in names}), **tables)


def hms(secs: Column) -> Column:
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    hours = (secs / 3600).cast("int").cast("string")
    return F.concat(hours, F.lit(":"), two((secs % 3600) / 60), F.lit(":"), two(secs % 60))


def mmss(secs: Column) -> Column:
    """Short form below one hour."""
    return F.when(
        secs < 3600, F.format_string("%d:%02d", (secs / 60).cast("int"), secs % 60)
    ).otherwise(hms(secs))


_WIDE = ("0123456789:", "０１２３４５６７８９：")


STYLES = 15
# styles 0-9 render what a viewer writes; 10-14 spread one entry over several lines
CHAT_STYLES = tuple(range(10))
MERGE_STYLES = (0, 2, 10, 11, 12, 13, 14)


def styled_lines(style: Column) -> Column:
    """Text of one item in one of the styles."""
    t, s, a, n = hms(F.col("secs")), F.col("song"), F.col("artist"), F.col("item_no")
    end = hms(F.col("secs") + 180)
    num = n.cast("string")
    base = F.concat(t, F.lit(" "), F.format_string("%02d. ", n), s, F.lit(" / "), a)
    plain = F.concat(s, F.lit(" / "), a)
    lit, cat = F.lit, F.concat
    return (
        F.when(style == 0, base)
        .when(style == 1, cat(num, lit(". "), t, lit(" "), s, lit(" - "), a))
        .when(style == 2, cat(t, lit("\n"), plain))
        .when(style == 3, cat(F.translate(t, *_WIDE), lit(" "), plain))
        .when(style == 4, cat(t, lit(" "), plain))
        .when(style == 5, cat(lit("『"), t, lit("』 "), s, lit("／"), a))
        .when(style == 6, cat(t, lit(" "), s, lit(" (練習) / "), a, lit("さん")))
        .when(style == 7, cat(base, lit("\n"), base))
        .when(style == 8, F.when(n == 1, cat(lit("so good at "), t, lit(" wow")))
              .otherwise(lit("nice song")))
        .when(style == 9, cat(t, lit(" 雑談")))
        .when(style == 10, cat(t, lit(" ;\n"), plain))
        .when(style == 11, cat(num, lit(".\n"), t, lit(" ~ "), end, lit("\n(Romaji Note)\n"), plain))
        .when(style == 12, cat(num, lit("曲目："), plain, lit("\n"), t, lit("~"), end))
        .when(style == 13, cat(num, lit("曲目 "), t, lit("~"), end, lit("「"), s, lit("／"), a, lit("」")))
        .otherwise(cat(plain, lit("\n▶ "), t))
    )


ITEM = ("item_no", "secs", "song", "artist")


def as_comments(tracks: DataFrame, line: Column, with_items: bool = False) -> DataFrame:
    """Join the item lines of each comment, in item order; the items may go along as an array."""
    also = ITEM[1:] if with_items else ()
    grouped = tracks.groupBy("video_id", "comment_id").agg(
        F.sort_array(F.collect_list(F.struct("item_no", line.alias("line"), *also))).alias("_p")
    )
    items = [F.transform("_p", lambda p: F.struct(*[p[c].alias(c) for c in ITEM])).alias("items")]
    return grouped.select(
        "video_id", F.lit("comment").alias("source"), F.col("comment_id").alias("source_pos"),
        "comment_id", F.array_join(F.transform("_p", lambda p: p["line"]), "\n").alias("text"),
        *(items if with_items else []),
    )


def style_of(styles: tuple[int, ...]) -> Column:
    return F.element_at(
        F.array(*[F.lit(s) for s in styles]), (F.col("comment_id") % len(styles)).cast("int") + 1
    )


def style_sql(styles: tuple[int, ...], key: str = "comment_id") -> str:
    return f"(CAST([{', '.join(map(str, styles))}] AS INT[]))[{key} % {len(styles)} + 1]"


def comments(spark: SparkSession, sf_dir: str, styles=CHAT_STYLES, with_items: bool = False) -> DataFrame:
    """Comments of all orders; the styles alternate over ``comment_id``."""
    built = as_comments(items(spark, sf_dir), styled_lines(style_of(styles)), with_items)
    # style 4 puts all items on one line
    flat = F.when(style_of(styles) == 4, F.regexp_replace("text", "\n", " "))
    return built.withColumn("text", F.coalesce(flat, F.col("text")))


def entries(tracks: DataFrame) -> DataFrame:
    """One entry per line number of a video (at most seven), from all its ``items``."""
    return tracks.groupBy("video_id", "item_no").agg(
        F.min("secs").alias("secs"), F.min("song").alias("song"), F.min("artist").alias("artist")
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One description per video with one line per entry."""
    return described(entries(items(spark, sf_dir)))


def described(rows: DataFrame) -> DataFrame:
    """Descriptions that list the ``entries``."""
    rows = rows.withColumn("comment_id", F.lit(-1).cast("bigint"))
    built = as_comments(rows, styled_lines(F.lit(0)))
    return built.withColumn("source", F.lit("description")).withColumn(
        "source_pos", F.lit(2**62).cast("bigint")
    )


MIX = 32


def mix_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lists: 32 neighbouring orders make one list of up to 224 entries."""
    return items(spark, sf_dir).select(
        F.floor(F.col("comment_id") / MIX).alias("video_id"),
        F.lit(0).cast("bigint").alias("comment_id"),
        ((F.col("comment_id") % MIX) * 7 + F.col("item_no")).cast("int").alias("item_no"),
        "secs", "song", "artist",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video per customer that has an order."""
    last = (
        table(spark, sf_dir, "orders").groupBy("o_custkey")
        .agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("part_date"))
    )
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    joined = last.join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey")
    )
    vid = F.col("c_custkey")
    yt = F.when(vid % 89 == 0, F.lit("")).otherwise(F.format_string("yt%09d", vid))
    return joined.select(
        F.col("c_mktsegment").alias("collection"), F.col("n_name").alias("section"),
        vid.cast("string").alias("video_id"), F.col("c_name").alias("title"), "part_date",
        yt.alias("yt_id"),
        F.when(
            vid % 89 == 0, F.col("c_name")
        ).otherwise(F.concat(F.lit("["), "part_date", F.lit("]["), yt, F.lit("]"), "c_name"))
        .alias("raw_part"),
    )


VIDEOS_SQL = """
SELECT c_mktsegment AS collection, n_name AS section, CAST(c_custkey AS VARCHAR) AS video_id,
       c_name AS title, strftime(max(o_orderdate), '%Y-%m-%d') AS part_date,
       CASE WHEN c_custkey % 89 = 0 THEN '' ELSE printf('yt%09d', c_custkey) END AS yt_id,
       c_custkey AS vid
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY c_mktsegment, n_name, c_custkey, c_name
"""


def snapshot(all_videos: DataFrame) -> DataFrame:
    """Videos known from the previous run."""
    return all_videos.where(F.col("video_id").cast("bigint") % 5 != 0).drop("raw_part")


def published(all_videos: DataFrame) -> DataFrame:
    return all_videos.where(F.col("video_id").cast("bigint") % 3 == 0).select("video_id")
