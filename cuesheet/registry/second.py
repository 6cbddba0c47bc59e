"""Queries for the second extraction and the rule loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.titles import DEFAULT_RULES
from ..operators import rules, second_pass, sets, text, tracks
from ..session import shared_dir
from . import query
from .lines import HMS, I, TITLE_FORMS, _written_titles, agg
from .lists import setlists_of


@query(
    "a01_build_requests",
    f"""WITH c AS (SELECT video_id, comment_id, {agg(HMS + " || printf(' %02d. ', item_no) || song || ' / ' || artist")}
               AS t FROM ({I}) GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT video_id, 0 AS part_no, 'List:' || chr(10) || string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10)
               ORDER BY comment_id) AS request, count(*) AS n_comments FROM c GROUP BY video_id""",
)
def a01(spark, sf):
    c = text.classify_songlist_comments(fx.comments(spark, sf, styles=(0,)))
    return second_pass.build_requests(c.where("is_songlist"), "List:")


@query(
    "a01_request_files",
    f"""WITH c AS (SELECT video_id, comment_id, {agg(HMS + " || printf(' %02d. ', item_no) || song || ' / ' || artist")}
               AS t FROM ({I}) GROUP BY 1, 2 HAVING count(*) >= 2),
             p AS (SELECT *, coalesce(sum(length(t) + 7) OVER (PARTITION BY video_id ORDER BY comment_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 400 AS part FROM c)
        SELECT video_id || '-' || part::BIGINT AS custom_id, 'm' AS model, 'Be exact.' AS instruction, 8000 AS most,
               'List:' || chr(10) || string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY comment_id) AS said
        FROM p GROUP BY video_id, part""",
)
def a01_files(spark, sf):
    """Requests of about 400 characters in JSON lines, read back."""
    c = text.classify_songlist_comments(fx.comments(spark, sf, styles=(0,))).where("is_songlist")
    lines = second_pass.request_lines(c, "List:", "m", "Be exact.", most=400)
    found = second_pass.write_requests(lines, shared_dir(spark, "request-files"), file_chars=100_000)
    r = F.from_json("value", second_pass.REQUEST_LINE)
    return found.select(
        r["custom_id"].alias("custom_id"), r["body"]["model"].alias("model"),
        r["body"]["input"][0]["content"].alias("instruction"), r["body"]["max_output_tokens"].alias("most"),
        r["body"]["input"][1]["content"].alias("said"),
    )


def _model_items(spark, sf):
    """What a second extraction says: every fifth item missing, every seventh in capitals."""
    rows = fx.items(spark, sf).where(F.col("item_no") % 5 != 0)
    return rows.withColumn(
        "song", F.when(F.col("item_no") % 7 == 0, F.upper("song")).otherwise(F.col("song"))
    )


def responses(spark, sf):
    """Model output as JSON in two shapes; one in eleven did not finish."""
    line = F.concat(
        fx.hms(F.col("secs")), F.lit(" "), F.format_string("%02d. ", "item_no"), "song",
        F.lit(" - "), F.when(F.col("item_no") == 6, F.lit("不明")).otherwise(F.col("artist")),
    )
    c = fx.as_comments(_model_items(spark, sf), line)
    done = F.when(F.col("comment_id") % 11 == 0, "incomplete").otherwise("completed")
    block = F.to_json(
        F.struct(
            done.alias("status"),
            F.array(
                F.struct(F.lit("reasoning").alias("type"), F.array().cast("array<struct<type:string,text:string>>").alias("content")),
                F.struct(
                    F.lit("message").alias("type"),
                    F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))).alias("content"),
                ),
            ).alias("output"),
        )
    )
    choice = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    )
    parts = F.to_json(
        F.struct(
            F.array(
                F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")).alias("message"))
            ).alias("choices")
        )
    )
    shape = F.col("comment_id") % 3
    return c.select(
        F.col("video_id"), "comment_id",
        F.when(F.col("comment_id") % 11 == 0, block).when(shape == 0, block).when(shape == 1, choice)
        .otherwise(parts).alias("json"),
    )


MODEL_SQL = f"""
  SELECT video_id, comment_id, item_no, secs, artist,
         CASE WHEN item_no % 7 = 0 THEN upper(song) ELSE song END AS song
  FROM ({I}) WHERE item_no % 5 <> 0
"""
_TEXT_SQL = agg(
    HMS + " || printf(' %02d. ', item_no) || song || ' - ' || "
    "CASE WHEN item_no = 6 THEN '不明' ELSE artist END"
)


@query(
    "a02_extract_response_text",
    f"""SELECT comment_id, CASE WHEN comment_id % 11 <> 0 THEN {_TEXT_SQL} END AS response
        FROM ({MODEL_SQL}) GROUP BY comment_id""",
)
def a02(spark, sf):
    return second_pass.extract_response_text(responses(spark, sf)).select("comment_id", "response")


@query(
    "a03_parse_response_tracks",
    f"""SELECT comment_id, item_no AS num, secs, song, CASE WHEN item_no = 6 THEN '' ELSE artist END
        AS artist FROM ({MODEL_SQL}) WHERE comment_id % 11 <> 0""",
)
def a03(spark, sf):
    parsed = second_pass.parse_response_tracks(
        second_pass.extract_response_text(responses(spark, sf))
    )
    return tracks.explode_tracks(parsed).select("comment_id", "num", "secs", "song", "artist")


@query(
    "a04_flag_sentinel",
    "SELECT o_orderkey AS comment_id, o_orderkey % 3 <> 0 AS is_sentinel FROM orders",
)
def a04(spark, sf):
    kind = F.col("o_orderkey") % 3
    said = F.when(kind == 1, "请提供歌手信息后再处理。\n").when(kind == 2, " 请提供 歌名信息后再处理。").otherwise(
        F.concat(F.lit("01. "), "o_orderpriority")
    )
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("comment_id"), said.alias("response"))
    return second_pass.flag_sentinel(rows).drop("response")


def _pairs(spark, sf, key="comment_id"):
    model = setlists_of(_model_items(spark, sf).withColumn("num", F.col("item_no")))
    source = setlists_of(fx.items(spark, sf).withColumn("num", F.col("item_no")))
    return second_pass.pair_lists(model, source, key)


_COUNTS = f"""
  SELECT comment_id, count(*) AS s, count(*) FILTER (item_no % 5 <> 0) AS m, max(item_no) AS top,
         string_agg(song || ' - ' || artist, chr(10) ORDER BY item_no) AS said,
         string_agg(CASE WHEN item_no % 7 = 0 THEN upper(song) ELSE song END || ' - ' || artist, chr(10)
                    ORDER BY item_no) FILTER (item_no % 5 <> 0) AS told
  FROM ({I}) GROUP BY comment_id
"""


def content(tracks="tracks"):
    """Titles and performers of a list, one entry a line."""
    return F.array_join(F.transform(tracks, lambda t: F.concat_ws(" - ", t["song"], t["artist"])), "\n")




@query(
    "a05_reconcile",
    f"""SELECT comment_id, item_no AS num, secs, CASE WHEN s = m THEN i.song WHEN item_no % 7 = 0
               THEN upper(i.song) ELSE i.song END AS song, artist,
               CASE WHEN s <> m THEN 'model:counts_differ' WHEN item_no % 7 = 0 THEN 'source:default'
               ELSE 'model:equal' END AS song_reason,
               CASE WHEN s <> m THEN 'model:counts_differ' ELSE 'model:equal' END AS artist_reason
        FROM ({I}) i JOIN ({_COUNTS}) c USING (comment_id) WHERE item_no % 5 <> 0""",
)
def a05(spark, sf):
    merged = second_pass.reconcile(_pairs(spark, sf))
    return merged.select(
        "comment_id", "num", "secs", "song", "artist", "song_reason", "artist_reason"
    )


@query(
    "a06_choose_pipeline",
    f"""SELECT comment_id, CASE WHEN m > 0 THEN 'model' ELSE 'source' END AS chosen,
               CAST(CASE WHEN m > 0 THEN m ELSE s END AS INT) AS n, CASE WHEN m > 0 THEN told ELSE said END AS content
        FROM ({_COUNTS})""",
)
def a06(spark, sf):
    chosen = second_pass.choose_result(_pairs(spark, sf), "pipeline")
    return chosen.select("comment_id", "chosen", F.size("tracks").alias("n"), content().alias("content"))


@query(
    "a06_choose_strict",
    f"""SELECT comment_id, CASE WHEN top = s AND m <> s THEN 'source' WHEN m = s THEN 'merged'
               WHEN m > 0 AND s > m THEN 'source' ELSE 'source' END AS chosen, CAST(s AS INT) AS n,
               said AS content
        FROM ({_COUNTS})""",
)
def a06_strict(spark, sf):
    chosen = second_pass.choose_result(_pairs(spark, sf), "strict")
    return chosen.select("comment_id", "chosen", F.size("tracks").alias("n"), content().alias("content"))


@query(
    "a06_second_pass",
    f"""SELECT comment_id, 'local' AS chosen, CAST(count(*) AS INT) AS n FROM ({MODEL_SQL})
        WHERE comment_id % 11 <> 0 GROUP BY comment_id
        UNION ALL SELECT comment_id, 'text', 0 FROM ({MODEL_SQL}) WHERE comment_id % 11 = 0
        GROUP BY comment_id""",
)
def a06_second(spark, sf):
    said = second_pass.extract_response_text(responses(spark, sf))
    chosen = second_pass.second_pass(said)
    return chosen.select("comment_id", "chosen", F.size("tracks").alias("n"))


_DIFF_SQL = f"""
  SELECT comment_id, CAST(count(DISTINCT song || ' - ' || artist) FILTER (item_no % 5 = 0 OR item_no % 7 = 0)
         AS INT) AS n_removed, CAST(count(*) FILTER (item_no % 7 = 0) AS INT) AS n_added,
         CAST(count(*) AS INT) AS local, CAST(count(*) FILTER (item_no % 5 <> 0) AS INT) AS model
  FROM (SELECT a.*, EXISTS (SELECT 1 FROM ({I}) b WHERE b.comment_id = a.comment_id AND b.song = a.song
        AND b.artist = a.artist AND b.item_no % 5 <> 0 AND b.item_no % 7 <> 0) AS kept FROM ({I}) a)
  GROUP BY comment_id
"""
# a dropped line that another item of the comment repeats is not missing
_DIFF_SQL = _DIFF_SQL.replace("(item_no % 5 = 0 OR item_no % 7 = 0)", "((item_no % 5 = 0 OR item_no % 7 = 0) AND NOT kept)")


@query("a07_diff_extractions", _DIFF_SQL)
def a07(spark, sf):
    diff = second_pass.diff_extractions(_pairs(spark, sf))
    return diff.select(
        "comment_id", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"),
        "local", "model",
    )


@query(
    "a07_agreement",
    f"""SELECT count(*) AS videos, count(*) FILTER (n_removed = 0 AND n_added = 0) AS identical,
               round(count(*) FILTER (n_removed = 0 AND n_added = 0) / count(*), 9) AS agreement
        FROM ({_DIFF_SQL})""",
)
def a07_agreement(spark, sf):
    rate = second_pass.agreement(second_pass.diff_extractions(_pairs(spark, sf)))
    return rate.withColumn("agreement", F.round("agreement", 9))


ROUTES = (("capitals", ["RING", "WIDGET", "BOLT"]), ("suppliers", ["Supplier#"]), ("never", ["＠"]))


@query(
    "a08_route_samples",
    f"""WITH d AS (SELECT comment_id, CAST(count(*) AS INT) AS local,
               CAST(count(*) FILTER (item_no % 5 <> 0) AS INT) AS model,
               bool_or(item_no % 7 = 0 AND regexp_matches(upper(song), 'RING|WIDGET|BOLT')) AS cap,
               bool_or((item_no % 7 = 0 OR item_no % 5 = 0) AND (item_no % 7 = 0 OR NOT kept)) AS sup
               FROM (SELECT a.*, EXISTS (SELECT 1 FROM ({I}) b WHERE b.comment_id = a.comment_id
                 AND b.song = a.song AND b.artist = a.artist AND b.item_no % 5 <> 0
                 AND b.item_no % 7 <> 0) AS kept FROM ({I}) a) GROUP BY comment_id),
             r AS (SELECT 'capitals' AS rule_id, * FROM d WHERE cap UNION ALL
                   SELECT 'suppliers', * FROM d WHERE sup)
        SELECT rule_id, comment_id, local, model, CAST(row_number() OVER (PARTITION BY rule_id
               ORDER BY comment_id) AS INT) AS rank FROM r QUALIFY rank <= 5""",
)
def a08(spark, sf):
    words = spark.createDataFrame(list(ROUTES), "rule_id STRING, words ARRAY<STRING>")
    diff = second_pass.diff_extractions(_pairs(spark, sf))
    return second_pass.route_samples(diff, words, k=5, order="comment_id").select(
        "rule_id", "comment_id", "local", "model", "rank"
    )


@query(
    "a08_batch_samples",
    f"""WITH d AS ({_DIFF_SQL}) SELECT comment_id, row_number() OVER (ORDER BY comment_id) AS sample_no,
               CAST((sample_no - 1) // 9 AS BIGINT) AS batch_no, '## ' || comment_id || ' (local=' || local
               || ' model=' || model || ')' AS head FROM d""",
)
def a08_batches(spark, sf):
    diff = second_pass.diff_extractions(_pairs(spark, sf))
    told = second_pass.sample_summary(diff, "comment_id")
    numbered = second_pass.batch_samples(told, "comment_id")
    return numbered.select(
        "comment_id", "sample_no", "batch_no", F.substring_index("summary", "\n", 1).alias("head")
    )


@query(
    "a09_collect_rule_proposals",
    """SELECT o_orderkey AS batch, CASE WHEN o_orderkey % 4 < 2 THEN 'cat_' || o_orderpriority END AS category,
              CASE WHEN o_orderkey % 4 < 2 THEN 'delete_suffix' END AS action,
              CASE o_orderkey % 4 WHEN 2 THEN 'not valid JSON' WHEN 3 THEN 'no JSON object' END AS note
       FROM orders UNION ALL SELECT o_orderkey, NULL, NULL, 'checked' FROM orders WHERE o_orderkey % 4 = 1""",
)
def a09(spark, sf):
    kind = F.col("o_orderkey") % 4
    rule = F.struct(
        F.concat(F.lit("cat_"), "o_orderpriority").alias("category"),
        F.lit("delete_suffix").alias("action"), F.lit("x$").alias("regex"),
    )
    plain = F.to_json(F.struct(F.array(rule).alias("rules")))
    noted = F.to_json(F.struct(F.array(rule).alias("rules"), F.array(F.lit("checked")).alias("notes")))
    said = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```json\n"), plain, F.lit("\n```\n")))
        .when(kind == 1, F.concat(noted, F.lit("\nDone.")))
        .when(kind == 2, F.concat(F.lit('{"rules": [{"category": '), "o_orderpriority", F.lit("}")))
        .otherwise(F.col("o_orderpriority"))
    )
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch"), said.alias("response"))
    return rules.collect_rule_proposals(rows, "batch").select("batch", "category", "action", "note")


_SUFFIXES = [i for i, (_, fired) in enumerate(TITLE_FORMS) if "R07" in fired]


@query(
    "a10_check_rules",
    f"""WITH c AS (SELECT (l_orderkey * 7 + l_linenumber) % {len(TITLE_FORMS)} AS form
               FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT 'current' AS rule_set, count(*) AS cases, 0 AS failures, true AS passed FROM c UNION ALL
        SELECT 'eager', count(*), count(*), false FROM c""",
)
def a10(spark, sf):
    """The current table passes its golden cases; an over-eager rule fails them."""
    from ..functions.titles import Rule

    cases = _written_titles(spark, sf).join(
        fx.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("expect_song")), "p_partkey"
    ).select(F.col("song").alias("input"), "expect_song", F.lit("").alias("expect_artist"))
    eager = DEFAULT_RULES + (Rule("X01", 99, "eager", "delete_suffix", r"[a-z]\z", scope="song"),)
    return rules.check_rules({"current": DEFAULT_RULES, "eager": eager}, cases)
