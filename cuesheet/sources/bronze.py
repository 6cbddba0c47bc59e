"""Raw payloads to typed tables.

Payload JSON stays text.  Fixed shapes go through ``from_json``; free trees are walked
once in Arrow batches, in document order, and everything after the walk is DataFrame
work.  The walk is a map: one payload in, its findings out, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import skew
from ..functions.rows import explode_rows
from ..functions.text import let, logical_text, sub
from ..operators.text import times_in_plain
from ..session import written

W = P.WS

# --- S1 collections -----------------------------------------------------------------------

_COLLECTION = """
code INT, message STRING,
data STRUCT<ugc_season: STRUCT<sections: ARRAY<STRUCT<title: STRING,
  episodes: ARRAY<STRUCT<bvid: STRING, title: STRING, page: STRUCT<part: STRING>>>>>>>
"""
_PART = r"(?s)^\[([0-9]{4}-[0-9]{2}-[0-9]{2})\]\[([\p{L}\p{N}_\-]{11})\](.*)$"


def load_videos(payloads: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row per episode of the collection payloads (``source, seq, json``).

    ``names`` maps an anchor to its collection name; the default is
    ``collection-<anchor>``.  Payloads with an error code yield no rows; those that are no
    valid JSON are rows of :func:`bad_collections`.  ``pos`` (payload, section, episode) is
    the place in the lists.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    named = F.lit(None).cast("string")
    for anchor, name in (names or {}).items():
        named = F.when(F.col("source") == anchor, F.lit(name)).otherwise(named)
    doc = payloads.select(
        F.coalesce(named, F.concat(F.lit("collection-"), "source")).alias("collection"),
        F.from_json("json", _COLLECTION).alias("p"), F.col("seq").cast("long").alias("seq"),
    )
    sections = explode_rows(
        doc, F.when(F.col("p.code") == 0, F.col("p.data.ugc_season.sections")),
        ["collection", "seq"], "s", "_s",
    )
    episodes = explode_rows(
        sections.select(
            "collection", "seq", "_s", text(F.col("s.title")).alias("section"), F.col("s.episodes").alias("_e")
        ),
        F.col("_e"), ["collection", "seq", "_s", "section"], "e", "_i",
    )
    part = text(F.col("e.page.part"))
    return episodes.select(
        "collection", "section", text(F.col("e.bvid")).alias("video_id"),
        text(F.col("e.title")).alias("title"), F.regexp_extract(part, _PART, 1).alias("part_date"),
        F.regexp_extract(part, _PART, 2).alias("yt_id"), part.alias("raw_part"),
        F.struct("seq", F.col("_s").alias("section"), F.col("_i").alias("episode")).alias("pos"),
    )


def bad_collections(payloads: DataFrame) -> DataFrame:
    """``source, seq, error`` of the payloads that are no valid JSON."""
    found = F.get_json_object("json", "$")
    return payloads.where(F.col("json").isNull() | found.isNull()).select(
        "source", "seq", F.lit("not valid JSON").alias("error")
    )


# --- S2 embedded JSON ------------------------------------------------------------------------


def _cut_json(marker: str):
    """Arrow function: the JSON object behind ``marker``, or why there is none."""

    def cut(texts):
        import json
        import re

        import pandas as pd

        outside, inside = re.compile(r'["{}]'), re.compile(r'(?s)\\.|"')

        def one(text):
            at = (text or "").find(marker)
            if at < 0:
                return None, f"{marker} not found"
            start = text.find("{", at)
            if start < 0:
                return None, f"{marker} object start not found"
            depth, pos = 0, start
            while True:
                hit = outside.search(text, pos)
                if hit is None:
                    return None, f"{marker} object end not found"
                pos = hit.end()
                if hit.group() == '"':
                    close = inside.search(text, pos)
                    while close is not None and close.group() != '"':
                        close = inside.search(text, close.end())
                    if close is None:
                        return None, f"{marker} object end not found"
                    pos = close.end()
                    continue
                depth += 1 if hit.group() == "{" else -1
                if depth == 0:
                    found = text[start:pos]
                    try:
                        json.loads(found)
                    except ValueError:
                        return None, f"{marker} object is not valid JSON"
                    return found, None

        return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])

    return cut


def extract_embedded_json(
    pages: DataFrame, marker: str, html: str = "html", default_version: str = "2.20260601.00.00"
) -> DataFrame:
    """Key, client version and the JSON object behind ``marker`` of each page."""
    from pyspark.sql import types as T

    shape = T.StructType(
        [T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]
    )
    keep = [c for c in pages.columns if c != html]
    key = F.regexp_extract(html, r'"INNERTUBE_API_KEY":"([^"]+)"', 1)
    version = F.regexp_extract(html, r'"INNERTUBE_CLIENT_VERSION":"([^"]+)"', 1)
    # the type hints pandas_udf needs, without importing pandas at module load
    import pandas as pd

    cut = _cut_json(marker)

    def found(texts: pd.Series) -> pd.DataFrame:
        return cut(texts)

    found.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return pages.select(
        *keep, key.alias("api_key"),
        F.when(version != "", version).otherwise(F.lit(default_version)).alias("client_version"),
        # only what follows the marker leaves the JVM
        F.pandas_udf(found, shape)(
            F.when(
                F.instr(F.col(html), F.lit(marker)) > 0,
                F.substring(F.col(html), F.instr(F.col(html), F.lit(marker)), F.length(F.col(html))),
            )
        ).alias("_j"),
    ).select(*keep, "api_key", "client_version", "_j.json", "_j.error")


# --- S3-S5 free trees ----------------------------------------------------------------------


PAYLOAD_SCHEMA = "yt_id STRING, part STRING, part_pos INT, json STRING"
WALK_SCHEMA = (
    "yt_id STRING, part STRING, part_pos INT, ordinal INT, kind STRING, text STRING, hint BOOLEAN, "
    "payload BIGINT, nth INT"
)


ALL_KINDS = ("comment", "simple", "runs", "token", "any_token", "reply", "error")


def walk_payloads(
    payloads: DataFrame, kinds: tuple[str, ...] = ALL_KINDS, initial: tuple[str, ...] | None = None
) -> DataFrame:
    """Findings of each payload (``yt_id, part, part_pos, json``) in document order.

    Kinds: ``comment`` text, ``simple`` and ``runs`` texts, ``token`` of a continuation
    (``hint``: its object mentions comments), ``any_token``, ``reply`` token, and ``error``,
    the one finding of a payload that is no valid JSON (see :func:`bad_payloads`).
    ``payload`` numbers the payloads (write the findings before it is used twice), ``nth`` the
    findings of a kind in one.  ``initial``: the kinds of first pages, when they are others.
    """

    every, first = frozenset(kinds), frozenset(kinds if initial is None else initial)

    def walk(batches):
        import json

        import pyarrow as pa
        from pyspark import TaskContext

        names = ["yt_id", "part", "part_pos", "ordinal", "kind", "text", "hint", "payload", "nth"]
        types = [
            pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(),
            pa.int64(), pa.int32(),
        ]
        payload = TaskContext.get().partitionId() << 33
        encode = json.JSONEncoder(ensure_ascii=False).encode
        key_of = {
            "comment": "commentEntityPayload", "simple": "simpleText", "runs": "runs",
            "token": "continuationEndpoint", "any_token": "continuationCommand",
            "reply": "commentRepliesRenderer",
        }
        keys_of = lambda wanted: frozenset(key_of[k] for k in wanted if k in key_of)
        plans = {True: (first, keys_of(first)), False: (every, keys_of(every))}

        def get(node, *path):
            for key in path:
                node = node.get(key) if isinstance(node, dict) else None
            return node

        def made(out):
            columns = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        def findings(item, wanted):
            if "comment" in wanted and "commentEntityPayload" in item:
                content = get(item, "commentEntityPayload", "properties", "content", "content")
                if isinstance(content, str):
                    yield "comment", content, None
            if "simple" in wanted and isinstance(item.get("simpleText"), str):
                yield "simple", item["simpleText"], None
            if "runs" in wanted and isinstance(item.get("runs"), list):
                texts = [r.get("text") for r in item["runs"] if isinstance(r, dict)]
                yield "runs", "".join([t for t in texts if isinstance(t, str)]), None
            if "token" in wanted and "continuationEndpoint" in item:
                token = get(item, "continuationEndpoint", "continuationCommand", "token")
                if token:
                    told = encode(item)
                    yield "token", str(token), "comment" in told.lower() or "コメント" in told
            if "any_token" in wanted and "continuationCommand" in item:
                token = get(item, "continuationCommand", "token")
                if token:
                    yield "any_token", str(token), None
            if "reply" in wanted and "commentRepliesRenderer" in item:
                contents = get(item, "commentRepliesRenderer", "contents")
                for one in contents if isinstance(contents, list) else ():
                    token = get(
                        one, "continuationItemRenderer", "continuationEndpoint", "continuationCommand", "token"
                    )
                    if token:
                        yield "reply", str(token), None

        for batch in batches:
            out = []
            keys = [batch.column(i).to_pylist() for i in range(3)]
            texts = batch.column(3)
            # one payload at a time leaves the column
            for i, key in enumerate(zip(*keys)):
                if len(out) >= 5000:
                    yield made(out)
                    out = []
                payload += 1
                wanted, keys_read = plans[key[1] == "initial"]
                met = dict.fromkeys(wanted, 0)
                try:
                    root = json.loads(texts[i].as_py() or "null")
                except (ValueError, RecursionError) as problem:
                    if "error" in wanted:
                        reason = "nested too deeply" if isinstance(problem, RecursionError) else "not valid JSON"
                        out.append((*key, 0, "error", reason, None, payload, 1))
                    continue
                # explicit stack: depth of the tree is not limited by the call stack; only
                # objects and lists go onto it, and most objects hold none of the keys
                stack, ordinal = [[root]], 0
                while stack:
                    node = stack.pop()
                    if type(node) is dict:
                        if not keys_read.isdisjoint(node):
                            for kind, text, hint in findings(node, wanted):
                                ordinal += 1
                                met[kind] += 1
                                out.append((*key, ordinal, kind, text, hint, payload, met[kind]))
                        node = node.values()
                    for value in reversed(node):
                        if type(value) is dict or type(value) is list:
                            stack.append(value)
            yield made(out)

    return payloads.select("yt_id", "part", "part_pos", "json").mapInArrow(walk, WALK_SCHEMA)


def _part_rank() -> Column:
    return F.when(F.col("part") == "initial", 0).when(F.col("part") == "comments", 1).otherwise(2)


def _walked(payloads: DataFrame, parts: Column, kinds: tuple[str, ...]) -> DataFrame:
    """Findings of the wanted parts; a table that was walked before is only filtered.

    The walk is opaque to the optimiser, so parts and kinds are chosen in front of it.
    """
    if "kind" in payloads.columns:
        return payloads.where(parts & F.col("kind").isin(*kinds))
    return walk_payloads(payloads.where(parts), kinds)


def bad_payloads(payloads: DataFrame) -> DataFrame:
    """``yt_id, part, part_pos, error`` of the payloads that could not be read."""
    return _walked(payloads, F.lit(True), ("error",)).select(
        "yt_id", "part", "part_pos", F.col("text").alias("error")
    )


def extract_comments(payloads: DataFrame) -> DataFrame:
    """Comment texts in order: the main response first, then the replies.

    Only the numbers of comments per payload are put in order; their running total is where
    the comments of a payload begin. It comes to the texts by payload, broadcast where Spark
    finds it small enough, so that texts stay where they were found.
    """
    found = written(_walked(payloads, F.col("part") != "initial", ("comment",)), "comments")
    counts = found.groupBy("yt_id", "part", "part_pos", "payload").agg(F.max("nth").cast("bigint").alias("_n"))
    upto = skew.running_total(
        counts, ["yt_id"], [_part_rank(), "part_pos", "payload"], F.col("_n"), "_upto"
    )
    before = written(upto.select("payload", (F.col("_upto") - F.col("_n")).alias("_before")), "offsets")
    return found.join(before, "payload").select(
        "yt_id", (F.col("_before") + F.col("nth")).alias("comment_pos"), "text"
    )


# fixed values: marks that are no words of a text
_NOT_TEXT = (
    rf"[{P.WS_SET}\[\]【】()（）<>＜＞:：;；,，.。~～{P.DASHES}_{P.DELIMS}♪♫♬♩▶▷►▸▹・･●○◆◇■□]+"
)
_ANY_TIME = rf"(^|[^0-9])({P.TS})(?![0-9])"


def is_timed_text(c: Column) -> Column:
    """Holds a time, and letters, kana or kanji besides times and marks."""
    value = F.translate(F.coalesce(c, F.lit("")), " ​", " ")
    rest = sub(sub(value, _ANY_TIME), _NOT_TEXT)
    # a time takes the one character before it along, marks hold no letters: two in a row leave one
    return value.rlike(_ANY_TIME) & (
        value.rlike("[A-Za-zぁ-んァ-ヶ]{2}") | rest.rlike("[A-Za-zぁ-んァ-ヶ一-龯々]")
    )


def extract_descriptions(payloads: DataFrame) -> DataFrame:
    """Distinct timed texts of the first page, in order, joined by a blank line.

    All texts of a video come from its one initial payload, so a group is one payload.
    """
    texts = _walked(payloads, F.col("part") == "initial", ("simple", "runs"))
    found = texts.where(is_timed_text(F.col("text")))
    first = found.groupBy("yt_id", "text").agg(F.min("ordinal").alias("_o"))
    return first.groupBy("yt_id").agg(
        F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY _o)").alias("description")
    )


def crawl_frontier(payloads: DataFrame, seen: DataFrame, cap: int | None = None) -> DataFrame:
    """Tokens to fetch next: the comments of a video, then reply pages first in, first out.

    Tokens in ``seen`` (``yt_id, token``) are left out.  With ``cap`` a video gets at most
    so many reply pages, the reply tokens already in ``seen`` included.
    """
    found = payloads
    if "kind" not in payloads.columns:
        # one walk for both queues
        found = written(walk_payloads(payloads, ("reply",), ("token", "any_token")), "tokens")
    initial = _walked(found, F.col("part") == "initial", ("token", "any_token")).where(
        F.col("hint") | (F.col("kind") == "any_token")
    )
    order = F.struct((F.col("kind") != "token").alias("late"), "part_pos", "ordinal")
    start = initial.groupBy("yt_id").agg(F.min_by("text", order).alias("token")).select(
        "yt_id", F.lit("comments").alias("kind"), "token", F.lit(1).alias("pos")
    )
    start = start.join(seen.select("yt_id", "token"), ["yt_id", "token"], "left_anti")
    replies = _walked(found, F.col("part") != "initial", ("reply",))
    first = replies.groupBy("yt_id", F.col("text").alias("token")).agg(
        F.min(F.struct(_part_rank().alias("r"), "part_pos", "ordinal")).alias("_o")
    )
    fresh = first.join(seen.select("yt_id", "token"), ["yt_id", "token"], "left_anti")
    numbered = fresh.withColumn(
        "pos", F.row_number().over(Window.partitionBy("yt_id").orderBy("_o"))
    )
    if cap is None:
        allowed = numbered
    else:
        used = first.join(seen.select("yt_id", "token").distinct(), ["yt_id", "token"], "left_semi")
        used = used.groupBy("yt_id").agg(F.count("*").alias("_used"))
        # the constant bound keeps cap rows per video on the map side
        allowed = numbered.where(F.col("pos") <= cap).join(used, "yt_id", "left").where(
            F.col("pos") <= cap - F.coalesce(F.col("_used"), F.lit(0))
        )
    queue = allowed.select("yt_id", F.lit("reply").alias("kind"), "token", "pos")
    return start.select("yt_id", "kind", "token", "pos").unionByName(queue)


# --- S6 renditions, S7 cache, S8 published ------------------------------------------------------


def pick_rendition(renditions: DataFrame) -> DataFrame:
    """Best of several renditions of a comment: times, then lines, then length."""
    def scored(t: Column) -> Column:
        # no line of a normalised text is empty
        n_lines = F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")))
        score = F.size(times_in_plain(t)) * 100000 + n_lines * 100 + F.length(t)
        return F.struct(t.alias("text"), score.cast("bigint").alias("score"))

    scored = renditions.withColumn("_s", let(logical_text(F.col("text")), scored)).select(
        "video_id", "comment_id", "kind", "pos", "_s.text", "_s.score"
    )
    value = F.struct("kind", "text", "score")
    rank = F.when(F.col("text") != "", F.struct("score", (-F.col("pos")).alias("p")))
    best = scored.groupBy("video_id", "comment_id").agg(F.max_by(value, rank).alias("b")).where(
        F.col("b").isNotNull()
    )
    return best.select("video_id", "comment_id", "b.kind", "b.text", "b.score")


def latest_raw(raw_events: DataFrame) -> DataFrame:
    """Latest payload per video and part."""
    value = F.struct("json", "fetched_at")
    best = raw_events.groupBy("yt_id", "part", "part_pos").agg(
        F.max_by(value, F.struct("fetched_at", "json")).alias("b")
    )
    return best.select("yt_id", "part", "part_pos", "b.json", "b.fetched_at")


BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("yt_id"), F.lit(buckets)).cast("int")


def append_raw(raw_events: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append raw payloads; the bucket of a video prunes later reads by key."""
    raw_events.withColumn("bucket", _bucket(buckets)).write.mode("append").partitionBy("bucket").parquet(path)


def read_latest(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Latest payload per video and part of a cache that :func:`append_raw` wrote.

    With ``wanted`` (``yt_id``) only the folders of its buckets are read (their numbers, at
    most ``buckets``, are the filter). The latest row is found on keys, times and places in
    the files, without the payloads; these are read for the rows that were found, and never
    go through an aggregate. Of equal times the row that was written further on counts.
    """
    key = ["yt_id", "part", "part_pos"]
    place = ["_file", "_row"]
    table = spark.read.schema(f"{PAYLOAD_SCHEMA}, fetched_at TIMESTAMP, bucket INT").parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    if wanted is not None:
        numbers = [r["b"] for r in wanted.select(_bucket(buckets).alias("b")).distinct().collect()]
        table = table.where(F.col("bucket").isin(numbers)).join(
            wanted.select("yt_id").distinct(), "yt_id", "left_semi"
        )
    latest = table.groupBy(*key).agg(F.max(F.struct("fetched_at", *place)).alias("_b"))
    latest = written(latest.select(*(F.col(f"_b.{c}") for c in place)), "latest")
    return table.join(latest, place, "left_semi").select(*key, "json", "fetched_at")


_PUBLISHED = """
code INT, data STRUCT<replies: ARRAY<STRUCT<rpid: STRING, ctime: BIGINT, like: INT,
  member: STRUCT<mid: STRING, uname: STRING>, content: STRUCT<message: STRING>>>>
"""


def load_published(payload_pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Published top-level comments, up to the first bad or empty page (or ``max_pages``).

    Input is ``source`` (the video), ``seq`` (page from 1) and ``json``.
    """
    wanted = payload_pages if max_pages is None else payload_pages.where(F.col("seq") <= max_pages)
    pages = wanted.select(
        F.col("source").alias("video_id"), "seq", F.from_json("json", _PUBLISHED).alias("p")
    )
    ok = (F.coalesce(F.col("p.code"), F.lit(-1)) == 0) & (F.coalesce(F.size("p.data.replies"), F.lit(0)) > 0)
    # one narrow row per page of a video
    so_far = Window.partitionBy("video_id").orderBy("seq")
    good = pages.withColumn("_ok", F.min(ok.cast("int")).over(so_far)).where(F.col("_ok") == 1)
    rows = explode_rows(good, F.col("p.data.replies"), ["video_id", "seq"], "r", "_i")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        "video_id", (F.col("seq") * 1000 + F.col("_i")).cast("int").alias("pos"),
        text(F.col("r.rpid")).alias("rpid"), text(F.col("r.member.mid")).alias("mid"),
        text(F.col("r.member.uname")).alias("uname"),
        F.coalesce("r.ctime", F.lit(0)).alias("ctime"), F.coalesce("r.like", F.lit(0)).alias("likes"),
        text(F.col("r.content.message")).alias("message"),
    )
