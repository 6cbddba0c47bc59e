"""The second extraction: requests, responses, reconciliation, choice and difference.

Response tables hold JSON text; nothing here calls a model.  Lists sit in one row per
video (``model`` and ``source`` arrays), so reconciling by position needs no shuffle
beyond the one join that brings the two lists of a video together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import skew
from ..functions.memo import per_context
from ..functions.rows import explode_rows
from ..functions.text import (
    clean_lines, first_match, let, loose_key, normalize, seconds_of, strip, sub, with_nfkc,
)
from ..functions.titles import TRACK_TYPE, drop_latin_suffix, drop_transliterations, track
from ..session import written
from .rules import small_table
from .tracks import is_contiguous, renumber

W = P.WS
TRACKS = f"array<{TRACK_TYPE}>"

_SEPARATOR = "\n\n---\n\n"

# --- requests and responses -------------------------------------------------------------


def build_requests(
    comments: DataFrame, template: str, text: str = "text", preclean: bool = False,
    part_size: int | None = None,
) -> DataFrame:
    """Request text per video that has setlist comments: template, then the texts in order.

    ``comments`` must already be the setlist comments.  Every video has one row with all
    its texts, whatever their number.  With ``part_size`` a video has a row per so many
    texts, each a request of its own that begins with the template.
    """
    value = F.col(text)
    if preclean:
        value = F.array_join(
            F.transform(clean_lines(value), lambda l: drop_latin_suffix(drop_transliterations(l))),
            "\n",
        )
    numbered = skew.ranked(
        written(comments.select("video_id", "source_pos", value.alias("_t")), "requests"),
        ["video_id"], ["source_pos"], "_rank",
    )
    part = F.floor((F.col("_rank") - 1) / part_size).cast("int") if part_size else F.lit(0)
    first = F.col("_rank") == (part * (part_size or 0) + 1)
    lead = F.when(first, F.lit(template + "\n")).otherwise(F.lit(_SEPARATOR))
    pieces = numbered.select(
        "video_id", "_rank", part.alias("part_no"),
        F.concat(lead, F.col("_t")).alias("_t"),
    )
    return pieces.groupBy("video_id", "part_no").agg(
        F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY _rank)").alias("request"),
        F.count("*").alias("n_comments"),
    )


# fixed values: shape and settings of a request
REQUEST_LINE = (
    "custom_id STRING, body STRUCT<model: STRING, input: ARRAY<STRUCT<role: STRING, content: STRING>>, "
    "max_output_tokens: INT, temperature: INT, reasoning: STRUCT<effort: STRING>>"
)
_MOST_TOKENS, _TEMPERATURE, _EFFORT = 8000, 0, "high"


def request_lines(
    comments: DataFrame, template: str, model: str, instruction: str = "", text: str = "text",
    most: int = 200_000, preclean: bool = False,
) -> DataFrame:
    """``video_id, part_no, line``: requests as JSON, the texts of a video in their order.

    A request begins a new part at the text that starts at or behind a multiple of ``most``
    characters, so it never holds more than that and one text. Where a text starts is a
    running total over narrow rows of lengths; no cell ever holds all texts of a video.
    """
    value = F.col(text)
    if preclean:
        value = F.array_join(
            F.transform(clean_lines(value), lambda l: drop_latin_suffix(drop_transliterations(l))),
            "\n",
        )
    cost = F.length("_t") + len(_SEPARATOR)
    placed = skew.running_total(
        written(comments.select("video_id", "source_pos", value.alias("_t")), "requests"),
        ["video_id"], ["source_pos"], cost, "_upto",
    )
    part = F.floor((F.col("_upto") - cost) / most).cast("int").alias("part_no")
    said = placed.select("video_id", part, "_t", "_upto").groupBy("video_id", "part_no").agg(
        F.expr(f"listagg(_t, '{_SEPARATOR.encode('unicode_escape').decode()}') WITHIN GROUP (ORDER BY _upto)").alias("_said")
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.concat(F.lit(template + "\n"), F.col("_said"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("developer", F.lit(instruction)), message("user", asked)).alias("input"),
        F.lit(_MOST_TOKENS).alias("max_output_tokens"), F.lit(_TEMPERATURE).alias("temperature"),
        F.struct(F.lit(_EFFORT).alias("effort")).alias("reasoning"),
    )
    name = F.concat_ws("-", F.col("video_id").cast("string"), F.col("part_no").cast("string"))
    return said.select("video_id", "part_no", F.to_json(F.struct(name.alias("custom_id"), body.alias("body"))).alias("line"))


def write_requests(requests: DataFrame, path: str, file_chars: int = 64 << 20) -> DataFrame:
    """Write request lines as JSON lines, a folder ``shard=N`` per ``file_chars`` characters.

    Requests go into shards in the order of video and part, by a running total of their
    lengths: the same requests are the same shards with the same lines in the same order,
    whenever they are written. Returns what is there, as it is read back.
    """
    cost = F.length("line") + 1
    placed = skew.running_total(requests, [], ["video_id", "part_no"], cost, "_upto")
    shard = F.floor((F.col("_upto") - cost) / file_chars).cast("int").alias("shard")
    dealt = placed.select(shard, F.col("line").alias("value"), "_upto")
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "_upto").select("shard", "value")
    ordered.write.mode("overwrite").partitionBy("shard").text(path)
    return requests.sparkSession.read.schema("value STRING, shard INT").text(path)


_RESPONSE = """
status STRING, output_text STRING,
output ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>>>,
choices ARRAY<STRUCT<text: STRING, message: STRUCT<content: STRING>>>
"""
_PARTS = "ARRAY<STRUCT<text: STRING>>"


def response_text(json: Column) -> Column:
    """Text of a completed response in either shape; null when it is not completed."""

    def pick(r: Column) -> Column:
        blocks = F.filter(r["output"], lambda o: o["type"] == "message")
        texts = F.flatten(
            F.transform(
                blocks,
                lambda o: F.transform(
                    F.filter(
                        F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")),
                        lambda c: (c["type"] == "output_text") & (F.coalesce(c["text"], F.lit("")) != ""),
                    ),
                    lambda c: c["text"],
                ),
            )
        )
        choice = F.get(r["choices"], F.lit(0))
        content = choice["message"]["content"]
        # a content that is itself a JSON array holds text parts
        parts = F.transform(F.from_json(content, _PARTS), lambda p: p["text"])
        joined = F.when(content.rlike(rf"^{W}*\["), F.array_join(parts, "\n"))
        text = F.coalesce(
            joined, content, choice["text"], r["output_text"], F.array_join(texts, "\n")
        )
        done = r["choices"].isNotNull() | (r["status"] == "completed")
        return F.when(done, strip(text))

    return let(F.from_json(json, _RESPONSE), pick)


def extract_response_text(responses: DataFrame, json: str = "json") -> DataFrame:
    """Add ``response``, the text of a completed response."""
    return responses.withColumn("response", response_text(F.col(json)))


_NO_ARTIST = ("请提供歌手信息后再处理。", "请提供歌名信息后再处理。")  # fixed values


def flag_sentinel(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``is_sentinel``: the response only asks for missing fields."""
    return responses.withColumn(
        "is_sentinel", sub(F.coalesce(F.col(text), F.lit("")), rf"{W}+").isin(*_NO_ARTIST)
    )


_RESPONSE_LINE = rf"(?s)^(?:({P.TS}){W}+)?([0-9]{{1,3}})[.)．。、]{W}*(.+)$"


def response_line(line: Column) -> Column:
    def build(p: Column) -> Column:
        label, body = F.get(p, F.lit(0)), strip(F.get(p, F.lit(2)))

        def fields(b: Column) -> Column:
            dash = r"(?s)^(.+) - (.*)$"
            slash = r"(?s)^(.+) / (.*)$"
            song = F.when(b.rlike(dash), first_match(b, dash, 1)).when(
                b.rlike(slash), first_match(b, slash, 1)
            ).otherwise(b)
            artist = F.when(b.rlike(dash), first_match(b, dash, 2)).when(
                b.rlike(slash), first_match(b, slash, 2)
            ).otherwise(F.lit(""))
            song = F.btrim(strip(song), F.lit("「」『』"))
            song = sub(song, r"(?s)^([\"'“”‘’])(.*)\1$", "$2")
            artist = strip(artist)
            return F.struct(
                strip(song).alias("song"),
                F.when(artist.rlike(r"(?i)^(?:未記載|未确定|不明|unknown)$"), "")
                .otherwise(artist).alias("artist"),
            )

        return let(
            let(body, fields),
            lambda f: F.when(
                f["song"] != "",
                track(F.lit(None), F.get(p, F.lit(1)).cast("int"), seconds_of(label), label,
                      f["song"], f["artist"]),
            ),
        )

    canonical = sub(strip(line), _RESPONSE_LINE, "$1\x02$2\x02$3")
    return let(
        canonical, lambda c: F.when(c.contains("\x02"), let(F.split(c, "\x02"), build))
    )


@per_context
def response_tracks(text: str) -> Column:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), P.LINE_BREAK)
    return renumber(F.filter(F.transform(lines, response_line), lambda t: t.isNotNull()))


def parse_response_tracks(responses: DataFrame, text: str = "response") -> DataFrame:
    """Numbered response lines to ``tracks``; title-only rows stay."""
    keep = [c for c in responses.columns if c not in (text, "json")]
    return responses.select(*keep, response_tracks(text).alias("tracks"))


# --- reconcile by position ----------------------------------------------------------------

_PAREN_TAIL = r"[(（]([^()（）]{1,30})[)）][" + P.WS_SET + r"]*$"


#: Control character between the fields of a list in one text.
_MARK = "\x02"


def _folded_fields(df: DataFrame, name: str, tracks: str) -> DataFrame:
    """Add ``name``: song and performer of each track in their compatibility form.

    Four parts a track: each field, and the field without its bracket at the end. Lists that
    are not merged by position are left out.
    """
    def parts(field: Column) -> Column:
        plain = F.translate(strip(F.coalesce(field, F.lit(""))), _MARK, "")
        return F.array(plain, strip(sub(plain, _PAREN_TAIL)))

    listed = F.flatten(
        F.transform(tracks, lambda t: F.concat(parts(t["song"]), parts(t["artist"])))
    )
    merged = (F.size("model") == F.size("source")) & (F.size("model") > 0)
    return with_nfkc(df, name, F.when(merged, F.array_join(listed, _MARK)))


def _with_folded(pairs: DataFrame) -> DataFrame:
    return _folded_fields(_folded_fields(pairs, "_model", "model"), "_source", "source")


def _merge_reason(
    source: Column, model: Column, source_form: Column, bare_form: Column, model_form: Column,
    paren_ok: Column, is_song: bool,
) -> Column:
    """Why a field keeps its value; the name starts with the side that wins."""
    s_key, m_key, bare = loose_key(source_form), loose_key(model_form), loose_key(bare_form)
    latin = F.length(sub(model, "[^A-Za-z]"))
    cjk = F.length(sub(model, rf"[^{P.CJK_RUN[1:-1]}]"))
    japanese_lost = (
        source.rlike(P.JAPANESE) & ~model.rlike(P.JAPANESE) & (latin >= 3) & (latin > cjk * 2)
    )
    replaced = lambda c: c.contains("�")
    time_in = lambda c: c.rlike(rf"(?:^|[^0-9]){P.TS_VALID}")
    longer, shorter = F.greatest(s_key, m_key), F.least(s_key, m_key)
    tail = F.substring(longer, F.length(shorter) + 1, F.length(longer))
    latin_tail = (
        ~replaced(source) & ~replaced(model) & ~source.rlike(P.JAPANESE)
        & ~model.rlike(P.JAPANESE) & (s_key != "") & (m_key != "") & (s_key != m_key)
        & F.startswith(longer, shorter) & tail.rlike("^[a-z]{1,3}$")
    )
    inner = first_match(source, _PAREN_TAIL, 1)
    if is_song:
        paren = paren_ok & (bare != "") & (bare == m_key) & inner.rlike(P.CJK_RUN) & ~inner.rlike("[A-Za-z]")
    else:
        paren = (bare != "") & (bare == m_key) & source.rlike("[(（]")
    return (
        F.when(source == "", "model:source_empty")
        .when(model == "", "source:model_empty")
        .when(source == model, "model:equal")
        .when(time_in(source) & ~time_in(model), "model:time_in_source")
        .when(replaced(model) & ~replaced(source), "source:broken_character")
        .when(latin_tail, "model:latin_tail")
        .when(japanese_lost, "source:japanese_name")
        .when((s_key == m_key) & (F.length(source) > F.length(model)), "source:fuller_spelling")
        .when(paren, "source:bracket_suffix")
        .otherwise("source:default")
    )


def merged_by_position(
    model: Column, source: Column, model_forms: Column, source_forms: Column
) -> Column:
    """Array of merged tracks with ``song_reason`` and ``artist_reason``.

    The forms are those of :func:`_folded_fields`, four a track.
    """
    cjk_tail = lambda t: (
        first_match(t["song"], _PAREN_TAIL, 1).rlike(P.CJK_RUN)
        & ~first_match(t["song"], _PAREN_TAIL, 1).rlike("[A-Za-z]")
    )
    few = let(
        F.size(F.filter(source, cjk_tail)),
        lambda n: (n > 0) & (n <= F.greatest(F.lit(2), F.floor(F.size(source) * 0.25))),
    )
    text = lambda c: strip(F.coalesce(c, F.lit("")))

    def merge(m: Column, s: Column, i: Column, paren_ok: Column) -> Column:
        s_form = lambda k: F.get(source_forms, i * 4 + k)
        m_form = lambda k: F.get(model_forms, i * 4 + k)

        def fields(f: Column) -> Column:
            song_r = _merge_reason(
                f["ss"], f["ms"], s_form(0), s_form(1), m_form(0), paren_ok, True
            )
            artist_r = _merge_reason(
                f["sa"], f["ma"], s_form(2), s_form(3), m_form(2), F.lit(True), False
            )
            pick = lambda r, src, mod: F.when(F.startswith(r, F.lit("model")), mod).otherwise(src)
            return let(
                F.struct(song_r.alias("s"), artist_r.alias("a")),
                lambda r: F.struct(
                    m["item_pos"].alias("item_pos"), m["num"].alias("num"),
                    F.coalesce(s["secs"], m["secs"]).alias("secs"),
                    F.when(F.coalesce(s["label"], F.lit("")) != "", s["label"])
                    .otherwise(m["label"]).alias("label"),
                    pick(r["s"], f["ss"], f["ms"]).alias("song"),
                    pick(r["a"], f["sa"], f["ma"]).alias("artist"),
                    r["s"].alias("song_reason"), r["a"].alias("artist_reason"),
                ),
            )

        return let(
            F.struct(
                text(s["song"]).alias("ss"), text(m["song"]).alias("ms"),
                text(s["artist"]).alias("sa"), text(m["artist"]).alias("ma"),
            ),
            fields,
        )

    return let(
        few, lambda ok: F.transform(model, lambda m, i: merge(m, F.get(source, i), i, ok))
    )


def pair_lists(model: DataFrame, source: DataFrame, key: str = "video_id") -> DataFrame:
    """Both lists of a video side by side; a missing list is empty."""
    empty = F.array().cast(TRACKS)
    joined = model.select(key, F.col("tracks").alias("model")).join(
        source.select(key, F.col("tracks").alias("source")), key, "full_outer"
    )
    return joined.select(
        key, F.coalesce("model", empty).alias("model"), F.coalesce("source", empty).alias("source")
    )


@per_context
def _merged_pair(model: str, source: str) -> Column:
    """For a table of :func:`_with_folded`."""
    m, s = F.col(model), F.col(source)
    m_forms, s_forms = F.split(F.col(f"_{model}"), _MARK), F.split(F.col(f"_{source}"), _MARK)
    reasoned = F.transform(
        m,
        lambda t: t.withField("song_reason", F.lit("model:counts_differ"))
        .withField("artist_reason", F.lit("model:counts_differ")),
    )
    return F.when((F.size(m) == F.size(s)) & (F.size(m) > 0), merged_by_position(m, s, m_forms, s_forms)).otherwise(
        reasoned
    )


def reconcile(pairs: DataFrame) -> DataFrame:
    """Merge the model list with the source list where their lengths agree.

    Times come from the source; each field carries the reason for its value.  Lists of
    different length keep the model rows.
    """
    keep = [c for c in pairs.columns if c not in ("model", "source")]
    rows = explode_rows(_with_folded(pairs), _merged_pair("model", "source"), keep, "t")
    return rows.select(*keep, "t.*")


def _plain_merged(model: str, source: str) -> Column:
    return F.transform(
        _merged_pair(model, source), lambda t: t.dropFields("song_reason", "artist_reason")
    )


def choose_result(
    pairs: DataFrame, policy: str = "pipeline", sentinel: str | None = None,
    raw_text: str | None = None, numbered: str | None = None,
) -> DataFrame:
    """Pick one list per video and say which: ``chosen``, ``tracks`` (and ``fallback_text``).

    ``pipeline``: the model list if it has rows, else the source list.  ``strict``: a
    source numbered 1..n wins unless the counts agree, equal counts are reconciled, a
    longer source wins, then the model, then the source, then the raw text.  ``numbered``
    is a flag column that says whether the numbered extraction of the source is 1..n (the
    chosen list may be another one); without it the source list itself is looked at.
    """
    used = ("model", "source", sentinel, raw_text, numbered)
    keep = [c for c in pairs.columns if c not in used]
    m, s = F.size("model"), F.size("source")
    asks = F.col(sentinel) if sentinel else F.lit(False)
    if policy == "pipeline":
        chosen = F.when((m > 0) & ~asks, "model").when(s > 0, "source").otherwise("none")
    elif policy == "strict":
        contiguous = F.col(numbered) if numbered else is_contiguous(F.col("source"))
        chosen = (
            F.when(asks & (s > 0), "source").when(asks, "none")
            .when((s > 0) & contiguous & (m != s), "source")
            .when((m > 0) & (m == s), "merged")
            .when((m > 0) & (s > m), "source")
            .when(m > 0, "model").when(s > 0, "source").otherwise("text")
        )
    else:
        raise ValueError(f"unknown policy {policy}")
    picked = pairs.withColumn("chosen", chosen)
    lists = F.when(F.col("chosen") == "model", F.col("model")).when(
        F.col("chosen") == "source", F.col("source")
    )
    if policy == "strict":
        picked = _with_folded(picked)
        lists = lists.when(F.col("chosen") == "merged", _plain_merged("model", "source"))
    out = [*keep, "chosen", F.coalesce(lists, F.array().cast(TRACKS)).alias("tracks")]
    if raw_text:
        out.append(F.when(F.col("chosen").isin("none", "text"), F.col(raw_text)).alias("fallback_text"))
    return picked.select(*out)


def second_pass(responses: DataFrame, text: str = "response") -> DataFrame:
    """Model text through the text extraction, then as numbered lines, then as it is."""
    from .sets import deduped, squeezed, without_honorifics
    from .tracks import numbered_tracks, plain_tracks

    display = lambda t: let(without_honorifics(t), squeezed)
    keep = [c for c in responses.columns if c not in (text, "json")]
    both = responses.select(
        *keep, text, numbered_tracks(text).alias("_n"), plain_tracks(text).alias("_p"),
        response_tracks(text).alias("_r"),
    )
    numbered = (is_contiguous(F.col("_n")) & (F.size("_n") >= F.size("_p"))) | (
        F.size("_n") > F.size("_p")
    )
    local = both.withColumn("_l", F.when(numbered, F.col("_n")).otherwise(F.col("_p")))
    chosen = F.when(F.size("_l") > 0, "local").when(F.size("_r") > 0, "lines").otherwise("text")
    return local.withColumn("chosen", chosen).select(
        *keep, "chosen",
        F.when(F.col("chosen") == "local", deduped(display(F.col("_l"))))
        .when(F.col("chosen") == "lines", display(F.col("_r")))
        .otherwise(F.array().cast(TRACKS)).alias("tracks"),
        F.when(F.col("chosen") == "text", normalize(F.col(text))).alias("fallback_text"),
    )


# --- difference and routing ---------------------------------------------------------------


def diff_extractions(
    pairs: DataFrame, source_lines: str | None = None, sample: int | None = None
) -> DataFrame:
    """Rendered lines only the source has (``removed``) and only the model has (``added``).

    ``sample`` limits the source lines that go along.
    """
    key = [c for c in pairs.columns if c not in ("model", "source", source_lines)]
    fields = lambda ts: F.transform(
        ts,
        lambda t: F.concat_ws(
            " - ", t["song"], F.when(F.coalesce(t["artist"], F.lit("")) != "", t["artist"])
        ),
    )
    local, model = fields(F.col("source")), fields(F.col("model"))
    lines = F.col(source_lines) if source_lines else F.array().cast("array<string>")
    lines = F.slice(lines, 1, sample) if sample is not None else lines
    return pairs.select(
        *key, F.size("source").alias("local"), F.size("model").alias("model"),
        F.array_except(local, model).alias("removed"), F.array_except(model, local).alias("added"),
        lines.alias("source_lines"),
    )


def agreement(diff: DataFrame) -> DataFrame:
    """Videos, identical videos and their share."""
    same = (F.size("removed") == 0) & (F.size("added") == 0)
    return diff.agg(
        F.count("*").alias("videos"), F.count_if(same).alias("identical"),
        F.avg(same.cast("int")).alias("agreement"),
    )


def route_samples(
    diff: DataFrame, keywords: DataFrame, k: int | None = None, order: str = "video_id"
) -> DataFrame:
    """Samples per rule whose changed lines hold one of its keywords; the first ``k``, if given.

    ``keywords`` is ``rule_id, words ARRAY<STRING>`` and one row per rule (a few dozen);
    the ranking keeps ``k`` rows per rule on the map side before it shuffles.
    """
    changed = diff.select(
        order, "local", "model",
        F.concat_ws(" ", F.array_join("removed", " "), F.array_join("added", " ")).alias("_h"),
    ).where(strip(F.col("_h")) != "")
    table = [(r.rule_id, list(r.words)) for r in small_table(keywords.orderBy("rule_id"))]
    hits = F.filter(
        F.array(
            *[
                F.when(_contains_any(F.col("_h"), words), F.lit(rule)) for rule, words in table
            ]
        ),
        lambda r: r.isNotNull(),
    )
    routed = explode_rows(changed, hits, [order, "local", "model"], "rule_id")
    if k is None:
        return routed
    first = Window.partitionBy("rule_id").orderBy(order)
    return routed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def batch_samples(diff: DataFrame, order: str, size: int = 9) -> DataFrame:
    """Number samples in order (a key of any type) and cut them into batches of ``size``."""
    numbered = skew.ranked(written(diff, "samples"), [], [order], "sample_no")
    return numbered.withColumn(
        "batch_no", F.floor((F.col("sample_no") - 1) / size).cast("bigint")
    )


def sample_summary(diff: DataFrame, key: str = "video_id") -> DataFrame:
    """Compact text of one sample."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name), F.to_json(c)))
    head = F.format_string("## %s (local=%d model=%d)", F.col(key).cast("string"), "local", "model")
    return diff.select(
        key,
        F.concat_ws(
            "\n", head, part("removed: ", F.col("removed")), part("added: ", F.col("added")),
            part("lines: ", F.col("source_lines")),
        ).alias("summary"),
    )
