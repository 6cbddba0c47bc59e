"""One run over all videos: candidates, extraction, choice, decision, texts and ledger.

Every stage is one table for all videos. The texts are parsed once: what the rules found in
them is written, and choice, decision, segments and notices read that. Videos of a run are
few against those known, so the candidates come first and limit all other inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import second_pass
from ..operators.sets import COUNTS, counted_lists, normalize_display, select_best_source
from ..operators.text import classify_songlist_comments
from ..operators.tracks import parse_setlists
from ..session import written
from . import publish

# fixed values: how a list came about
_LOCAL = "本地兜底（%s）"
_NOT_ASKED, _NO_PERFORMER, _FAILED = "评论区无结构化歌单（不调 DS）", "AI 判定缺歌手", "AI 整理失败: %s"
_TEXT = ["video_id", "source", "source_pos", "comment_id", "text"]


@dataclass
class Inputs:
    """Tables of a run.

    ``comments`` and ``descriptions``: ``video_id, source, source_pos, comment_id, text``;
    ``responses``: ``video_id, json`` and, if there is one, ``error``; the others as in
    :mod:`publish`.
    """

    videos: DataFrame
    snapshot: DataFrame
    published: DataFrame
    comments: DataFrame
    descriptions: DataFrame
    responses: DataFrame
    published_comments: DataFrame
    ignore: DataFrame
    errors: DataFrame | None = None


def listed_comments(comments: DataFrame) -> DataFrame:
    """The setlist comments, with their flag.

    Counts of lines are no columns behind the filter: the optimiser would count for both.
    """
    listed = classify_songlist_comments(comments.select(*_TEXT)).where("is_songlist")
    return listed.select(*_TEXT, F.lit(True).alias("is_songlist"))


def local_lists(comments: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Track lists of all texts of a run: setlist comments and every description."""
    listed = comments.where("is_songlist").select(*_TEXT)
    return normalize_display(parse_setlists(listed.unionByName(descriptions.select(*_TEXT))))


def model_lists(responses: DataFrame) -> DataFrame:
    """``video_id, model, note`` per video: the model's list, and why there is none.

    A video with several responses has that with the smallest text.
    """
    reason = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    first = responses.groupBy("video_id").agg(F.min(F.struct("json", reason.alias("error"))).alias("r"))
    said = second_pass.extract_response_text(first.select("video_id", "r.json", "r.error"))
    flagged = second_pass.flag_sentinel(said)
    note = (
        F.when(F.col("response").isNull(), F.format_string(_FAILED, F.coalesce("error", F.lit("not completed"))))
        .when(F.col("is_sentinel"), _NO_PERFORMER).otherwise("")
    )
    parsed = second_pass.parse_response_tracks(
        flagged.withColumn("note", note).withColumn("response", F.when(F.col("note") == "", F.col("response")))
    )
    return parsed.select("video_id", F.col("tracks").alias("model"), "note")


def choose_lists(candidates: DataFrame, local: DataFrame, model: DataFrame) -> DataFrame:
    """``video_id, source, tracks, note``: the model's list where it has rows, else the local one.

    Lists of either side may be missing; every candidate has a row.
    """
    pairs = second_pass.pair_lists(
        model.select("video_id", F.col("model").alias("tracks")), local.select("video_id", "tracks")
    )
    chosen = second_pass.choose_result(pairs)
    known = candidates.select("video_id").join(chosen, "video_id", "left").join(
        model.select("video_id", "note"), "video_id", "left"
    )
    note = F.coalesce("note", F.lit(_NOT_ASKED))
    by_model = F.coalesce(F.col("chosen") == "model", F.lit(False))
    return known.select(
        "video_id", F.when(by_model, "ai").otherwise("local").alias("source"), "tracks",
        F.when(by_model | (note == ""), "").otherwise(F.format_string(_LOCAL, note)).alias("note"),
    )


def run_once(
    inputs: Inputs, owner: str, run_id: str, mode: str = "incremental", wanted: DataFrame | None = None,
    limit: int = 0, dry_run: bool = True, require_artist: bool = False, path: str | None = None,
    run_at: Column | None = None,
) -> dict[str, DataFrame]:
    """Tables of one run: ``candidates, lists, results, segments, notices`` and the ledger.

    The model is heard only for videos with a setlist comment. With ``path`` results, ledger,
    segments and notices are written, a partition per run; running again replaces it. A
    dry run sends nothing and writes neither snapshot nor published keys.
    """
    at = F.current_timestamp() if run_at is None else run_at
    candidates = written(
        publish.select_candidates(inputs.videos, inputs.snapshot, inputs.published, mode, wanted, limit),
        "candidates",
    )
    mine = lambda table: table.join(candidates.select("video_id"), "video_id", "left_semi")
    comments = written(listed_comments(mine(inputs.comments)), "listed")
    lists = counted_lists(local_lists(comments, mine(inputs.descriptions)))
    asked = mine(inputs.responses).join(comments.select("video_id").distinct(), "video_id", "left_semi")
    chosen = choose_lists(candidates, select_best_source(lists), written(model_lists(asked), "model"))
    own = publish.own_state(mine(inputs.published_comments), owner)
    results = written(
        publish.decide(
            candidates, own, chosen, inputs.ignore, inputs.errors, dry_run=dry_run,
            require_artist=require_artist, run_id=run_id,
        ),
        "results",
    )
    texts = results.where("message <> ''").select("run_id", "video_id", "message")
    out = {
        "candidates": candidates, "lists": lists.drop(*COUNTS), "results": results,
        "segments": publish.segment_messages(texts),
        "notices": publish.notice_outbox(results, at).withColumn("run_id", F.lit(run_id)),
    }
    if path:
        for name in ("segments", "notices"):
            publish.write_run(out[name], f"{path}/{name}", run_id)
    return out | publish.close_run(
        results, inputs.published, inputs.videos, path, dry_run=dry_run, run_id=run_id, run_at=at
    )
