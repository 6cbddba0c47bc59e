import random

from pyspark.sql import functions as F

from cuesheet.functions import skew
from cuesheet.operators import rules, second_pass, sets, tracks
from cuesheet.plans import publish


def flat(df):
    out = {}
    for r in tracks.explode_tracks(df).orderBy("video_id", "item_pos").collect():
        out.setdefault(r.video_id, []).append(r)
    return out


def test_honorifics_and_kanji(lists):
    df = lists({1: [(1, "a", "歌手さん"), (2, "b", "歌手さん"), (3, "c", "歌手様"), (4, "d", "森 花子")],
                2: [(1, "a", "歌手さん"), (2, "b", "Always cold river")]})
    got = flat(sets.squeeze_kanji(sets.strip_honorifics(df)))
    assert [r.artist for r in got[1]] == ["歌手", "歌手", "歌手", "森花子"]
    assert [r.artist for r in got[2]] == ["歌手さん", "Always cold river"]


def test_dedupe_is_idempotent(lists):
    df = lists({1: [(10, "a", "A"), (10, "A!", "a"), (20, "b", "B"), (None, "a", "A"), (None, "a", "A"), (10, "a", "")]})
    once = sets.dedupe_tracks(df)
    assert [(r.secs, r.song) for r in flat(once)[1]] == [(10, "a"), (20, "b"), (None, "a"), (None, "a"), (10, "a")]
    assert flat(sets.dedupe_tracks(once)) == flat(once)


def test_near_duplicates(lists):
    df = lists({
        1: [(30, "chat", "x"), (32, "song", "y", 5), (34, "again", "z", 6), (60, "other", "w")],
        2: [(10, "a", "A"), (11, "b", "B")], 3: [(None, "n", "N"), (5, "c", "C", 1)],
    })
    got = flat(sets.dedupe_near(df))
    assert [r.song for r in got[1]] == ["song", "other"]
    assert [r.song for r in got[2]] == ["a", "b"]
    assert [r.song for r in got[3]] == ["n", "c"]


def brute_near(ts, tol=2):
    timed = sorted((t[0], i) for i, t in enumerate(ts) if t[0] is not None)
    lost, group = set(), []
    for j, (s, i) in enumerate(timed):
        if group and s - timed[j - 1][0] > tol:
            group = finish(group, ts, lost)
        group.append(i)
    finish(group, ts, lost)
    return [t[1] for i, t in enumerate(ts) if i not in lost]


def finish(group, ts, lost):
    numbered = [i for i in group if ts[i][3] is not None]
    if numbered:
        lost.update(i for i in group if i != numbered[0])
    return []


def test_near_duplicates_against_brute_force(lists):
    rng = random.Random(7)
    data = {
        v: [(rng.choice([None, *range(0, 40, 1)]), f"s{i}", "a", rng.choice([None, None, i])) for i in range(rng.randint(1, 25))]
        for v in range(1, 60)
    }
    got = flat(sets.dedupe_near(lists(data)))
    assert {v: [r.song for r in rows] for v, rows in got.items()} == {v: brute_near(ts) for v, ts in data.items()}


def test_format(lists):
    df = lists({1: [(10, "a", "A"), (5, "b", "B"), (None, "c", ""), (3700, "d", "D")]})
    message = sets.format_setlists(df).collect()[0].message
    assert message == "0:00:05 01. b - B\n0:00:10 02. a - A\n1:01:40 03. d - D\n04. c"
    back = sets.parse_rendered(sets.format_setlists(df)).orderBy("line_no").collect()
    assert [r.secs for r in back] == [5, 10, 3700]
    short = sets.format_setlists(lists({1: [(65, "a", "A")]}), style="short").collect()[0].message
    assert short == "1:05 01. a - A"
    many = sets.format_setlists(lists({1: [(i, "s", "a") for i in range(100)]})).collect()[0].message
    assert many.startswith("0:00:00 001. s - a")


def test_best_source(lists):
    df = lists({1: [(1, "a", "A")], 2: [(1, "a", "A"), (2, "b", "")], 3: [(1, "a", "A"), (2, "b", "B")], 4: []})
    same = df.withColumn("video_id", F.lit(9).cast("bigint"))
    assert sets.select_best_source(same).collect()[0].comment_id == 3
    tie = same.withColumn("source", F.when(F.col("comment_id") == 3, "description").otherwise("comment")).withColumn(
        "tracks", F.transform("tracks", lambda t: t.withField("artist", F.lit("x")))
    )
    assert sets.select_best_source(tie).collect()[0].comment_id == 2
    assert sets.select_best_source(df.where("comment_id = 4")).collect() == []


def test_duplicate_messages(spark):
    df = spark.createDataFrame(
        [(1, "01. ＡＢ - c"), (2, "1. ab-C"), (3, ""), (4, "other"), (5, None)], "id bigint, message string"
    )
    got = {r.id: (r.kept, r.dup_of) for r in sets.dedupe_setlists(df, "id").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_skewed_groups(spark):
    """One key holds two thirds of the rows; results match the plain join and window."""
    rows = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50))).alias("k"),
        F.xxhash64("id").alias("v"),
    )
    groups = rows.groupBy("k").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    got = skew.attach_groups(rows, groups, ["k"], "n", ["id"], hot_groups=2)
    want = rows.join(groups, "k").select("id", "k", "v", "low", "n")
    assert got.exceptAll(want).count() == 0 and got.count() == 6000
    ranked = skew.ranked(rows, ["k"], ["id"], "rank")
    from pyspark.sql import Window

    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    assert ranked.exceptAll(plain).count() == 0 and ranked.count() == 6000


def test_segments(spark):
    lines = [f"0:{i:02d}:00 {i + 1:02d}. 行を埋める曲 - 行を埋める人" for i in range(59)]
    exact = ["x" * 449, "y" * 449, "z" * 448, "w" * 1200, "v"]
    df = spark.createDataFrame(
        [(1, "\n".join(lines)), (2, "\n".join(exact)), (3, "a\n\n b \n"), (4, "")], "video_id int, message string"
    )
    out = {}
    for r in publish.segment_messages(df).orderBy("video_id", "seg_no").collect():
        out.setdefault(r.video_id, []).append(r)
    assert len(out[1]) >= 2 and all(len(r.text) <= 900 for r in out[1])
    assert "\n".join(r.text for r in out[1]) == "\n".join(lines)
    assert [r.is_root for r in out[1]] == [True] + [False] * (len(out[1]) - 1)
    # 450 + 450 fits exactly; a longer line stands alone
    assert [len(r.text) for r in out[2]] == [899, 448, 1200, 1]
    assert [r.text for r in out[3]] == ["a\n b "] and 4 not in out


def test_own_rows(one):
    got = one(
        publish.own_lines,
        ["0:05:12 01. まほうのパレード!! - 歌手\n0:08:40 02. Hand in hand - はるのみちえ", "1:12:40 01. 北極星 - x",
         "0:15:09 Dragon-Fly / 大谷健人", None],
    )
    assert got == [2, 1, 0, 0]


def test_own_comment(spark):
    rows = [("v", 1, "r1", "7", "0:01:00 01. a - b"), ("v", 2, "r2", "42", "hello"), ("v", 3, "r3", "42", "0:01:00 01. a - b"),
            ("w", 1, "r4", "7", "x")]
    df = spark.createDataFrame(rows, "video_id string, pos int, rpid string, mid string, message string")
    assert [tuple(r) for r in publish.own_state(df, "42").collect()] == [("v", "r2", 0)]


def test_close_run_writes(spark, tmp_path):
    results = spark.createDataFrame(
        [("r1", "v1", "posted", "m"), ("r1", "v2", "error", "")], "run_id string, video_id string, status string, message string"
    )
    old = spark.createDataFrame([("v0",)], "video_id string")
    videos = spark.createDataFrame([("v1", "p"), ("v2", "p")], "video_id string, raw_part string")
    publish.close_run(results, old, videos, str(tmp_path), dry_run=True)
    assert not (tmp_path / "published").exists() and (tmp_path / "runs").exists()
    publish.close_run(results, old, videos, str(tmp_path), dry_run=False)
    assert {r.video_id for r in spark.read.parquet(str(tmp_path / "published")).collect()} == {"v0", "v1"}


def test_closing_a_run_again_replaces_it(spark, tmp_path):
    schema = "run_id string, video_id string, status string, message string"
    videos = spark.createDataFrame([("v1", "p"), ("v2", "p")], "video_id string, raw_part string")
    old = spark.createDataFrame([("v0",)], "video_id string")
    for run, status in (("r1", "posted"), ("r2", "ignored"), ("r1", "posted")):
        results = spark.createDataFrame([(run, "v1", status, "m"), (run, "v2", "error", "")], schema)
        publish.close_run(results, old, videos, str(tmp_path), dry_run=False)
    runs = spark.read.parquet(str(tmp_path / "runs")).select("run_id", "status", "videos", "total").collect()
    assert sorted(map(tuple, runs)) == [
        ("r1", "error", 1, 2), ("r1", "posted", 1, 2), ("r2", "error", 1, 2), ("r2", "ignored", 1, 2),
    ]
    assert spark.read.parquet(str(tmp_path / "video_results")).count() == 4
    assert spark.read.parquet(str(tmp_path / "video_snapshots")).where("run_id = 'r1'").count() == 2


def test_published_keys_are_stored_once(spark, tmp_path):
    schema = "run_id string, video_id string, status string, message string"
    videos = spark.createDataFrame([("v1", "p")], "video_id string, raw_part string")
    old = spark.createDataFrame([("v0",)], "video_id string")
    for run, video in (("r1", "v1"), ("r2", "v2"), ("r3", None), ("r1", "v1")):
        results = spark.createDataFrame([(run, video, "posted", "m")] if video else [], schema)
        publish.close_run(results, old, videos, str(tmp_path), dry_run=False, run_id=run)
        old = spark.read.parquet(str(tmp_path / "published")).select("video_id")
    stored = [tuple(r) for r in spark.read.parquet(str(tmp_path / "published")).collect()]
    assert sorted(stored) == [("v0", "r1"), ("v1", "r1"), ("v2", "r2")]


def test_a_run_with_no_rows_leaves_none_behind(spark, tmp_path):
    schema = "run_id string, video_id string, status string, message string"
    videos = spark.createDataFrame([("v1", "p")], "video_id string, raw_part string")
    for rows in ([("r1", "v1", "posted", "m")], []):
        results = spark.createDataFrame(rows, schema)
        publish.close_run(results, videos.select("video_id").limit(0), videos, str(tmp_path), run_id="r1")
    assert spark.read.parquet(str(tmp_path / "video_results")).count() == 0


def test_choice_tells_how_a_list_came_about(spark):
    from cuesheet.plans import run

    said = [
        ("a", '{"choices":[{"message":{"content":"0:01:00 01. x - y"}}]}', None),
        ("b", '{"choices":[{"message":{"content":"请提供歌手信息后再处理。"}}]}', None),
        ("c", None, "timeout"), ("d", '{"status":"failed","output_text":"01. z"}', None),
        ("e", '{"choices":[{"message":{"content":"no list"}}]}', None),
    ]
    model = run.model_lists(spark.createDataFrame(said, "video_id string, json string, error string"))
    track = "array<struct<item_pos:int,num:int,secs:int,label:string,song:string,artist:string>>"
    local = spark.createDataFrame([(v, [(1, 1, 5, "", "l", "m")]) for v in "abcd"], f"video_id string, tracks {track}")
    videos = spark.createDataFrame([(v,) for v in "abcdef"], "video_id string")
    got = {r.video_id: (r.source, len(r.tracks or []), r.note) for r in run.choose_lists(videos, local, model).collect()}
    assert got == {
        "a": ("ai", 1, ""), "b": ("local", 1, "本地兜底（AI 判定缺歌手）"),
        "c": ("local", 1, "本地兜底（AI 整理失败: timeout）"), "d": ("local", 1, "本地兜底（AI 整理失败: not completed）"),
        "e": ("local", 0, ""), "f": ("local", 0, "本地兜底（评论区无结构化歌单（不调 DS））"),
    }


def test_rule_proposals_of_both_shapes(spark):
    said = [
        'Text [1] first {"rules": [{"category": "c", "regex": "x", "description": "d", "protection": ["p"],'
        ' "examples": [{"input": "a", "output": "b"}]}], "notes": ["n"]}',
        '[{"function": "f", "kind": "update_regex", "old_regex": "o", "new_regex": "w", "tests": [{"input": "i"}]}]',
        "no json", "[broken", '{"rules": [', None, "[]",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "id int, response string")
    got = rules.collect_rule_proposals(df, "id").collect()
    seen = sorted((r.id, r.category or r.function or "", r.note or "") for r in got)
    assert seen == [
        (0, "", "n"), (0, "c", ""), (1, "f", ""), (2, "", "no JSON object"), (3, "", "no JSON object"),
        (4, "", "no JSON object"), (5, "", "no JSON object"),
    ]
    full = next(r for r in got if r.category == "c")
    assert (full.description, full.protection, full.examples[0].output) == ("d", ["p"], "b")
    assert next(r for r in got if r.function).tests[0].input == "i"


def test_requests_have_one_shape(spark):
    rows = [("v", i, "t%05d" % i) for i in range(1500)] + [("w", 0, "only")]
    df = spark.createDataFrame(rows, "video_id string, source_pos bigint, text string")
    got = {r.video_id: r for r in second_pass.build_requests(df, "T:").collect()}
    assert got["v"].n_comments == 1500 and got["v"].request.startswith("T:\nt00000\n\n---\n\nt00001")
    assert got["w"].request == "T:\nonly"
    parts = second_pass.build_requests(df, "T:", part_size=1000).orderBy("video_id", "part_no").collect()
    assert [p.n_comments for p in parts] == [1000, 500, 1] and all(p.request.startswith("T:\n") for p in parts)


def test_batches_over_text_keys(spark):
    df = spark.createDataFrame([(f"BV{i:03d}",) for i in range(25)], "video_id string")
    got = second_pass.batch_samples(df, "video_id").orderBy("video_id").collect()
    assert [(r.sample_no, r.batch_no) for r in got] == [(i + 1, i // 9) for i in range(25)]


def test_wide_letters_compare_equal(lists):
    merged = second_pass.reconcile(second_pass.pair_lists(
        lists({1: [(1, "Ｂｌｕｅ", "ｾﾝ")]}), lists({1: [(1, "Ｂｌｕｅｓ", "セン ")]})
    )).collect()
    assert [(r.song, r.song_reason) for r in merged] == [("Ｂｌｕｅ", "model:latin_tail")]


def test_styled_letters_compare_equal(lists):
    source = lists({1: [(1, "𝐁𝐥𝐮𝐞!", "㍿ x"), (2, "冬（原曲㈱）", "é")]})
    model = lists({1: [(1, "Blue", "株式会社 x"), (2, "冬", "e\u0301")]})
    merged = second_pass.reconcile(second_pass.pair_lists(model, source)).orderBy("item_pos").collect()
    assert [(r.song, r.song_reason) for r in merged] == [
        ("𝐁𝐥𝐮𝐞!", "source:fuller_spelling"), ("冬（原曲㈱）", "source:bracket_suffix"),
    ]
    pairs = second_pass.pair_lists(model, source)
    (row,) = second_pass.choose_result(pairs, "strict").collect()
    assert row.chosen in ("merged", "source") and "_model" not in row.asDict()


def test_numbered_source_wins(spark, lists):
    model = lists({1: [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]})
    source = lists({1: [(1, "a", "A"), (2, "b", "B")]})
    pairs = second_pass.pair_lists(model, source).withColumn("flag", F.lit(True))
    assert second_pass.choose_result(pairs, "strict", numbered="flag").collect()[0].chosen == "source"
    assert second_pass.choose_result(pairs.drop("flag"), "strict").collect()[0].chosen == "model"


def test_response_lines(spark):
    text = (
        "0:03:26 01. マトリョシカ - 花咲ゆめ starring 大村千夏（アフタヌーン組。）\n\n0:05:12 02. Hand in hand - はるのみちえ\n"
        "03. 有効曲 - 歌手\n0:20:00 05. paper moon engine\n0:01:00 01. 曲 - 未記載\n0:01:00 01. Isn't it \"hazy\" - 南高合唱部\n"
        "no number - x\n0:01:00 02. 「題」 / 人\n0:01:00 03. \"q\" - r"
    )
    df = spark.createDataFrame([(1, text)], "video_id int, response string")
    got = tracks.explode_tracks(second_pass.parse_response_tracks(df)).orderBy("item_pos").collect()
    assert [(r.secs, r.song, r.artist) for r in got] == [
        (206, "マトリョシカ", "花咲ゆめ starring 大村千夏（アフタヌーン組。）"), (312, "Hand in hand", "はるのみちえ"),
        (None, "有効曲", "歌手"), (1200, "paper moon engine", ""), (60, "曲", ""), (60, 'Isn\'t it "hazy"', "南高合唱部"),
        (60, "題", "人"), (60, "q", "r"),
    ]


def test_reconcile_reasons(lists):
    source = lists({1: [(10, "冬の路面電車のうた", "森野かおる"), (20, "雨宿り（弾き語り）", "柏木透"), (30, "Blue!", "Udoo"), (40, "1:23 x", "a")]})
    model = lists({1: [(11, "Fuyu no Romen", "森野かおる"), (21, "雨宿り", "柏木�"), (31, "Blue", "Udo"), (41, "x", "")]})
    merged = second_pass.reconcile(second_pass.pair_lists(model, source)).orderBy("item_pos").collect()
    assert [(r.secs, r.song, r.song_reason) for r in merged] == [
        (10, "冬の路面電車のうた", "source:japanese_name"), (20, "雨宿り（弾き語り）", "source:bracket_suffix"),
        (30, "Blue!", "source:fuller_spelling"), (40, "x", "model:time_in_source"),
    ]
    assert [(r.artist, r.artist_reason) for r in merged] == [
        ("森野かおる", "model:equal"), ("柏木透", "source:broken_character"), ("Udo", "model:latin_tail"), ("a", "source:model_empty"),
    ]


def test_gate(spark):
    cases = spark.createDataFrame(
        [("0:01 x / y", "x", "y"), ("カルデラ（少し）", "カルデラ", ""), ("DISH//", "DISH//", "")],
        "input string, expect_song string, expect_artist string",
    )
    from cuesheet.functions.titles import DEFAULT_RULES, Rule

    eager = DEFAULT_RULES + (Rule("X", 99, "x", "delete_suffix", "ラ$", scope="song"),)
    got = {r.rule_set: (r.failures, r.passed) for r in rules.check_rules({"a": DEFAULT_RULES, "b": eager}, cases).collect()}
    assert got == {"a": (0, True), "b": (1, False)}


def test_plain_texts_take_the_long_way_too(one):
    from cuesheet.functions.titles import TRACK_TYPE, parse_plain_text
    from cuesheet.operators.tracks import merged_tracks, numbered_any_line, numbered_line

    plain = ["0:15:07 1. Song / Artist", "12) 15:07 曲 - 歌い手", "[0:15] a|b", "1:02:03 Song 2 / Artist #3"]
    odd = ["0:15:07", "0:15:07 a  / b", "Song / Artist", "0:15:99 a / b", "0:15 end / a", "0:15 a / 告知", "",
           " 0:15 a / b", "0:15 a / b 0:16 c / d", "3曲目：a / b", "0:15 a\u3000b / c", "0:15 a / \x02b", "1. 0:15 x",
           "0:15 #3 a / b", "0:15 a / b ", "0:15 1, a / b", "0:15 mc / talk", "１:02:03 a / b", "0:15 Re: a / b"]
    texts = ["\n".join(plain), *plain, *odd, None]
    texts += [f"{x}\n{y}" for x in plain[:2] + odd for y in plain[1:3] + odd]
    # what the first line means may hang on the second: only texts of plain lines are cut short
    taken = one(lambda t: F.size(parse_plain_text(t, F.array().cast(f"array<{TRACK_TYPE}>"))), texts)
    assert taken[:5] == [4, 1, 1, 1, 1] and max(taken[5:24]) <= 0
    got = one(lambda t: F.to_json(parse_plain_text(t, merged_tracks(t))), texts)
    want = one(lambda t: F.to_json(merged_tracks(t)), texts)
    assert [x for x in zip(texts, got, want) if x[1] != x[2]] == []
    lines = [x for x in plain + odd if "\x02" not in x]
    got, want = (one(lambda l: F.to_json(f(l)), lines) for f in (numbered_line, numbered_any_line))
    assert [x for x in zip(lines, got, want) if x[1] != x[2]] == []
