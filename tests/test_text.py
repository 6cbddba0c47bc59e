import random

from pyspark.sql import functions as F

from cuesheet.functions import text as X
from cuesheet.operators import merge, text, tracks


def comments(spark, texts):
    return spark.createDataFrame(
        [(1, "comment", i, i, t) for i, t in enumerate(texts)],
        "video_id bigint, source string, source_pos bigint, comment_id bigint, text string",
    )


def test_normalize_is_idempotent(one):
    raw = "a \t b\r\n\r\n  c​d \r e　"
    once = one(X.normalize, [raw])
    assert once == ["a b\ncd\ne"]
    assert one(X.normalize, once) == once


def test_logical_lines(one):
    got = one(
        X.logical_lines,
        ["pre 1:00 x 2:00 y", "[1:23] a [2:34] b", "１：２３　x", "12:00 a 99:99 b",
         "1曲目 41:05~46:50「みずうみの灯／白木ユウ」", ""],
    )
    assert got == [
        ["pre", "1:00 x", "2:00 y"], ["[1:23] a", "[2:34] b"], ["1:23　x"], ["12:00 a 99:99 b"],
        ["1曲目 41:05~46:50「みずうみの灯／白木ユウ」"], [],
    ]


def test_bracket_mask(one):
    def mask(t):
        depth, out = 0, ""
        for ch in t:
            opening, closing = ch in "([{（［【「『《〈｢", ch in ")]}）］】」』》〉｣"
            out += "\x02" if depth and ch == "/" else ch
            depth = depth + 1 if opening else max(0, depth - 1) if closing else depth
        return out

    rng = random.Random(3)
    texts = ["a(b)c", "a(b]c", "a)b", "a(b", "😀(x)/y", "a(b(c)d)e", "x)(y)z"]
    texts += ["".join(rng.choice("a/ ()「」[😀") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = one(X.outside_brackets, texts)
    assert [len(g) for g in got] == [len(t) for t in texts]
    slashes = lambda t: [i for i, ch in enumerate(t) if ch == "/"]
    assert [slashes(g) for g in got] == [slashes(mask(t)) for t in texts]


def merged(spark, texts):
    df = merge.merge_timeline_lines(comments(spark, texts))
    out = {}
    for r in df.orderBy("comment_id", "item_pos").collect():
        out.setdefault(r.comment_id, []).append(r.line)
    return [out.get(i, []) for i in range(len(texts))]


def test_merge_forms(spark):
    got = merged(
        spark,
        [
            "7:19\n霧雨/kumoさん\n🎸 砂の塔 / 青い列車\n▶ 03:33\nMC",
            "1曲目 41:05~46:50「みずうみの灯／白木ユウ」\n2曲目：冬の路面電車 / 森野かおる\n(Fuyuno)\n14:00~15:30\n20:00 ab / cd",
            "1.\n3:04~\n5:00\n(Romaji Note)\n曲 / 人\n2.\n6:00 ~ 7:00\n曲2 / 人2\nchat",
            "第3曲：x / y\n1:00 ~\n2:00\nfoo / bar\n3:00\n",
            "0:08:31 ;\n雑談",
            # the song comes as the ninth line behind the number: too far
            "1.\n1:00\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n曲 / 人",
            "1.\n1:00\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n(aa bb)\n曲 / 人",
        ],
    )
    assert got == [
        ["7:19 霧雨/kumoさん", "03:33 🎸 砂の塔 / 青い列車"],
        ["41:05 みずうみの灯 / 白木ユウ", "14:00 冬の路面電車 / 森野かおる", "20:00 ab / cd"],
        ["3:04 曲 / 人", "6:00 曲2 / 人2"],
        ["1:00 x / y", "3:00 foo / bar"],
        [],
        # the number is dropped; the time line then takes the next line
        ["1:00 (aa bb)"],
        ["1:00 曲 / 人"],
    ]


def rows(spark, texts):
    lists = tracks.parse_setlists(comments(spark, texts))
    flat = tracks.explode_tracks(lists).orderBy("comment_id", "item_pos").collect()
    return [(r.comment_id, r.secs, r.song, r.artist) for r in flat]


def test_start_placeholder(spark):
    assert rows(spark, ["0:08:31 ;\n0:12:07 KITE / MioRa"]) == [(0, 511, "KITE", "MioRa")]


def test_wrapped_times(spark):
    text_ = "《Setlist》\n 『16:40』 paper moon engine / カラス\n 『21:05』 硝子の国と猫の歌 / カラス\n『2:03:44』Ｃパート"
    assert rows(spark, [text_]) == [
        (0, 1000, "paper moon engine", "カラス"), (0, 1265, "硝子の国と猫の歌", "カラス"),
    ]


def test_songlist_classifier(spark):
    texts = [
        "ひなげし 9:05\n波を数える 17:32\nオルガン 22:48\n坂道の途中で待っている 33:15",
        "今日もありがとう〜\n1:12:40 かえでさんの『北極星』すごく良いー\n最後の挨拶も楽しかったwww",
        "3:31 [開始]\n14:08 [雑談time☆]\n1:41:20 [あくび]",
        "2:58 開始~start~\n11:02 Hoshimeguri / Lantern\n29:17 ラムネ色 / Pado feat. 音羽ねね",
        "0:01 a / b 0:02 c / d", "1:00 Weekend / x\n2:00 Legend / y\n3:00 ok / z", None,
    ]
    got = text.classify_songlist_comments(comments(spark, texts)).orderBy("comment_id").collect()
    assert [r.is_songlist for r in got] == [True, False, False, True, False, False, False]


def test_range_lines_wide_and_strict(spark):
    df = spark.createDataFrame([("3:04 あ",), ("3:04~",), ("3:04 - 5:00",)], "line string")
    wide = [r.is_range for r in text.classify_lines(df).collect()]
    strict = [r.is_range for r in text.classify_lines(df, strict_range=True).collect()]
    assert wide == [True, True, False] and strict == [False, True, True]


def test_section(spark):
    t = "タイムライン\n0:10 a / b\n【セトリ】\n1:00 c / d\n2:00 e / f\n雑談\n3:00 g / h"
    got = text.select_setlist_section(comments(spark, [t, "1:00 c / d", "a\nセトリ"])).orderBy("comment_id")
    assert [r.lines for r in got.collect()] == [["1:00 c / d", "2:00 e / f"], ["1:00 c / d"], ["a", "セトリ"]]


def test_section_headings_of_any_width(spark):
    texts = ["雑談\n0:10 a / b\nＳＥＴＬＩＳＴ\n1:00 c / d", "0:10 a / b\nｾﾄﾘ\n1:00 c / d"]
    got = text.select_setlist_section(comments(spark, texts)).collect()
    assert [r.lines for r in got] == [["1:00 c / d"]] * 2


def test_section_headings_in_styled_letters(spark):
    """Headings are compared in their compatibility form, combined marks and all."""
    texts = [
        "雑談\n0:10 a / b\n🎵𝐒𝐞𝐭𝐥𝐢𝐬𝐭\n1:00 c / d\n雑談\n2:00 e / f", "0:10 a / b\nⓈⓔⓣⓛⓘⓢⓣ\n1:00 c / d",
        "0:10 a / b\n【セ\u200bトリ】\n1:00 c / d".replace("\u200b", ""), "0:10 a / b",
    ]
    got = text.select_setlist_section(comments(spark, texts)).orderBy("comment_id").collect()
    assert [r.lines for r in got] == [["1:00 c / d"]] * 3 + [["0:10 a / b"]]


def test_compatibility_form(spark):
    import random
    import unicodedata

    rng = random.Random(4)
    pool = [chr(c) for c in range(1, 0x1FBFF) if not 0xD800 <= c <= 0xDFFF]
    marks = ["か", "\u3099", "ｶ", "ﾞ", "é", "e", "\u0301", "㌔", "㈱", "½", "　", "가", "\u11a8", "a", " "]
    texts = ["".join(rng.choice(marks if rng.random() < 0.5 else pool) for _ in range(8)) for _ in range(3000)]
    texts += ["plain", "曲名 / 歌手", "", None, *(a + b for a in marks for b in marks)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in X.with_nfkc(df, "form", F.col("t")).collect():
        assert r.form == (None if r.t is None else unicodedata.normalize("NFKC", r.t)), ascii(r.t)


def test_width(one):
    assert one(X.fold_width, ["Ａｂ１！", "ｶﾞﾗｽﾊﾟﾝ", "ｾﾄﾘ　x", "plain", None]) == ["Ab1!", "ガラスパン", "セトリ x", "plain", None]


def test_rank_comments_without_times_keeps_order(spark):
    got = text.rank_comments(comments(spark, ["x", "y", "z"])).collect()
    assert {r.comment_id: r["rank"] for r in got} == {0: 1, 1: 2, 2: 3}


def test_numbered_and_shape(spark):
    t = comments(spark, ["#01 A / B\n【2】C / D\n(3) E / F\n3. G / H", "1. a / b\n4. c / d", "2. 日本の歌 Band"])
    lists = tracks.extract_numbered(t).cache()
    flat = tracks.explode_tracks(lists).orderBy("comment_id", "item_pos").collect()
    assert [(r.comment_id, r.num, r.song, r.artist) for r in flat] == [
        (0, 1, "A", "B"), (0, 2, "C", "D"), (0, 3, "E", "F"), (1, 1, "a", "b"), (1, 4, "c", "d"),
        (2, 2, "日本の歌", "Band"),
    ]
    shape = tracks.setlist_shape(lists).orderBy("comment_id").collect()
    assert [(r.n, r.is_contiguous, r.is_ascending) for r in shape] == [
        (3, True, True), (2, False, False), (1, False, False),
    ]


def test_lines_known_by_shape(one):
    from cuesheet.functions.text import let
    from cuesheet.operators import merge

    times = ["0:15:07", "15:07", "0:15:99", "0:15:995", "1:2", "99:59", "0:61:00", "１:02:03"]
    names = ["Song / Artist", "曲／歌手", "Mc / Talk", "encore a / b", "告知 / b", "a | b", "ab", "", "song - 告知♪",
             "編集中です / a", "丨ab / c", "第3曲 / b"]
    forms = ["{t}", "{t} {n}", "({t} {n})", "({t}) {n}", "[{t} {n}]", "[{t}] {n}", "『{t} {n}』", "12. {t} {n}", "{n}", "{t} ;",
             "{t}~", "{t} ~ 1:02:03", "▶ {t}", "▶{t} {n}", "3曲目：{n}", "3曲目 {t}~0:18:07「{n}」", "第3曲目: {n}", "({n})"]
    lines = sorted({f.format(t=t, n=n) for f in forms for t in times for n in names})
    lines += ["7", "7.", "7)", "1234.", "(Romaji Note)", "(mc)", "(a)", "()", "0:01 ab 告知♪", "(0:01 Romaji)", "- 0:01 ab"]
    slow = lambda l: let(
        text.line_flags(l), lambda f: F.to_json(F.struct(*[f[c].alias(c) for c in text.FLAG_COLUMNS]))
    )
    got, want = one(lambda l: F.to_json(text.line_classes(l)), lines), one(slow, lines)
    assert [x for x in zip(lines, got, want) if x[1] != x[2]] == []
    tag = lambda l: let(text.line_flags(l), merge._tagged)
    got, want = one(merge.tagged_line, lines), one(tag, lines)
    assert [x for x in zip(lines, got, want) if x[1] != x[2]] == []


def test_logical_text_and_plain_times(one):
    """The short ways of the rendition choice, next to the long ones."""
    rng = random.Random(11)
    parts = ["0:15", "1:02:03", "99:99", "1:02:033", "10:15:61", "１：２３", "12：30．", "\x01", " ", "  ", "\t", "\n", "\r\n",
             " ", "​", "　", "\x0b", "[0:30]", "『1:00』", "歌", "abc", "/", "1曲目 ", "~", ":", "7", "", "0:15 a 0:30 b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", None]
    found = one(X.logical_text, texts)
    assert found == one(lambda c: X.normalize(F.array_join(X.logical_lines(c), "\n")), texts)
    assert one(text.times_in_plain, found) == one(text.times_in, found)
    assert one(X.logical_text, ["a 0:15 b 0:30 c \x01 d"]) == ["a\n0:15 b\n0:30 c d"]


def test_bracket_mask_classes():
    """Runs outside brackets are tested by plain ranges only (negated classes take ten times as long)."""
    import re

    from cuesheet.functions import patterns as P

    brackets = P.BRACKETS_OPEN + P.BRACKETS_CLOSE
    found = P.other_set(brackets)
    assert not found.startswith("[^")
    spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", found)]
    held = set().union(*(range(a, b + 1) for a, b in spans))
    assert set(range(0x110000)) - held == {ord(ch) for ch in brackets}


def test_timed_lines_need_no_heading_key(spark):
    lines = ["0:15 セトリ", "♪ セトリ", "1:00 a / b", "雑談", "2:00 c / d"]
    got = text.select_setlist_section(comments(spark, ["\n".join(lines)]))
    assert [r.lines for r in got.collect()] == [["1:00 a / b"]]
    # the key of a line with a time is left out, here with an empty head
    cut = text.section_lines(F.array(*[F.lit(l) for l in lines]), F.array(*[F.lit("")] * 5))
    assert spark.range(1).select(cut).first()[0] == lines
