import pytest
from pyspark.sql import functions as F

from cuesheet.functions import titles as T
from cuesheet.functions.text import seconds_of

RULES = {r.rule_id: r for r in T.DEFAULT_RULES}


def test_seconds(one):
    got = one(seconds_of, ["0:03:55", "1:00:55", "3:04", "0:75", "abc", "99:59:59", "61:00", "１：０５"])
    assert got == [235, 3655, 184, None, None, 359999, None, 65]


@pytest.mark.parametrize(
    "rule, before, after",
    [
        ("R01", "１・２・３", "1・2・3"), ("R01", "はじまり１（少し）", "はじまり1（少し）"),
        ("R10", "ＨＯＰＥ", "HOPE"), ("R02", "01. 'QQQQ' / KEN", "'QQQQ' / KEN"), ("R02", "7.45", "7.45"),
        ("R03", "〔11〕 PAPER DOLL", "PAPER DOLL"), ("R03", "〔雪〕", "〔雪〕"),
        ("R04", "└  Red Boots / MIKA", "Red Boots / MIKA"),
        ("R05", "'QQQQ'", "QQQQ"), ("R05", 'Isn\'t it "hazy"', 'Isn\'t it "hazy"'),
        ("R06", "深海賛歌 (Shinkai Sanka | Deep Sea Hymn)", "深海賛歌"), ("R06", "nao(hypergrid)", "nao(hypergrid)"),
        ("R07", "カルデラ（少し）", "カルデラ"), ("R07", "渡り鳥（2番のみ）", "渡り鳥"),
        ("R13", "12. 楓（かえで）", "楓（かえで）"), ("R14", "楓（かえで）", "楓"),
        ("R14", "星野カナタ(水瀬凛)", "星野カナタ(水瀬凛)"), ("R15", "Lumier (2017/03/09)", "Lumier"),
        ("R15", "村井渚 [2016年]", "村井渚"),
    ],
)
def test_rule(one, rule, before, after):
    assert one(lambda c: T.rule_step(c, RULES[rule]), [before]) == [after]


def test_rules_together(one):
    cases = {
        "01. カルデラ（少し）/ブランコ": "カルデラ / ブランコ",
        "2. 深海賛歌 (Shinkai Sanka | Deep Sea Hymn) / 小春ねる": "深海賛歌 / 小春ねる",
        "7.45 / *Nova": "7.45 / *Nova",
        'Isn\'t it "hazy" - 南高合唱部': 'Isn\'t it "hazy" - 南高合唱部',
        "Lumier (2017/03/09)": "Lumier",
        "01. SEA:LINE // Lumier": "SEA:LINE // Lumier",
        "ペンギン (Late Night Remix) / MOKA*31": "ペンギン (Late Night Remix) / MOKA*31",
        "1. 2. 3. 4. x": "3. 4. x",
        "7.45": "7.45",
    }
    assert one(T.apply_rules, list(cases)) == list(cases.values())


def test_slash_at_the_start_is_no_delimiter(one):
    assert one(T.apply_rules, ["/a (練習)/b", "/a"]) == ["/a/b", "/a"]


def test_bracket_suffix_of_any_depth(one):
    deep = lambda k: "曲 " + "".join(f"(n{i} " for i in range(k)) + "x" + ")" * k
    got = one(T.drop_latin_suffix, [deep(1), deep(3), deep(4), deep(5), deep(12), "曲(a (b (c (d))))", "曲 a (b (c) (d) (e)"])
    assert got == ["曲"] * 5 + ["曲(a (b (c (d))))", "曲 a (b (c) (d)"]


def test_dated_slash_after_many_blanks(one):
    (got,) = one(T.split_fields, ["歌3" + " " * 30 + "/5月/人"])
    assert got.song.startswith("歌3") and got.song.endswith("5月") and got.artist == "人"


def test_records_keep_readings_and_notes(spark):
    from cuesheet.operators.tracks import split_multifield

    df = spark.createDataFrame([("楓（かえで）／スキマ | x／アルバム／備考",)], "line string")
    got = split_multifield(df).collect()
    assert [(r.song, r.artist) for r in got] == [("楓（かえで）", "スキマ [x]")]


def test_rule_table_round_trip(spark):
    from cuesheet.operators.rules import load_rules, rules_table

    assert load_rules(rules_table(spark)) == T.DEFAULT_RULES


def fields(one, texts):
    return [None if r is None else (r.song, r.artist) for r in one(T.split_fields, texts)]


def test_split(one):
    got = fields(
        one,
        ["512/kana", "48日/GT", "透明標本Diver // 灯台P", "Who cares... - 星野カナタ(水瀬凛)",
         "a (b / c) / d", "a／b|c", "Xs-深海魚", "歌名 / x", "title / artist | album", "x [y / z",
         "A / B / C"],
    )
    assert got == [
        ("512", "kana"), ("48日", "GT"), ("透明標本Diver", "灯台P"), ("Who cares...", "星野カナタ(水瀬凛)"),
        # the bracket with blanks inside goes as a translation note
        ("a", "d"), ("a / b", "c"), None, None, ("title", "artist [album]"),
        # an unclosed bracket hides the slash from the bracket-aware steps only
        ("x [y", "z"), ("A", "B / C"),
    ]


def parsed(one, lines):
    return [None if r is None else (r.secs, r.song, r.artist) for r in one(T.parse_line, lines)]


def test_parse_line(one):
    got = parsed(
        one,
        ['1. 18:20 「灯々」 - ミナトアカリ ("Hihi" - Minato Akari)',
         '6. 1:25:10 「アカツキ」 - すズね("Akatsuki" - suzune)', "2. 31:07 「海鳥の子」 - ミナトアカリ",
         "5:40 01.distant shore / Velvetia", "『16:40』 paper moon engine / カラス",
         "0:04:20 01. マトリョシカ / 花咲ゆめ starring 大村千夏（アフタヌーン組。）",
         "0:15 幕開け / Opening", "0:15 START / someone", "no time / here", "1:00 宣伝）Zoom-UP!! / x",
         "99:99 a / b"],
    )
    assert got == [
        (1100, "灯々", "ミナトアカリ"), (5110, "アカツキ", "すズね"), (1867, "海鳥の子", "ミナトアカリ"),
        (340, "distant shore", "Velvetia"), (1000, "paper moon engine", "カラス"),
        (260, "マトリョシカ", "花咲ゆめ starring 大村千夏（アフタヌーン組。）"),
        None, (15, "START", "someone"), None, None, (None, "a", "b"),
    ]


HEADS = ["1:02:03 ", "12:34 ", "3. 0:15:00 ", "『15:10』", "[1:00] ", "2) 1:00 ", "0:30 04. ", "9:59 100. "]
NAMES = ["small ring", "恋", "Talk", "MC", "encore song", "op en", "告知の歌", "Melon!", "a", "朝を待つ", "1000s",
         "x (live)", "Re:start", "talk box", "終了後", "スタート", "Supplier#000000001", "A, B & C", "だれか", "  "]
DELIMS = [" / ", "/", " - ", "／", " ｜ ", "|", " // ", "-"]


def test_short_cut_equals_long_way(spark):
    """Plain lines take a short cut; it must not change one result."""
    rows = [
        (h + a + d + b,) for h in HEADS for a in NAMES for d in DELIMS for b in NAMES[::2]
    ]
    df = spark.createDataFrame(rows, "v string")
    both = df.select("v", T.parse_line(F.col("v")).alias("a"), T.parse_any_line(F.col("v")).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).limit(5).collect() == []
    names = spark.createDataFrame([(a + s + b,) for a in NAMES for s in ("", " ", "、") for b in NAMES], "v string")
    long_way = T.tidy_field(T.apply_rules(F.col("v")))
    differ = names.where(T.clean_field(F.col("v")) != long_way)
    assert differ.limit(5).collect() == []


def test_artist_metadata(one):
    got = one(
        T.clean_artist,
        ["大谷健人 1997/10/02 ほしぞら探検隊 オープニング", "DISH//", "柏木透 弾き語り", "HIRUNEZ【モデル】",
         "小松原ミノル Komatsu / Minoru", "Udo (2020/02/14)", "mako チャレンジ"],
    )
    assert got == ["大谷健人", "DISH//", "柏木透", "HIRUNEZ", "小松原ミノル", "Udo", "mako"]


def test_plain_numbered_lines_take_the_short_cut(one):
    """Lines in plain words need no candidates; notes, years and bad fields go the long way, with equal tracks."""
    from cuesheet.operators.tracks import numbered_any_line, numbered_line

    plain = [
        "0:15:07 #3 Part blue / Supplier#000012", "【3】夜に駆ける - A b", "1:02:03 ⟦3⟧ a/b", "[3] a／b", "(3) a | b",
        "3曲/a / b", "3, a / b", "3 - a / b", "3. a / b", "3。a / b", "3. 曲Part　blue Supplier_000012",
    ]
    other = [
        "3. a / b acoustic", "3. 曲 acoustic guitar", "3. 曲x Love Song", "3. a / 2020年5月1日", "3. a / b チャレンジ",
        "3. OP / ED", "3. a (cover) / b", "99:99 3. a / b", "3. アンコール　夜 b", "3 a / b", "0:15:07 a / b",
    ]
    found = one(lambda c: T.plain_numbered(c, lambda l: F.lit(None)), plain + other)
    assert [f is not None for f in found] == [True] * len(plain) + [False] * len(other)
    assert one(numbered_line, plain + other) == one(numbered_any_line, plain + other)


def test_plain_performers_skip_the_note_steps(spark, one):
    from cuesheet.functions import titles as T

    names = {"Supplier#1": "Supplier#1", "Supplier#1 1999/04/23 アニメ": "Supplier#1", "Supplier#1【作品】": "Supplier#1",
             "Supplier#1 弾き語り": "Supplier#1", "Supplier#1 Original Song": "Supplier#1", " a ※": "a", " x9 ": "x9", "X//": "X//"}
    assert one(T.clean_artist, list(names)) == list(names.values())
    assert one(T.drop_performance_notes, [" a 9 ", "a challenge ", "a ★挑戦枠", "a\t"]) == ["a 9", "a", "a", "a"]
    for name in ("Supplier#1", "small gear"):
        assert one(lambda c: c.rlike(T._PLAIN_PERFORMER), [name]) == [True]
    assert one(lambda c: c.rlike(T._PLAIN_PERFORMER), ["a 2020年", "a 初披露", "a acoustic"]) == [False] * 3
