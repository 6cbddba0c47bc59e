"""A whole run: what it reads, counts and stores once, and the short cuts that its lists take."""

import datetime
import itertools
import os

from pyspark.sql import functions as F

from cuesheet import fixtures as fx
from cuesheet import registry
from cuesheet.functions import patterns as P
from cuesheet.functions import titles
from cuesheet.operators import sets
from cuesheet.operators.text import setlist_line_count
from cuesheet.plans import run
TEXT = "video_id string, source string, source_pos bigint, comment_id bigint, text string"


def test_two_runs_render_their_inputs_once(spark, tmp_path, monkeypatch):
    def store(name, shape, rows):
        spark.createDataFrame(rows, shape).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))

    store("region", "r_regionkey int", [(0,)])
    store("nation", "n_nationkey int, n_name string", [(0, "n")])
    store("customer", "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
          [(i, f"c{i}", 0, "m") for i in (5, 9, 14)])
    store("supplier", "s_suppkey bigint, s_name string", [(1, "Some One"), (2, "Other")])
    store("part", "p_partkey bigint, p_name string", [(i, f"tune {i}") for i in range(1, 8)])
    # video 5 has an own list of five, 9 is published, 14 is to be posted; orders 20 and 30 are of style 0
    store("orders", "o_orderkey bigint, o_custkey bigint, o_orderdate date",
          [(20, 14, datetime.date(2024, 1, 1)), (36, 5, datetime.date(2024, 1, 2)), (30, 9, datetime.date(2024, 1, 3))])
    store("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
          [(o, n, 1 + n % 2, n) for o in (20, 36, 30) for n in range(1, 6)])
    read = []
    items = fx.items
    monkeypatch.setattr(fx, "items", lambda *args: read.append(1) or items(*args))
    registry.load_all()
    got = registry.QUERIES["p10_full_run_written"](spark, str(tmp_path))
    assert len(read) == 1
    assert sorted(tuple(r) for r in got.collect()) == [
        ("notices", "14", 1), ("published", "14", 1), ("published", "9", 1), ("runs", "already_posted", 1),
        ("runs", "posted", 1), ("segments", "14", 1),
    ]


def test_lines_are_counted_once(spark):
    rows = [("v", "comment", 1, 1, "0:01 one / a\n0:02 two / b"), ("v", "comment", 2, 2, "0:01 talk\n0:02 two / b")]
    listed = run.listed_comments(spark.createDataFrame(rows, TEXT))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [tuple(r)[:4] for r in listed.collect()] == [("v", "comment", 1, 1)]


def test_counted_lists_are_not_written_again(lists, monkeypatch):
    made = lists({1: [(1, "s", "a", None), (2, "t", "b", None)], 2: [(1, "u", "", None)]})
    counted = sets.counted_lists(made)
    stored = []
    write = sets.written
    monkeypatch.setattr(sets, "written", lambda df, name: stored.append(name) or write(df, name))
    best = sets.select_best_source(counted)
    assert stored == ["winners"] and best.columns == made.columns
    assert sorted(r.video_id for r in best.collect()) == [1, 2]


def test_words_are_found_in_any_case_as_by_the_flags(spark):
    every = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    texts = [f.replace("_", c) for f in ("tal_", "clo_e", "t_mestamp", "_tart", "x お_ y", "M_") for c in every]
    odd = ("ki", "é", "straße", "a.b", "Σ")
    texts += ["" , "KI", "kİ", "ÉCLAIR", "STRASSE", "STRAẞE", "aXb", "A.B", "ς", "σ", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (P.MARKER_WORDS, odd, odd[:1], ("日", "k"), (), ("", "a")):
        same = F.col("t").rlike(rf"(?iu){P.words(words)}") == F.col("t").rlike(P.holds_word(words))
        assert df.where(~same).collect() == []


def test_lines_end_at_any_break(one):
    breaks = ["\r\n", "\n", "\x0b", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\n\r", "\r\r\n"]
    values = [f"a{b}b{c}c" for b, c in itertools.product(breaks, repeat=2)] + ["a\x1fb", "a‧b", "a‪b", "", "\r\n"]
    old = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    assert one(lambda c: F.split(c, P.LINE_BREAK), values) == one(lambda c: F.split(c, old), values)
    timed = ["0:01 a\n1:0:02 b", "x0:01 a\n:0:02 b", "0:011 a\n0:02", "0:01 mc\n0:02 b", "0:01 a\n 0:02 b"]
    assert one(setlist_line_count, timed) == [1, 1, 0, 1, 2]


def test_noted_titles_are_parsed_as_the_long_way(one):
    heads = ("0:15:01 ", "1. 0:15:01 ", "【0:15:01】", "0:15:01 04. ", "0:99 ", "")
    names = ("cold gear", "夢 の 歌", "short", "encore", "mc", "open", "a", "12", "DISH//", "ロキ!", "年 2020", "x.y")
    notes = ("(練習)", " (練習)", " （うろ覚え）", "　(少し)", "  (2番のみ)", " (２番のみ)", "(short.)", " (short)", " (ゆめ)",
             "（ユメー）", " (live)", " (練習", " 練習)", " (練習) (途中まで)", "\t(練習)", " (Rock)", " (夢)", " (お知らせ)", "")
    ends = (" / Supplier#0012さん", "/A b", " - x", "／y", "|z", " / open", " / (練習)", " // b", " / a (練習)", "")
    lines = ["".join(p) for p in itertools.product(heads, names, notes, ends)]
    assert one(titles.parse_line, lines) == one(titles.parse_any_line, lines)
    short = ["0:15:01 cold gear (練習) / Supplier#0012さん", "【0:15:01】夢（ユメー）／y", "0:15:01 04. a(2番のみ) - x"]
    assert all("\x02" in p for p in one(titles._plain_parts, short))


def test_notes_do_not_merge_lines(spark):
    from cuesheet.operators import tracks

    rows = [("v", "comment", i, i, t) for i, t in enumerate([
        "0:01 one (練習) / a さん\n0:02 two（ゆめ） / b", "0:01 one (練習) / a\nnot a song\n0:02 two / b",
        "0:01 one (練習) / a\n0:02\ntwo (少し) / b"])]
    got = tracks.parse_setlists(spark.createDataFrame(rows, TEXT)).orderBy("comment_id").collect()
    assert [[(t.secs, t.song) for t in r.tracks] for r in got] == [[(1, "one"), (2, "two")]] * 3


def test_display_of_equal_and_polite_entries(lists):
    made = lists({
        1: [(5, "s", "山 田さん", None), (5, "S", "山田さん", None), (9, "t", "b 氏 ", None), (9, "t", "c様", None)],
        2: [(1, "s", "a b", None), (2, "s", "a b", None)],
        3: [(None, "s", "a", None), (None, "s", "a", None), (3, "u", " x ", None), (3, "U", "x", None)],
    })
    got = {r.video_id: [(t.secs, t.song, t.artist) for t in r.tracks] for r in sets.normalize_display(made).collect()}
    assert got == {
        1: [(5, "s", "山田"), (9, "t", "b"), (9, "t", "c")], 2: [(1, "s", "a b"), (2, "s", "a b")],
        3: [(None, "s", "a"), (None, "s", "a"), (3, "u", "x")],
    }
