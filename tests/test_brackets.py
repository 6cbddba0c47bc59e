"""Bracket rules against plain patterns, and on long texts that hold little but brackets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import patterns as P
from cuesheet.functions import titles as T
from cuesheet.functions.brackets import closing_brackets, drop_notes
from cuesheet.functions.text import outside_brackets, strip, sub
from cuesheet.operators.rules import apply_title_rules
from cuesheet.operators.tracks import clean_artist_metadata, split_tracks

W = P.WS
RULES = {r.rule_id: r for r in T.DEFAULT_RULES}
END = rf"{W}*(?=/|\z)"
# what each rule says, as a pattern that searches from every opening
PLAIN = {
    "R06": rf"(?i){W}*[(（](?!.*{RULES['R06'].regex})[^)）]*(?:{W}|\|)[^)）]*[)）]{END}",
    "R07": rf"{W}*[（(](?:少し|練習|[0-9]+番のみ|short\.?)[）)]{END}",
    "R14": rf"{W}*[（(][ぁ-んァ-ヶー]+[）)]{END}",
    "R15": rf"{W}*[\[（(]{W}*(?:18|19|20|21)[0-9]{{2}}(?:{W}*[/.\-]{W}*[0-9]{{1,2}})?"
           rf"(?:{W}*[/.\-]{W}*[0-9]{{1,2}})?{W}*(?:年|月)?{W}*日?{W}*[\]）)]{W}*\z",
}


def texts(seed, parts, count=4000, most=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(count)]


def differing(spark, values, left, right):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(8)
    rows = df.select("v", left(F.col("v")).alias("a"), right(F.col("v")).alias("b"))
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).limit(5).collect()


@pytest.mark.parametrize(
    "rule,parts",
    [
        ("R06", ["(", ")", "（", "）", " ", "　", "|", "/", "a", "歌", "mix", "Live ", "\n", "xmix", "ver."]),
        ("R07", ["(", "）", " ", "　", "少し", "(練習)", "（2番のみ）", "/", "a", "\n", "(short)"]),
        ("R14", ["(", "）", "（", ")", " ", "　", "かな", "ナ", "/", "a", "（かな）"]),
        ("R15", ["(", "）", "[", "]", " ", "　", "2017", "/", "05", "3", "年", "月", "日", "a", " (2019/05/05)"]),
    ],
)
def test_rules_equal_their_plain_patterns(spark, rule, parts):
    values = texts(len(rule) + ord(rule[-1]), parts)
    new = lambda c: T.rule_step(c, RULES[rule])
    assert differing(spark, values, new, lambda c: sub(c, PLAIN[rule])) == []


def test_closing_bracket_is_the_partner(one):
    def partner(text):
        close = {")": "(", "）": "（", "]": "[", "］": "［"}
        if not text or text[-1] not in close:
            return None
        depth = 0
        for i in range(len(text) - 1, -1, -1):
            depth += (text[i] == text[-1]) - (text[i] == close[text[-1]])
            if depth == 0:
                blank = i > 0 and text[i - 1] in " 　"
                return (text[:i].strip(" 　"), text[i + 1 : -1].strip(" 　")) if blank else None
        return None

    values = [v.strip(" 　") for v in texts(5, ["(", ")", " ", "　", "a", "[", "]", "（", "歌", "）"], 1500, 14)]
    spaced = lambda c: closing_brackets(c, lambda r: F.concat_ws("\x01", F.get(r, F.lit(0))["before"], F.get(r, F.lit(0))["content"]))
    for text, got in zip(values, one(spaced, values), strict=True):
        want = partner(text)
        if want and want[0]:
            assert got == "\x01".join(want), text
        elif text[-1:] in (")", "）", "]", "］") and text:
            assert got.startswith("\x01"), text


def test_mask_hides_what_brackets_hold(one):
    def mask(text):
        out, depth = "", 0
        for ch in text:
            if ch in P.BRACKETS_OPEN:
                depth += 1
                out += "\x02"
            elif ch in P.BRACKETS_CLOSE:
                depth = max(0, depth - 1)
                out += "\x02"
            else:
                out += "\x02" if depth else ch
        return out

    values = texts(6, ["(", ")", "「", "」", "/", "a", " ", "歌", "[", "|"], 1500, 14)
    for text, got in zip(values, one(outside_brackets, values), strict=True):
        if any(ch in P.DELIMS for ch in text):
            shown = lambda m: [i for i, ch in enumerate(m) if ch in "/|"]
            assert len(got) == len(text) and shown(got) == shown(mask(text)), text


@pytest.mark.parametrize(
    "tail",
    ["Komatsu / Minoru", " A / B", "A /  / B", " a　/ b", " a / b　", "　A　/　B / C", " a /　/ b", " a / b c", "　 / ", " a b / 歌 c / d",
     " a\t/\tb", " / b", "  / b", " 　/ b"],
)
def test_alias_equals_its_plain_pattern(spark, tail):
    name = r"[A-Za-z0-9 .,'’\"!?&+_\-]+"
    held = rf"{name[1:-2]}{P.DELIMS}{W[1:-1]}"
    part = rf"(?>{name})"
    plain = (
        rf"(?s)^((?>.*[^{held}])[{held}]*?){W}+{part}(?:{W}*[{P.DELIMS}]{W}*{part})+{W}*$"
    )
    rng = random.Random(3)
    values = ["歌" + tail] + [
        "歌" + "".join(rng.choice(list(" 　/a|b") + [tail]) for _ in range(rng.randint(1, 7))) for _ in range(300)
    ]
    alias = lambda c: sub(c, T.ALIAS, "$1")
    assert differing(spark, values, alias, lambda c: sub(c, plain, "$1")) == []


LONG = 16_000
SHAPES = {
    "open": "(" * LONG,
    "open after blanks": " (a" * (LONG // 3),
    "mixed": "([（［" * (LONG // 4),
    "open, closed at the end": " (a b" * (LONG // 5) + ")",
    "nested": "歌" + " (a" * (LONG // 4) + ")" * (LONG // 4),
    "pairs": " (a b) x" * (LONG // 8),
    "guarded": " (live a" * (LONG // 8),
    "blanks": "a" + " " * LONG + "b",
    "year and blanks": "x (2017" + " " * LONG + "y",
    "readings": "（かな" * (LONG // 3),
    "slashes": " a /" * (LONG // 4),
    "stars": "a" + "★ " * (LONG // 2),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_long_texts_take_linear_time(spark, shape):
    """Sixteen thousand characters through the rules and the line split, half a second each."""
    rules = lambda v: apply_title_rules(spark.createDataFrame([(v,)], "song string")).collect()
    lines = lambda v: split_tracks(spark.createDataFrame([(f"1:02:03 {v} / x",)], "line string")).collect()
    for run in (rules, lines):
        times = []
        for value in ("warm (up)", "a (b", SHAPES[shape], SHAPES[shape]):
            start = time.time()
            run(value)
            times.append(time.time() - start)
        assert min(times[2:]) - times[1] < 0.5, (shape, times)


@pytest.mark.parametrize("shape", ["open after blanks", "blanks", "slashes", "year and blanks", "nested"])
def test_long_performers(spark, shape):
    run = lambda v: clean_artist_metadata(spark.createDataFrame([(v,)], "artist string")).collect()
    run("歌 (a b)")
    start = time.time()
    run("歌" + SHAPES[shape])
    assert time.time() - start < 5


def test_notes_over_lines(one):
    guard = RULES["R06"].regex
    got = one(lambda c: strip(drop_notes(c, guard)), ["a (b c)", "a (x live\n(b c)", "a (b\nlive c) d", "a (b\nc)", "a (live mix)"])
    assert got == ["a", "a (x live", "a (b\nlive c) d", "a", "a (live mix)"]
