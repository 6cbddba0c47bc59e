"""Regular-expression building blocks shared by every text operator.

All patterns use Java syntax.  White space is spelled out, because Java's ``\\s``
is ASCII only and the texts are full of U+3000 and U+00A0.
"""

from __future__ import annotations

import string

# --- white space -----------------------------------------------------------
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# one property test instead of a chain of ranges; the four separators complete the set
WS_SET = r"\p{IsWhite_Space}\x1C-\x1F"
WS = f"[{WS_SET}]"
# one test a character: alternatives and single characters beyond Latin-1 are tried one by one
LINE_BREAK = r"[\n\x0B\f\r\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}](?:(?<=\r)\n)?+"

# --- characters and scripts -------------------------------------------------
ASCII_LETTERS = string.ascii_letters  # spelled out in a set, they are tested at once
JAPANESE = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
CJK_RUN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
KANJI = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
WORD = r"[\p{L}\p{N}_]"
# fixed values: ranges of picture characters
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"
)
LEAD_SET = WS_SET + r"\x{FE0F}\x{200E}\x{200F}\x{2060}"
LEAD_CHARS = WS_CHARS + "\ufe0f\u200e\u200f\u2060"
DASHES = r"\-—–−"
PIPES = r"|｜￤∣丨"
DELIMS = r"/／" + PIPES

# --- in-video times ----------------------------------------------------------
TS = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
# same shape, with the value limits: minutes and seconds below 60
TS_VALID = (
    r"(?:[0-9]{1,2}:[0-5][0-9]:[0-5][0-9](?![0-9])"
    r"|[0-5]?[0-9]:[0-5][0-9](?![0-9])(?!:[0-9]{2}(?![0-9])))"
)
TS_OPEN = r"[\[【(（『]"
TS_CLOSE = r"[\]】)）』]"
RANGE_MARK = r"[~～〜\-－—–−]"
# range mark as really accepted for whole range lines: U+301C..U+FF0D is one range
RANGE_MARK_WIDE = r"[~～\x{301C}-\x{FF0D}—–−]"

# --- brackets (fixed values) --------------------------------------------------
BRACKETS_OPEN = "([{（［【「『《〈｢"
BRACKETS_CLOSE = ")]}）］】」』》〉｣"
RULE_BRACKETS_OPEN = "([{（［【「『《〈"
RULE_BRACKETS_CLOSE = ")]}）］】」』》〉"

# --- Latin annotations ----------------------------------------------------------
# fixed values: characters of a romanised note
LATIN_INNER = (
    r"[A-Za-zÀ-ÖØ-öø-ÿ\x{0100}-\x{024F}0-9 .,:'’\"“”&+_\-/!?~～#＃♯♭★☆♪♫♡♥◎･=×∞]"
)
LATIN_ANY = LATIN_INNER[:-1] + r"()\[\]（）［］]"
# words that mark a bracket as musical information (fixed values)
QUALIFIER = (
    rf"(?i:(?<!{WORD})(?:feat|ft|ver|version|mix|remix|edit|size|inst(?:rumental)?"
    rf"|off{WS}*vocal|live|solo|duet|acoustic|arrange|cover|chorus|short|full|tv|anime"
    rf"|movie|op|ed|from|single|album|demo|self[{WS_SET}\-]?cover|piano|guitar)(?!{WORD}))"
)

# --- line decorations --------------------------------------------------------
# fixed values: line decorations
TREE = (
    rf"[{LEAD_SET}]*(?:[├└┣┗┝┖│┃┆┇┊┋]+|[>＞]+|[\-－—–−]+|[・･●○◆◇■□]+){WS}*"
)
ICON_MARKS = r"[♪♫♬♩]"
TIME_ICONS = r"[♪♫♬♩▶▷►▸▹>|・･●○◆◇■□]"
TRAIL_MARKS = r"[♪♫♬♩♡♥★☆⭐✨❄☂]"
QUOTE_OPEN = r"[「『｢《〈【]"
QUOTE_CLOSE = r"[」』｣》〉】]"

# --- word lists (fixed values) --------------------------------------------------
# words that turn a timed line into a marker line, matched anywhere in the line
MARKER_WORDS = (
    "開始", "开始", "start", "終了", "end", "opening", "open", "closing", "close", "mc",
    "雑談", "talk", "感想", "告知", "お知らせ", "チャプター", "chapter", "セトリ", "setlist",
    "タイムスタンプ", "timestamp", "スクショ", "挨拶", "自己紹介", "コメント", "おつ", "お疲れ",
    "ありがとう", "宣伝", "休憩", "トイレ", "お水", "スパチャ読み", "リクエスト募集", "あくび",
    "助かる", "てぇてぇ",
)
# whole-field words that are never a title or a performer
BAD_FIELD_WORDS = ("歌名", "歌手", "编号", "未确定")
TALK_WORDS = ("talk", "mc", "雑談", "聊天", "感想", "开场", "结束", "告知", "返场", "休息")
NON_SONG_TALK = ("talk", "mc", "雑談", "聊天", "感想", "告知", "返场", "休息")
NON_SONG_EDGES = ("開始", "结束", "終了", "end", "start")
SECTION_WORDS = (
    "opening", "open", "op", "start", "starting", "intro", "introduction", "幕開け", "開幕",
    "開始", "オープニング", "closing", "close", "end", "ending", "ed", "outro", "閉幕", "終幕",
    "終了", "エンディング",
)
SETLIST_HEADINGS = (
    "セトリ", "セットリスト", "setlist", "setlisttimestamp", "setlistandtimestamp", "songlist",
    "songlisttimestamp", "歌った曲", "歌唱曲", "曲リスト", "歌リスト",
)
OTHER_HEADINGS = (
    "タイムライン", "timeline", "雑談パート", "雑談", "talk", "mc", "感想", "告知", "チャプター",
    "chapter", "chapters",
)
# words of notices; the first characters of all are in the range, which passes most texts over
NOTICE = r"(?=[\x{304A}-\x{7DE8}])(?:宣伝|告知|お知らせ|編集中です)"
# titles whose symbols belong to the name; a field holding one is left alone
PROTECTED_TITLES = (
    "DISH//", "Don't say \"lazy\"", "God knows...", "ハロ／ハワユ", "ryo(supercell)",
    "ナノウ(ほえほえP)", "ツインテールは20歳まで♡",
)


def _literal(ch: str) -> str:
    return "\\" + ch if ch in "\\^$.|?*+()[]{}/" else ch


def words(items) -> str:
    """Alternation of literal words."""
    return "(?:" + "|".join("".join(map(_literal, w)) for w in items) + ")"


# characters of other blocks that are an ASCII letter in another case
_OTHER_CASE = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}


def _any_case(ch: str) -> str:
    if ch.isascii() and ch.isalpha():
        return char_set(ch.lower() + ch.upper() + _OTHER_CASE.get(ch.lower(), ""))
    return _literal(ch)


def holds_word(items) -> str:
    """Pattern that is found where ``(?iu)`` and ``words(items)`` is; what it matches may be shorter.

    The flags compare every letter in both cases, word by word at each character. Here both cases
    are spelled out, words share their beginnings, and characters that begin no word are passed over.
    """
    cased = lambda c: not c.isascii() and not c.lower() == c == c.upper()
    if not items or not all(items) or any(map(cased, "".join(items))):
        return rf"(?iu){words(items)}"

    def branch(tails: list[tuple[str, ...]]) -> str:
        by: dict[str, list] = {}
        for first, *rest in tails:
            by.setdefault(first, []).append(rest)
        found = [first + ("" if [] in rests else branch(rests)) for first, rests in by.items()]
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    firsts = {c for w in items for c in w[0].lower() + w[0].upper() + _OTHER_CASE.get(w[0].lower(), "")}
    # one range for all that is not ASCII: a set of single characters is slow to test
    far = sorted(c for c in firsts if not c.isascii())
    near = char_set("".join(sorted(c for c in firsts if c.isascii())))[1:-1]
    span = rf"\x{{{ord(far[0]):X}}}-\x{{{ord(far[-1]):X}}}" if far else ""
    return f"(?=[{near}{span}])" + branch([tuple(map(_any_case, w)) for w in items])


def char_set(chars: str) -> str:
    """Character class of literal characters."""
    return "[" + "".join("\\" + ch if ch in "[]\\^-&" else ch for ch in chars) + "]"


def other_set(chars: str) -> str:
    """Character class of all characters but these, as plain ranges.

    A negated class that mixes characters and ranges takes ten times as long to test.
    """
    points, first, ranges = sorted(map(ord, set(chars))), 0, []
    for point in (*points, 0x110000):
        if point > first:
            ranges.append(rf"\x{{{first:X}}}-\x{{{point - 1:X}}}")
        first = point + 1
    return "[" + "".join(ranges) + "]"
