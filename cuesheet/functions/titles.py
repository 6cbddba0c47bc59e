"""Column functions on titles and performers: cleanup rules, field split, line parse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .brackets import BEFORE_SLASH, BLANKS, HAS_BRACKET, LEAD, closing_brackets, drop_notes
from .text import (
    annotation_key, first_match, let, markers, outside_brackets, section_key, seconds_of,
    strip, sub, valid_seconds,
)

W = P.WS


@dataclass(frozen=True)
class Rule:
    """One row of the rule table.

    ``scope`` is ``field`` (whole field) or ``song`` (the part before a slash).
    ``action`` ``translate`` maps the characters of ``regex`` to ``replacement``;
    ``delete_note`` removes closing brackets with a blank or bar that ``regex`` does not follow.
    """

    rule_id: str
    ord: int
    category: str
    action: str
    regex: str
    replacement: str = ""
    scope: str = "field"
    protection: tuple[str, ...] = P.PROTECTED_TITLES


_VERSION_WORD = (
    rf"(?<!{P.WORD})(?:remix|mix|live|ver\.?|edit|instrumental)(?!{P.WORD})"
)

# fixed values: notes in round brackets behind a title; the second is its reading
_PERFORMANCE_NOTE = "(?:少し|ちょっと|うろ覚え|練習|[0-9０-９]++番のみ|short\\.?|ワンコーラス|途中まで)"
_READING_NOTE = "[ぁ-んァ-ヶー]++"

# fixed values: the rule table; order of application is ``ord``
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("R01", 1, "fullwidth_digits", "translate", "０１２３４５６７８９", "0123456789"),
    Rule(
        "R10", 2, "fullwidth_letters", "translate",
        "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
        "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    ),
    Rule("R02", 3, "leading_number", "delete_prefix",
         rf"^[0-9０-９]+[.、.)）．](?![0-9０-９]){W}*"),
    Rule("R13", 4, "track_number", "delete_prefix",
         rf"^{W}*[0-9０-９]{{1,3}}{W}*[.．:：](?:{W}+|(?=[^0-9０-９{P.WS_SET}]))"),
    Rule("R03", 5, "bracket_number", "delete_prefix", rf"^〔[0-9０-９]+〕{W}*"),
    Rule("R04", 6, "list_decoration", "delete_prefix", rf"^[└├│▸▪●○◆◇☆★➔→・]{W}*"),
    Rule("R05", 7, "single_quotes", "normalize", r"(?s)^'([^']*)'.*$", "$1"),
    Rule(
        "R07", 8, "performance_note", "delete_suffix",
        rf"{LEAD}[（(]{_PERFORMANCE_NOTE}[）)]{BEFORE_SLASH}", scope="song",
    ),
    Rule("R14", 9, "reading_note", "delete_suffix",
         rf"{LEAD}[（(]{_READING_NOTE}[）)]{BEFORE_SLASH}", scope="song"),
    Rule(
        "R15", 10, "release_date", "delete_suffix",
        rf"{LEAD}[\[（(]{W}*+(?:18|19|20|21)[0-9]{{2}}(?:{W}*+[/.\-]{W}*+[0-9]{{1,2}}){{0,2}}+"
        rf"{W}*+(?:年|月)?+{W}*+日?+{W}*+[\]）)]{W}*+\z", scope="song",
    ),
    Rule("R06", 11, "translation_note", "delete_note", _VERSION_WORD, scope="song"),
)
NOISE_LINE = r"^(?:締め|[0-9０-９]+[,，][0-9０-９]+曲リクエスト)$"

_PROTECTED = P.words(P.PROTECTED_TITLES)
_PLAIN_NUMBER = r"^[0-9]{1,4}[.．][0-9]{1,4}$"


def rule_step(c: Column, rule: Rule) -> Column:
    if rule.action == "translate":
        return F.translate(c, rule.regex, rule.replacement)
    if rule.action == "delete_note":
        return drop_notes(c, rule.regex)
    return sub(c, rule.regex, rule.replacement)


def suffix_steps(c: Column, rules) -> Column:
    """Suffix rules in order; all of them remove brackets, so most fields skip them."""

    def steps(t: Column) -> Column:
        out = t
        for rule in rules:
            out = rule_step(out, rule)
        return F.when(t.rlike(HAS_BRACKET), out).otherwise(t)

    return let(c, steps) if rules else c


def protected_pattern(rules=DEFAULT_RULES) -> str:
    titles = sorted({t for r in rules for t in r.protection}, key=lambda t: (-len(t), t))
    return P.words(titles) if titles else r"(?!)"


def song_slash(c: Column) -> Column:
    """Characters before the first single slash outside brackets; null if there are none."""
    prefix = lambda m: first_match(m, r"(?s)^(.*?(?<![/／]))[/／](?![/／])", 1)
    return F.when(
        c.rlike("[/／]"),
        let(
            outside_brackets(c, P.RULE_BRACKETS_OPEN, P.RULE_BRACKETS_CLOSE),
            lambda m: F.when(prefix(m) != "", F.length(prefix(m))),
        ),
    )


def join_song_artist(song: Column, artist: Column) -> Column:
    """Put the cleaned title back in front of an untouched performer part."""
    song, artist = strip(song), F.coalesce(artist, F.lit(""))
    return F.when(artist == "", song).otherwise(
        F.btrim(F.concat(song, F.lit(" / "), strip(artist)), F.lit(" /"))
    )


def apply_rules(c: Column, rules=DEFAULT_RULES, check_protected: bool = True) -> Column:
    """The rule table on one field value, as one expression."""
    ordered = sorted(rules, key=lambda r: r.ord)
    prefix = [r for r in ordered if r.scope == "field"]
    suffix = [r for r in ordered if r.scope == "song"]

    def song_part(t: Column) -> Column:
        at = song_slash(t)

        def rebuild(b: Column) -> Column:
            song = F.when(b["at"].isNull(), b["t"]).otherwise(
                F.substring(b["t"], F.lit(1), b["at"])
            )
            song = suffix_steps(song, suffix)
            artist = F.when(b["at"].isNotNull(), F.substring(b["t"], b["at"] + 2, F.length(b["t"])))
            return join_song_artist(song, artist)

        return let(F.struct(t.alias("t"), at.alias("at")), rebuild)

    def body(raw: Column) -> Column:
        t = raw
        for rule in prefix:
            t = rule_step(t, rule)
        guard = (raw == "") | raw.rlike(_PLAIN_NUMBER)
        if check_protected:
            guard = guard | raw.rlike(protected_pattern(rules))
        return F.when(guard, raw).otherwise(let(strip(t), song_part))

    return let(strip(c), body)


# --- brackets that repeat or transliterate a name -----------------------------------


def is_latin_note(c: Column) -> Column:
    return c.rlike(rf"^(?=[^A-Za-z]*[A-Za-z]){P.LATIN_ANY}+$")


def drop_transliterations(c: Column) -> Column:
    """Remove `` (romanised)`` brackets that carry no musical information."""
    return sub(
        c,
        rf"(?<![ \t\x{{3000}}])[ \t\x{{3000}}]++[(（](?=[^()（）]{{1,80}}[)）])(?=[^()（）A-Za-z]*[A-Za-z])"
        rf"(?![^()（）]*{P.QUALIFIER}){W}*(?:{P.LATIN_INNER}|[\[\]［］])+{W}*[)）]",
    )


def drop_latin_suffix(c: Column) -> Column:
    """Remove a closing bracket that repeats the name or romanises a Japanese name."""

    def redundant(p: Column) -> Column:
        same = (annotation_key(p["before"]) == annotation_key(p["content"])) & (
            annotation_key(p["before"]) != ""
        )
        return (p["before"] != "") & (
            (is_latin_note(p["content"]) & p["before"].rlike(P.JAPANESE)
             & ~p["content"].rlike(P.JAPANESE)) | same
        )

    def body(raw: Column) -> Column:
        first = lambda readings: F.get(F.filter(readings, redundant), F.lit(0))["before"]
        return closing_brackets(raw, lambda r: F.coalesce(first(r), raw))

    return let(strip(c), body)


# --- field edges ------------------------------------------------------------------

_INDEX_MARK = (
    rf"^(?:[0-9]{{1,3}}{W}*[{P.DASHES}]{W}*"
    rf"|[#＃]{W}*[0-9]{{1,3}}{W}*[.)．。、,，：:{P.DASHES}]{W}*"
    rf"|[0-9]{{1,3}}{W}*[.)．。]{W}*(?=[A-Za-z\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}])"
    rf"|[#＃]{W}*[0-9]{{1,3}}{W}+)"
)
_EDGE_CHARS = "-—–−/／|｜￤∣丨:：;；"
_YEAR = rf"{LEAD}[\[［【(（]{W}*+(?:18|19|20|21)[0-9]{{2}}{W}*+年?+{W}*+[\]］】)）]?+{W}*+\z"
_SOFT = rf"[{P.WS_SET}\x{{FE0F}}\x{{200D}}]"
# read from the end: up to six marks and the blanks around them
_TRAILING = rf"^{_SOFT}*+(?:{W}*+(?:{P.EMOJI}|{P.TRAIL_MARKS}){_SOFT}*+){{0,6}}+"


def drop_tree(c: Column) -> Column:
    return strip(sub(c, rf"^{P.TREE}"))


def drop_weird_lead(c: Column) -> Column:
    return strip(F.ltrim(c, F.lit(P.LEAD_CHARS)))


def drop_quotes(c: Column) -> Column:
    c = strip(c)
    for _ in range(3):
        c = strip(F.rtrim(F.ltrim(c, F.lit("「『｢《〈【")), F.lit("」』｣》〉】")))
    return c


def drop_trailing_marks(c: Column) -> Column:
    return let(
        strip(c),
        lambda t: F.when(
            F.right(t, F.lit(1)).rlike(rf"^(?:{P.EMOJI}|{P.TRAIL_MARKS})"), strip(F.reverse(sub(F.reverse(t), _TRAILING)))
        ).otherwise(t),
    )


def drop_year(c: Column) -> Column:
    return strip(sub(c, _YEAR))


def tidy_field(c: Column) -> Column:
    """Cleanup that follows the rule table."""
    bracketed = lambda t: F.when(
        t.rlike(HAS_BRACKET), drop_latin_suffix(drop_tree(strip(drop_transliterations(t))))
    ).otherwise(drop_tree(t))
    c = let(strip(c), bracketed)
    c = strip(sub(c, _INDEX_MARK))
    c = strip(sub(c, rf"(?i)^(?:encore|アンコール){W}+"))
    c = drop_quotes(c)
    c = F.rtrim(F.ltrim(c, F.lit("[［")), F.lit("]］"))
    c = strip(F.rtrim(F.ltrim(c, F.lit(_EDGE_CHARS)), F.lit(_EDGE_CHARS)))
    dated = lambda t: F.when(t.rlike(HAS_BRACKET), drop_year(t)).otherwise(t)
    return drop_trailing_marks(drop_quotes(let(c, dated)))


# --- short cut for plain names ---------------------------------------------------------
# A name of letters, digits, single marks and inner blanks that starts with a letter is
# changed by no cleanup step: every step needs a bracket, a quote, an edge mark, a leading
# number or a full-width character.  Names that a word list could match are left out.
_FAR_LETTER = r"\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"


def _name_set(ascii_marks: str = "", far_marks: str = "") -> str:
    """Letters and some marks; the set of ASCII characters is tested before the ranges of the others."""
    return rf"[[{P.ASCII_LETTERS}{ascii_marks}][{far_marks}{_FAR_LETTER}]]"


_LETTER = _name_set()
_NAME_END = _name_set("0123456789!?", "ー々")
_PLAIN_TAIL = rf"(?:{_name_set(r'0123456789 #\&!?,', 'ー々')}*{_NAME_END})?"
_NOT_PLAIN = (
    rf"(?!(?i:encore|アンコール) )(?!(?i:{P.words(P.BAD_FIELD_WORDS)}|{P.words(P.TALK_WORDS)})"
    rf"(?!{_NAME_END}))"
)
_PLAIN_NAME = rf"{_NOT_PLAIN}{_LETTER}{_PLAIN_TAIL}"
_PLAIN_FIELD = rf"^{_PLAIN_NAME}$"
PLAIN_PAIR = rf"^({_PLAIN_NAME})(?: [{P.DELIMS}{P.DASHES}] |[/／|])({_PLAIN_NAME})$"


def tidy_unless_plain(c: Column) -> Column:
    """``tidy_field``, which leaves plain names alone; most names are plain once the rules have run."""
    return let(c, lambda t: F.when(t.rlike(_PLAIN_FIELD), t).otherwise(tidy_field(t)))


def clean_field(c: Column, rules=DEFAULT_RULES) -> Column:
    """Rule table plus field cleanup; protected titles come back untouched."""

    def body(raw: Column) -> Column:
        full = F.when(raw.rlike(protected_pattern(rules)), strip(raw)).otherwise(
            tidy_unless_plain(apply_rules(raw, rules, check_protected=False))
        )
        # the short cut knows the default rules only
        return F.when(raw.rlike(_PLAIN_FIELD), raw).otherwise(full) if rules is DEFAULT_RULES else full

    return let(c, body)


# the two suffix rules that the numbered extraction uses, without slash handling
SUFFIX_RULES = tuple(r for r in DEFAULT_RULES if r.rule_id in ("R07", "R06"))


def clean_field_light(c: Column) -> Column:
    return let(
        strip(c),
        lambda raw: F.when(raw.rlike(_PLAIN_FIELD) | raw.rlike(_PROTECTED), raw).otherwise(
            tidy_unless_plain(suffix_steps(raw, SUFFIX_RULES))
        ),
    )


_BAD = (
    rf"^(?:|(?i:{P.words(P.BAD_FIELD_WORDS)})|{P.TS}|{P.words(P.TALK_WORDS)})$"
)


def is_bad_field(c: Column) -> Column:
    return strip(c).rlike(_BAD)


# --- performers with dates, work titles and notes -----------------------------------

# fixed values: words of performance notes
_NOTE_WORDS = (
    "Original Song|Original song|ORIGINAL SONG|Original|オリジナル(?:曲|ソング)?"
    "|弾き語り(?:初披露)?|初披露|初公開|途中まで|ワンコーラス|挑戦枠?"
)
_DAY_TAIL = rf"{W}*+(?:[/.\-年]{W}*+[0-9]{{1,2}}){W}*+(?:[/.\-月]{W}*+[0-9]{{1,2}})?+{W}*+日?+"
_ALIAS_SET = r"A-Za-z0-9 .,'’\"!?&+_\-"
# one name of an alias; names that are blank count as long as one of the blanks is plain
_NAME = rf"[{_ALIAS_SET}&&[^ ]][{_ALIAS_SET}]*+"
_WIDE_BLANK = rf"[{P.WS_SET}&&[^ ]]"
_HELD = rf"{_ALIAS_SET}{P.DELIMS}{P.WS_SET}"
# Latin names with delimiters that end a text; they can only begin behind the last character
# that an alias cannot hold, and the Japanese characters are among these
_NEXT_NAME = rf"[{P.DELIMS}](?>{W}*+{_NAME}|(?={_WIDE_BLANK}*+ )){W}*+"
ALIAS = (
    rf"(?s)^((?>.*[^{_HELD}])[{_HELD}]*?)(?<!{W})"
    rf"(?>{W}++{_NAME}|{W}(?={_WIDE_BLANK}*+ )){W}*+"
    rf"(?:{_NEXT_NAME})++$"
)


# last characters of the notes that end a performer, or of what may follow them
_NOTE_END = rf"[A-Za-z&&[ercglERCGL]]$|[ジ曲グルり露開でス戦枠※＊\]】)）]$|{W}$"


def drop_performance_notes(c: Column) -> Column:
    def steps(t: Column) -> Column:
        t = sub(t, rf"(?i){LEAD}(?:[❄✨⭐★☆]++{W}*+)?+(?:チャレンジ|challenge){W}*+$")
        t = sub(
            t,
            rf"(?i){LEAD}(?:[※＊❄✨⭐★☆]++{W}*+)?+(?:[\[【(（]{W}*+)?+(?:with{W}+acoustic{W}+gui?t[ae]?r"
            rf"|with{W}+acoustic|acoustic{W}+gui?t[ae]?r|acoustic|{_NOTE_WORDS})"
            rf"(?:{W}*+[\]】)）])?+{W}*+$",
        )
        t = sub(t, rf"(?i)(?<![ \t\x{{3000}}])[ \t\x{{3000}}]++(?:{_NOTE_WORDS}){W}*+$")
        return strip(sub(t, rf"{LEAD}[※＊]{W}*+$"))

    return let(c, lambda t: F.when(t.rlike(_NOTE_END), steps(t)).otherwise(strip(t)))


def drop_release_date(c: Column) -> Column:
    def steps(t: Column) -> Column:
        t = sub(t, rf"{LEAD}[(（]{W}*+[0-9]{{4}}{_DAY_TAIL}{W}*+[)）]{W}*+$")
        t = sub(t, rf"{LEAD}[\[［【]{W}*+[0-9]{{4}}{_DAY_TAIL}{W}*+[\]］】]{W}*+$")
        return drop_year(t)

    return let(c, lambda t: F.when(t.rlike(HAS_BRACKET), steps(t)).otherwise(strip(t)))


def drop_release_tail(c: Column) -> Column:
    def dated(t: Column) -> Column:
        tail = rf"(?s){BLANKS}(?:18|19|20|21)[0-9]{{2}}{_DAY_TAIL}.*$"
        return F.when(t.rlike("(?:18|19|20|21)[0-9]{2}"), sub(t, tail)).otherwise(t)

    def original(t: Column) -> Column:
        cut = sub(t, rf"(?i){BLANKS}[0-9]++(?:st|nd|rd|th)?+{W}*+オリジナル(?:ソング|曲)?+{W}*+$")
        cut = sub(cut, rf"{BLANKS}オリジナル(?:ソング|曲){W}*+$")
        return F.when(t.contains("オリジナル"), cut).otherwise(t)

    return strip(let(let(drop_release_date(c), dated), original))


def clean_artist(c: Column) -> Column:
    """Performer without dates, work title, notes and Latin alias; ``X//`` stays."""
    title = lambda t: F.when(t.contains("【"), strip(sub(t, rf"{LEAD}【[^】]{{1,120}}】{W}*+$"))).otherwise(t)
    work = let(drop_release_date(drop_release_tail(c)), title)

    def restore(raw: Column) -> Column:
        cleaned = drop_trailing_marks(
            drop_release_tail(drop_performance_notes(clean_field_light(raw)))
        )
        return let(
            cleaned,
            lambda v: F.when(
                (v != "") & raw.rlike(rf"[A-Za-z0-9)\]）]//{W}*$") & ~v.rlike(rf"//{W}*$"),
                F.concat(v, F.lit("//")),
            ).otherwise(v),
        )

    named = lambda w: F.when(
        w.rlike(P.JAPANESE) & w.rlike(rf"{_NEXT_NAME}$"), sub(w, ALIAS, "$1")
    ).otherwise(w)
    # what follows changes no plain name that a note does not end
    return let(
        work, lambda w: F.when(w.rlike(_PLAIN_PERFORMER), w).otherwise(let(strip(named(w)), restore))
    )


# --- song / artist -------------------------------------------------------------------

_SPACED_SLASHES = rf"(?s)^(.*?{W})//(?={W})"
_SPACED_DELIM = rf"(?s)^(.*?{W})[{P.DELIMS}](?={W})"
_SPACED_PIPE = rf"(?s)^(.*?{W})[{P.PIPES}](?={W})"
_GREEDY_DELIM = rf"(?s)^(.+){W}[{P.DELIMS}]{W}+."
_GREEDY_DASH = rf"(?s)^(.+){W}[{P.DASHES}]{W}+."
_DATE_SLASH = rf"([0-9]{W}*+)/(?={W}*[0-9]{{1,2}}(?:[^0-9]|\z))"
_TIGHT_SLASH = r"(?s)^(.+?)/."
_TIGHT_PIPE = rf"(?s)^(.+)[{P.PIPES}]."
_TIGHT_WIDE = r"(?s)^(.+)／."
_HAS_DELIM = rf"[{P.DELIMS}]|{W}[{P.DASHES}]{W}"


def _pair(song: Column, artist: Column) -> Column:
    return F.struct(strip(song).alias("s"), strip(artist).alias("a"))


def _pieces(pair: Column) -> Column:
    """Raw title, performer head, metadata after a spaced pipe, whole performer."""
    head = lambda m: F.when(m.rlike(_SPACED_PIPE), F.length(first_match(m, _SPACED_PIPE, 1)))
    at = F.when(pair["a"].rlike(rf"{W}[{P.PIPES}]{W}"), let(outside_brackets(pair["a"]), head))
    return let(
        at,
        lambda n: F.array(
            pair["s"],
            F.when(n.isNull(), pair["a"]).otherwise(F.substring(pair["a"], F.lit(1), n)),
            F.when(n.isNotNull(), F.substring(pair["a"], n + 2, F.length(pair["a"]))),
            F.when(n.isNotNull(), pair["a"]),
        ),
    )


def performer_with_note(c: Column) -> Column:
    """Performer of a record; what follows a spaced pipe becomes a note in brackets."""

    def joined(p: Column) -> Column:
        head, meta = clean_artist(F.get(p, F.lit(1))), F.get(p, F.lit(2))
        return F.when(meta.isNull(), head).otherwise(
            let(
                F.struct(head.alias("h"), clean_field_light(meta).alias("m")),
                lambda s: F.when(s["h"] == "", clean_artist(F.get(p, F.lit(3))))
                .when(s["m"] == "", s["h"])
                .otherwise(F.concat(s["h"], F.lit(" ["), s["m"], F.lit("]"))),
            )
        )

    return let(_pieces(_pair(F.lit(""), c)), joined)


def _cut(raw: Column, mask: Column, pattern: str, width: int = 1) -> Column:
    """Candidate at the delimiter that ends the first group of ``pattern``."""
    return let(
        F.length(first_match(mask, pattern, 1)),
        lambda n: F.when(
            n > 0,
            _pair(F.substring(raw, F.lit(1), n), F.substring(raw, n + 1 + width, F.length(raw))),
        ),
    )


def _regex_cut(raw: Column, pattern: str) -> Column:
    """Candidate at the last delimiter with blanks on both sides, brackets or not."""
    after = lambda n: F.substring(
        strip(F.substring(raw, n + 1, F.length(raw))), F.lit(2), F.length(raw)
    )
    return let(
        F.length(first_match(raw, pattern, 1)),
        lambda n: F.when(n > 0, _pair(F.substring(raw, F.lit(1), n), after(n))),
    )


def split_fields(c: Column, clean=clean_field, clean_performer=None, extended=False) -> Column:
    """``title / performer`` as ``struct<song, artist>``, or null.

    Candidates are listed in priority order; equal ones are dropped, all pieces run
    through one cleanup expression, and the first candidate with two good fields wins.
    ``extended`` puts multi-field records and ``a - b | c`` first.
    """
    same_cleanup = clean_performer is None
    clean_performer = clean_performer or clean

    def candidates(raw: Column, mask: Column) -> Column:
        # a dated slash is no delimiter; pipes come before full-width slashes
        undated = sub(mask, _DATE_SLASH, "$1\x02")
        tight = (
            F.when(undated.contains("/"), _cut(raw, undated, _TIGHT_SLASH))
            .when(mask.rlike(f"[{P.PIPES}]"), _cut(raw, mask, _TIGHT_PIPE))
            .otherwise(_cut(raw, mask, _TIGHT_WIDE))
        )
        options = [
            _cut(raw, mask, _SPACED_SLASHES, 2),
            _cut(raw, mask, _SPACED_DELIM),
            _regex_cut(raw, _GREEDY_DELIM),
            _regex_cut(raw, _GREEDY_DASH),
            tight,
        ]
        if extended:
            dash_first = F.when(mask.rlike(_SPACED_PIPE), _regex_cut(raw, _GREEDY_DASH))
            options = [multi_field_pair(raw, mask), options[0], dash_first, *options[1:]]
        return F.filter(F.array_distinct(F.array(*options)), lambda o: o.isNotNull())

    def cleaned(pieces: Column) -> Column:
        if same_cleanup:
            return F.transform(pieces, lambda x: F.when(x.isNotNull(), clean(x)))
        return F.concat(
            F.transform(F.slice(pieces, 1, 1), clean),
            F.transform(F.slice(pieces, 2, 1), clean_performer),
            F.transform(F.slice(pieces, 3, 1), lambda x: F.when(x.isNotNull(), clean(x))),
            F.transform(F.slice(pieces, 4, 1), lambda x: F.when(x.isNotNull(), clean_performer(x))),
        )

    def assemble(p: Column) -> Column:
        song, head, meta, whole = (F.get(p, F.lit(i)) for i in range(4))
        artist = (
            F.when(meta.isNull(), head)
            .when(head == "", whole)
            .when(meta == "", head)
            .otherwise(F.concat(head, F.lit(" ["), meta, F.lit("]")))
        )
        return F.struct(song.alias("song"), artist.alias("artist"))

    good = lambda s: ~is_bad_field(s["song"]) & ~is_bad_field(s["artist"])

    def choose(raw: Column) -> Column:
        options = let(outside_brackets(raw), lambda m: candidates(raw, m))
        fields = F.transform(options, lambda o: let(cleaned(_pieces(o)), assemble))
        return F.get(F.filter(fields, good), F.lit(0))

    def general(raw: Column) -> Column:
        return F.when(raw.rlike(_HAS_DELIM), choose(raw))

    def short(raw: Column) -> Column:
        pair = lambda p: F.struct(
            F.substring_index(p, "\x02", 1).alias("song"),
            F.substring_index(p, "\x02", -1).alias("artist"),
        )
        return let(
            sub(raw, PLAIN_PAIR, "$1\x02$2"),
            lambda p: F.when(p.contains("\x02"), pair(p)).otherwise(general(raw)),
        )

    # two plain names need no candidates; a performer cleanup of its own may change them
    return let(strip(c), short if same_cleanup and clean is clean_field else general)


# --- multi-field records ---------------------------------------------------------------

# fixed values: words that mark a work title
_METADATA_SHAPE = (
    r"(?i)^[「『《〈【]|OP|ED|オープニング|エンディング|Opening|Ending|テーマ|主題歌|挿入歌"
    r"|ゲーム|アニメ|映画|ドラマ|ソフト|ブランド|レーベル|project|CIRCUS"
    rf"|SAGA{W}*PLANETS|ゆずソフト|戯画|(?:18|19|20|21)[0-9]{{2}}"
)


def multi_fields(raw: Column, mask: Column) -> Column:
    """Fields of ``a／b／c…`` cut outside brackets when the record shape holds, else null."""

    def cut(parts: Column) -> Column:
        # the mask has the length of the text, so field lengths carry over
        ends = F.transform(
            parts,
            lambda p, i: F.aggregate(
                F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, q: n + F.length(q) + 1
            ),
        )
        fields = F.filter(
            F.zip_with(
                parts, ends,
                lambda p, e: strip(F.substring(raw, e - F.length(p), F.length(p))),
            ),
            lambda f: f != "",
        )
        shape = lambda fs: F.when(
            (F.size(fs) >= 4)
            | ((F.size(fs) == 3) & markers(F.get(fs, F.lit(2))).rlike(_METADATA_SHAPE)),
            fs,
        )
        return let(fields, shape)

    return F.when(mask.contains("／"), let(F.split(mask, "／"), cut))


def multi_field_pair(raw: Column, mask: Column) -> Column:
    return let(
        multi_fields(raw, mask),
        lambda fs: F.when(
            fs.isNotNull(), _pair(F.get(fs, F.lit(0)), drop_release_tail(F.get(fs, F.lit(1))))
        ),
    )


# --- one timed line -----------------------------------------------------------------

_TIME_LEAD = (
    rf"(?:{P.TS_OPEN}{W}*)?{P.TS}{W}*{P.TS_CLOSE}?(?:{W}*[;；,，、~～{P.DASHES}]+{W}*)?"
)
_ICONS = rf"(?:[{P.LEAD_SET}]*(?:{P.EMOJI}|{P.ICON_MARKS}))+{W}*"
# fixed values: forms of a line number
_SERIAL = (
    r"(?:(?i:Re)" + rf"{W}*[:：]{W}*(?![A-Za-z])"
    rf"|【{W}*[0-9]{{1,3}}{W}*】{W}*"
    rf"|[⟦〚]{W}*[0-9]{{1,3}}{W}*[⟧〛]{W}*"
    rf"|\[{W}*[0-9]{{1,3}}{W}*\]{W}*"
    rf"|\({W}*[0-9]{{1,3}}{W}*\){W}*"
    rf"|[0-9]{{1,3}}{W}*曲{W}*[/／]{W}*"
    rf"|[0-9]{{1,3}}{W}+(?={P.TS}(?!{P.WORD}))"
    rf"|[0-9]{{1,3}}{W}*[,，]{W}+(?![0-9])"
    rf"|[0-9]{{1,3}}{W}*[{P.DASHES}]{W}*"
    rf"|[0-9]{{1,3}}{W}*[.)．。、,，：:]{W}+(?![0-9]))"
)
_LEAD_ROUND = (
    rf"(?:(?:{P.TREE}){{0,2}}(?:{W}*(?:{_TIME_LEAD})?(?:{P.TREE})?){{0,8}}"
    rf"(?:{_ICONS})?(?:{P.TREE})?(?:{W}*{_SERIAL})?)"
)
_LEAD = rf"^{_LEAD_ROUND}{{0,6}}+{W}*"
_NUMBERED_TIME = rf"^[0-9]{{1,3}}{W}*[.)．。、,，：:]{W}+(?={P.TS})"
TIMED_LINE = (
    rf"^(?:{P.TS}|{P.TS_OPEN}{W}*{P.TS}{W}*{P.TS_CLOSE}|[0-9]{{1,3}}{W}*[.)．。、,，：:]{W}+{P.TS})"
)
# fixed values: words of lines that are no songs
_NON_SONG = (
    rf"^$|^(?i:{P.words(P.NON_SONG_EDGES)})$|^{P.words(P.NON_SONG_TALK)}$"
    rf"|(?:宣伝|告知|お知らせ){W}*$|^[（(]?{W}*(?:宣伝|告知|お知らせ)|^編集中です"
)


def drop_line_lead(c: Column) -> Column:
    """Remove times, numbers, icons and tree marks in front of a title."""
    return strip(sub(markers(c), _LEAD))


def is_non_song(c: Column) -> Column:
    return drop_trailing_marks(drop_weird_lead(c)).rlike(_NON_SONG)


def is_section_pair(song: Column, artist: Column) -> Column:
    marker = rf"^{P.words(P.SECTION_WORDS)}$"
    return section_key(song).rlike(marker) & section_key(artist).rlike(marker)


def first_time(c: Column) -> Column:
    """First time label when it is valid, else the empty string."""
    return let(
        first_match(markers(c), P.TS),
        lambda t: F.when(t.rlike(rf"^{P.TS_VALID}$"), t).otherwise(F.lit("")),
    )


def line_body(c: Column) -> Column:
    """Text of a timed line after lead and romanised notes; null for other lines."""
    lead = lambda t: drop_line_lead(sub(t, _NUMBERED_TIME))
    rest = lambda b: F.when(~is_non_song(b), drop_latin_suffix(drop_transliterations(b)))
    return let(
        drop_weird_lead(c),
        lambda t: F.when(
            t.rlike(TIMED_LINE),
            let(let(lead(t), rest), lambda b: F.when(~is_non_song(b), b)),
        ),
    )


def number(digits: Column) -> Column:
    """Digits to a number; null for the empty string (a failing cast is slow)."""
    return F.when(digits != "", digits.cast("int"))


TRACK_TYPE = (
    "struct<item_pos:int,num:int,secs:int,label:string,song:string,artist:string>"
)


def track(pos, num, secs, label, song, artist) -> Column:
    return F.struct(
        pos.cast("int").alias("item_pos"), num.cast("int").alias("num"),
        secs.cast("int").alias("secs"), label.alias("label"), song.alias("song"),
        artist.alias("artist"),
    )


_NUMBER_AFTER_TIME = (
    rf"^[┗┣━─{P.DASHES}|>{P.WS_SET}]*{P.TS}{W}*[:：]?{W}*([0-9]{{1,3}}){W}*[.．:：]{W}+"
)


# "1:02:03 04. title / performer" with two plain names, the time bare, numbered or in
# brackets; everything else needs the long way. One note that the rules R07 or R14 delete may
# stand behind the title: nothing else changes it, and without it the title is a plain name
_SPACED_WORDS = "|".join(" *".join(w) for w in P.SECTION_WORDS)
_PLAIN_LINE = (
    rf"^(?:(?:[0-9]{{1,3}}[.)] +)?({P.TS_VALID}) +|{P.TS_OPEN}({P.TS_VALID}){P.TS_CLOSE} *)"
    rf"(?:([0-9]{{1,3}})\. +)?(?!.*{P.NOTICE})"
    rf"(?!(?i:{_SPACED_WORDS}))({_PLAIN_NAME})(?: *[（(](?:{_PERFORMANCE_NOTE}|{_READING_NOTE})[）)])?"
    rf"(?: [{P.DELIMS}{P.DASHES}] |[/／|])({_PLAIN_NAME})$"
)


# "1:02:03 [4] title / performer" and "4. 題名 performer" in plain words. No performer cleanup
# changes these either, when they hold no year and no note ends them
_NO_NOTE = (
    "(?<!(?i:challenge|チャレンジ|acoustic|g[ui]{0,2}t[ae]?r|original|song|オリジナル|曲|ソング|語り|披露|公開|まで"
    "|コーラス|挑戦|枠))"
)
_PLAIN_PERFORMER = rf"^(?![^年]*年){_PLAIN_NAME}{_NO_NOTE}$"
_SERIAL_FORMS = (
    "#{n} +", "【{n}】 *", "[⟦〚]{n}[⟧〛] *", r"\[{n}\] *", r"\({n}\) *", "{n}曲[/／] *", "{n}, *", "{n} - *",
    r"{n}\. *", "{n}。 *",
)
_PLAIN_TITLE = (
    rf"(?=.*{P.JAPANESE})(?!(?i:encore|アンコール)\x{{3000}}){_NOT_PLAIN}"
    rf"{_LETTER}{_name_set(r'0123456789 #\&!?,', 'ー々　')}*{_NAME_END}"
)
_PLAIN_NUMBERED = (
    rf"^(?:({P.TS_VALID}) +)?(?:{'|'.join(f.format(n='([0-9]{1,3})') for f in _SERIAL_FORMS)})"
    rf"(?![^年]*年)(?!(?i:{_SPACED_WORDS}))"
    rf"(?:({_PLAIN_NAME})(?: [{P.DELIMS}{P.DASHES}] |[/／|])({_PLAIN_NAME})"
    rf"|({_PLAIN_TITLE})[ \x{{3000}}]({_NOT_PLAIN}[A-Za-z][A-Za-z0-9_]*)){_NO_NOTE}$"
)


# a plain line with a time and no number: the numbered extraction finds nothing in it
_PLAIN_UNNUMBERED = rf"^{P.TS_VALID} +{_PLAIN_NAME}(?: [{P.DELIMS}{P.DASHES}] |[/／|]){_PLAIN_NAME}$"


def plain_numbered(line: Column, other) -> Column:
    """Track of a numbered line in plain words; ``other(line)`` of all other lines."""
    found = lambda p: track(
        F.lit(None), F.get(p, F.lit(1)), seconds_of(F.get(p, F.lit(0))),
        F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(3)),
    )

    def body(l: Column) -> Column:
        return let(
            sub(l, _PLAIN_NUMBERED, "$1\x02$2$3$4$5$6$7$8$9$10$11\x02$12$14\x02$13$15"),
            lambda r: F.when(r != l, let(F.split(r, "\x02"), found))
            .when(~l.rlike(_PLAIN_UNNUMBERED), other(l)),
        )

    return let(line, body)


def _plain_parts(line: Column) -> Column:
    """Time, number, title and performer of a plain line, parted; other lines as they are."""
    return sub(line, _PLAIN_LINE, "$1$2\x02$3\x02$4\x02$5")


def _plain_track(parts: Column) -> Column:
    short = lambda p: track(
        F.lit(None), number(F.get(p, F.lit(1))), valid_seconds(F.get(p, F.lit(0))),
        F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(3)),
    )
    return let(F.split(parts, "\x02"), short)


def parse_line(line: Column) -> Column:
    """Timed line to a track struct (without position), or null."""

    def body(l: Column) -> Column:
        return let(
            _plain_parts(l),
            lambda r: F.when(r != l, _plain_track(r)).otherwise(parse_any_line(l)),
        )

    return let(line, body)


def parse_plain_text(text: Column, other: Column) -> Column:
    """Tracks of a text in which every line is plain; ``other`` for all other texts.

    Such lines hold one time, are left alone by every cleanup, and never merge with one another.
    """
    plain = lambda parts: F.forall(parts, lambda r: r.contains("\x02"))
    # a text that holds a blank twice or the mark itself goes the long way
    odd = F.coalesce(text.contains("  ") | text.contains("\x02"), F.lit(True))
    parts = F.when(~odd, F.transform(F.split(text, "\n"), _plain_parts))
    return let(
        parts, lambda ps: F.when(plain(ps), F.transform(ps, _plain_track)).otherwise(other)
    )


def parse_any_line(line: Column) -> Column:
    """``parse_line`` without the short cut."""

    def build(fields: Column) -> Column:
        keep = fields.isNotNull() & ~is_section_pair(fields["song"], fields["artist"])
        return F.when(
            keep,
            let(
                first_time(line),
                lambda label: track(
                    F.lit(None), number(first_match(markers(line), _NUMBER_AFTER_TIME, 1)),
                    seconds_of(label), label, fields["song"], fields["artist"],
                ),
            ),
        )

    return let(split_fields(line_body(line)), build)
