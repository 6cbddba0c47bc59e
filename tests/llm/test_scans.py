"""Secret scan, decontamination, toxicity, language: per-text operators against plain code."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, langid, secret_scan, toxicity

PLAIN = {
    "assign": re.compile(
        "((?:" + "|".join(
            "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
            for w in ("password", "passwd", "secret", "token", "api_key", "apikey")
        ) + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": (2, 12), "access": (0, 18), "hex": (0, 16)}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        group, least = LEAST[kind]
        out += [
            (m.start(), k, m.end(), kind) for m in pattern.finditer(text or "")
            if len(m[group]) >= least
        ]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def secret_texts():
    rng = random.Random(1)
    parts = [
        "password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"',
        "abc", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "XYZ123", "é", "-", ".",
        "longvalue123456", "\n", "deadbeef", "pass", "ak", "漢",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    return texts + ["ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "f" * 100_000, None, ""]


def test_secret_spans_are_those_of_the_patterns(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(docs).collect()}
    base = {r.kind for r in secret_scan.BASE}
    for i, text in enumerate(texts):
        spans = [(s["kind"], s["start"], s["end"]) for s in got[i]]
        assert [s for s in spans if s[0] in base] == plain_spans(text)
    assert [s["kind"] for s in got[len(texts) - 5]] == ["github"]
    assert [s["kind"] for s in got[len(texts) - 4]] == ["private_key"]


def test_secrets_of_odd_rows(docs, no_docs, rows):
    assert secret_scan.find_secrets(docs).count() == len(rows)
    assert secret_scan.find_secrets(no_docs).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, width=10):
    seq, hit, found = fold(text), set(), set()
    for item, other in items:
        w = fold(other)
        n = min(width, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(seq) - n + 1):
            if n and tuple(seq[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(seq), len(hit), sorted((f for f in found if f is not None), key=str)


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows]
    words = texts[45].split()
    return [
        (1, " ".join(words[20:34]).upper()), (12, texts[54]), (3, "one"), (3, " ".join(words[:11])),
        (None, " ".join(words[50:62])), (9, ""), (10, None), (2, " ".join(words[40:49])),
    ]


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contamination(spark, docs, rows, items, part_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, benchmark, part_bytes=part_bytes)
    got = sorted(
        repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in found.collect()
    )
    assert got == sorted(repr((r[0], *plain_hits(r[1], items))) for r in rows)


def test_contamination_spans_point_into_the_text(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, benchmark).where("n_hit > 0")
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id > 7").collect()}
    for r in found.where("doc_id > 7").collect():
        hit = [w for s in r["spans"] for w in fold(texts[r["doc_id"]][s["start"] : s["end"]])]
        assert len(hit) == r["n_hit"]


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contaminated_rows_go(spark, docs, rows, items, part_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark, part_bytes=part_bytes)
    assert kept.schema == docs.schema
    want = [r for r in rows if not plain_hits(r[1], items)[1]]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_no_benchmark_and_no_documents(spark, docs, no_docs, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, empty).where("n_hit = 0").count() == len(rows)
    assert decontaminate.drop_contaminated(docs, empty).count() == len(rows)
    assert decontaminate.find_contamination(no_docs, empty).count() == 0


def test_fold():
    assert toxicity.fold("Id10t, іdiot! $TUPID st@r ｍｏｒｏｎ mo​ron") == [
        "idiot", "idiot", "stupid", "star", "moron", "moron",
    ]
    assert toxicity.fold("word$$$ !!") == ["word"]
    assert toxicity.fold("") == []


def test_exception_phrases_spare_their_words():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " dum": 4.0}, (" trash can ",), ())
    found = toxicity.Matcher(lexicon).matches("the trash can is dumb trash".split())
    assert [w for _, _, w in found] == [4.0, 5.0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("lmnopr") for _ in range(5)) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zebub", "ZEBUB", "z3bub", "quaxo" + rng.choice("mnop")]))
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 49 else int(toxic), "clash"))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([*labels, (None, 1, "x"), (3, 0, "x")], "doc_id long, toxic int, text string"),
    )


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    lexicon = toxicity.learn(docs, labels)
    assert " zebub " in lexicon.entries and any(e.startswith(" quax") for e in lexicon.entries)
    scores = toxicity.rate(docs, lexicon, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    wrong = [r for r in scores.collect() if (r["score"] >= 0.5) != (r["doc_id"] % 6 == 0)]
    assert len(wrong) <= 2
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and 490 <= kept.count() <= 510


def test_toxicity_odds_are_those_of_all_labelled_rows(spark, labelled):
    """Thinning the clean rows to as many as the toxic ones leaves no trace in the odds."""
    docs, labels = labelled
    known = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id is not null and toxic is not null and doc_id <> 3").collect()}
    train = docs.where(~toxicity.held_out(F.col("doc_id"))).collect()
    sizes = [sum(known.get(r["doc_id"], 0 if r["doc_id"] == 3 else None) == k for r in train) for k in (0, 1)]
    bound = sizes[1] // 2
    _, all_in = toxicity._sample(docs, labels, 10_000)
    _, thinned = toxicity._sample(docs, labels, bound)
    assert all_in == {0: 1.0, 1: 1.0}
    assert thinned == {k: pytest.approx(bound / sizes[k]) for k in (0, 1)}
    rows, _ = toxicity._sample(docs, labels, bound)
    lexicon = toxicity.learn(docs, labels, sample=bound)
    points = toxicity._matched(rows.select("text", "toxic"), lexicon, "toxic").collect()
    x = np.array([toxicity.features(r["weight"], r["hits"], r["n_words"]) for r in points])
    plain = toxicity.logistic(x, np.array([r["toxic"] for r in points], dtype=float))
    assert lexicon.curve[0] - plain[0] == pytest.approx(math.log(sizes[1] / sizes[0]))


def test_toxicity_of_odd_rows(spark, docs, no_docs, rows, labelled):
    lexicon = toxicity.learn(*labelled)
    assert toxicity.rate(docs, lexicon, "doc_id").where("score between 0 and 1").count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    silent = toxicity.learn(docs, none)
    assert toxicity.rate(docs, silent, "doc_id").agg(F.max("score")).first()[0] < 0.01
    assert toxicity.rate(no_docs, silent, "doc_id").count() == 0


def test_languages(spark):
    rng = random.Random(2)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}

    def text(lang, k):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(k))

    docs = [(i, text(lang, 30), lang, f"s{i % 3}") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    docs += [(None, None, None, None), (500, "", "aa", "s0")]
    pages = [
        (i, f"http://h{i % 5}.{'x' if lang == 'aa' else 'y'}/p", f'<html lang="{lang}"><p>{text(lang, 20)}</p>')
        for i, lang in enumerate(["aa", "bb"] * 20)
    ]
    # nothing to read: markup, suffix and host decide
    pages += [(100, "http://h0.x/", '<html lang="aa"></html>'), (101, "http://h1.y/", None), (None, None, "")]
    found = langid.identify(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(pages, "page_id long, url string, html string"),
    ).collect()
    assert len(found) == len(docs) + len(pages)
    truth = {i: lang for i, _, lang, _ in docs}
    for r in found:
        assert 0 < r["chance"] <= 1 + 1e-9
        if r["doc_id"] is not None and r["doc_id"] < 500:
            assert r["lang"] == truth[r["doc_id"]]
        if r["page_id"] is not None:
            assert r["lang"] == ({100: "aa", 101: "bb"}.get(r["page_id"]) or ["aa", "bb"][r["page_id"] % 2])


def plain_languages(docs, pages):
    """The chances of :func:`langid.identify`, one row after the other."""
    def buckets(data):
        data = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in data) + b" "
        codes = (data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2))
        return [(c * 2654435761 % 2**32) >> 17 for c in codes]

    counts = {}
    for i, text, lang, _ in docs:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(buckets((text or "").encode()))
    names = sorted(counts)
    size, rows = len(names), []
    for kind, table in (("document", docs), ("page", pages)):
        for row in table:
            data, host, suffix, says = (row[1] or "").encode(), row[-1] or "", "", "none"
            if kind == "page":
                data = (row[2] or "").encode()
                host, suffix = langid.address(row[1])
                says = langid.declared(data)
                says = "none" if says is None else says if says in names else "other"
                data = langid.visible(data)
            at = buckets(data)
            logs = []
            for lang in names:
                n = sum(counts[lang].values()) + 0.5 * 32768
                logs.append(sum(math.log((counts[lang][b] + 0.5) / n) for b in at) * min(1, 40 / max(1, len(at))))
            share = [math.exp(x - max(logs)) for x in logs]
            rows.append((kind, row[0], host, suffix, says, logs, [x / sum(share) for x in share]))

    def sums(key):
        found = {}
        for row in rows:
            held = found.setdefault(key(row), [0, [0.0] * size])
            held[0] += 1
            held[1] = [a + b for a, b in zip(held[1], row[6])]
        return found

    kinds, says = sums(lambda r: r[0]), sums(lambda r: (r[0], r[4]))
    suffixes, hosts = sums(lambda r: (r[0], r[3])), sums(lambda r: (r[0], r[3], r[2]))
    out = []
    for kind, key, host, suffix, said, logs, share in rows:
        scores = []
        for j in range(size):
            (nk, sk), (nx, sx), (nh, sh) = kinds[kind], suffixes[kind, suffix], hosts[kind, suffix, host]
            top = (sk[j] + 4 / size) / (nk + 4)
            by_suffix = (sx[j] + 4 * top) / (nx + 4)
            prior = (max(sh[j] - share[j], 0) + 4 * by_suffix) / (nh - 1 + 4)
            by_declared = (says[kind, said][1][j] + 4 / (size + 2)) / (sk[j] + 4)
            scores.append(logs[j] + math.log(by_declared) + math.log(prior))
        best = max(scores)
        chance = 1 / sum(math.exp(x - best) for x in scores)
        out.append((kind, key, names[scores.index(best)], chance))
    return out


@pytest.mark.parametrize("block", [100, 2, 1])
def test_chances_of_languages_are_those_of_plain_code(spark, block, monkeypatch):
    """Every language that has training rows is one, whatever the size of a block."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efghi", "dd": "абвгд", "ee": "ab漢字"}

    def text(lang, k):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(3)) for _ in range(k))

    docs = [
        (i, text(lang, rng.randint(0, 4)), lang if i % 7 else None, f"s{rng.randrange(4)}")
        for i, lang in enumerate([*letters] * 12)
    ]
    docs += [(3, "abc", "aa", "s1")] * 3 + [(None, None, None, None), (900, "", "bb", ""), (901, "ab " * 20_000, None, "s0")]
    pages = [
        (i, f"http://h{rng.randrange(3)}.{rng.choice('xy')}/p", f'<html lang="{rng.choice(["aa", "bb", "zz"])}"><p>{text(lang, 2)}')
        for i, lang in enumerate([*letters] * 6)
    ]
    pages += [(77, "http://1.2.3.4/", "<p>abc"), (78, None, None), (None, "nothing", ""), (79, "http://h0.x/", "")]
    found = langid.identify(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(pages, "page_id long, url string, html string"),
    ).collect()

    got = sorted(
        (("document", r["doc_id"]) if r["doc_id"] is not None else ("page", r["page_id"])) + (r["lang"], r["chance"])
        for r in found if r["doc_id"] is not None or r["page_id"] is not None
    )
    want = sorted(r for r in plain_languages(docs, pages) if r[1] is not None)
    assert len(found) == len(docs) + len(pages) and len({r[2] for r in got}) == 5
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-4)


def test_language_sample_is_the_first_rows_by_hash(spark):
    """2,000 rows of a common language, repeated ids counted, all of a rare one."""
    assert langid.SAMPLE >= 2_000
    ids = [*range(6_000), *[17] * 50, *range(500)]
    rows = [(i, "aa") for i in ids] + [(i, "bb") for i in range(10_000, 10_300)]
    known = spark.createDataFrame(rows, "doc_id long, lang string")
    placed = sorted(
        (r["h"], r["doc_id"]) for r in known.where("lang = 'aa'").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    )
    for most in (1, 299, 300, 301, 2_000, 6_549, 6_550, 6_551, 7_000):
        found = [r["doc_id"] for r in langid.first_ids(known, most).collect()]
        rare = [i for i in found if i >= 10_000]
        assert len(found) == len(set(found)) and len(rare) == min(most, 300)
        assert set(found) - set(rare) == {i for _, i in placed[:most]}


def test_languages_without_training(no_docs, spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
    (row,) = langid.identify(no_docs, pages).collect()
    assert (row["page_id"], row["lang"]) == (1, None)


def test_folding_maps_to_letters_and_parts_no_word():
    for letter, to in toxicity._ALIKE.items():
        assert "a" <= to <= "z" and toxicity.fold(f"x{letter}y") == [f"x{to}y"]
    for digit, to in toxicity._DIGITS.items():
        assert toxicity.fold(f"x{digit}y") == [f"x{to}y"]
    for letter in map(chr, [*range(0x3B1, 0x3CA), *range(0x430, 0x460)]):
        assert len(toxicity.fold(f"x{letter}y")) == 1
    assert toxicity.fold("бот") == ["бot"]
    assert toxicity.fold("сор wоrd") == ["cop", "word"]
