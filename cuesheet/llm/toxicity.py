"""Operator 5: toxicity by a learned, weighted lexicon matched with Aho-Corasick."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, kept_rows, table, written

FOLDS = 5
#: Labelled training rows that the lexicon is learned from, at most, per label.
SAMPLE = 5_000
#: Lexicon entries and exception phrases at most; those of most weight stay.
ENTRIES = 2_000
#: Share of the toxic sample rows that an entry must be found in (five rows at least).
SUPPORT = 0.02
#: Log odds that an entry must have.
LEAST_WEIGHT = 4.0
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6)

# fixed values: letters that look alike, and digits and signs that stand for letters
_ALIKE = dict(zip("авекмнорстухьіјѕԁԛԝαβγεικνορτυχω", "abekmhopctyxbijsdqwabyeiknoptuxw", strict=True))
_DIGITS = dict(zip("0134578@$!", "oieastbasi", strict=True))
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def _fold_table() -> bytes:
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        c = _DIGITS.get(c, c)
        out[b] = ord(c) if "a" <= c <= "z" else 32
    return bytes(out)


_ASCII = _fold_table()
# signs stand for letters only where the word goes on after them
_CLOSING = re.compile(rb"[$@!]+(?![A-Za-z0-9$@!])")
_OTHER = {ord(a): b for a, b in _ALIKE.items()}


def fold(text: str) -> list[str]:
    """Words after folding: lower case, look-alike letters, digits that stand for letters.

    A word is a run of what folds to a-z and of letters above ASCII.
    """
    if not text.isascii():
        text = text.translate(_WIDE | _INVISIBLE) if _odd(text) else text
        text = text.lower().translate(_OTHER) if not text.isascii() else text
    data = text.encode("utf-8", "replace")
    if b"$" in data or b"@" in data or b"!" in data:
        data = _CLOSING.sub(b" ", data)
    return data.translate(_ASCII).decode("utf-8", "replace").split()


def _odd(text: str) -> bool:
    return max(text) >= "​" or "­" in text


class Lexicon(NamedTuple):
    """Entries with a leading blank, whole words with a closing one too, and their weights.

    ``exceptions`` are phrases (blanks around them) inside which an entry does not count.
    ``curve`` turns the matched weight into a score.
    """

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]


class Matcher:
    """One automaton over entries and exception phrases."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) outside exceptions in the blank-joined text."""
        if self.empty or not words:
            return []
        found, spared = [], []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                spared.append((end + 1 - size, end + 1))
            else:
                found.append((end + 1 - size, end + 1, weight))
        if spared:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in spared)]
        return found


def features(weight: float, hits: int, n_words: int) -> tuple[float, ...]:
    """What the score rests on: matched weight, and weight and matches by length."""
    size = n_words + 20
    return 1.0, math.log1p(weight), math.log1p(100 * weight / size), math.log1p(100 * hits / size)


def score(curve: tuple[float, ...], x: tuple[float, ...]) -> float:
    z = sum(a * b for a, b in zip(curve, x, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def candidates(words: list[str]) -> set[str]:
    """Entries that a text could support: its words and the beginnings of longer words."""
    out = set()
    for w in set(words):
        if len(w) >= 3:
            out.add(f" {w} ")
        for n in STEMS:
            if len(w) >= n:
                out.add(f" {w[:n]}")
    return out


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that are never learned from: checksum of the id as text, by folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, dict[int, float]]:
    """``bound`` training rows of each label (all if fewer), the first by a hash of the id.

    Their ids are a fixed number, so they are sent to every task and the texts are picked
    out in place; the sample is written once. With it, the share of each label's ids that
    are in it, counted over all labels.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    )
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = [
        known.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(bound) for label in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    shares = {
        r["toxic"]: r["n"] for r in present.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    }
    sample = written(docs.select("doc_id", "text").join(ids, "doc_id"), "sample")
    taken = sample.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()
    return sample, {r["toxic"]: r["n"] / shares[r["toxic"]] for r in taken}


def _counts(sample: DataFrame) -> DataFrame:
    """Rows of each label that support each candidate entry."""
    schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def flush():
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([by[1][n] for n in names], pa.int64()),
                 pa.array([by[0][n] for n in names], pa.int64())], schema=schema,
            )
            by[0].clear()
            by[1].clear()

        for batch in source:
            for data, toxic in zip(blobs(batch), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update(candidates(fold(data.decode("utf-8", "replace"))))
            if len(by[0]) + len(by[1]) > 400_000:
                yield from flush()
        yield from flush()

    return (
        sample.select("text", "toxic")
        .mapInArrow(count, "entry string, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, entries: int) -> dict:
    """Entries with weights (log odds) from (entry, toxic rows, clean rows).

    The most telling come first (rows won, then whole words, then longer ones); an entry
    that an earlier one already matches, or that only widens an earlier one, is left out.
    """
    scored = []
    for entry, toxic, clean in rows:
        p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
        weight = math.log(p / q)
        if weight > LEAST_WEIGHT:
            scored.append((toxic * weight, entry.endswith(" "), len(entry), entry, weight))
    scored.sort(reverse=True)
    out: dict[str, float] = {}
    wider: set[str] = set()
    for _, _, _, entry, weight in scored:
        if entry in wider or any(entry[:n] in out for n in range(2, len(entry))):
            continue
        out[entry] = weight
        wider.update(entry[:n] for n in range(2, len(entry)))
        if len(out) >= entries:
            break
    return out


def _phrases(sample: DataFrame, entries: dict[str, float]) -> DataFrame:
    """Entry matches with one neighbour word, and the rows of each label that hold them."""
    schema = pa.schema([("phrase", pa.string()), ("toxic", pa.int64())])
    lexicon = Lexicon(entries, (), ())

    def look(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in source:
            names, marks = [], []
            for data, toxic in zip(blobs(batch), batch.column("toxic").to_pylist(), strict=True):
                words = fold(data.decode("utf-8", "replace"))
                starts, at = {}, 0
                for i, w in enumerate(words):
                    starts[at] = i
                    at += len(w) + 1
                held = set()
                for start, _, _ in matcher.matches(words):
                    i = starts[start]
                    if i:
                        held.add(f" {words[i - 1]} {words[i]} ")
                    if i + 1 < len(words):
                        held.add(f" {words[i]} {words[i + 1]} ")
                names += held
                marks += [toxic] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(marks, pa.int64())], schema=schema
            )

    return (
        sample.select("text", "toxic")
        .mapInArrow(look, "phrase string, toxic long")
        .groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )


def _matched(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """``weight, hits, n_words`` of every text."""

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in source:
            columns: tuple[list, list, list] = ([], [], [])
            for data in blobs(batch):
                words = fold(data.decode("utf-8", "replace"))
                found = matcher.matches(words)
                for column, value in zip(
                    columns, (sum(m[2] for m in found), len(found), len(words)), strict=True
                ):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(columns[0], pa.float64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                names=[*keep, "weight", "hits", "n_words"],
            )

    ddl = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(scan, f"{ddl}weight double, hits long, n_words long")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES,
    support: float = SUPPORT,
) -> Lexicon:
    """Lexicon, exception phrases and score curve from labelled training rows.

    Uses a spread sample of at most ``sample`` rows of each label, whole texts. What reaches
    the driver is bounded: ``entries`` candidates, as many phrases, three numbers a sample
    row. The curve's odds are those of all labelled rows, however many are in the sample.
    Without rows of both labels the lexicon is empty and every score is 0.
    """
    rows, shares = _sample(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, (), (-60.0, 0.0, 0.0, 0.0))
    least = max(5, int(support * sizes[1]))
    p = (F.col("toxic") + 0.5) / (sizes[1] + 1)
    gain = F.col("toxic") * F.log(p / ((F.col("clean") + 0.5) / (sizes[0] + 1)))
    best = (
        _counts(rows).where(F.col("toxic") >= least).withColumn("gain", gain)
        .orderBy(F.desc("gain"), "entry").limit(10 * entries)
    )
    found = choose(
        [(r["entry"], r["toxic"], r["clean"]) for r in best.collect()], sizes[1], sizes[0], entries
    )
    spare = (
        _phrases(rows, found).where((F.col("clean") >= 3) & (F.col("clean") > 10 * F.col("toxic")))
        .orderBy(F.desc("clean"), "phrase").limit(entries)
    )
    lexicon = Lexicon(found, tuple(r["phrase"] for r in spare.collect()), ())
    at = _matched(rows.select("text", "toxic"), lexicon, "toxic")
    points = at.collect()
    x = np.array([features(r["weight"], r["hits"], r["n_words"]) for r in points])
    y = np.array([r["toxic"] for r in points], dtype=float)
    curve = logistic(x, y)
    # the odds of all labelled rows, not those of the sample
    return lexicon._replace(curve=(curve[0] + math.log(shares[0] / shares[1]), *curve[1:]))


def rate(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row, in place.

    A null or empty text has no match and gets the score of that; long texts are matched
    whole. Equal texts get equal scores.
    """
    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            plain = [batch.column(n).to_pylist() for n in ("weight", "hits", "n_words")]
            values = [
                score(lexicon.curve, features(*row)) for row in zip(*plain, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(values, pa.float64())],
                names=[*keep, "score"],
            )

    ddl = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return _matched(docs, lexicon, *keep).mapInArrow(scored, f"{ddl}score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``limit``; filters in place."""

    def maker():
        matcher = Matcher(lexicon)

        def keep(texts: list[bytes]) -> list[bool]:
            out = []
            for data in texts:
                words = fold(data.decode("utf-8", "replace"))
                found = matcher.matches(words)
                x = features(sum(m[2] for m in found), len(found), len(words))
                out.append(score(lexicon.curve, x) < limit)
            return out

        return keep

    return kept_rows(docs, maker)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document, learned from the training folds."""
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("doc_id")
    return rate(docs, lexicon, "doc_id").select(
        "doc_id", held_out(doc_id).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
