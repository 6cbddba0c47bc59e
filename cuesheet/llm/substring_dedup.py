"""Operator 9: repeated word windows, found by recompression symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, numbered, table, text_key, written
from .recompress import BREAK, Sums, segments, word_names

#: Words of a window.
WIDTH = 35
ROUNDS = 6
#: Words that are worked on at once; longer texts are cut into overlapping pieces.
CHUNK = 100_000

_STEP = 64  # more than the windows of one segment


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


class Chunk:
    """Texts laid out one after another, with a break after each piece."""

    def __init__(self, width: int) -> None:
        self.width, self.parts, self.size = width, [], 0
        self.owner: list[tuple[int, int, int]] = []  # (begin here, text, first word)

    def add(self, text: int, names: np.ndarray) -> None:
        for at in range(0, max(1, len(names)), CHUNK):
            piece = names[at : at + CHUNK + self.width - 1]
            if len(piece) < self.width:
                continue
            self.owner.append((self.size, text, at))
            self.parts += [piece, np.full(1, BREAK)]
            self.size += len(piece) + 1

    def segments(self):
        """(texts, symbol names, stretch names, first windows, lengths) in text order."""
        if not self.parts:
            return None
        names = np.concatenate(self.parts)
        symbol, first, last = segments(names, self.width, ROUNDS)
        stretch = Sums(names).stretch(first, last + self.width)
        begin, text, word = (np.array(c) for c in zip(*self.owner, strict=True))
        k = np.searchsorted(begin, first, side="right") - 1
        return text[k], symbol, stretch, first - begin[k] + word[k], last - first


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """A row per text: its words, digest, and the segments of its windows.

    A segment is a run of windows with the same symbol: ``name`` of the symbol, ``span``
    (name of all words of the run), ``at`` (first window * 64 + further windows).
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()),
         ("sha", pa.binary()), ("name", pa.list_(pa.int64())), ("span", pa.list_(pa.int64())),
         ("at", pa.list_(pa.int64()))]
    )

    def survey(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list, chunk: Chunk) -> pa.RecordBatch:
            found = chunk.segments()
            empty = np.zeros(0, np.int64)
            lists = [[empty] * len(rows) for _ in range(3)]
            if found is not None:
                text, symbol, stretch, first, more = found
                cut = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                values = (symbol.view(np.int64), stretch.view(np.int64), first * _STEP + more)
                for column, value in zip(lists, values, strict=True):
                    for t, part in zip(text[cut], np.split(value, cut[1:]), strict=True):
                        column[t] = part
            plain = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip([*plain, *lists], schema, strict=True)],
                schema=schema,
            )

        rows, chunk = [], Chunk(width)
        for batch in source:
            keys = [batch.column(n).to_pylist() for n in ("doc_id", "k1", "k2")]
            for *key, data in zip(*keys, blobs(batch), strict=True):
                words = data.split()
                chunk.add(len(rows), word_names(words))
                rows.append((*key, len(words), _digest(words)))
                if chunk.size > CHUNK or len(rows) >= 2000:
                    yield settle(rows, chunk)
                    rows, chunk = [], Chunk(width)
        if rows:
            yield settle(rows, chunk)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text"
    ).mapInArrow(
        survey, "doc_id long, k1 long, k2 long, n_words long, sha binary, name array<long>, "
        "span array<long>, at array<long>"
    )


def _packed(docs: DataFrame) -> DataFrame:
    """``k1, k2, packed``: texts compressed for the way through a shuffle."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in source:
            packed = pa.array([packer.compress(b) for b in blobs(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names if n != "text"), packed],
                names=[*(n for n in batch.schema.names if n != "text"), "packed"],
            )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text"]
    return docs.select(*columns).mapInArrow(pack, "doc_id long, k1 long, k2 long, packed binary")


def _unpacked(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def _windows(open_texts: DataFrame, width: int) -> DataFrame:
    """``window, row, first, alone``: a row for each window of the listed segments."""
    schema = pa.schema(
        [("window", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("alone", pa.bool_())]
    )

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            held, size = [], 0
            columns = (batch.column(n).to_pylist() for n in ("row", "packed", "segments"))
            for row, packed, listed in zip(*columns, strict=True):
                sums = Sums(word_names(_unpacked(packed)))
                at = np.array([s["at"] for s in listed])
                alone = np.array([s["alone"] for s in listed])
                many = at % _STEP + 1
                first = np.repeat(at // _STEP - np.cumsum(many) + many, many) + np.arange(many.sum())
                names = sums.stretch(first, first + width).view(np.int64)
                held.append((names, np.full(len(first), row), first, np.repeat(alone, many)))
                size += len(first)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema
                    )
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema
                )

    return open_texts.select("row", "packed", "segments").mapInArrow(
        cut, "window long, row long, first long, alone boolean"
    )


def repeated_ranges(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(texts, ranges)``: every text with its digest, and its words that occur elsewhere.

    ``texts``: ``row, doc_id, k1, k2, n_words, sha`` per input row. ``ranges``: ``row`` and
    ``ranges``, an array of ``from, to`` (words, end exclusive, possibly overlapping)
    that are windows of ``width`` words whose sequence also starts anywhere else.

    1. Each task names words, their runs and pairs in rounds (:mod:`recompress`); names are
       computed from the content, so they agree everywhere. A window is represented by one
       symbol inside it; neighbouring windows with the same symbol are a segment.
    2. Symbols are counted over the corpus. A window whose symbol is met once is unique;
       only segments of shared symbols go on.
    3. Segments are compared as a whole: all windows of a segment that occurs twice are
       repeated, one row instead of many. Where a symbol stands in different segments, one
       occurrence of each is cut into its windows, and these are counted.

    Names are 64-bit values; a chance match of two different windows would have to agree in
    them. Frequent symbols meet in joins that Spark can split and in combining aggregates.
    """
    survey = written(
        _survey(docs, width).withColumn("row", F.monotonically_increasing_id()), "survey"
    )
    # positions in lists of one length: zipped by the explode
    rows = survey.select("row", F.explode(F.arrays_zip("name", "span", "at")).alias("s")).select(
        "row", "s.name", "s.span", "s.at"
    )
    # written, as Spark can split a frequent key only where both sides come straight from a
    # shuffle
    shared = written(
        survey.select(F.explode("name").alias("name")).groupBy("name").agg(
            F.count("*").alias("n")
        ).where("n > 1").select("name"),
        "shared",
    )
    live = written(rows.join(shared, "name"), "live")
    spans = written(
        live.groupBy("name", "span").agg(
            F.count("*").alias("times"), F.min(F.struct("row", "at")).alias("one")
        ),
        "spans",
    )
    whole = live.join(spans.where("times > 1").select("name", "span"), ["name", "span"]).select(
        "row", (F.col("at") / _STEP).cast("long").alias("from"),
        ((F.col("at") / _STEP).cast("long") + F.col("at") % _STEP + width).alias("to"),
    )
    several = spans.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    listed = spans.join(several, "name").groupBy(F.col("one.row").alias("row")).agg(
        F.collect_list(
            F.struct(F.col("one.at").alias("at"), (F.col("times") == 1).alias("alone"))
        ).alias("segments")
    )
    keyed = listed.join(survey.select("row", "k1", "k2"), "row")
    packed = _packed(docs).drop("doc_id")
    cut = written(_windows(packed.join(keyed, ["k1", "k2"]), width), "windows")
    twice = cut.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single = cut.where("alone").join(twice, "window").select(
        "row", F.col("first").alias("from"), (F.col("first") + width).alias("to")
    )
    ranges = whole.unionByName(single).groupBy("row").agg(
        F.collect_list(F.struct("from", "to")).alias("ranges")
    )
    return survey.select("row", "doc_id", "k1", "k2", "n_words", "sha"), ranges


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row; ``kept`` is the SHA-256 of what is left.

    Every word inside a window that also starts anywhere else, the same text included, goes;
    windows are judged on the input. Null and empty texts, and those with fewer words than
    a window, lose nothing. Equal rows get equal results and stay as many as they are;
    other columns are not read.
    """
    texts, ranges = repeated_ranges(docs, width)
    found = written(texts.join(ranges, "row", "left"), "ranges")
    clean = found.where("ranges is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"),
        F.lower(F.hex("sha")).alias("kept"),
    )
    hit = found.where("ranges is not null").dropDuplicates(["k1", "k2"]).select(
        "k1", "k2", "ranges"
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
         ("kept", pa.string())]
    )

    def strip(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[list] = [[] for _ in schema.names]
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "packed", "ranges"))
            for doc_id, packed, ranges in zip(*columns, strict=True):
                words = _unpacked(packed)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [r["from"] for r in ranges], 1)
                np.add.at(edges, [r["to"] for r in ranges], -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                values = (doc_id, len(words), int(gone.sum()), _digest(kept).hex())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
            )

    stripped = _packed(docs).join(hit, ["k1", "k2"]).select("doc_id", "packed", "ranges").mapInArrow(
        strip, "doc_id long, n_words long, n_removed long, kept string"
    )
    return clean.unionByName(stripped)


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the words that :func:`remove_repeats` counts, all columns and rows kept.

    A text that loses words becomes its kept words joined by one space (empty if none is
    left); every other text, null and empty ones too, stays as it is. Rows are known by a
    written number, so repeated ids and null ids stay apart; any other column may be there.
    """
    names = docs.columns
    stored, row = numbered(docs)
    texts, ranges = repeated_ranges(stored.select(F.col(row).alias("doc_id"), "text"), width)
    hit = texts.join(ranges, "row").select(
        F.col("doc_id").alias(row), F.col("ranges").alias(f"{row}_ranges")
    )

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            column, texts = [], batch.column("text")
            at = batch.column(f"{row}_ranges").to_pylist()
            for text, data, ranges in zip(texts.to_pylist(), blobs(batch), at, strict=True):
                if ranges:
                    words = data.split()
                    gone = np.zeros(len(words), bool)
                    for r in ranges:
                        gone[r["from"] : r["to"]] = True
                    text = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()
                column.append(text)
            columns = [
                pa.array(column, texts.type) if name == "text" else batch.column(name) for name in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.join(hit, row, "left").mapInArrow(cut, docs.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are removed as parts of repeated windows."""
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")
