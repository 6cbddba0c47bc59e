"""Operator 3: language by fused evidence of text, markup, address and host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs, numbered, table, written

FOLDS = 5
#: Training rows of one language at most.
SAMPLE = 2_000
#: Languages of one scan of the texts (13 MB of chances); more languages take more scans.
BLOCK = 100
#: Bits of the hash that part the rows of a language before the last few are ranked.
PARTS = 12
#: Hash buckets of byte triples.
BUCKETS = 1 << 15
#: Triples that a text counts for at most, as neighbouring ones say the same thing.
WEIGHT = 40.0
#: Rows that a parent's prior is worth: suffix under all, host under suffix; declared values.
PRIOR = 4.0

# fixed values: where markup declares its language, and what is not text
_HTML = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]+)", re.I)
_SKIP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(rb"<[^>]*>")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def triples(text: bytes) -> np.ndarray:
    """Buckets of the text's byte triples, letters lowered."""
    a = np.frombuffer(b" " + text.translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def visible(html: bytes) -> bytes:
    return _TAG.sub(b" ", _SKIP.sub(b" ", html))


def declared(html: bytes) -> str | None:
    found = _HTML.search(html) or _META.search(html)
    return found[1].decode("ascii").lower() if found else None


def address(url: str | None) -> tuple[str, str]:
    """Host and its last label; empty where the address has none."""
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        host = ""
    suffix = host.rpartition(".")[2]
    return host, "" if suffix.isdigit() else suffix


def first_ids(known: DataFrame, most: int) -> DataFrame:
    """``doc_id`` of the first ``most`` rows of each language by a hash of the id.

    Counts by the first bits of the hash tell in which part the last of them is: rows of the
    parts before are in, and only ids of that part are ranked, so no task meets all rows of
    a common language.
    """
    place = F.xxhash64("doc_id")
    rows = known.select("lang", "doc_id", F.shiftright(place, 64 - PARTS).alias("part"))
    upto = Window.partitionBy("lang").orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )  # at most 2^PARTS counts of a language
    sizes = rows.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn(
        "upto", F.sum("n").over(upto)
    )
    cuts = written(
        sizes.where(F.lit(most).between(F.col("upto") - F.col("n") + 1, F.col("upto"))).select(
            "lang", F.col("part").alias("cut"), (most - (F.col("upto") - F.col("n"))).alias("room")
        ),
        "cuts",
    )  # a row for each language with ``most`` rows
    rows = rows.join(cuts, "lang", "left").where("cut is null or part <= cut")
    order = Window.partitionBy("lang").orderBy(place, "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = rows.where("part = cut").groupBy("lang", "doc_id", "room").agg(F.count("*").alias("n"))
    last = last.withColumn("upto", F.sum("n").over(order)).where("upto - n < room")
    early = rows.where("cut is null or part < cut").select("doc_id")
    return early.unionByName(last.select("doc_id")).distinct()


def learn(docs: DataFrame) -> tuple[list[str], list[Broadcast]]:
    """Languages and log chances of the triple buckets, in blocks of ``BLOCK`` languages.

    Every language that has a training row is one; it is learned from at most ``SAMPLE``
    training rows, the first by a hash of the id, whose texts are read whole. The driver
    holds one block at a time. Without training rows there is one block of no language.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    ids = written(first_ids(known, SAMPLE), "sample")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in source:
            for lang, data in zip(batch.column("lang").to_pylist(), blobs(batch), strict=True):
                part = np.bincount(triples(data), minlength=BUCKETS)
                held[lang] = held[lang] + part if lang in held else part
        yield from pieces(held)

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in source:
            for lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(data, np.int64)
                held[lang] = held[lang] + part if lang in held else part
        yield from pieces(held)

    def pieces(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([part.tobytes()], pa.binary())],
                names=["lang", "counts"],
            )

    ddl = "lang string, counts binary"
    sample = known.select("doc_id", "lang", "text").join(ids, "doc_id")
    summed = sample.select("lang", "text").mapInArrow(count, ddl).repartition("lang").mapInArrow(add, ddl)
    names, blocks, held = [], [], []

    def close() -> None:
        logs = np.log(np.stack(held)).astype(np.float32) if held else np.zeros((0, BUCKETS), np.float32)
        blocks.append(docs.sparkSession.sparkContext.broadcast(logs))
        held.clear()

    for r in summed.orderBy("lang").toLocalIterator():
        smooth = np.frombuffer(r["counts"], np.int64) + 0.5
        names.append(r["lang"])
        held.append(smooth / smooth.sum())
        if len(held) == BLOCK:
            close()
    if held or not blocks:
        close()
    return names, blocks


_ROW = [
    ("kind", pa.string()), ("id", pa.int64()), ("host", pa.string()), ("suffix", pa.string()),
    ("declared", pa.string()), ("row", pa.int64()), ("text", pa.list_(pa.float64())),
    ("best", pa.float64()),
]
_DDL = (
    "kind string, id long, host string, suffix string, declared string, row long, "
    "text array<double>, best double"
)


def likelihoods(chances: np.ndarray, data: bytes) -> np.ndarray:
    """Log likelihoods of a text; a long one is counted first, so memory has a bound."""
    at = triples(data)
    share = min(1.0, WEIGHT / max(1, len(at)))
    if len(at) <= BUCKETS:
        return chances[:, at].sum(axis=1, dtype=np.float64) * share
    return chances.astype(np.float64) @ np.bincount(at, minlength=BUCKETS) * share


def _scan(rows: DataFrame, known: set[str], block: Broadcast, pages: bool) -> DataFrame:
    """Per row its evidence for one block of languages, as distances from the ``best`` of them."""
    schema = pa.schema(_ROW)

    def look(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = block.value
        for batch in source:
            out: list[list] = [[] for _ in schema.names]
            columns = [batch.column(n).to_pylist() for n in ("id", "place", "row")]
            for key, place, row, data in zip(*columns, blobs(batch, "content"), strict=True):
                host, suffix, says = place or "", "", None
                if pages:
                    host, suffix = address(place)
                    says = declared(data)
                    says = "none" if says is None else says if says in known else "other"
                    data = visible(data)
                sums = likelihoods(chances, data)
                best = float(sums.max()) if len(sums) else 0.0
                values = (
                    "page" if pages else "document", key, host, suffix, says or "none", row,
                    (sums - best).tolist(), best,
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
            )

    return rows.select("id", "place", "content", "row").mapInArrow(look, _DDL)


def _evidence(rows: DataFrame, names: list[str], blocks: list[Broadcast], pages: bool) -> DataFrame:
    """Per row the log likelihoods of its text, what it declares and where it is from.

    Each block of languages is one scan of the texts; several scans meet by row numbers.
    """
    known = set(names)
    if len(blocks) == 1:
        plain = rows.withColumn("row", F.lit(0).cast("long"))
        return _scan(plain, known, blocks[0], pages).drop("row", "best")
    stored, row = numbered(rows)
    stored = stored.withColumnRenamed(row, "row")
    found = None
    for i, block in enumerate(blocks):
        part = written(_scan(stored, known, block, pages), "scan").withColumnsRenamed(
            {"text": f"text{i}", "best": f"best{i}"}
        )
        found = found.join(part.select("row", f"text{i}", f"best{i}"), "row") if found else part
    top = F.greatest(*(f"best{i}" for i in range(len(blocks))))

    def moved(i: int) -> Column:
        return F.transform(f"text{i}", lambda x: x + (F.col(f"best{i}") - F.col("top")))

    return found.withColumn("top", top).select(
        "kind", "id", "host", "suffix", "declared",
        F.concat(*map(moved, range(len(blocks)))).alias("text"),
    )


def _sums(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows and summed shares of each language by ``keys``."""
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(size)]
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *sums).select(
        *keys, "n", F.array(*(f"s{i}" for i in range(size))).alias("sums")
    )


def _smoothed(sums: Column, n: Column, parent: Column) -> Column:
    return F.zip_with(sums, parent, lambda s, p: (s + PRIOR * p) / (n + PRIOR))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, lang, chance, text_lang`` for every document and every page.

    The log chance of each language adds three pieces of evidence:

    - the text: byte triples under chances learned from documents with a language;
    - what the markup declares: how often rows of a language declare this value;
    - the host: the languages of its other rows, smoothed towards those of its address
      suffix, and these towards those of all rows of the kind (documents have their source
      as host and no suffix).

    The second and third come from grouped aggregates over all rows, in which a row counts
    with the shares that its text alone gives; a row's own share is taken out of its host
    again. Null and empty texts have no text evidence and go by the others; a row without a
    host is smoothed with its like. Without documents that have a language, ``lang`` is
    null. Frequent hosts and suffixes meet their priors in joins that Spark may split.
    """
    names, blocks = learn(docs)
    size = len(names)
    as_docs = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("place"),
        F.col("text").alias("content"),
    )
    as_pages = pages.select(
        F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("place"),
        F.col("html").alias("content"),
    )
    rows = _evidence(as_docs, names, blocks, False).unionByName(
        _evidence(as_pages, names, blocks, True)
    )
    ids = [
        F.when(F.col("kind") == kind, F.col("id")).alias(name)
        for kind, name in (("document", "doc_id"), ("page", "page_id"))
    ]
    if not size:
        nothing = F.lit(None)
        return rows.select(
            *ids, nothing.cast("string").alias("lang"), nothing.cast("double").alias("chance"),
            nothing.cast("string").alias("text_lang"),
        )
    power = F.transform("text", lambda x: F.exp(x))
    total = F.aggregate("power", F.lit(0.0), lambda a, x: a + x)
    rows = written(
        rows.withColumn("power", power).withColumn("share", F.transform("power", lambda x: x / total))
        .drop("power"),
        "evidence",
    )
    even = F.array(*([F.lit(1.0 / size)] * size))
    everything = written(
        _sums(rows, ["kind"], size).select(
            "kind", F.col("sums").alias("kind_sums"), _smoothed(F.col("sums"), F.col("n"), even).alias("top")
        ),
        "kinds",
    )  # two rows
    says = _sums(rows, ["kind", "declared"], size).join(F.broadcast(everything), "kind").select(
        "kind", "declared",
        F.transform(
            F.zip_with("sums", "kind_sums", lambda s, t: (s + PRIOR / (size + 2)) / (t + PRIOR)),
            lambda p: F.log(p),
        ).alias("by_declared"),
    )  # for both kinds a row per language, and two more
    suffixes = _sums(rows, ["kind", "suffix"], size).join(F.broadcast(everything), "kind").select(
        "kind", "suffix", _smoothed(F.col("sums"), F.col("n"), F.col("top")).alias("by_suffix")
    )
    hosts = _sums(rows, ["kind", "suffix", "host"], size).join(suffixes, ["kind", "suffix"]).select(
        "kind", "suffix", "host", F.col("sums").alias("host_sums"), F.col("n").alias("host_n"), "by_suffix"
    )
    others = F.zip_with("host_sums", "share", lambda s, own: F.greatest(s - own, F.lit(0.0)))
    fused = rows.join(hosts, ["kind", "suffix", "host"]).join(F.broadcast(says), ["kind", "declared"])
    prior = _smoothed(others, F.col("host_n") - 1, F.col("by_suffix"))
    scores = F.zip_with(
        F.zip_with("text", "by_declared", lambda a, b: a + b),
        F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b,
    )
    listed = F.array(*map(F.lit, names))
    fused = fused.withColumn("scores", scores).withColumn("best", F.array_max("scores"))
    norm = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return fused.select(
        *ids, F.element_at(listed, F.array_position("scores", F.col("best")).cast("int")).alias("lang"),
        (1 / norm).alias("chance"),
        F.element_at(listed, F.array_position("text", F.array_max("text")).cast("int")).alias("text_lang"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page."""
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
