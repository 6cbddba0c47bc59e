"""Operator 12: documents drawn by how much they look like a target, lines weighed once."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import attach_groups, ranked
from .common import blobs, table, written

#: Longest run of words that is a feature, and the buckets that features fall into.
RUN, BUCKETS = 3, 10_000
#: Fewest words of a document that may be drawn, the share drawn, and the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42

# A-Z to a-z; digits, a-z and every byte above 0x7F are word bytes; all others separate
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def buckets(line: list[bytes]) -> list[int]:
    """Buckets of all runs of one to three words of a line, repeats too.

    A longer run's checksum goes on from that of the run without its last word.
    """
    out = []
    one = two = None
    for word in line:
        more = b" " + word
        three = None if two is None else crc32(more, two)
        two = None if one is None else crc32(more, one)
        one = crc32(word)
        out.append(one % BUCKETS)
        if two is not None:
            out.append(two % BUCKETS)
        if three is not None:
            out.append(three % BUCKETS)
    return out


def crossing(lines: list[list[bytes]]) -> list[int]:
    """Buckets of the runs that begin on one line and end on a later one."""
    out = []
    tail: list[tuple[bytes, int]] = []  # the last words so far, each with its line
    for number, line in enumerate(lines):
        for word in line[: RUN - 1]:
            for first in range(len(tail)):
                if tail[first][1] != number:
                    run = b" ".join([*(w for w, _ in tail[first:]), word])
                    out.append(crc32(run) % BUCKETS)
            tail = [*tail, (word, number)][-(RUN - 1) :]
        if len(line) >= RUN:
            tail = [(word, number) for word in line[-(RUN - 1) :]]
    return out


def _packed(values: list[int]) -> bytes:
    return np.array(values, "<u2").tobytes()


def _name(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()


def _lines(rows: DataFrame) -> DataFrame:
    """``line, n``: the different lines of all texts and how often each is there."""
    line = F.explode(F.split("text", "\n")).alias("line")
    return rows.where("text is not null").select(line).where("line <> ''").groupBy("line").agg(
        F.count("*").alias("n")
    )


def line_features(rows: DataFrame) -> DataFrame:
    """``line, n, features``: name, occurrences and buckets of every different line with words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            data = blobs(batch, "line")
            found = [_packed(buckets(words(line))) for line in data]
            out = pa.RecordBatch.from_arrays(
                [pa.array([_name(line) for line in data], pa.binary()), batch.column("n"),
                 pa.array(found, pa.binary())],
                names=["line", "n", "features"],
            )
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return _lines(rows).mapInArrow(run, "line binary, n long, features binary")


def row_lines(rows: DataFrame) -> DataFrame:
    """``_row, doc_id, n_words, features, lines, times`` of every row.

    ``features`` are the runs across lines only; ``lines`` names the different lines with words,
    ``times`` says how often each is in the text.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[list] = [[] for _ in range(4)]
            for data in blobs(batch):
                lines = data.split(b"\n")
                split = [words(line) for line in lines]
                held = Counter(line for line, found in zip(lines, split, strict=True) if found)
                values = (
                    sum(map(len, split)), _packed(crossing(split)), [_name(line) for line in held],
                    list(held.values()),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"),
                 *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["_row", "doc_id", "n_words", "features", "lines", "times"],
            )

    named = rows.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return named.mapInArrow(
        run, "_row long, doc_id long, n_words long, features binary, lines array<binary>, times array<long>"
    )


def bucket_counts(parts: DataFrame) -> DataFrame:
    """``bucket, n``: features of ``n, features`` rows, each counted ``n`` times."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in source:
            times = batch.column("n").to_numpy()
            sizes, flat = _flat(batch)
            np.add.at(total, flat, np.repeat(times, sizes))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(total[met])], names=["bucket", "n"]
        )

    return parts.select("n", "features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data = batch.column("features").to_pylist()
    sizes = np.fromiter((len(d) // 2 for d in data), np.int64, len(data))
    return sizes, np.frombuffer(b"".join(data), "<u2").astype(np.int64)


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket from both ``bucket, n`` tables (``BUCKETS`` whole numbers)."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    ).select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    both = written(both, "buckets")
    size = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(size["s"] + BUCKETS) / ((F.col("s") + 1) * F.lit(size["t"] + BUCKETS))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    return out


def _weighed(parts: DataFrame, columns: list[str], gain) -> DataFrame:
    """``columns`` and ``weight``, the sum of the gains of ``features``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, flat = _flat(batch)
            upto = np.r_[0, np.cumsum(gain.value[flat])]
            ends = np.cumsum(sizes)
            weight = upto[ends] - upto[ends - sizes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(weight, pa.int64())],
                names=[*columns, "weight"],
            )

    kinds = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns)
    return parts.select(*columns, "features").mapInArrow(run, f"{kinds}, weight long")


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``_row, doc_id, n_words, weight`` for every row of ``docs``.

    Newlines cut the texts into lines. Equal lines of all texts meet in a count, so the
    features inside a different line are worked out once: times its occurrences they are the
    corpus counts, and its sum of gains is what each text that has it adds as often as it has
    it. Runs of words across lines are added from the texts themselves. Lines are known by
    their SHA-256. The most frequent lines are joined by a broadcast of fixed length, every
    other one is below a thousandth of all.
    """
    rows = written(row_lines(docs), "rows")
    lines = written(line_features(docs), "lines")
    once = rows.select(F.lit(1).cast("long").alias("n"), "features")
    corpus = bucket_counts(lines.select("n", "features").unionByName(once))
    wanted = written(line_features(target), "target-lines")
    cross = row_lines(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    aim = bucket_counts(
        wanted.select("n", "features").unionByName(cross.select(F.lit(1).cast("long").alias("n"), "features"))
    )
    gain = docs.sparkSession.sparkContext.broadcast(gains(corpus, aim))
    groups = written(_weighed(lines, ["line", "n"], gain), "line-weights")
    met = rows.select("_row", F.explode(F.arrays_zip("lines", "times")).alias("l")).select(
        "_row", F.col("l.lines").alias("line"), F.col("l.times").alias("times")
    )
    told = attach_groups(met, groups, ["line"], "n", ["_row"])
    inside = told.select(
        "_row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"),
        (F.col("times") * F.col("weight")).alias("weight"),
    )
    across = _weighed(rows, ["_row", "doc_id", "n_words"], gain)
    return across.unionByName(inside).groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``.

    ``weight`` is the log ratio (in thousandths, each bucket's rounded down) of the row's
    features under the counts of ``target`` and of ``docs``; ``score`` adds Gumbel noise made of
    the seed and ``doc_id`` (null: nothing in its place). Of the N rows with at least
    ``LEAST_WORDS`` words the ``percent * N div 100`` highest scores are drawn and have a
    ``rank``; ties go to the smaller ``doc_id``, null last. Null or empty texts have no
    features and weight 0. Every row is a document of its own. Only ``doc_id, text`` are read.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    runs = sum((F.greatest(F.col("n_words") - i, F.lit(0)) for i in range(1, RUN)), F.col("n_words"))
    scored = written(
        weigh(docs, target).select(
            "_row", "doc_id", runs.cast("long").alias("n_features"), "weight",
            (F.col("weight") + noise).cast("long").alias("score"),
            (F.col("n_words") >= LEAST_WORDS).alias("_open"),
        ),
        "scored",
    )
    many = percent * scored.where("_open").count() // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")]
    first = _candidates(scored, many)
    drawn = written(
        ranked(first, [], order, "rank").where(F.col("rank") <= many).select("_row", "rank"), "drawn"
    )
    return scored.join(drawn, "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def _candidates(scored: DataFrame, many: int) -> DataFrame:
    """Open rows from the score on that surely holds the ``many`` highest.

    The bound comes from a histogram of the scores (a row for each thousand of them between
    the extremes), so what is sorted is not much more than what is drawn.
    """
    rows = scored.where("_open").select("_row", "doc_id", "score")
    edge = rows.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if not many or edge["low"] is None:
        return rows.limit(0)
    step = max(1, (edge["high"] - edge["low"]) // 1000)
    at = F.floor((F.col("score") - edge["low"]) / step).cast("long").alias("at")
    least = 0
    for r in sorted(rows.groupBy(at).count().collect(), key=lambda r: -r["at"]):
        many -= r["count"]
        if many <= 0:
            least = r["at"]
            break
    return rows.where(F.col("score") >= edge["low"] + least * step)


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
                                                      ELSE c >> 1 END, i) AS v
    FROM range(256) r(i))),
rows AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')
  FROM benchmark),
grams AS (
  SELECT side, doc_id, unnest(flatten([
    w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS g
  FROM rows),
counted AS (SELECT side, doc_id, g, count(*) AS n FROM grams GROUP BY side, doc_id, g),
named AS (
  SELECT g, (xor(list_reduce(
      list_transform(range(1, 2 * strlen(g), 2), lambda p: ('0x' || substr(hex(g), p, 2))::BIGINT),
      lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295)) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT g FROM counted), crc),
sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM range({BUCKETS}) b(bucket) LEFT JOIN (SELECT * FROM counted JOIN named USING (g)) c ON c.bucket = b.bucket
  GROUP BY b.bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain
  FROM sums),
weights AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN named USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM rows LEFT JOIN weights USING (doc_id) WHERE side = 0),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many
  FROM scored WHERE n >= {LEAST_WORDS})
SELECT doc_id, n + greatest(n - 1, 0) + greatest(n - 2, 0) AS n_features, weight, score,
       CASE WHEN rank <= {PERCENT} * many // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
