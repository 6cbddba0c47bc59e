"""Operator 7: documents packed into sequences by fitted length patterns."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs, table, written

LENGTH = 1024
END = 2
#: Rows of one ranking task.
RANK_ROWS = 5_000
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Byte-level pairs never reach across a blank that stands alone before a word, or across a
    line feed between words; such chunks are encoded once and kept. Texts with white space
    of another kind are encoded whole. ``<|endoftext|>`` in a text is ordinary text.
    """

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        chunks = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        if "\0" in text or not _plain(text, chunks):
            return self.ids(text)
        out = list(map(known.get, chunks))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    out[i] = known[chunks[i]] = self.ids(chunks[i])
        return b"".join(out)


def _plain(text: str, chunks: list[str]) -> bool:
    """Each chunk but the first is one white space before a character that is none."""
    # a lone separator would be a chunk of length one; other white space shows in split()
    if any(len(c) < 2 for c in chunks[1:]) or text[:1].isspace() or text[-1:].isspace():
        return False
    return len(text.split()) == len(chunks)


def _pieces(source: Iterator[pa.RecordBatch], path: str, length: int, end: int, schema):
    encode = Encoder(path)
    closing = np.array([end], dtype="<u4").tobytes()
    for batch in source:
        out: list[list] = [[] for _ in schema]
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), blobs(batch), strict=True):
            ids = encode(data.decode("utf-8", "replace")) + closing
            total = len(ids) // 4
            first = total % length or length
            start, piece = 0, 0
            while start < total:
                size = first if piece == 0 else length
                part = ids[4 * start : 4 * (start + size)]
                values = (doc_id, piece, start, size, zlib.crc32(part))
                for column, value in zip(out, values, strict=False):
                    column.append(value)
                if len(schema) > 5:
                    out[5].append(np.frombuffer(part, "<u4").tolist())
                start, piece = start + size, piece + 1
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
            )


def token_pieces(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: documents cut to pieces.

    Texts get the closing id ``end``; those longer than ``length`` are cut so that only
    their first piece may be shorter. A null or empty text is its closing id alone.
    """
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda source: _pieces(source, path, length, end, schema),
        "doc_id long, piece int, start long, length long, ids_crc32 long"
        + ", ids array<long>" * with_ids,
    )


def patterns(present: np.ndarray, length: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence exactly, from lengths present."""
    has = np.zeros(length + 1, dtype=bool)
    has[present] = True
    a, b = np.meshgrid(present, present, indexing="ij")
    c = length - a - b
    full = (a <= b) & (c >= b) & has[np.maximum(c, 0)]
    threes = np.column_stack([a[full], b[full], c[full]])
    twos = present[(present <= length - present) & has[length - present]]
    return np.concatenate(
        [np.column_stack([twos, length - twos, 0 * twos]), threes]
    ).astype(np.int64)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats of the patterns that best give the counts.

    Accelerated projected gradient on ``|A x - h|^2``; ``A`` has three ones a column, so a
    step is a gather and a ``bincount``.
    """
    if not len(rows):
        return np.zeros(0)
    use = rows > 0

    def back(r):
        return np.where(use, r[rows], 0.0).sum(axis=1)

    def apply(x):
        weight = np.repeat(x[:, None], 3, axis=1)[use]
        return np.bincount(rows[use], weights=weight, minlength=len(counts))

    v = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue of A'A gives the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - back(apply(z) - counts) / top)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(counts: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, how many, first sequence, offset)`` for all pieces.

    The pieces of a length are known by rank. Fitted patterns are rounded and taken as long
    as the histogram has what they need; what is left is packed best fit, longest first, a
    whole run of equal lengths into a whole run of equally filled sequences at a time.
    """
    left = counts.astype(np.int64).copy()
    rank = np.zeros_like(left)
    out, sequence = [], 0
    present = np.flatnonzero(left)
    rows = patterns(present[present < length], length)
    x = fit(rows, left.astype(float))

    def take(size: int, many: int, first: int, offset: int) -> None:
        out.append((int(size), int(rank[size]), int(many), int(first), int(offset)))
        rank[size] += many
        left[size] -= many

    for up in (False, True):  # whole repeats first, then what rounding up still allows
        for p in np.argsort(-x, kind="stable"):
            sizes = [int(s) for s in rows[p] if s]
            need = defaultdict(int)
            for s in sizes:
                need[s] += 1
            many = min(left[s] // n for s, n in need.items())
            many = min(many, int(np.floor(x[p])) if not up else int(np.round(x[p] % 1)))
            if many <= 0:
                continue
            offset = 0
            for s in sizes:
                take(s, many, sequence, offset)
                offset += s
            sequence += many
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space: (first, many)
    for size in range(length, 0, -1):
        while left[size]:
            space = next((f for f in range(size, length) if open_runs[f]), None)
            if space is None:
                # a new sequence takes as many of this length as fit
                fits = length // size
                fresh = max(1, left[size] // fits)
                each = min(fits, left[size])
                for i in range(each):
                    take(size, fresh, sequence, i * size)
                if length - each * size:
                    open_runs[length - each * size].append((sequence, fresh))
                sequence += fresh
                continue
            first, many = open_runs[space].pop()
            used = min(many, left[size])
            take(size, used, first, length - space)
            if used < many:
                open_runs[space].append((first + used, many - used))
            if space > size:
                open_runs[space - size].append((first, used))
    return out


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: as few sequences as the plan finds.

    ``pieces`` is written once to the shared folder, so ranks do not change when a task
    runs again. Only the histogram (``length`` numbers) is counted to the driver, where
    :func:`plan` works on it. A full piece is a sequence of its own. All others are ranked
    within their length: in chunks of about ``RANK_ROWS`` rows, with the chunks' counts as
    offsets, so that a length that holds a third of all pieces is many tasks.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    stored = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(length + 1, dtype=np.int64)
    for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    total = int(histogram.sum())
    histogram[length] = 0
    runs = plan(histogram, length)
    step = 1 << 40  # more than the ranks of one length
    table_ = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = table_[:, 0] * step + table_[:, 1]
    shared = spark.sparkContext.broadcast((keys, table_))
    used = int((table_[:, 3] + table_[:, 2]).max()) if len(table_) else 0

    chunks = max(1, total // RANK_ROWS)
    short = stored.where(F.col("length") < length).withColumn(
        "_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks))
    )
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = short.groupBy("length", "_chunk").agg(F.count("*").alias("_n")).select(
        "length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("length", "_chunk").orderBy("_row")
    ranked = short.withColumn("_rank", F.row_number().over(within) - 1).join(
        offsets, ["length", "_chunk"]
    ).select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    out_schema = [f for f in stored.schema if f.name in names]
    order = [f.name for f in out_schema]

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in source:
            size = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, size * step + rank, side="right") - 1
            run = rows[at] if len(rows) else np.zeros((0, 5), dtype=np.int64)
            columns = [batch.column(n) for n in order]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=[*order, "sequence_id", "offset"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema)
    placed = ranked.select(*order, "_rank").mapInArrow(
        place, f"{ddl}, sequence_id long, offset long"
    )
    full = stored.where(F.col("length") >= length).select(
        *order, (F.lit(used) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(token_pieces(table(spark, sf_dir, "documents"), path)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
