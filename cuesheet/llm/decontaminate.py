"""Operator 2: benchmark passages in documents, by one Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, kept_rows, table

WINDOW = 10
#: Item text of one automaton; more items are scanned for in further blocks.
PART_BYTES = 512 << 10

# A-Z to a-z; digits, a-z and every byte above 0x7F are word bytes; all others separate
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Windows:
    """Aho-Corasick automaton over word numbers; the patterns are the items' windows."""

    def __init__(self, items: list[tuple[int | None, str]], width: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            seq = tuple(
                self.numbers.setdefault(w, len(self.numbers) + 1)
                for w in words((text or "").encode())
            )
            n = min(width, len(seq))
            for i in range(len(seq) - n + 1 if seq else 0):
                owners.setdefault(seq[i : i + n], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, owner in owners.items():
            self.automaton.add_word(seq, (len(seq), tuple(o for o in owner if o is not None)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (end exclusive, merged) that are hit, and the items found."""
        ranges: list[tuple[int, int]] = []
        items: set = set()
        if self.empty:
            return ranges, items
        get = self.numbers.get
        for end, (n, owner) in self.automaton.iter(tuple([get(w, 0) for w in seq])):
            items.update(owner)
            start, stop = end + 1 - n, end + 1
            while ranges and ranges[-1][1] >= start:
                a, b = ranges.pop()
                start, stop = min(a, start), max(b, stop)
            ranges.append((start, stop))
        return ranges, items


def char_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code points of the original text."""
    bounds = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    out = []
    for a, b in ranges:
        start = len(data[: bounds[a][0]].decode("utf-8", "replace"))
        size = len(data[bounds[a][0] : bounds[b - 1][1]].decode("utf-8", "replace"))
        out.append({"start": start, "end": start + size})
    return out


def _scan(docs: DataFrame, items: list[tuple[int | None, str]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
            ("items", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Windows(shared.value, width)
        for batch in source:
            out: list[list] = [[] for _ in schema.names[1:]]
            for data in blobs(batch):
                seq = words(data)
                ranges, hit = found.find(seq)
                values = (
                    len(seq), sum(b - a for a, b in ranges), sorted(hit, key=str),
                    char_spans(data, ranges) if ranges else [],
                    [{"start": a, "end": b} for a, b in ranges],
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            arrays = [pa.array(v, f.type) for v, f in zip(out, list(schema)[1:], strict=True)]
            ids = batch.column("doc_id").cast(pa.int64())
            keys = [batch.column(k) for k in batch.schema.names if k.startswith("_row")]
            yield pa.RecordBatch.from_arrays(
                [ids, *arrays, *keys],
                schema=pa.schema([*schema, *(pa.field(k, pa.int64()) for k in batch.schema.names if k.startswith("_row"))]),
            )

    span = "array<struct<start:long,end:long>>"
    keys = "".join(f", {k} long" for k in docs.columns if k.startswith("_row"))
    return docs.mapInArrow(
        scan,
        f"doc_id long, n_words long, n_hit long, items array<long>, spans {span}, ranges {span}{keys}",
    )


def _items(benchmark: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-size // part_bytes)


def _block(items: DataFrame, parts: int, k: int) -> list[tuple[int | None, str]]:
    """Items of one block: bounded in bytes, whatever the benchmark holds."""
    if parts > 1:
        items = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
    return [tuple(r) for r in items.collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row of ``docs``.

    A window is ``width`` consecutive words of an item (all words of a shorter one). A
    document word inside any occurrence of a window is hit; ``items`` are the ids of the
    items that occur, sorted as strings, ``spans`` the hit stretches in code points of the
    original text. Null texts and items have no words; an empty benchmark hits nothing; an
    item without an id hits but is not listed; other columns are not read.

    The size of the item texts is measured first. Up to ``part_bytes`` they go to every
    task as one automaton and each text is scanned once, in place. A larger benchmark is
    cut into blocks of that size; the texts are scanned once per block, and the hits of the
    blocks are united per row.
    """
    items, parts = _items(benchmark, part_bytes)
    texts = docs.select("doc_id", "text")
    if parts <= 1:
        return _scan(texts, _block(items, 1, 0), width).drop("ranges")
    texts = texts.withColumns({"_row1": F.xxhash64("doc_id"), "_row2": F.xxhash64("text")})
    found = None
    for k in range(parts):
        block = _scan(texts, _block(items, parts, k), width)
        found = block if found is None else found.unionByName(block)
    return _united(found, parts)


def _united(found: DataFrame, parts: int) -> DataFrame:
    """Rows of several blocks to one row each; equal rows stay as many as they were."""

    def merged(column: str):
        step = F.array_sort(F.flatten(F.collect_list(column)))
        return F.aggregate(
            step, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
            lambda acc, r: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["start"]),
                F.concat(
                    F.slice(acc, F.lit(1), F.size(acc) - 1),
                    F.array(F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end"),
                    )),
                ),
            ).otherwise(F.concat(acc, F.array(r))),
        )

    rows = found.groupBy("doc_id", "_row1", "_row2").agg(
        F.first("n_words").alias("n_words"), merged("ranges").alias("ranges"),
        F.transform(
            F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items"))),
                                     lambda i: i.cast("string"))),
            lambda s: s.cast("long"),
        ).alias("items"),
        merged("spans").alias("spans"), (F.count("*") / parts).cast("int").alias("_copies"),
    )
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        "doc_id", "n_words", hit.alias("n_hit"), "items", "spans"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Rows of ``docs``, all columns, in whose text no benchmark window occurs.

    Filters in place, one block of the benchmark after the other.
    """
    items, parts = _items(benchmark, part_bytes)
    for k in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(_block(items, parts, k))

        def maker(shared=shared):
            windows = Windows(shared.value, width)
            return lambda texts: [not windows.find(words(t))[0] for t in texts]

        docs = kept_rows(docs, maker)
    return docs


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those hit by benchmark windows, and a digest of the items."""
    found = find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col("items").cast("array<string>")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _words_sql(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def contamination_sql(documents: str, width: int = WINDOW) -> str:
    """DuckDB: hit words and found items per row of ``documents``, as relation bodies.

    Common table expressions that end in ``hits(row, n_hit)`` and ``found(row, items)``.
    """
    return f"""
d AS (SELECT row_number() OVER () AS row, doc_id, {_words_sql('text')} AS w FROM {documents}),
b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({width}, len(w)) AS n,
       unnest(list_transform(range(1, len(w) - least({width}, len(w)) + 2),
              lambda i: array_to_string(w[i:i + least({width}, len(w)) - 1], ' '))) AS s
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, n, unnest(range(1, len(w) - n + 2)) AS pos,
       unnest(list_transform(range(1, len(w) - n + 2),
              lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
       FROM d, sizes WHERE len(w) >= n),
m AS (SELECT dw.row, dw.pos, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hits AS (SELECT row, count(DISTINCT pos + k) AS n_hit
         FROM (SELECT row, pos, unnest(range(0, n)) AS k FROM (SELECT DISTINCT row, pos, n FROM m))
         GROUP BY row),
found AS (SELECT row, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY row)
"""


SQL = f"""
WITH {contamination_sql('documents')}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN found USING (row)
"""
