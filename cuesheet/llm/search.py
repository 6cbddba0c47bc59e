"""Operator 11: ranked lexical search for many queries that share their sub-sums."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs, table, written

TOP = 10
#: Terms (with repeats over items) of one block of items; a block's plan is held by every task.
BLOCK_TERMS = 1 << 18
#: Bits of the filter for terms that some item may have (fixed).
FILTER = 1 << 20
#: Cells (nodes times documents) that a task fills at once.
CELLS = 4 << 20
#: Ranges of tasks whose best rows are ranked before all of them are.
SPREAD = 1024

# A-Z to a-z; digits, letters and every byte above 0x7F belong to terms; all others separate
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def terms(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


# ---- the plan of a block of items


@dataclass
class Plan:
    """A graph of sums: leaves are terms, a node adds two earlier ones, an item adds nodes."""

    leaves: list[bytes]
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    @property
    def nodes(self) -> int:
        return len(self.leaves) + sum(len(left) for left, _ in self.levels)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Items' sums from the leaves' values (leaves times documents), each node computed once."""
        held = np.empty((self.nodes, values.shape[1]), np.int64)
        at = len(self.leaves)
        held[:at] = values
        for left, right in self.levels:
            np.add(held[left], held[right], out=held[at : at + len(left)])
            at += len(left)
        out = np.zeros((len(self.items), values.shape[1]), np.int64)
        for i, nodes in enumerate(self.items):
            if len(nodes):
                out[i] = held[nodes].sum(axis=0)
        return out


def mine(items: list[list[bytes]]) -> Plan:
    """Shared term sets of the items' different terms, as a graph that all items go through.

    Terms in order of the number of items that have them stand next to those they are
    shared with. In rounds, neighbours that at least two items have become a node, frequent
    pairs first; the node takes their place in these items. So sets that several items
    share become one node, and larger ones are made of smaller ones.
    """
    often = Counter(t for item in items for t in set(item))
    owners: dict[bytes, list[int]] = {}
    for i, item in enumerate(items):
        for t in set(item):
            owners.setdefault(t, []).append(i)
    # terms of the same items next to each other
    order = {t: n for n, t in enumerate(sorted(owners, key=lambda t: (-often[t], owners[t], t)))}
    plan = Plan(list(order))
    rows = [sorted(order[t] for t in set(item)) for item in items]
    count = len(order)
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:], strict=False))
        chosen = [_disjoint(row, pairs) for row in rows]
        used = Counter(row[at] * count + row[at + 1] for row, ats in zip(rows, chosen, strict=True) for at in ats)
        made = {key: count + n for n, key in enumerate(sorted(k for k, n in used.items() if n > 1))}
        if not made:
            break
        for i, (row, ats) in enumerate(zip(rows, chosen, strict=True)):
            new, last = [], 0
            for at in sorted(ats):
                node = made.get(row[at] * count + row[at + 1])
                if node is not None:
                    new += row[last:at] + [node]
                    last = at + 2
            rows[i] = new + row[last:]
        keys = np.array(sorted(made), np.int64)
        plan.levels.append((keys // count, keys % count))
        count += len(made)
    plan.items = [np.array(row, np.int64) for row in rows]
    return plan


def _disjoint(row: list[int], pairs: Counter) -> list[int]:
    """Places of pairs of a row that more than one item has, frequent ones first, none touching."""
    places = [at for at in range(len(row) - 1) if pairs[row[at], row[at + 1]] > 1]
    places.sort(key=lambda at: (-pairs[row[at], row[at + 1]], row[at], row[at + 1]))
    taken, out = set(), []
    for at in places:
        if at not in taken and at + 1 not in taken:
            taken |= {at, at + 1}
            out.append(at)
    return out


# ---- documents and items as terms


def _counted(rows: DataFrame, keep: np.ndarray | None, columns: list[str]) -> DataFrame:
    """``columns`` and ``n, terms, tf`` of every text; only terms that pass the filter ``keep``."""
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        known: dict[bytes, bool] = {}
        for batch in source:
            sizes, names, times = [], [], []
            for data in blobs(batch):
                found = Counter(terms(data))
                sizes.append(found.total())
                if held is not None:
                    if len(known) > 500_000:
                        known.clear()
                    for t in found:
                        if t not in known:
                            known[t] = bool(held[zlib.crc32(t) % FILTER])
                    found = {t: n for t, n in found.items() if known[t]}
                names.append(list(found.keys()))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sizes, pa.int64()),
                 pa.array(names, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=[*columns, "n", "terms", "tf"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, n long, terms array<binary>, tf array<long>")


def _filter(items: DataFrame) -> np.ndarray:
    """Mask of the hash values of all items' terms."""
    place = (F.crc32("term") % FILTER).cast("int").alias("place")
    found = items.select(F.explode("terms").alias("term")).select(place).distinct().toArrow()
    keep = np.zeros(FILTER, bool)
    keep[found.column("place").to_numpy()] = True
    return keep


# ---- ranking


class Best:
    """The best documents of each item among those met so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.zeros(items, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        item, at = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        if len(item):
            self.held.append((item, scores[item, at], none[at], doc[at]))
            self.waiting += len(item)
            if self.waiting > 40 * self.top * len(self.least) + 100_000:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        item, score, none, doc = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        order, item = order[np.arange(len(item)) - first < self.top], None
        kept = tuple(c[order] for c in (np.concatenate([h[0] for h in self.held]), score, none, doc))
        full = np.bincount(kept[0], minlength=len(self.least)) >= self.top
        last = np.zeros_like(self.least)
        last[kept[0]] = kept[1]  # rows of an item go down in score
        self.least = np.where(full, last, 0)
        self.held, self.waiting = [kept], len(order)
        return kept


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms; beyond 64 bits in whole numbers of any size."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * int(v) * docs // total for v in n], np.int64)
    return 10 + 90 * n * docs // total


def _ranked_block(docs: DataFrame, items: list, plan: Plan, weight: np.ndarray, docs_n: int, total: int,
                  top: int) -> DataFrame:
    """``item, score, none, doc_id``: each task's best documents for each item of the block."""
    shared = docs.sparkSession.sparkContext.broadcast((items, plan, weight))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, plan, weight = shared.value
        best = Best(len(numbers), top)
        vocabulary = pa.array(plan.leaves, pa.binary())
        step = max(1, CELLS // max(1, plan.nodes))
        for batch in source:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.column("n").to_numpy()
                cells = part.column("terms")
                leaf = pc.index_in(cells.flatten(), value_set=vocabulary)
                tf = part.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), cells.value_lengths().to_numpy())
                met = leaf.is_valid().to_numpy(zero_copy_only=False)
                leaf = leaf.fill_null(0).to_numpy()[met]
                tf, doc = tf[met], doc[met]
                values = np.zeros((len(plan.leaves), len(n)), np.int64)
                values[leaf, doc] = impacts(weight[leaf], tf, _lengths(n, docs_n, total)[doc])
                ids = part.column("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.add(plan.sums(values), ids.fill_null(0).to_numpy(), none)
        item, score, none, doc = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(numbers, np.int64)[item]), pa.array(score),
             pa.array(doc, mask=none.astype(bool))],
            names=["item", "score", "doc_id"],
        )

    return docs.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, score long, doc_id long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents for each row of ``queries``.

    ``queries`` has ``item_id, text``, ``docs`` has ``doc_id, text``; other columns are not read.
    A null or empty text has no terms and is neither found nor finds anything. Every row
    is a document or an item of its own, whatever its id; equal scores go by ``doc_id``,
    null last. Items without any scoring document have no row.

    Documents are read once: terms that no item has are left out by a fixed-size filter, the
    rest is written with its counts. Items are dealt into blocks of bounded size. A block's
    items become one graph of sums over shared term sets (:func:`mine`); a task fills the
    leaves for some documents, computes every node once, and keeps ``top`` documents an item.
    """
    named = queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = written(
        _counted(named, None, ["item", "item_id"]).where("n > 0").drop("n", "tf"), "items"
    )
    size = items.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_TERMS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = written(
        _counted(texts, _filter(items), ["doc_id"]).where("n > 0"), "terms"
    )
    whole = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    df = written(
        counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df"
    )
    # floor(1000 * ln((2N + 2) / (2df + 1)))
    weighed = df.select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * whole["docs"] + 2) / (2 * F.col("df") + 1))).alias("w")
    )
    block_of = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    parts = []
    for block in range(blocks):
        mine_ = items.where(block_of == block).select("item", "terms").orderBy("item")
        rows = mine_.collect()
        plan = mine([r["terms"] for r in rows])
        found = weighed.join(mine_.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        weights = {bytes(r["term"]): r["w"] for r in found.collect()}
        weight = np.array([weights.get(bytes(t), 0) for t in plan.leaves], np.int64)
        parts.append(written(
            _ranked_block(counted, [r["item"] for r in rows], plan, weight, whole["docs"], whole["total"], top)
            .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD))),
            "best",
        ))
    if not parts:
        empty = docs.sparkSession.createDataFrame([], "rank int, doc_id long, score long")
        return items.limit(0).select("item_id").join(empty, F.lit(True)).select("item_id", "rank", "doc_id", "score")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    inner = Window.partitionBy("item", "part").orderBy(*order)
    outer = Window.partitionBy("item").orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}'))"
SQL = f"""
WITH w AS (SELECT doc_id, {_SPLIT} AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_SPLIT} AS term FROM benchmark)),
score AS (
  SELECT item_id, doc_id,
         sum(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM item JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), whole
  GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM score WHERE score > 0) WHERE rank <= {TOP}
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
