"""Operator 13: near copies among embeddings, by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import attach_groups
from .common import table, written
from .components import components

LEAST = 0.95
#: Rows and columns of one product.
TILE = 1024
#: Bytes of quantised vectors of one block, and the least number of blocks: a task holds two.
BLOCK_BYTES, BLOCKS = 16 << 20, 4
#: Components that one product may sum: 1024 * 127 * 127 is a whole number in single precision.
_EXACT = 1024
#: Rounding of the double sums around the bounds.
_SLACK = 1e-9

_CELL = ["dim", "p", "q"]
_FOUND = "kind int, dim int, p int, q int, node long, other long"
LINKS, EDGE, OPEN = 0, 1, 2


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, the step of each row, and the length of what rounding took."""
    step = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / step[:, None])
    error = np.sqrt(((unit - whole * step[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.int8), step, error + _SLACK


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows: single precision holds each part sum."""
    total: np.ndarray | float = 0.0
    for at in range(0, x.shape[1], _EXACT):
        part = x[:, at : at + _EXACT].astype(np.float32) @ y[:, at : at + _EXACT].astype(np.float32).T
        total = part if x.shape[1] <= _EXACT else total + part.astype(np.float64)
    return total


class Forest:
    """Trees over row numbers; :meth:`unite` joins the ends of many links at once."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.parent[rows]
        while (self.parent[at] != at).any():
            at = self.parent[at]
        return at

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def tiles(
    whole: np.ndarray, step: np.ndarray, error: np.ndarray, left: np.ndarray, right: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, sure`` of the pairs of ``left`` and ``right`` rows that may reach ``LEAST``.

    With ``u = s q + r`` and ``v = t p + w`` the product ``u v`` differs from ``s t q p`` by at
    most ``|r| + |w| + |r||w|``. Rows go by their steps, so that one bound for a whole tile
    leaves few pairs that the pair's own bound then drops. ``sure`` pairs reach ``LEAST``
    whatever the rounding took. Equal sides give each pair once.
    """
    same = left is right
    left = left[np.argsort(step[left], kind="stable")]
    right = left if same else right[np.argsort(step[right], kind="stable")]
    for at in range(0, len(left), TILE):
        i = left[at : at + TILE]
        for to in range(at if same else 0, len(right), TILE):
            j = right[to : to + TILE]
            e, f = error[i].max(), error[j].max()
            floor = (LEAST - e - f - e * f) / (step[i].max() * step[j].max())
            product = _product(whole[i], whole[j])
            a, b = np.nonzero(product >= min(floor, floor * (1 - 1e-6)))
            if same and at == to:
                a, b = a[a < b], b[a < b]
            value = product[a, b].astype(np.float64) * step[i[a]] * step[j[b]]
            e, f = error[i[a]], error[j[b]]
            bound = e + f + e * f
            may = value + bound >= LEAST
            yield i[a[may]], j[b[may]], (value - bound >= LEAST)[may]


def _found(key, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    dim, p, q = (k.as_py() for k in key)
    kind = np.concatenate([np.full(len(n), k) for k, n, _ in parts])
    node, other = (np.concatenate([part[i] for part in parts]).astype(np.int64) for i in (1, 2))
    fixed = [pa.array(np.full(len(kind), v), pa.int32()) for v in (dim, p, q)]
    return pa.table(
        [pa.array(kind, pa.int32()), *fixed, pa.array(node), pa.array(other)],
        names=["kind", *_CELL, "node", "other"],
    )


def _sides(block: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(block == p)
    return left, left if p == q else np.flatnonzero(block == q)


def _told(key, node, links, forest: Forest, more: list) -> pa.Table:
    """Number of links of each row, and a tree of links for each connected part."""
    has = np.flatnonzero(links)
    roots = forest.roots(np.arange(len(node)))
    tied = np.flatnonzero(roots != np.arange(len(node)))
    return _found(key, [(LINKS, node[has], links[has]), (EDGE, node[tied], node[roots[tied]]), *more])


def _compare(key, source):
    """A cell's sure links, and its rows with pairs that the bounds leave open."""
    dim, p, q = (k.as_py() for k in key)
    node, copies, block, step, error = (
        source.column(n).to_numpy() for n in ("node", "copies", "block", "step", "error")
    )
    whole = np.frombuffer(b"".join(source.column("whole").to_pylist()), np.int8).reshape(-1, dim)
    links, undecided, forest = np.zeros(len(node), np.int64), np.zeros(len(node), bool), Forest(len(node))
    for i, j, sure in tiles(whole, step, error, *_sides(block, p, q)):
        undecided[i[~sure]] = undecided[j[~sure]] = True
        _add(links, copies, forest, i[sure], j[sure])
    rows = np.flatnonzero(undecided)
    return _told(key, node, links, forest, [(OPEN, node[rows], block[rows])])


def _add(links, copies, forest: Forest, i: np.ndarray, j: np.ndarray) -> None:
    if len(i):
        links += np.bincount(i, copies[j], len(links)).astype(np.int64)
        links += np.bincount(j, copies[i], len(links)).astype(np.int64)
        forest.unite(i, j)


def _decide(key, source):
    """The open pairs of a cell in double precision, from the vectors of the rows that have any."""
    dim, p, q = (k.as_py() for k in key)
    node, copies, block = (source.column(n).to_numpy() for n in ("node", "copies", "block"))
    flat = source.column("embedding").combine_chunks().flatten()
    unit = units(flat.to_numpy(zero_copy_only=False).reshape(-1, dim))
    links, forest = np.zeros(len(node), np.int64), Forest(len(node))
    for i, j, sure in tiles(*quantise(unit), *_sides(block, p, q)):
        i, j = i[~sure], j[~sure]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= LEAST
            _add(links, copies, forest, a[near], b[near])
    return _told(key, node, links, forest, [])


def _quantised(nodes: DataFrame, blocks: int) -> DataFrame:
    """``node, copies, dim, block, whole, step, error`` of every different vector."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = pa.Table.from_batches([batch])
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = rows.filter(pa.array(dims == dim)).combine_chunks()
                flat = part.column("embedding").combine_chunks().flatten()
                whole, step, error = quantise(
                    units(flat.to_numpy(zero_copy_only=False).reshape(-1, dim))
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n).combine_chunks() for n in ("node", "copies", "dim", "block")),
                     pa.array([w.tobytes() for w in whole], pa.binary()), pa.array(step), pa.array(error)],
                    names=["node", "copies", "dim", "block", "whole", "step", "error"],
                )

    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    return nodes.select("node", "copies", "dim", block, "embedding").mapInArrow(
        run, "node long, copies long, dim int, block int, whole binary, step double, error double"
    )


def links(nodes: DataFrame) -> DataFrame:
    """``kind, dim, p, q, node, other``: links of the different vectors ``node, copies, dim, embedding``.

    ``LINKS`` rows add ``other`` linked vectors (copies counted) to ``node``; ``EDGE`` rows are
    links that connect what all links connect. Vectors are dealt into blocks; a cell is a
    pair of blocks, and every pair of vectors of one dimension meets in one cell. What
    travels to the cells is quantised. Only rows with pairs that the bounds leave open
    follow with their full vectors, once a cell, and only those pairs are computed anew. Pairs
    themselves never travel.
    """
    size = nodes.agg(F.sum("dim").alias("bytes")).first()["bytes"] or 0
    blocks = max(BLOCKS, -(-size // BLOCK_BYTES))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = _quantised(nodes, blocks).withColumn("other", other).select(
        "dim", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
        "node", "copies", "block", "whole", "step", "error",
    )
    sure = written(cells.groupBy(*_CELL).applyInArrow(_compare, _FOUND), "tiles")
    rest = sure.where(F.col("kind") == OPEN).select(*_CELL, "node", F.col("other").cast("int").alias("block"))
    full = rest.join(nodes.select("node", "copies", "embedding"), "node")
    exact = written(full.groupBy(*_CELL).applyInArrow(_decide, _FOUND), "exact")
    return sure.where(F.col("kind") != OPEN).unionByName(exact)


def find_near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Rows link when the cosine of their vectors is at least ``LEAST``. A vector that is null,
    empty, zero, or holds null or non-finite components links with nothing, nor do vectors
    of different lengths. Equal vectors are one node with a number of copies; each copy is
    a link. ``component_id`` is the smallest id that links reach (of ids that are not null);
    ``kept`` rows have it as their id. Repeated ids stay rows of their own. An empty table
    gives an empty result; other columns are not read.
    """
    vector = F.col("embedding")
    sound = F.coalesce(
        (F.size(vector) > 0)
        & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        & F.exists(vector, lambda v: v != 0),
        F.lit(False),
    )
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, vector).alias("embedding"))
        .withColumn("_row", F.monotonically_increasing_id()),
        "vectors",
    )
    nodes = written(
        rows.where("embedding is not null").groupBy("embedding").agg(
            F.min("_row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
        ).withColumn("dim", F.size("embedding")),
        "nodes",
    )
    found = links(nodes)
    count = found.where(F.col("kind") == LINKS).groupBy("node").agg(F.sum("other").alias("links"))
    edges = found.where(F.col("kind") == EDGE).select(F.col("node").alias("a"), F.col("other").alias("b"))
    marked = nodes.select("embedding", "node", "copies", "least").join(count, "node", "left").join(
        components(edges), "node", "left"
    )
    marked = written(marked.withColumn("root", F.coalesce("root", "node")), "marked")
    least = written(marked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    groups = written(
        marked.join(least, "root").select(
            "embedding", "copies", "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "groups",
    )
    told = attach_groups(rows, groups, ["embedding"], "copies", ["_row"])
    alone = F.col("embedding").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return told.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_vectors(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` with all their columns whose id is that of their component."""
    kept = find_near_vectors(vectors).where("kept").select(F.col("vec_id").alias("_kept")).distinct()
    return vectors.join(kept, F.col("vec_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.sound AND b.sound AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e)
       >= {LEAST} * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return find_near_vectors(table(spark, sf_dir, "embeddings"))
