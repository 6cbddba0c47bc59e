"""Operator 6: documents whose shingle sets overlap, by trees over group counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_maps, blobs, marked, numbered, only_rows, placed, table, written
from .components import components
from .recompress import Sums, mix, word_names

#: Words of a shingle; links have 100 * intersection >= 80 * union.
SHINGLE = 5
#: Groups that the shingles of a document are counted in.
GROUPS = 256
#: Smallest hash values that the first round of links goes by.
FIRST = 4
#: Counters of the shingle frequency sketch (fixed; 4 MB).
COUNTERS = 1 << 20
_PIECE = 4096
#: Points of one tree; documents of a more frequent shingle are dealt into several.
TILE = 2048
#: Shingles of the sets that a verifying task keeps.
HELD = 2_000_000
#: Most promising candidates of a set that are verified before all others, and how often.
BEST, ROUNDS = 4, 1
#: Bits of the map of needed texts (fixed; 8 MB).
BITS = 1 << 26
#: Sets of a rare shingle that are compared with each other by their room; all of more are kept.
NEIGHBOURS = 8
#: Parts of a prefix that places are told apart by.
PARTS = 32
_LEAF = 16
#: Groups of so many points need no boxes above them.
ONE_LEAF = 64
_SATURATED = 255

U = np.uint64


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct names of the text's shingles; of fewer words, of all of them."""
    names = word_names(data.lower().split())
    if not len(names):
        return np.zeros(0, U)
    width = min(SHINGLE, len(names))
    start = np.arange(len(names) - width + 1)
    return np.unique(Sums(names).stretch(start, start + width))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def group_counts(names: np.ndarray) -> np.ndarray:
    """Shingles per hash group; 255 stands for 255 and more."""
    counts = np.bincount((mix(names) >> U(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, _SATURATED).astype(np.uint8)


def _unpacked(data: bytes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(data))


def _sets(docs: DataFrame) -> DataFrame:
    """Every row's number, its set and size, with group counts, hashes and packed text."""
    fields = [
        *((k, pa.int64()) for k in ("doc_id", "row", "set", "n")), ("counts", pa.binary()),
        ("least", pa.list_(pa.int64())), ("packed", pa.binary()),
    ]
    schema = pa.schema(fields)

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in source:
            out: list[list] = [[] for _ in schema.names]
            ids = [batch.column(k).to_pylist() for k in ("doc_id", "row")]
            for *key, data in zip(*ids, blobs(batch), strict=True):
                names = shingles(data)
                n = len(names)
                name = mix(mix(names).sum(dtype=U, keepdims=True) + U(n)).view(np.int64)[0]
                least = [
                    int(names[np.argmin(mix(names + U(i + 1)))].view(np.int64))
                    for i in range(FIRST if n else 0)
                ]
                values = (
                    *key, int(name), n, group_counts(names).tobytes(), least, packer.compress(data)
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(
        build, "doc_id long, row long, set long, n long, counts binary, "
        "least array<long>, packed binary"
    )


def _picked(sets: DataFrame, needed: DataFrame) -> DataFrame:
    """``sets`` without most of those that are not ``needed``, where they stand.

    A bitmap of ``BITS`` bits, marked at the names that are needed, goes to every task, so
    that few other texts come to the joins behind it. Its size is fixed; the more names it
    marks, the less it spares, and the joins decide.
    """
    at = F.pmod("set", F.lit(BITS))
    return marked(sets, at, bit_maps(needed.select(at.alias("at"))))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``a, b`` those that link: the sets of both are built from their texts again.

    The texts that are needed are picked out once. ``a`` meets its text first; ``b``, of which
    a pair may have many, is the sorted side of the second join, where Spark may split it and
    a task builds its set once in a row.
    """
    needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    needed = written(needed.distinct(), "sets-needed")
    texts = written(_picked(sets.select("set", "packed"), needed), "needed")
    left = pairs.join(texts.withColumnsRenamed({"set": "a", "packed": "pa"}), "a")
    right = texts.withColumnsRenamed({"set": "b", "packed": "pb"})

    def check(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        known: dict[int, np.ndarray] = {}  # sets met lately, as far as they fit
        held = 0
        for batch in source:
            keep = []
            columns = (batch.column(n).to_pylist() for n in ("a", "b", "pa", "pb"))
            for a, b, pa_, pb in zip(*columns, strict=True):
                if b != last:
                    last, other = b, _unpacked(pb)
                if a not in known:
                    if held > HELD:
                        known.clear()
                        held = 0
                    known[a] = _unpacked(pa_)
                    held += len(known[a])
                keep.append(linked(known[a], other))
            mask = pa.array(keep, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return left.join(right.hint("merge"), "b").select("a", "b", "pa", "pb").mapInArrow(
        check, "a long, b long"
    )


def _sketch(sets: DataFrame) -> np.ndarray:
    """Level (twice the binary logarithm) of every counter of the shingle sketch.

    Tasks count all their shingles in one array and give it out in pieces; pieces are
    summed as they stream by. Only the ``COUNTERS`` sums reach the driver.
    """

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in source:
            held = [_unpacked(b) for b in batch.column("packed").to_pylist()]
            if held:
                at = (np.concatenate(held) >> U(44)).astype(np.int64)
                total += np.bincount(at, minlength=COUNTERS)
        if total.any():
            yield from pieces({i: p for i, p in enumerate(total.reshape(-1, _PIECE))})

    def pieces(held: dict) -> Iterator[pa.RecordBatch]:
        for i, p in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.array([p.astype(np.int64).tobytes()], pa.binary())],
                names=["piece", "counts"],
            )

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in source:
            for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(data, np.int64)
                held[i] = held[i] + part if i in held else part
        yield from pieces(held)

    ddl = "piece long, counts binary"
    summed = sets.select("packed").mapInArrow(count, ddl).repartition(
        COUNTERS // _PIECE // 8, "piece"
    ).mapInArrow(add, ddl)
    total = np.zeros((COUNTERS // _PIECE, _PIECE), np.int64)
    for r in written(summed, "sketch").toLocalIterator():
        total[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    return total.reshape(-1)


def _prefix(n):
    """Shingles of ``n`` of which linked sets share one."""
    return n - -(-4 * n // 5) + 1


def _postings(sets: DataFrame, total: np.ndarray) -> DataFrame:
    """``token, set, n``: the prefix shingles of every set that may be shared.

    Shingles are ordered by sketch level, then by name: rare ones first. Two linked sets
    share one of their first n - ceil(0.8 n) + 1 shingles in any common order.
    A set of ``n`` shingles that shares none before place ``p`` (from 0) with another one of
    ``m`` has at most ``n - p`` in common with it, so links ask for ``4 m <= 5 n - 9 p``, its
    ``room``, of the first shingle that both share. Places travel with the size, as one of
    ``PARTS`` parts of the prefix. Sets of a rare shingle are dropped on the
    way if they and no other set of it have room for each other; those of frequent ones are
    kept here, their rows spread by set. Texts stay where they are.
    """
    level = (2 * np.log2(total + 1.0)).astype(np.uint8)
    often = int(4 * total.mean() + 256)
    shared = sets.sparkSession.sparkContext.broadcast((level, (total > often)))

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hot = shared.value
        for batch in source:
            held = []
            columns = (batch.column(n).to_pylist() for n in ("set", "n", "packed"))
            for name, n, packed in zip(*columns, strict=True):
                names = _unpacked(packed)
                at = (names >> U(44)).astype(np.int64)
                order = np.argsort(level[at], kind="stable")[: _prefix(n)]
                size = len(order)
                held.append(
                    (names[order].view(np.int64), np.full(size, name),
                     n * PARTS + np.arange(size) * PARTS // size, np.where(hot[at[order]], name % 64, -1))
                )
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)],
                    names=["token", "set", "sized", "salt"],
                )

    def drop(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in source:
            both = pa.Table.from_batches([rest, batch] if rest is not None else [batch])
            token = both.column("token").to_numpy()
            # the last run may go on in the next batch
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield from kept(both.slice(0, cut))
            rest = both.slice(cut).combine_chunks().to_batches()
            rest = rest[0] if rest else None
        if rest is not None:
            yield from kept(pa.Table.from_batches([rest]))

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        token, sized, salt = (rows.column(c).to_numpy() for c in ("token", "sized", "salt"))
        n = sized // PARTS
        # the first place of the part
        room = 5 * n - 9 * -(-(sized % PARTS) * _prefix(n) // PARTS)
        # by size; sets on both sides of such a step do not link
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (5 * n[:-1] < 4 * n[1:])])
        size = np.diff(np.r_[first, len(token)])
        group = np.repeat(np.arange(len(first)), size)
        keep = (salt >= 0) | (size > NEIGHBOURS)[group]
        for step in range(1, min(NEIGHBOURS, len(token))):
            fits = (group[step:] == group[:-step]) & (4 * n[step:] <= room[:-step]) & (4 * n[:-step] <= room[step:])
            keep[step:] |= fits
            keep[:-step] |= fits
        columns = [rows.column("token"), rows.column("set"), pa.chunked_array([n])]
        yield from pa.table(columns, names=["token", "set", "n"]).filter(pa.array(keep)).to_batches()

    ddl = "token long, set long, sized long, salt long"
    rows = sets.select("set", "n", "packed").mapInArrow(emit, ddl)
    return (
        rows.repartition(F.col("token"), F.col("salt")).sortWithinPartitions("token", "sized")
        .mapInArrow(drop, "token long, set long, n long")
    )


def _labelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """``live`` with the label of every set: its root, or itself."""
    roots = labels.select(F.col("node").alias("set"), F.col("root").alias("_root"))
    return live.drop("label").join(roots, "set", "left").select(
        "token", F.coalesce("_root", "set").alias("label"), "set", "n"
    )


def _widened(points: np.ndarray) -> np.ndarray:
    """Counts in which a saturated one is more than any sum that matters."""
    wide = points.astype(np.int32)
    wide[points == _SATURATED] = 1 << 24
    return wide


def _within_leaves(edge, many, counts, sizes, labels, side) -> np.ndarray:
    """Pairs of rows that pass the bound, of groups that are one leaf; all groups at once.

    ``edge`` and ``many`` are the first row and the rows of each group; rows of the same
    ``side`` (where it is not negative) are not paired.
    """
    row = np.repeat(edge - np.cumsum(many) + many, many) + np.arange(many.sum())
    place = row - np.repeat(edge, many)
    a = np.repeat(row, place)
    within = np.arange(len(a)) - np.repeat(np.cumsum(place) - place, place)
    b = np.repeat(row - place, place) + within
    keep = (labels[a] != labels[b]) & ((side[a] < 0) | (side[a] != side[b]))
    keep &= (5 * sizes[a] >= 4 * sizes[b]) & (5 * sizes[b] >= 4 * sizes[a])
    pairs = np.column_stack([a[keep], b[keep]])
    return pairs[_reach(_widened(counts), sizes, pairs)]


class Tree:
    """Packed R-tree over group counts: leaves of neighbouring sizes, boxes above them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        order = np.lexsort((*points.T[:4], sizes))
        self.order = order
        wide = _widened(points[order])
        self.points, self.sizes, self.labels = wide, sizes[order], labels[order]
        m = len(order)
        self.levels = []
        high, low_n, high_n, low_l, high_l = wide, self.sizes, self.sizes, self.labels, self.labels
        while True:
            starts = np.arange(0, len(high), _LEAF)
            high = np.maximum.reduceat(high, starts, axis=0)
            low_n, high_n = np.minimum.reduceat(low_n, starts), np.maximum.reduceat(high_n, starts)
            low_l, high_l = np.minimum.reduceat(low_l, starts), np.maximum.reduceat(high_l, starts)
            self.levels.append((high, low_n, high_n, low_l, high_l))
            if len(high) == 1 or m <= _LEAF:
                break

    def pairs(self, cross: np.ndarray | None = None) -> np.ndarray:
        """(i, j) of points with different labels that may link, by the bound on the overlap.

        The overlap of two sets is at most the sum of their smaller group counts, that of
        two boxes the sum of the smaller upper bounds; pairs of boxes that cannot reach what
        their smallest sizes ask for are left with all their points. ``cross`` limits the
        pairs to points of different sides.
        """
        top = len(self.levels) - 1
        todo = np.zeros((1, 2), np.int64)
        for depth in range(top, -1, -1):
            high, low_n, high_n, low_l, high_l = self.levels[depth]
            a, b = todo[:, 0], todo[:, 1]
            keep = (5 * high_n[a] >= 4 * low_n[b]) & (5 * high_n[b] >= 4 * low_n[a])
            keep &= (low_l[a] < high_l[a]) | (low_l[b] < high_l[b]) | (low_l[a] != low_l[b])
            todo = todo[keep]
            todo = todo[_reach(high, low_n, todo)]
            todo = _children(todo, len(self.levels[depth - 1][0]) if depth else len(self.sizes))
        a, b = todo[:, 0], todo[:, 1]
        keep = (a != b) & (self.labels[a] != self.labels[b])
        keep &= (5 * self.sizes[a] >= 4 * self.sizes[b]) & (5 * self.sizes[b] >= 4 * self.sizes[a])
        if cross is not None:
            side = cross[self.order]
            keep &= side[a] != side[b]
        todo = todo[keep]
        todo = todo[_reach(self.points, self.sizes, todo)]
        return self.order[todo]


def _first_of_each(key: np.ndarray, value: np.ndarray, many: int) -> np.ndarray:
    """Mask of the ``many`` smallest values of each key."""
    order = np.lexsort((value, key))
    ranked = key[order]
    edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    place = np.arange(len(key)) - np.repeat(edge, np.diff(np.r_[edge, len(key)]))
    out = np.zeros(len(key), bool)
    out[order[place < many]] = True
    return out


def _reach(high: np.ndarray, sizes: np.ndarray, todo: np.ndarray) -> np.ndarray:
    return 9 * _overlap(high, todo) >= 4 * (sizes[todo[:, 0]] + sizes[todo[:, 1]])


def _overlap(high: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts of both rows of each pair."""
    out = np.zeros(len(todo), np.int64)
    for at in range(0, len(todo), 8_000):
        a, b = todo[at : at + 8_000].T
        out[at : at + 8_000] = np.minimum(high[a], high[b]).sum(axis=1)
    return out


def _children(todo: np.ndarray, count: int) -> np.ndarray:
    """All pairs (first not after second) of the children of pairs of nodes."""
    step = np.arange(_LEAF)
    a = (todo[:, :1, None] * _LEAF + step[None, :, None]).repeat(_LEAF, axis=2).reshape(-1)
    b = (todo[:, 1:, None] * _LEAF + step[None, None, :]).repeat(_LEAF, axis=1).reshape(-1)
    keep = (a <= b) & (b < count) & (a < count)
    return np.column_stack([a[keep], b[keep]])


def _candidates(live: DataFrame, sets: DataFrame, best: int | None = None) -> DataFrame:
    """``a, b, near``: pairs with different labels that share a prefix shingle and pass the bound.

    With ``best`` a tree gives only the so many most promising pairs of each of its points.

    The sets of a shingle are one tree. A shingle of more than ``TILE`` sets is dealt into
    tiles by set, and each pair of tiles is a tree of its own, so no task holds more than
    two tiles; every pair of sets still meets.
    """
    counted = live.groupBy("token").agg(
        F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("token", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    counted = written(counted, "tokens")
    rows = live.join(counted, "token").withColumn("tile", F.pmod(F.xxhash64("set"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select(
        "token", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"),
        "tile", "label", "set", "n",
    ).join(sets.select("set", "counts"), "set")

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in source:
            both = pa.Table.from_batches([rest, batch] if rest is not None else [batch])
            keys = np.column_stack([both.column(n).to_numpy() for n in ("token", "p", "q")])
            # the last group may go on in the next batch
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from found(both.slice(0, cut), keys[:cut])
            rest = both.slice(cut).combine_chunks().to_batches()[0]
        if rest is not None:
            one = pa.Table.from_batches([rest])
            yield from found(one, np.column_stack([one.column(n).to_numpy() for n in ("token", "p", "q")]))

    def found(rows: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        label, name, size, tile = (
            rows.column(n).to_numpy() for n in ("label", "set", "n", "tile")
        )
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8)
        counts = counts.reshape(-1, GROUPS)
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        many = np.diff(np.r_[edge, len(keys)])
        side = np.where(keys[:, 1] != keys[:, 2], tile, -1)
        sums = _widened(counts)
        out = [_within_leaves(edge[many <= ONE_LEAF], many[many <= ONE_LEAF], counts, size, label, side)]
        for low, high in zip(edge[many > ONE_LEAF], (edge + many)[many > ONE_LEAF], strict=True):
            part = slice(low, high)
            cross = side[part] if side[low] >= 0 else None
            out.append(Tree(counts[part], size[part], label[part]).pairs(cross) + low)
        at = np.concatenate(out)
        pairs = np.sort(name[at], axis=1)
        if len(pairs):
            bound = np.minimum(_overlap(sums, at), size[at].min(axis=1))
            # the similarity that the bound leaves possible, per mille
            near = 1000 * bound // (size[at].sum(axis=1) - bound)
            if best is not None:
                top = _first_of_each(at[:, 0], -near, best) | _first_of_each(at[:, 1], -near, best)
                pairs, near = pairs[top], near[top]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(near)],
                names=["a", "b", "near"],
            )

    return (
        rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")
        .select("token", "p", "q", "tile", "label", "set", "n", "counts")
        .mapInArrow(search, "a long, b long, near long").distinct()
    )


def links(sets: DataFrame) -> DataFrame:
    """``a, b``: verified links that connect exactly what the full set of links connects.

    1. Sets with the same smallest shingle under one of ``FIRST`` hashes are compared with
       the first of them: a few pairs a set, whatever the size of the group. The links found
       give labels; equal labels are connected already.
    2. Every pair of linked sets shares a prefix shingle (an exact filter; see
       :func:`_postings`). Shingles whose sets all have one label are done. For all others
       the R-trees over group counts give the pairs of different labels that the summed
       minima allow.
    3. In ``ROUNDS`` the ``BEST`` most promising pairs of each set are verified and renew the
       labels. Then all pairs whose labels still differ are verified. So in a large group of
       near copies most pairs are connected before they would be compared.
    """
    first = sets.select("set", "n", F.posexplode("least").alias("i", "key"))
    # small tables are written before a join: Spark can split a frequent key only where both
    # sides come straight from a shuffle
    pivots = first.groupBy("i", "key").agg(F.min("set").alias("b"), F.count("*").alias("m"))
    pivots = written(pivots.where("m > 1"), "pivots")
    pairs = written(
        first.join(pivots, ["i", "key"]).where("set <> b").select(F.col("set").alias("a"), "b").distinct(),
        "pairs",
    )
    near = written(_verified(pairs, sets), "links")
    labels = components(near, rounds=2)
    live = written(_labelled(written(_postings(sets, _sketch(sets)), "prefixes"), labels), "postings")
    for _ in range(ROUNDS):
        pairs = written(_candidates(live, sets, BEST), "pairs")
        best = written(
            _most_promising(pairs, "a").unionByName(_most_promising(pairs, "b")).distinct(), "best"
        )
        near = written(near.unionByName(_verified(best, sets)), "links")
        live = written(_labelled(live, components(near, rounds=3)), "postings")
    rest = written(_candidates(live, sets).select("a", "b"), "pairs")
    return near.unionByName(_verified(rest, sets))


def _most_promising(pairs: DataFrame, side: str) -> DataFrame:
    order = Window.partitionBy(side).orderBy(F.desc("near"), "a", "b")
    return pairs.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= BEST).select("a", "b")


def _rooted(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n, root`` of every row of ``doc_id, row, text``; equal roots are one component."""
    every = written(_sets(docs), "sets")
    rows = every.select("doc_id", "row", "set", "n")
    # one row of equal sets
    first = every.where("n > 0").groupBy("set").agg(F.min("row").alias("row"))
    sets = only_rows(every.select("row", "set", "n", "counts", "least", "packed"), "row", first)
    roots = components(links(sets))
    named = rows.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "root", F.coalesce("root", "set")
    )
    return written(named.select("doc_id", "row", "n", "root"), "roots")


def find_near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Sets of distinct five-word shingles (A-Z lowered) link when 100 * intersection >= 80 *
    union; ``component_id`` is the smallest id that links reach. Fewer words are one
    shingle; a text without words, or null, is linked with nothing, its own id is its
    component. Equal sets are one node, so copies cost nothing beyond their row. Rows
    without an id have the smallest id of their component. Shingles and sets are known by
    64-bit names. Other columns are not read.
    """
    named = _rooted(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    least = written(
        named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least"
    )
    alone = named.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return named.where("n > 0").join(least, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    ).unionByName(alone)


def drop_near_copies(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each component: the smallest id.

    Texts without words all stay. ``stored``: ``docs`` is a stored Parquet table as it was
    read, so no copy of it is written.
    """
    rows, row = placed(docs) if stored else numbered(docs)
    named = _rooted(rows.select("doc_id", "text", F.col(row).alias("row")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = named.where("n > 0").groupBy("root").agg(F.min(order).alias("o"))
    return only_rows(rows, row, first.select("o.row").unionByName(named.where("n = 0").select("row")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return find_near_copies(table(spark, sf_dir, "documents"))
