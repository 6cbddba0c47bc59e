"""Operator 10: context-tree weighting over bytes, and a word baseline."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, table, written

FOLDS, HELD_OUT = 7, 2
#: Depth of the context tree in bytes; a code is so many bytes and the one after them.
DEPTH = 6
#: Latest bytes of a context that are never parted by two blocks; the tree above is made of sums.
CUT = 3
#: Bytes of text of one chunk of texts, of the texts of a chunk that are coded at a time, and of
#: the corpus for one block of contexts: they say what a task holds, and no result depends on them.
CHUNK, PIECE, BLOCK = 8 << 20, 4 << 20, 4 << 20
#: Bytes of text that the borders of the blocks are sampled from.
BORDERS = 8 << 20
#: Byte that stands before a text and ends it; it is no part of UTF-8.
END = 0xFF
#: Commonest words whose counts every task holds (bounded: at most this many, each at most
#: ``HEAD_BYTES`` long); counts of all other words come by a join.
HEAD, HEAD_BYTES = 1 << 16, 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(
        F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)
    )


# ---- counts of words and bytes


def _pairs(keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(counts, pa.int64())], names=["key", "n"]
    )


def word_counts(train: DataFrame) -> DataFrame:
    """``key, n``: tokens of the training texts; the empty key is the end token."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in source:
            for data in blobs(batch):
                held.update(data.lower().split())
                held[b""] += 1
                if len(held) > 200_000:
                    yield _pairs(pa.array(list(held), pa.binary()), list(held.values()))
                    held.clear()
        yield _pairs(pa.array(list(held), pa.binary()), list(held.values()))

    return train.select("text").mapInArrow(count, "key binary, n long").groupBy("key").agg(
        F.sum("n").alias("n")
    )


# ---- contexts


def context_codes(texts: list[bytes]) -> np.ndarray:
    """A code for each byte of the texts and the END of each, text by text.

    The highest byte of a code is the last byte before, then the one before that and so on,
    the lowest is the byte itself; END stands before a text. So the contexts of any depth
    are ranges of codes.
    """
    if not texts:
        return np.zeros(0, np.int64)
    raw = b"".join(part for text in texts for part in (b"\xff" * DEPTH, text, b"\xff"))
    byte = np.frombuffer(raw, np.uint8)
    code = np.zeros(len(byte) - DEPTH, np.int64)
    for back in (*range(1, DEPTH + 1), 0):
        code <<= 8
        code |= byte[DEPTH - back : len(byte) - back]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    skip = np.ones(len(code), bool)  # what stands before the second text and so on is no symbol
    begin = np.cumsum(sizes + DEPTH)[:-1]
    for back in range(1, DEPTH + 1):
        skip[begin - back] = False
    return code[skip]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and the place of each code among them."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    coded = pa.array(codes).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.int32)  # fewer than 2 ** 31 codes meet in a task
    place[order] = np.arange(len(found), dtype=np.int32)
    return found[order], place[coded.indices.to_numpy()]


def places(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different codes of the texts in order, and the place of each code among them.

    Texts are coded a ``PIECE`` at a time, and the places come piece by piece, so that
    the codes of all texts never stand side by side.
    """
    held, first, size = [], 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text) + 1
        if size >= PIECE or i == len(texts):
            held.append(distinct(context_codes(texts[first:i])))
            first, size = i, 0
    if not held:
        return np.zeros(0, np.int64), []
    if len(held) == 1:
        return held[0][0], [held[0][1]]
    codes = np.concatenate([found for found, _ in held])
    codes.sort(kind="stable")  # merges what is in order already
    codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
    return codes, [np.searchsorted(codes, found).astype(np.int32)[place] for found, place in held]


def _stored(values: np.ndarray) -> bytes:
    """Compressed, equal bytes of the numbers next to each other."""
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _loaded(data: bytes, kind: type = np.int64) -> np.ndarray:
    count, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    plain = pa.decompress(data[8:], decompressed_size=width * count, codec="zstd", asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(width, count).T.copy().view(kind).reshape(-1)


def _borders(texts: DataFrame) -> np.ndarray:
    """First heads (latest ``CUT`` bytes) of the blocks, the smallest left out.

    A block is for ``BLOCK`` bytes of the corpus. Where it begins comes from the codes of a
    sample of the texts; that only says which task works on which contexts.
    """
    size = texts.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    many = -(-size // BLOCK)
    if many < 2:
        return np.zeros(0, np.int64)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < max(1, (BORDERS << 20) // size)

    def heads(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found, _ = distinct(context_codes(blobs(batch)))
            head, n = np.unique(found >> 8 * (DEPTH + 1 - CUT), return_counts=True)
            yield _pairs(pa.array(head), n)

    rows = texts.where(part).select("text").mapInArrow(heads, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")
    ).toArrow()
    head, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(head)
    head, upto = head[order], np.cumsum(n[order])
    if not len(head):
        return head
    ends = upto[-1] * np.arange(1, many) // many
    return np.unique(head[np.searchsorted(upto, ends, side="right")])


def _chunks(texts: DataFrame, borders: np.ndarray) -> DataFrame:
    """``chunk, block, codes, counts, docs``: the written table that all later steps read.

    A chunk is a task's next texts, about ``CHUNK`` bytes. One row (block -1) has its texts
    in ``docs``; a row for each block that it meets has its different codes in the block
    and how often the training texts among them hold each (0: only others do).
    """

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = numbers(TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in source:
            first = 0
            for i, n in enumerate(batch.column("size").to_pylist()):
                size += n
                if size >= CHUNK:
                    held.append(batch.slice(first, i + 1 - first))
                    yield from chunk(next(ids), held)
                    held, size, first = [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from chunk(next(ids), held)

    def chunk(key: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        data = blobs(rows)
        found, parts = places(data)
        learn = np.repeat(rows.column("train").to_numpy(zero_copy_only=False), [len(t) + 1 for t in data])
        n = np.zeros(len(found), np.int64)
        for place, train in zip(parts, np.split(learn, np.cumsum([len(p) for p in parts])), strict=False):
            n += np.bincount(place[train], minlength=len(found))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        yield row(key, -1, b"", b"", sink.getvalue().to_pybytes())
        edge = np.searchsorted(found >> 8 * (DEPTH + 1 - CUT), borders)
        edge = np.r_[0, edge, len(found)]
        for block in np.flatnonzero(edge[1:] > edge[:-1]):
            at = slice(edge[block], edge[block + 1])
            yield row(key, block, _stored(np.diff(found[at], prepend=0)), _stored(n[at]), b"")
        pa.default_memory_pool().release_unused()

    def row(chunk: int, block: int, *cells: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([block], pa.int64()),
             *(pa.array([c], pa.binary()) for c in cells)],
            names=["chunk", "block", "codes", "counts", "docs"],
        )

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    rows = texts.select(
        "doc_id", "text", size, (~held_out(F.col("doc_id"))).alias("train"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return written(
        rows.mapInArrow(cut, "chunk long, block long, codes binary, counts binary, docs binary"), "chunks"
    )


# ---- the tree


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5: Stirling's series after a shift by eight."""
    x = x.astype(np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (
        360 * y**3
    ) + 1 / (1260 * y**5) - np.log(shift)


def _log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


#: The same for small counts, as most are.
_SMALL = _log_estimate(*np.indices((256, 256)))


def estimate(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Krichevsky-Trofimov: log probability of all outcomes seen, chance of a one next."""
    total = n.sum(axis=-1)
    a, b = n[..., 0].astype(np.int64), n[..., 1].astype(np.int64)
    log_all = _SMALL[np.minimum(a, 255), np.minimum(b, 255)]
    large = (a > 255) | (b > 255)
    log_all[large] = _log_estimate(a[large], b[large])
    log_all[total == 0] = 0.0
    return log_all, (n[..., 1] + 0.5) / (total + 1)


def weigh(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weighted probability of a node, weight of its own estimate, and that estimate.

    ``n``: outcomes at the node; ``below``: sum over the children of their weighted log
    probability. Half the weight is the node's own estimate's, half the children's; what
    was seen tells which of both is right.
    """
    own, p_own = estimate(n)
    weighted = math.log(0.5) + np.logaddexp(own, below)
    return weighted, np.exp(math.log(0.5) + own - weighted), p_own


def mixed(weight, p_own, p_below, seen_below):
    """Chance at a node; a child that has seen nothing of a decision leaves it to the node."""
    return np.where(seen_below, weight * p_own + (1 - weight) * p_below, p_own)


class Block:
    """The tree from depth ``CUT`` on over the sorted codes of one block, level by level.

    A level is one of the eight binary decisions on a byte. A node is a context and the
    decisions before; codes that only held-out texts have are nodes that have seen nothing.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        #: For depths ``DEPTH`` to ``CUT - 1``: codes without the older bytes, their counts, and
        #: the place of each code of the depth before among them.
        self.depths = [(codes, n, None)]
        for _ in range(DEPTH - CUT + 1):
            older, weight, _ = self.depths[-1]
            found, place = distinct(older >> 16 << 8 | older & 255)
            self.depths.append((found, np.bincount(place, weight, len(found)).astype(np.int64), place))

    def nodes(self, level: int) -> list[tuple]:
        """For depths ``DEPTH`` to ``CUT - 1``: outcomes, own and weighted log probability, node of each code.

        The weighted one of the last depth is the sum of its children.
        """
        out: list[tuple] = []
        for codes, n, place in self.depths:
            key = codes >> (8 - level)
            new = np.r_[True, key[1:] != key[:-1]]
            first, node = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            one = np.add.reduceat(n * (codes >> (7 - level) & 1), first)
            seen = np.stack([np.add.reduceat(n, first) - one, one], axis=-1)
            if place is None:
                own, _ = estimate(seen)
                weighted = own
            else:
                _, weighted, born = out[-1][1:]
                parent = np.empty(len(weighted), np.int32)
                parent[born] = node[place]
                own, below = None, np.bincount(parent, weighted, len(first))
                weighted = below
                if len(out) < DEPTH - CUT + 1:
                    own, _ = estimate(seen)
                    weighted = math.log(0.5) + np.logaddexp(own, below)
            out.append((seen, own, weighted, node))
        return out

    def top(self) -> tuple[np.ndarray, ...]:
        """Nodes one depth above the block: key, both outcomes, sum of their children here."""
        codes = self.depths[-1][0]
        keys, seen, below = [], [], []
        for level in range(8):
            n, _, weighted, node = self.nodes(level)[-1]
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            keys.append(node_key(codes[first], level))
            seen.append(n)
            below.append(weighted)
        return np.concatenate(keys), np.concatenate(seen), np.concatenate(below)

    def logs(self, upper: Upper) -> np.ndarray:
        """Log10 chance of each code."""
        codes = self.depths[0][0]
        total = np.zeros(len(codes))
        for level in range(8):
            nodes = self.nodes(level)
            at = np.arange(len(codes))
            chance = has = None
            for (_, _, place), (n, own, weighted, node) in zip(self.depths[:-1], nodes[:-1], strict=True):
                at = at if place is None else place[at]
                mine = node[at]
                p = ((n[:, 1] + 0.5) / (n.sum(axis=1) + 1))[mine]
                if chance is not None:
                    p = mixed(np.exp(math.log(0.5) + own - weighted)[mine], p, chance, has)
                chance, has = p, (n.sum(axis=1) > 0)[mine]
            at = self.depths[-1][2][at]
            chance = upper.chance(node_key(self.depths[-1][0], level)[at], chance, has)
            total += np.log10(np.where(codes >> (7 - level) & 1, chance, 1 - chance))
        return total


def node_key(codes: np.ndarray, level: int) -> np.ndarray:
    """Context, and the decisions before with a one in front."""
    return codes >> 8 << 8 | 1 << level | (codes & 255) >> (8 - level)


class Upper:
    """The tree above the blocks: at most 256 ** (CUT - 1) contexts, those met."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray, below: np.ndarray) -> None:
        #: From depth ``CUT - 1`` to 0: keys, weight of the own estimate, that estimate, any seen.
        self.depths = []
        for depth in range(CUT - 1, -1, -1):
            order = np.argsort(keys, kind="stable")
            keys, seen, below = keys[order], seen[order], below[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            if len(first):
                keys, seen, below = (
                    keys[first], np.add.reduceat(seen, first), np.add.reduceat(below, first)
                )
            weighted, weight, own = weigh(seen, below)
            self.depths.append((keys, weight, own, seen.sum(axis=-1) > 0))
            if depth:
                keys, below = keys >> 16 << 8 | keys & 255, weighted

    def chance(self, keys: np.ndarray, p: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Chances at the root from those at the nodes below ``keys``."""
        for held, weight, own, seen in self.depths:
            at = np.searchsorted(held, keys)
            p, has = mixed(weight[at], own[at], p, has), seen[at]
            keys = keys >> 16 << 8 | keys & 255
        return p


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """A block's codes in order, their counts, the chunks' sizes, and the place of each of their codes."""
    parts = [np.cumsum(_loaded(c)) for c in rows.column("codes").to_pylist()]
    codes, place = distinct(np.concatenate(parts))
    n = np.concatenate([_loaded(c) for c in rows.column("counts").to_pylist()])
    return codes, np.bincount(place, n, len(codes)).astype(np.int64), [len(p) for p in parts], place


def _answers(chunks: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``chunk, block, data``: log10 chances of the codes of each row of ``chunks``, in their order.

    They are kept in single precision and added in double. The tree above the blocks comes
    with the rows, to be destroyed once they have been read.

    Every byte is eight binary decisions, each mixed over all depths from 0 to ``DEPTH``;
    every context that the training texts hold is a node, however seldom it is met. Blocks
    are weighed twice: first for the sums that the tree above them needs, then from the root
    down for the chances.
    """
    rows = chunks.where("block >= 0").select("chunk", "block", "codes", "counts")

    def up(key, source):
        codes, n, _, _ = _merged(source)
        keys, seen, below = Block(codes, n).top()
        pa.default_memory_pool().release_unused()
        return pa.table(
            {"block": [key[0].as_py()], "keys": [keys.tobytes()], "seen": [seen.tobytes()],
             "below": [below.tobytes()]}
        )

    tops = written(
        rows.groupBy("block").applyInArrow(up, "block long, keys binary, seen binary, below binary"), "tops"
    )
    keys, seen, below = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for r in tops.orderBy("block").toLocalIterator():
        keys.append(np.frombuffer(r["keys"], np.int64))
        seen.append(np.frombuffer(r["seen"], np.int64).reshape(-1, 2))
        below.append(np.frombuffer(r["below"]))
    shared = chunks.sparkSession.sparkContext.broadcast(
        Upper(np.concatenate(keys), np.concatenate(seen), np.concatenate(below))
    )

    def down(key, source):
        codes, n, sizes, place = _merged(source)
        logs = Block(codes, n).logs(shared.value).astype(np.float32)[place]
        cells = [_stored(part) for part in np.split(logs, np.cumsum(sizes)[:-1])]
        pa.default_memory_pool().release_unused()
        return pa.table(
            {"chunk": source.column("chunk"), "block": source.column("block"),
             "data": pa.array(cells, pa.binary())}
        )

    return rows.groupBy("block").applyInArrow(down, "chunk long, block long, data binary"), shared


# ---- scores


def commonest(counts: DataFrame, most: int | None = None) -> tuple[pa.Array, pa.Array]:
    """Words and counts from the least count on for which they are at most ``most``.

    Words longer than ``HEAD_BYTES`` are left out. The bound is looked up in a histogram of
    the counts (a row for each sixteenth of a power of two).
    """
    step = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int").alias("step")
    short = counts.where(F.octet_length("key") <= HEAD_BYTES).select("key", "n", step)
    rows = sorted(
        (r["step"], r["words"]) for r in short.groupBy("step").agg(F.count("*").alias("words")).collect()
    )
    least, room = 1 << 20, HEAD if most is None else most
    for at, many in reversed(rows):
        room -= many
        if room < 0:
            break
        least = at
    found = short.where(F.col("step") >= least).select("key", "n").toArrow()
    return found.column("key").combine_chunks(), found.column("n").combine_chunks()


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens (words in lower case
    and one end), with counts of the training rows; ``score`` is the log10 probability of
    the text's bytes and its end under the context tree. A null or empty text is its end
    alone. Without training rows all counts are 0. Equal rows stay as many as they are;
    other columns are not read.

    All contexts of up to ``DEPTH`` bytes that training texts hold count, however seldom
    they are met; they are dealt into blocks, whose number grows with the corpus, and the
    texts are scored chunk by chunk from the blocks' answers.

    Counts of the commonest words are with every task (a fixed number). The remaining
    words of a text, a few per cent, meet their counts in a join.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), "text")
    counts = written(word_counts(texts.where(~held_out(F.col("doc_id")))), "words")
    sizes = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct_ = sizes["n"] or 0, sizes["v"]
    chunks = _chunks(texts, _borders(texts))
    answers, upper = _answers(chunks)
    shared = spark.sparkContext.broadcast(commonest(counts))
    schema = pa.schema(
        [("_row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
         ("logs", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())),
         ("times", pa.list_(pa.int64()))]
    )

    def scan(key, source):
        words, times = shared.value
        head = dict(zip(words.to_pylist(), times.to_pylist(), strict=True))
        cells = dict(zip(source.column("block").to_pylist(), source.column("data").to_pylist(), strict=True))
        docs = pa.ipc.open_stream(cells.pop(-1)).read_all().combine_chunks().to_batches()[0]
        data = blobs(docs)
        _, parts = places(data)
        logs = np.concatenate([_loaded(cells.pop(block), np.float32) for block in sorted(cells)])
        logs = np.concatenate([logs[place] for place in parts])
        begin = np.cumsum([0, *(len(t) + 1 for t in data[:-1])])
        scores = np.add.reduceat(logs, begin, dtype=np.float64)
        pa.default_memory_pool().release_unused()
        out: list[list] = [[] for _ in schema.names]
        ids = (docs.column(n).to_pylist() for n in ("_row", "doc_id"))
        for row, doc, text, score in zip(*ids, data, scores.tolist(), strict=True):
            held = Counter(text.lower().split())
            held[b""] += 1
            known, logs, words, times = 0, 0.0, [], []
            for word, n in held.items():
                c = head.get(word)
                if c is None:
                    words.append(word)
                    times.append(n)
                else:
                    known += n
                    logs += n * math.log10(c + 1)
            values = (row, doc, sum(held.values()), known, logs, score, words, times)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
        )

    rows = chunks.where("block = -1").select("chunk", "block", F.col("docs").alias("data")).unionByName(
        answers
    ).groupBy("chunk").applyInArrow(
        scan, "_row long, doc_id long, n_tokens long, known long, logs double, score double, "
        "words array<binary>, times array<long>"
    )
    rows = written(rows, "scored")
    for held in (shared, upper):  # the scores are stored; nothing computes them again
        held.destroy()
    rest = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "_row", F.col("w.words").alias("key"), F.col("w.times").alias("times")
    )
    met = rest.join(counts, "key").groupBy("_row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs")
    )
    size = math.log10(tokens + distinct_ + 1)
    zero = F.lit(0)
    return rows.drop("words", "times").join(met, "_row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
        "score",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document."""
    return score_texts(table(spark, sf_dir, "documents"))
