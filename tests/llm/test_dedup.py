"""Copies, near copies and repeated windows against brute force."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet import session
from cuesheet.llm import common, exact_dedup, ngram_join, substring_dedup
from cuesheet.llm.components import components
from cuesheet.llm.recompress import BREAK, segments, word_names


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain_copies(rows):
    groups = {}
    for i, t in ((r[0], normal(r[1])) for r in rows):
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = [i == keep for i in ids]
        if sum(kept) > 1:  # ties: one row stays
            first = kept.index(True)
            kept = [k == first for k in range(len(ids))]
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), k, sha) for i, k in zip(ids, kept, strict=True)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("size,route", [(4096, F.xxhash64), (16, F.xxhash64), (16, F.length)])
def test_exact_copies(docs, rows, size, route):
    found = exact_dedup.find_copies(docs, size, lambda b: route(b).cast("long")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_copies(rows)


def test_dropping_copies_keeps_the_columns(docs, no_docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r[1]) for r in rows})
    assert exact_dedup.find_copies(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def split(text):
    return (text or "").encode().split()


def plain_set(text):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def plain_components(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(known) if known else None) for i in members]
    return sorted(map(repr, out)), groups


def test_near_copies(docs, rows, monkeypatch):
    found = ngram_join.find_near_copies(docs)
    want, _ = plain_components(rows)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want


def test_near_copies_without_first_links_and_with_tiles(docs, rows, monkeypatch):
    # all links have to come from the trees, whose shingles are dealt into tiles of two sets
    monkeypatch.setattr(ngram_join, "TILE", 2)
    monkeypatch.setattr(ngram_join, "ONE_LEAF", 1)
    monkeypatch.setattr(ngram_join, "BEST", 1)
    monkeypatch.setattr(ngram_join, "HELD", 100)
    monkeypatch.setattr(ngram_join, "_verified", _without_first(ngram_join._verified))
    want, _ = plain_components(rows)
    got = ngram_join.find_near_copies(docs)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def _without_first(verified):
    calls = []

    def run(pairs, sets):
        calls.append(1)
        return verified(pairs.where("false") if len(calls) == 1 else pairs, sets)

    return run


def test_one_of_each_group_stays(docs, no_docs, rows):
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    _, groups = plain_components(rows)
    wordless = [i for i in range(len(rows)) if not split(rows[i][1])]
    with_words = [m for m in groups.values() if split(rows[m[0]][1])]
    assert kept.count() == len(with_words) + len(wordless)
    assert ngram_join.find_near_copies(no_docs).count() == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, ngram_join.drop_near_copies])
def test_stored_rows_are_known_by_their_places(docs, drop, monkeypatch):
    """A stored table is not copied, whatever its columns are named."""
    stored = session.written(docs.withColumn("_file", F.lit("f")).withColumn("_AT", F.lit(1)).repartition(3), "in")
    named = []
    for module in (common, exact_dedup, ngram_join):
        monkeypatch.setattr(module, "written", lambda df, name: named.append(name) or session.written(df, name))
    kept = drop(stored, stored=True)
    assert "numbered" not in named and kept.columns == stored.columns
    want = drop(stored)
    assert "numbered" in named
    rest = lambda df: sorted(map(repr, df.select("doc_id", F.length("text"), F.col("doc_id").isNull()).collect()))
    assert rest(kept) == rest(want) and kept.count() < stored.count()


def test_shuffle_files_go_when_a_table_is_written(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in map(str, blocks.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = files()
    made = session.written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert made.count() == 7
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    # the count above has one of its own, of one row a task
    assert sum(1 for f in left if f.endswith(".data")) <= spark.sparkContext.defaultParallelism


def test_sets_without_room_for_a_link_are_no_candidates(spark):
    """A shingle that unlike sizes share, or like ones only at the ends of their prefixes."""
    word = lambda i: f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{i // 676}"
    text = lambda start, n: " ".join(word(start + i) for i in range(n))
    both = " v w x y z"
    docs = spark.createDataFrame(
        [(1, text(0, 20) + both), (2, text(100, 200) + both), (3, text(400, 300)), (4, text(401, 300))],
        "doc_id long, text string",
    ).coalesce(1).withColumn("row", F.col("doc_id"))
    sets = ngram_join._sets(docs)
    total = np.zeros(ngram_join.COUNTERS, np.int64)  # all are rare: the order is that of the names
    left = ngram_join._postings(sets, total).join(sets.select("set", "doc_id"), "set")
    assert {r["doc_id"] for r in left.select("doc_id").distinct().collect()} == {3, 4}


def test_rows_are_known_by_number(spark):
    """Null and repeated ids, equal rows, and a column that is named like the number."""
    rows = [(None, "", 1), (None, "", 2), (0, "", 3), (0, None, 4), (0, "a b", 5), (None, "a b", 6), (0, "a b", 7),
            (3, "c d e f g h", 8), (3, "C d e f g h", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(2)
    near = ngram_join.drop_near_copies(docs)
    assert near.columns == docs.columns
    stay = {r["_row"] for r in near.collect()}
    assert {1, 2, 3, 4} <= stay and len(stay & {5, 7}) == 1 and 6 not in stay and len(stay & {8, 9}) == 1
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    stay = {r["_row"] for r in exact.collect()}
    assert len(stay & {3, 4}) == 1 and not stay & {1, 2} and len(stay & {5, 7}) == 1 and {8, 9} <= stay and len(stay) == 4


def test_tree_gives_every_pair_within_the_bound():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 6, (20, 64))
    points = np.minimum(np.repeat(base, 15, axis=0) + rng.integers(0, 2, (300, 64)), 255).astype(np.uint8)
    sizes, labels = points.sum(axis=1).astype(np.int64), rng.integers(0, 40, 300)
    got = {tuple(sorted(p)) for p in ngram_join.Tree(points, sizes, labels).pairs().tolist()}
    want = set()
    for i in range(300):
        for j in range(i):
            n = sizes[i] + sizes[j]
            near = 9 * np.minimum(points[i], points[j]).sum() >= 4 * n
            alike = 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i]
            if labels[i] != labels[j] and near and alike:
                want.add((j, i))
    assert got == want and want


def test_leaves_give_every_pair_within_the_bound():
    rng = np.random.default_rng(0)
    points = np.minimum(rng.integers(0, 3, (60, 64)) + np.repeat(rng.integers(0, 9, (12, 64)), 5, axis=0), 255)
    sizes, labels = points.sum(axis=1), rng.integers(0, 9, 60)
    many = np.array([1, 7, 20, 2, 30])
    edge = np.cumsum(many) - many
    side = np.where(np.arange(60) >= 30, rng.integers(0, 2, 60), -1)
    got = ngram_join._within_leaves(edge, many, points.astype(np.uint8), sizes, labels, side)
    group = np.repeat(np.arange(5), many)
    want = {
        (j, i) for i in range(60) for j in range(i)
        if group[i] == group[j] and labels[i] != labels[j] and (side[i] < 0 or side[i] != side[j])
        and 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])
        and 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i]
    }
    assert {tuple(sorted(p)) for p in got.tolist()} == want and want


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 5), (200, 201), (202, 201), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200, 202: 200}


def plain_repeats(rows, width):
    texts = [split(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", [200_000, 50])
def test_repeated_windows(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    found = substring_dedup.remove_repeats(docs)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_repeats(rows, 35)


def test_dropping_repeats_keeps_rows_and_columns(docs, rows):
    found = substring_dedup.drop_repeats(docs)
    assert found.schema == docs.schema
    got = {r["row"]: r for r in found.collect()}
    texts = [split(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    assert len(got) == len(rows)
    for r, w in zip(rows, texts, strict=True):
        hit = [i for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1]
        gone = {k for i in hit for k in range(i, i + 35)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if hit else r[1]
        assert tuple(got[r[7]]) == (r[0], left, *r[2:])


def test_no_windows(no_docs):
    assert substring_dedup.drop_repeats(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_equal_windows_have_equal_symbols():
    """Few words, many runs and periods: the hardest texts for consistent symbols."""
    rng = np.random.default_rng(4)
    names = []
    for k in range(60):
        words = rng.integers(0, 3, 200) if k % 2 else np.tile(rng.integers(0, 2, 7), 30)
        names += [word_names([b"%d" % w for w in words]), np.full(1, BREAK)]
    all_names = np.concatenate(names)
    width = 12
    symbol, first, last = segments(all_names, width, rounds=6, longest=8)
    of = {}
    covered = 0
    for s, a, b in zip(symbol, first, last, strict=True):
        for i in range(a, b + 1):
            covered += 1
            assert of.setdefault(all_names[i : i + width].tobytes(), s) == s
    assert covered == sum(len(n) - width + 1 for n in names if len(n) > 1)
