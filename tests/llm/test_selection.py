"""Search, resampling and embeddings against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cuesheet.llm import embedding_dedup, resample, search

ITEMS = "item_id long, text string, rank int, doc_id long, score long, item string, terms string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- search


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))


def plain_search(docs, items, top=10):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, total = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 10 + (90 * c.total() * n_docs // total if total else 0)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, doc, -score))
    return sorted(map(repr, out))


def make_items(rows):
    rng = random.Random(8)
    texts = [r[1] for r in rows if r[1]]
    shared = " ".join(texts[2].split()[:12])
    out = [(i, " ".join(rng.choice(texts).split()[:30])) for i in range(20)]
    out += [(i, f"{shared} {rng.choice(texts)[:60]}") for i in range(20, 30)]
    return [*out, (30, None), (31, ""), (32, ".,;"), (33, "unheard of"), (5, "ONE"), (None, shared), (7, out[7][1])]


@pytest.mark.parametrize("block,cells", [(1 << 18, 4 << 20), (60, 500)])
def test_search_ranks_all_documents(spark, docs, rows, block, cells, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "CELLS", cells)
    items = make_items(rows)
    queries = spark.createDataFrame([(*i, 1, 2, 3, "x", "y") for i in items], ITEMS).repartition(2)
    found = search.search(docs, queries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_search([r[:2] for r in rows], items)


def test_search_without_documents_or_items(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for found in (search.search(no_docs, items), search.search(docs, items.limit(0))):
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_terms_follow_the_pattern():
    text = "Ab_c É́x\u0085y\x7fz 12:3{q} ~w\n"
    assert [t.decode() for t in search.terms(text.encode())] == plain_terms(text)


def test_shared_sums_are_computed_once():
    """Items with common sets go through common nodes, and every item adds exactly its terms."""
    rng = random.Random(2)
    base = [str(i).encode() for i in range(40)]
    items = [rng.sample(base, 20) + [b"own%d" % i] * 2 for i in range(30)] + [base[:10]] * 5 + [[]]
    plan = search.mine(items)
    values = np.array([[1 << n] for n in range(len(plan.leaves))], object)
    held = list(values[:, 0])
    for left, right in plan.levels:
        held += [held[a] + held[b] for a, b in zip(left, right, strict=True)]
    for item, nodes in zip(items, plan.items, strict=True):
        want = sum(1 << plan.leaves.index(t) for t in set(item))
        assert sum(held[n] for n in nodes) == want
    adds = plan.nodes - len(plan.leaves) + sum(max(0, len(n) - 1) for n in plan.items)
    assert adds < 0.8 * sum(max(0, len(set(i)) - 1) for i in items)
    counts = np.arange(len(plan.leaves) * 3).reshape(-1, 3)
    want = [counts[[plan.leaves.index(t) for t in set(i)]].sum(axis=0) for i in items]
    assert (plan.sums(counts) == np.array(want)).all()


def test_best_documents_of_many_batches():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (4, 5000))
    best = search.Best(4, 7)
    for at in range(0, 5000, 50):
        doc = np.arange(at, at + 50)
        best.add(scores[:, at : at + 50], doc, (doc % 11 == 0).astype(int))
        if at % 500 == 0:
            best.cut()
    item, score, none, doc = best.cut()
    for i in range(4):
        want = sorted((-s, d % 11 == 0, d) for d, s in enumerate(scores[i].tolist()) if s > 0)[:7]
        assert [(-s, bool(n), d) for s, n, d in zip(score[item == i], none[item == i], doc[item == i])] == want


# ---- resampling


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def plain_features(text):
    w = plain_words(text)
    return [
        zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)
    ]


def plain_resample(docs, target, percent=5):
    every = [plain_features(t) for _, t in docs]
    s, t = Counter(b for f in every for b in f), Counter(b for x in target for b in plain_features(x))
    big_s, big_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    out = []
    for (doc, text), f in zip(docs, every, strict=True):
        name = f"42:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, len(f), weight, score, None, len(plain_words(text)) >= 20])
    drawn = sorted((r for r in out if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = rank
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling(spark, docs, rows, percent):
    extra = [(900, "a b\nc\n\nd e f g\nh"), (901, "a b\n" * 30), (902, "\n\n"), (903, "One\ntwo\nthree four\none"),
             (904, "x y z\nx y z\n x y z"), (905, "é\n" * 25), (906, "a b\r\nc d")]
    both = docs.select("doc_id", "text", "n").unionByName(
        spark.createDataFrame([(*e, 1) for e in extra], "doc_id long, text string, n int")
    )
    target = [rows[3][1], "a b\nc d", None, "", "A B\nC\nD", "é é"]
    aim = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, line string")
    found = resample.resample(both, aim, percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample([r[:2] for r in rows] + extra, target, percent)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want


def test_resampling_from_nothing_and_towards_nothing(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(no_docs, none).count() == 0
    found = resample.resample(docs, none)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_resample([r[:2] for r in rows], [])


def test_lines_and_borders_give_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\n.") for _ in range(rng.randint(0, 40)))
        lines = [resample.words(line.encode()) for line in text.split("\n")]
        found = [b for line in lines for b in resample.buckets(line)] + resample.crossing(lines)
        assert sorted(found) == sorted(plain_features(text))


def test_a_repeated_line_is_one_row(spark):
    docs = spark.createDataFrame([(i, "the same line\nthe same line\nown %d" % i) for i in range(50)], "doc_id long, text string")
    lines = resample.line_features(docs).collect()
    assert len(lines) == 51 and sorted(r["n"] for r in lines)[-1] == 100


# ---- embeddings

VECTORS = "vec_id long, embedding array<float>, label int, node long, copies string, root long, block int, kept int"


def make_vectors():
    rng = np.random.default_rng(3)
    out = [rng.normal(size=24) for _ in range(60)]
    for spread in (0.02, 0.05, 0.062, 0.07, 0.1):  # some groups around the bound
        base = rng.normal(size=24)
        out += [base + spread * rng.normal(size=24) * np.sqrt(24) / 2 for _ in range(15)]
    out += [out[3]] * 30 + [out[4] * 7, out[4] * -1, out[5][:10], out[5][:10] * 2, out[70], np.zeros(24)]
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(out)]
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 24), (504, [float("inf")] + [1.0] * 23),
             (2, rows[2][1]), (7, rows[70][1]), (None, rows[3][1]), (None, None), (505, [0.0, 0.0]), (-9, rows[80][1]),
             (506, [1e-30] * 24), (507, [1e30] * 24)]
    return rows


def plain_links(rows, least=0.95):
    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = []
    for _, v in rows:
        w = np.array(v, float) if sound(v) else None
        unit.append(None if w is None else w / np.abs(w).max() / np.linalg.norm(w / np.abs(w).max()))
    near = [[i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and float(unit[i] @ unit[j]) >= least for j in range(n)] for i in range(n)]
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                k = todo.pop()
                for j in range(n):
                    if near[k][j] and j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
        out.append((rows[i][0], sum(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("tile,blocks,size", [(1024, 4, 16 << 20), (7, 1, 16 << 20), (16, 2, 1000)])
def test_links_of_vectors(spark, tile, blocks, size, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "BLOCKS", blocks)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", size)
    rows = make_vectors()
    vectors = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], VECTORS).repartition(3)
    found = embedding_dedup.find_near_vectors(vectors)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_links(rows)


def test_one_vector_of_each_component_stays(spark):
    rows = make_vectors()
    vectors = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], VECTORS)
    kept = embedding_dedup.drop_near_vectors(vectors)
    assert kept.columns == vectors.columns
    ids = {r[0] for r in rows}
    stay = {eval(r)[0] for r in plain_links(rows) if eval(r)[3]}  # noqa: S307
    assert {r["vec_id"] for r in kept.collect()} == stay < ids
    none = vectors.limit(0)
    assert embedding_dedup.find_near_vectors(none).count() == embedding_dedup.drop_near_vectors(none).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold_and_products_are_exact(dim):
    rng = np.random.default_rng(dim)
    unit = embedding_dedup.units(rng.normal(size=(60, dim)) * rng.choice([1e-20, 1, 1e20], (60, 1)))
    whole, step, error = embedding_dedup.quantise(unit)
    product = embedding_dedup._product(whole, whole)
    assert (product == whole.astype(np.int64) @ whole.astype(np.int64).T).all()
    bound = error[:, None] + error + error[:, None] * error
    assert (np.abs(product * step[:, None] * step - unit @ unit.T) <= bound).all()


def test_few_pairs_are_left_open():
    """Of pairs spread over all angles only those close to the limit need full precision."""
    rng = np.random.default_rng(9)
    base = embedding_dedup.units(rng.normal(size=(1, 64)))
    near = embedding_dedup.units(base + rng.uniform(0, 0.15, (300, 1)) * rng.normal(size=(300, 64)))
    every = np.arange(300)
    parts = list(embedding_dedup.tiles(*embedding_dedup.quantise(near), every, every))
    i, j, sure = (np.concatenate(c) for c in zip(*parts, strict=True))
    cosine = near @ near.T
    linked = np.argwhere(np.triu(cosine >= 0.95, 1))
    assert {frozenset(p) for p in linked.tolist()} <= {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert (cosine[i[sure], j[sure]] >= 0.95).all() and (np.abs(cosine[i[~sure], j[~sure]] - 0.95) < 0.04).all()


def test_sql_of_these_queries_runs_on_odd_rows():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, NULL::VARCHAR AS text")
    con.execute("CREATE TABLE benchmark AS SELECT 1::BIGINT AS item_id, ''::VARCHAR AS text")
    con.execute("CREATE TABLE embeddings AS SELECT 1::BIGINT AS vec_id, NULL::FLOAT[] AS embedding")
    assert con.execute(search.SQL).fetchall() == []
    assert con.execute(resample.SQL).fetchall()[0][:3] == (1, 0, 0)
    assert con.execute(embedding_dedup.SQL).fetchall() == [(1, 0, 1, True)]
