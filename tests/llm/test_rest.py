"""Packing, archives, language model, registered queries and the pipeline."""

import base64
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cuesheet.llm import lm_score, packing, warc
from cuesheet.session import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_packed(found, texts, tokenizer, length=1024):
    """Pieces hold all ids in order, sequences have no gap; gives the sequences' count."""
    want = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            data = np.array(ids[a:b], dtype="<u4").tobytes()
            want.append((doc_id, k, a, b - a, zlib.crc32(data)))
    assert sorted(map(repr, (tuple(r)[:5] for r in found))) == sorted(map(repr, want))
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), sum(r["length"] for r in found)


def test_packing(docs, no_docs, rows, tokenizer):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(packing.token_pieces(docs, path)).collect()
    count, total = check_packed(found, [r[:2] for r in rows], tokenizer)
    assert count <= math.ceil(total / 1024) * 1.1 + 1
    assert packing.pack(packing.token_pieces(no_docs, path)).count() == 0


def test_encoder_gives_the_tokenizer_s_ids(tokenizer, rows):
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in rows] + [
        " lead", "trail ", "two  blanks", "line\n\nbreak", "a \n b", "tab\there", "no break x",
        "it's we'll", "<|endoftext|> x", "nul\0byte x", " wide", "12 345,6 ?!", "x\r\ny z", "a\x1cb c", "\n", " ",
    ]
    for text in texts:
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    counts[1:100] = rng.integers(0, [3, 200, 40, 5][seed], 99) * (rng.random(99) < [1, 1, 0.1, 0.5][seed])
    placed, ranks = defaultdict(list), defaultdict(list)
    for size, rank, many, first, offset in packing.plan(counts, 100):
        for i in range(many):
            placed[first + i].append((offset, size))
            ranks[size].append(rank + i)
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in enumerate(counts) if n)
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100
    total = (counts * np.arange(101)).sum()
    assert len(placed) <= math.ceil(total / 100) * 1.25 + 2


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/x y", "same"), (3, None, None), (4, "http://d/", ""),
    (5, "http://e/", "é" * 5000), (6, "u\r\nv", "WARC/1.1\r\n\r\nin the page"), (None, "n", "same"),
    (7, "http://g/", "only"), (2, "http://b/", "same"), (None, None, "no id"), (8, "x", "x" * 3_000_000),
]


def plain_archive(pages, least=0):
    keep = {}
    for i, _, t in pages:
        if i is not None:
            keep[t or ""] = max(i, keep.get(t or "", i))
    out = []
    for i, _, t in pages:
        data = (t or "").encode()
        best = keep.get(t or "")
        again = len(data) >= least and best is not None and i != best
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", best if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("split,least", [(8 << 20, 0), (97, 0), (1 << 12, 5)])
def test_archives_round_trip(spark, split, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = warc.write_archives(pages, shared_dir(spark, "warc"), least=least, archive_bytes=3000)
    found = warc.read_archives(archives, split).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_archive(PAGES, least)


def test_archive_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, shared_dir(spark, "warc"))).count() == 0


def test_ranges_own_the_records_that_begin_inside():
    members = [
        warc.gzip_member(warc.record(i, "u", bytes([i % 7]) * (i * 13), "D", None), level=i % 3 * 3)
        for i in range(40)
    ]
    data = b"junk\x1f\x8b\x08junk" + b"".join(members) + b"\x1f\x8b"
    for step in (1, 5, 64, 1000, len(data)):
        got = [
            warc.parse(r)["page_id"] for at in range(0, len(data), step)
            for r in warc.read_range(io.BytesIO(data), at, min(at + step, len(data)))
        ]
        assert got == list(range(40))


def plain_base(rows):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter()
    for r in train:
        counts.update([*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for r in rows:
        tokens = [*(r[1] or "").encode().lower().split(), b""]
        out[r[0], r[1]] = (
            len(tokens), sum(counts[t] > 0 for t in tokens), n,
            sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens),
        )
    return out


@pytest.mark.parametrize("head", [1 << 18, 50])
def test_word_baseline_and_tree_scores(docs, rows, head, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    found = lm_score.score_texts(docs).collect()
    assert len(found) == len(rows)
    want = defaultdict(list)
    for (doc_id, _), values in plain_base(rows).items():
        want[doc_id].append(values)
    for r in found:
        got = (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert any(got == w[:3] and math.isclose(r["base_score"], w[3], rel_tol=1e-9) for w in want[r["doc_id"]])
        assert r["score"] < 0
    long = {r["doc_id"]: r["score"] for r in found}
    sizes = {r[0]: len((r[1] or "").encode()) for r in rows}
    # learned letters cost far less than the eight bits of a byte
    assert -long[0] / (sizes[0] + 1) * math.log2(10) < 4


def test_without_training_rows(spark):
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(alone, "some text")], "doc_id long, text string")
    (r,) = lm_score.score_texts(docs).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def tree(train, asked):
    """Log10 chances of ``asked`` (codes) under the tree of the training texts, all in one block."""
    codes, n = np.unique(lm_score.context_codes(train), return_counts=True)
    held = np.union1d(codes, asked)
    counts = np.zeros(len(held), np.int64)
    counts[np.searchsorted(held, codes)] = n
    block = lm_score.Block(held, counts)
    return block.logs(lm_score.Upper(*block.top()))[np.searchsorted(held, asked)]


def test_codes_do_not_depend_on_pieces(monkeypatch):
    texts = [b"one two", b"", b"two one two", b"x" * 50, b""]
    want, (whole,) = lm_score.places(texts)
    assert (want[whole] == lm_score.context_codes(texts)).all()
    for piece in (1, 9, 30):
        monkeypatch.setattr(lm_score, "PIECE", piece)
        found, parts = lm_score.places(texts)
        assert len(parts) > 1 and (found == want).all() and (np.concatenate(parts) == whole).all()
    assert lm_score.places([])[1] == []


def test_next_byte_chances_sum_to_one():
    """After contexts that are met often, once, in their latest bytes only, and never."""
    train = [b"the hill and the hollow", b"over the hill", b"zyx rare", b""] * 3 + [b"alone once"]
    for context in (b"he hil", b"lone o", b"!!!hil", b"\x01\x02\x03\x04\x05\x06", b"\xff" * 6):
        asked = (int.from_bytes(context[::-1], "big") << 8) + np.arange(256)
        assert math.isclose((10 ** tree(train, asked)).sum(), 1, rel_tol=1e-9)


def test_long_contexts_sharpen_the_chances():
    """A byte that always follows six others, and half the time the latest four of them."""
    train = [b"abcdefg", b"uvcdefh"] * 30
    after = lambda context, byte: 10 ** tree(
        train, np.array([int.from_bytes(context[::-1], "big") << 8 | byte])
    )[0]
    assert after(b"abcdef", ord("g")) > 0.9 > 0.6 > after(b"xycdef", ord("g")) > 0.4
    assert after(b"uvcdef", ord("g")) < 0.1


def test_weighting_is_the_mean_of_all_prunings():
    """One decision, depth one, two contexts: half root alone, half the children."""
    below = np.array([[[3, 1]], [[0, 5]]])
    log1, p1 = lm_score.estimate(below)
    root = below.sum(axis=0)
    weighted, weight, own = lm_score.weigh(root, log1.sum(axis=0))
    p = lm_score.mixed(weight, own, p1, below.sum(axis=-1) > 0)

    def kt(a, b):
        value, n = 1.0, [0, 0]
        for bit in [0] * a + [1] * b:
            value *= (n[bit] + 0.5) / (sum(n) + 1)
            n[bit] += 1
        return value

    whole, parts = kt(3, 6), kt(3, 1) * kt(0, 5)
    assert math.isclose(math.exp(weighted[0]), (whole + parts) / 2)
    after = (kt(3, 7) + kt(3, 2) * kt(0, 5)) / (whole + parts)
    assert math.isclose(p[0, 0], after)


def plain_tree(texts, train, depth=6):
    """Log10 chance of each text, node by node in dictionaries."""
    symbols = lambda t: [(b"\xff" * depth + t)[i : i + depth] + bytes([c]) for i, c in enumerate(t + b"\xff")]
    nodes = defaultdict(lambda: [0, 0])
    for t in train:
        for code in symbols(t):
            for k in range(depth + 1):
                for level in range(8):
                    at = code[depth - k : depth], level, code[-1] >> (8 - level)
                    nodes[at][code[-1] >> (7 - level) & 1] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    own, weighted, below = {}, {}, Counter()
    for at in sorted(nodes, key=lambda a: -len(a[0])):
        own[at] = weighted[at] = kt(nodes[at])
        if len(at[0]) < depth:
            weighted[at] = math.log(0.5) + np.logaddexp(own[at], below[at])
        if at[0]:
            below[at[0][1:], *at[1:]] += weighted[at]

    def one(code, level):
        p = None
        for k in range(depth, -1, -1):
            at = code[depth - k : depth], level, code[-1] >> (8 - level)
            if at in nodes:
                mine, share = (nodes[at][1] + 0.5) / (sum(nodes[at]) + 1), 0.5 * math.exp(own[at] - weighted[at])
                p = mine if p is None else share * mine + (1 - share) * p
        return 0.5 if p is None else p

    def log10(code):
        chances = [(code[-1] >> (7 - level) & 1, one(code, level)) for level in range(8)]
        return sum(math.log10(p if bit else 1 - p) for bit, p in chances)

    return {t: sum(map(log10, symbols(t))) for t in texts}


@pytest.mark.parametrize("block", [1 << 30, 700])
def test_every_context_counts_however_seldom(spark, block, monkeypatch):
    """Long common texts, and passages that a few training texts share."""
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "PIECE", block)
    rng = np.random.default_rng(4)
    common = [" ".join(rng.choice(["over", "under", "the", "hill", "and"], 40)) for _ in range(30)]
    texts = [f"{t} {'rare zyx' if i % 9 == 0 else ''} {i}" for i, t in enumerate(common)] + ["", "zyx rare", "Q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = plain_tree([t.encode() for t in texts], train)
    found = lm_score.score_texts(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert abs(r["score"] - want[data]) <= 1e-6 * (len(data) + 1)


def test_a_rare_script_has_contexts_of_its_own(spark):
    """Few Greek texts among many Latin ones, whose letters are the commonest bytes by far."""
    rng = np.random.default_rng(6)
    latin = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz ABCDEFGH"), 400)) for _ in range(40)]
    greek = "το γρήγορο καφέ άλογο πηδά πάνω από το τεμπέλικο σκυλί"
    texts = [greek if i % 8 == 0 else t for i, t in enumerate(latin)]
    alone = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [*enumerate(texts), (alone, greek)]
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 2 <= train.count(greek.encode()) <= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (score,) = [r["score"] for r in lm_score.score_texts(docs).collect() if r["doc_id"] == alone]
    size = len(greek.encode()) + 1
    assert abs(score - plain_tree([greek.encode()], train)[greek.encode()]) <= 1e-6 * size
    assert -score * math.log2(10) / size < 2.5


def test_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now < kept or now == kept
        assert docs.count() == len(now) > 100
        kept = now
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    name, stage = corpus_pipeline.STAGES[-1]
    count, total = check_packed(stage(spark, docs, SF).collect(), texts, tokenizer)
    assert count <= math.ceil(total / 1024) * 1.03 + 1
