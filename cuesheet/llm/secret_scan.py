"""Operator 1: secrets found by one minimal automaton for all rules."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa, compile_rules, longest
from .common import blobs, table


class Rule(NamedTuple):
    """``pattern`` over ASCII; ``least`` characters are asked of what follows ``head``.

    Of the matches of one rule, the one that ends first must also be the one that begins
    first (true where matches of a rule can only nest in their last, repeated class).
    """

    kind: str
    pattern: str
    least: int = 0
    head: str = ""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the three base kinds and some further well-known formats
_NAMES = "|".join(
    _either(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")
)
_ASSIGN = f"({_NAMES})[\"']?[ ]*[:=][ ]*[\"']?"
BASE = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 12, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Scanner:
    """The combined automaton, and per rule a forward, a backward and a head automaton.

    One pass over the bytes with the combined automaton says where a match of which rule
    can end; only there the rule's own automata find its begin (backwards, not before the
    end of the rule's last match) and its longest end.
    """

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = compile_rules([r.pattern for r in rules], anchored=False)
        self.ahead = [compile_rules([r.pattern], anchored=True) for r in rules]
        self.back = [compile_rules([r.pattern], True, backwards=True) for r in rules]
        self.head: list[Dfa | None] = [
            compile_rules([r.head], anchored=True) if r.head else None for r in rules
        ]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(index, state) of each byte after which some rule accepts."""
        moves, accepting, s = self.all.moves, self.all.accepting, self.all.start
        out = []
        for i, c in enumerate(data.translate(self.all.classes)):
            s = moves[s + c]
            if s >= accepting:
                out.append((i, s))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule; leftmost and not overlapping."""
        found = self.ends(data)
        if not found:
            return []
        last, out = [0] * len(self.rules), []
        read: dict[int, bytes] = {}

        def classes(dfa: Dfa) -> bytes:
            if id(dfa) not in read:
                read[id(dfa)] = data.translate(dfa.classes)
            return read[id(dfa)]

        for i, s in found:
            for k in self.all.rules[s]:
                if i < last[k]:
                    continue
                start = longest(self.back[k], classes(self.back[k]), i, last[k] - 1, -1) + 1
                if start == 0 and not self._begins(k, classes, i, last[k]):
                    continue
                end = longest(self.ahead[k], classes(self.ahead[k]), start, len(data), 1)
                last[k] = end
                head, body = self.head[k], start
                if head is not None:
                    body = longest(head, classes(head), start, end, 1)
                if end - body >= self.rules[k].least:
                    out.append((start, k, end))
        return sorted(out)

    def _begins(self, k: int, classes, i: int, low: int) -> bool:
        """Tell a match that begins at byte 0 from none (both give 0)."""
        if low:
            return False
        return longest(self.ahead[k], classes(self.ahead[k]), 0, i + 1, 1) == i + 1


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offset (at character bounds) to offset in code points."""
    if data.isascii():
        return {o: o for o in offsets}
    out, at, count = {}, 0, 0
    for o in sorted(set(offsets)):
        count += len(data[at:o].decode("utf-8", "replace"))
        out[o], at = count, o
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row: the secrets in its text.

    Spans (``kind, start, end`` in code points, end exclusive) are ordered by start, then
    by the rules' order. A null or empty text has no span; repeated rows give repeated
    rows; other columns are not read. The automata are small, built from the rules alone;
    texts are read row by row in place, nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    scanner = Scanner(rules)

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            column = []
            for data in blobs(batch):
                spans = scanner.spans(data)
                at = code_points(data, [o for s, _, e in spans for o in (s, e)])
                column.append(
                    [{"kind": rules[k].kind, "start": at[s], "end": at[e]} for s, k, e in spans]
                )
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(column, schema[1].type)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def _joined(spans):
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans of every document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*(r.kind for r in BASE)))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )
