"""Regular expressions to one minimal deterministic automaton over bytes."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from typing import NamedTuple

import numpy as np


class Nfa:
    """Thompson construction from the parsed form of a pattern over ASCII bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str, backwards: bool = False, least: bool = False) -> tuple[int, int]:
        """First and last state of the pattern, read from its end if ``backwards``.

        ``least`` leaves out the open end of a last repetition: where a match can end first
        stays as it is.
        """
        items = list(sre_parser.parse(pattern))
        if least and items[-1][0] == sre.MAX_REPEAT and items[-1][1][0]:
            low, _, body = items[-1][1]
            items[-1] = (sre.MAX_REPEAT, (low, low, body))
        return self._sequence(items, backwards)

    def _sequence(self, items: list, backwards: bool) -> tuple[int, int]:
        first = last = self.state()
        for item in reversed(items) if backwards else items:
            start, end = self._item(item, backwards)
            self.empty[last].append(start)
            last = end
        return first, last

    def _item(self, item, backwards: bool) -> tuple[int, int]:
        kind, value = item
        if kind in (sre.LITERAL, sre.IN):
            start, end = self.state(), self.state()
            self.moves[start] = (_bytes_of([item] if kind == sre.LITERAL else value), end)
            return start, end
        if kind == sre.SUBPATTERN:
            return self._sequence(list(value[-1]), backwards)
        if kind == sre.BRANCH:
            start, end = self.state(), self.state()
            for branch in value[1]:
                a, b = self._sequence(list(branch), backwards)
                self.empty[start].append(a)
                self.empty[b].append(end)
            return start, end
        if kind == sre.MAX_REPEAT:
            low, high, body = value
            first = last = self.state()
            for i in range(low if high is sre.MAXREPEAT else high):
                a, b = self._sequence(list(body), backwards)
                self.empty[last].append(a)
                if i >= low:
                    self.empty[a].append(b)
                last = b
            if high is sre.MAXREPEAT:
                a, b = self._sequence(list(body), backwards)
                end = self.state()
                self.empty[last] += [a, end]
                self.empty[b] += [a, end]
                last = end
            return first, last
        raise ValueError(f"not supported in a rule: {kind}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(items: list) -> frozenset[int]:
    out: set[int] = set()
    for kind, value in items:
        if kind == sre.LITERAL:
            out.add(value)
        elif kind == sre.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if max(out) > 127:
        raise ValueError("rules are over ASCII")
    return frozenset(out)


class Dfa(NamedTuple):
    """Transition array ``moves[state + class]``; states are premultiplied offsets.

    Accepting states come last, from ``accepting`` on; ``rules`` gives the rules that
    accept in each of them. ``dead`` is the state that never accepts again, or -1.
    """

    classes: bytes
    moves: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int


def compile_rules(patterns: list[str], anchored: bool, backwards: bool = False) -> Dfa:
    """Subset construction over all patterns at once, then minimisation.

    Not anchored, a match may begin at any byte: the automaton is in an accepting state
    after every byte at which a match of one of the rules can end first (a last open
    repetition is not followed further).
    """
    nfa = Nfa()
    root, ends = nfa.state(), {}
    for k, pattern in enumerate(patterns):
        a, b = nfa.add(pattern, backwards, least=not anchored)
        nfa.empty[root].append(a)
        ends[b] = k
    # bytes that no rule tells apart share a class
    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    for s, move in enumerate(nfa.moves):
        for b in move[0] if move else ():
            signature[b].append(s)
    names: dict[tuple, int] = {}
    classes = bytes(names.setdefault(tuple(signature[b]), len(names)) for b in range(256))
    example = [classes.index(c) for c in range(len(names))]

    start = nfa.closure([root])
    index, rows, todo = {start: 0}, [], [start]
    for subset in todo:
        row = []
        for b in example:
            step = {nfa.moves[s][1] for s in subset if nfa.moves[s] and b in nfa.moves[s][0]}
            target = nfa.closure(step | (set() if anchored else {root}))
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in todo]

    # refine the partition by (own block, blocks of the successors) until it is stable
    table = np.array(rows)
    kinds: dict[tuple, int] = {}
    block = np.array([kinds.setdefault(a, len(kinds)) for a in accepts])
    while True:
        _, refined = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    block = refined
    member = {int(q): i for i, q in reversed(list(enumerate(block)))}
    order = sorted(member, key=lambda q: bool(accepts[member[q]]))
    width = len(example)
    place = {q: i * width for i, q in enumerate(order)}
    moves = [place[int(q)] for p in order for q in block[table[member[p]]]]
    plain = sum(not accepts[member[q]] for q in order)
    dead = [
        s for q in order if not accepts[member[q]]
        for s in [place[q]] if all(moves[s + c] == s for c in range(width))
    ]
    return Dfa(
        classes, moves, place[int(block[0])], plain * width,
        {place[q]: accepts[member[q]] for q in order[plain:]}, dead[0] if dead else -1,
    )


def longest(dfa: Dfa, data, at: int, stop: int, step: int) -> int:
    """Where the longest match ends that begins at ``at`` and goes by ``step``; -1: none.

    ``data`` holds classes, ``stop`` is the first index that is not read.
    """
    s, found = dfa.start, -1
    moves, accepting, dead = dfa.moves, dfa.accepting, dfa.dead
    for i in range(at, stop, step):
        s = moves[s + data[i]]
        if s >= accepting:
            found = i + step
        elif s == dead:
            break
    return found
