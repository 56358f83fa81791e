"""Table-driven recognition of token streams by bundled grammars.

A grammar is a text file of rules `name: alternatives ;` with quoted terminals, CAPITAL token classes, groups, `?`, `*` and `+`.
From it come LR(0) item sets with SLR(1) lookaheads. Conflicts stay in the table; the recogniser follows all their branches (generalised
LR). Stacks are shared cells, so equal stacks are one object, and what a line of tokens does to a set of stacks is computed once and
looked up afterwards: a code base repeats few line shapes in few contexts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import product

END = "$end"


@dataclass
class Table:
    shifts: list[dict[str, int]]
    reduces: list[dict[str, list[tuple[str, int]]]]
    gotos: list[dict[str, int]]
    terminals: set[str]


_TOK = re.compile(r"\s+|#[^\n]*|(?P<str>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[:;|()?*+])")


def _rules(text: str) -> dict[str, list[tuple[str, ...]]]:
    """Rules without empty alternatives: options are expanded into alternatives, repetitions into left-recursive rules."""
    toks = [m.group() for m in _TOK.finditer(text) if m.lastgroup]
    out: dict[str, list[tuple[str, ...]]] = {}
    pos, extra = 0, 0

    def alternatives() -> list[tuple[str, ...]]:
        nonlocal pos
        alts = sequence()
        while toks[pos] == "|":
            pos += 1
            alts = alts + sequence()
        return alts

    def fresh(alts: list[tuple[str, ...]]) -> str:
        nonlocal extra
        key = tuple(alts)
        if key not in made:
            extra += 1
            made[key] = f"_{extra}"
            out[made[key]] = list(alts)
        return made[key]

    def sequence() -> list[tuple[str, ...]]:
        nonlocal pos
        parts: list[list[tuple[str, ...]]] = []
        while toks[pos] not in "|);":
            t = toks[pos]
            pos += 1
            if t == "(":
                item = alternatives()
                pos += 1
            else:
                item = [(t,)]
            if toks[pos] in "?*+":
                op = toks[pos]
                pos += 1
                if op in "*+":
                    one = item[0][0] if item == [item[0]] and len(item[0]) == 1 else fresh(item)
                    rep = fresh([(one,), ("@", one)])
                    out[rep] = [(one,), (rep, one)]
                    item = [(rep,)]
                if op in "?*":
                    item = [*item, ()]
            parts.append(item)
        return [sum(p, ()) for p in product(*parts)]

    made: dict[tuple, str] = {}
    while pos < len(toks):
        name = toks[pos]
        pos += 2
        out[name] = alternatives()
        pos += 1
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def build(text: str) -> Table:
    """The table of a grammar; its first rule is the start."""
    rules = _rules(text)
    start = next(iter(k for k in rules if not k.startswith("_")))
    prods: list[tuple[str, tuple[str, ...]]] = [("$start", (start,))]
    by: dict[str, list[int]] = defaultdict(list)
    for k, alts in rules.items():
        for a in alts:
            if not a and k == start:
                continue  # a file without tokens is the caller's case
            if not a:
                raise ValueError(f"empty alternative in {k}")
            if a == (k,):
                continue
            by[k].append(len(prods))
            prods.append((k, a))
    unknown = {s for _, a in prods for s in a if s not in by and not (s[0] == "'" or s.isupper())}
    if unknown:
        raise ValueError(f"no rule for {sorted(unknown)}")
    first: dict[str, set[str]] = {k: set() for k in by}
    follow: dict[str, set[str]] = {k: set() for k in [*by, "$start"]}
    follow["$start"] = {END}
    first_of = lambda s: first[s] if s in by else {s}
    moved = True
    while moved:
        moved = False
        for k, a in prods[1:]:
            n = len(first[k])
            first[k] |= first_of(a[0])
            moved |= len(first[k]) != n
    moved = True
    while moved:
        moved = False
        for k, a in prods:
            for i, s in enumerate(a):
                if s in by:
                    n = len(follow[s])
                    follow[s] |= first_of(a[i + 1]) if i + 1 < len(a) else follow[k]
                    moved |= len(follow[s]) != n

    heads: dict[str, list[int]] = {}

    def closure_heads(sym: str) -> list[int]:
        if sym not in heads:
            seen, todo, got = {sym}, [sym], []
            while todo:
                for p in by[todo.pop()]:
                    got.append(p)
                    s = prods[p][1][0]
                    if s in by and s not in seen:
                        seen.add(s)
                        todo.append(s)
            heads[sym] = got
        return heads[sym]

    table = Table([], [], [], {s for _, a in prods for s in a if s not in by})
    kernels: dict[frozenset, int] = {}
    order: list[frozenset] = []

    def state(kernel: frozenset) -> int:
        if kernel not in kernels:
            kernels[kernel] = len(order)
            order.append(kernel)
        return kernels[kernel]

    state(frozenset([(0, 0)]))
    i = 0
    while i < len(order):
        items = set(order[i])
        for p, d in order[i]:
            a = prods[p][1]
            if d < len(a) and a[d] in by:
                items |= {(q, 0) for q in closure_heads(a[d])}
        moves: dict[str, set] = defaultdict(set)
        reduces: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for p, d in items:
            k, a = prods[p]
            if d < len(a):
                moves[a[d]].add((p, d + 1))
            else:
                for t in follow[k]:
                    reduces[t].append((k, len(a)))
        shifts, gotos = {}, {}
        for s, kern in moves.items():
            (gotos if s in by else shifts)[s] = state(frozenset(kern))
        table.shifts.append(shifts)
        table.gotos.append(gotos)
        table.reduces.append(dict(reduces))
        i += 1
    return table


class Recogniser:
    """Sets of stacks are tuples of cells; a cell is an index into (state, cell below). Memory is bounded: beyond `limit` entries the
    caches start afresh."""

    def __init__(self, table: Table, asi: bool = False, limit: int = 400_000):
        self.t, self.asi, self.limit = table, asi, limit
        self.reset()

    def reset(self) -> None:
        self.states, self.below = [0], [-1]
        self.cells: dict[tuple[int, int], int] = {}
        self.lines: dict[tuple, tuple] = {}
        self.steps: dict[tuple, tuple] = {}
        self.start = (0,)

    def cell(self, state: int, below: int) -> int:
        key = (state, below)
        c = self.cells.get(key)
        if c is None:
            c = self.cells[key] = len(self.states)
            self.states.append(state)
            self.below.append(below)
        return c

    def step(self, front: tuple, tok: str) -> tuple:
        """The stacks after one more token; none if it fits nowhere."""
        key = (front, tok)
        got = self.steps.get(key)
        if got is not None:
            return got
        states, below, t = self.states, self.below, self.t
        todo, seen, out = list(front), set(front), []
        while todo:
            c = todo.pop()
            s = states[c]
            if tok in t.shifts[s]:
                out.append(self.cell(t.shifts[s][tok], c))
            for name, n in t.reduces[s].get(tok, ()):
                if name == "$start":
                    out.append(-1)
                    continue
                b = c
                for _ in range(n):
                    b = below[b]
                new = self.cell(t.gotos[states[b]][name], b)
                if new not in seen:
                    seen.add(new)
                    todo.append(new)
        got = self.steps[key] = tuple(sorted(set(out)))
        return got

    def line(self, front: tuple, toks: tuple) -> tuple[tuple, int]:
        """(stacks after the tokens of a line, index of the token that fits nowhere or -1). With asi, a statement may end unmarked
        before the first token of a line and before `}`."""
        key = (front, toks)
        got = self.lines.get(key)
        if got is None:
            got = self.lines[key] = self._line(front, toks)
        return got

    def _line(self, front: tuple, toks: tuple) -> tuple[tuple, int]:
        for i, tok in enumerate(toks):
            new = self.step(front, tok)
            if not new and self.asi and (i == 0 or tok in ("'}'", END)):
                ended = self.step(front, "ASI")
                new = self.step(ended, tok) if ended else ()
            if not new:
                return (), i
            front = new
        return front, -1

    def full(self) -> bool:
        return len(self.lines) + len(self.steps) + len(self.cells) > self.limit
