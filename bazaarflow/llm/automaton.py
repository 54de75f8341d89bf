"""Deterministic automata over bytes: regex to NFA, subset construction, minimisation, transition arrays.

The regex dialect is what secret rules need: literals, `[...]` classes, groups, `|`, `?`, `*`, `+`,
`{m}`, `{m,}`, `{m,n}` and `\\xHH` or `\\c` escapes. With `nocase` ASCII letters match either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.skip: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.skip.append([])
        self.move.append(None)
        return len(self.skip) - 1


class _Reader:
    """Builds the NFA of one pattern; a tree node is a function (nfa, from state) -> to state."""

    def __init__(self, pattern: str, nocase: bool) -> None:
        self.left, self.nocase = list(pattern), nocase

    def peek(self) -> str:
        return self.left[0] if self.left else ""

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.left.pop(0)
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]

        def build(nfa: _Nfa, begin: int) -> int:
            end = nfa.state()
            for option in options:
                first = nfa.state()
                nfa.skip[begin].append(first)
                nfa.skip[option(nfa, first)].append(end)
            return end

        return build

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())

        def build(nfa: _Nfa, begin: int) -> int:
            for part in parts:
                begin = part(nfa, begin)
            return begin

        return build

    def repeated(self):
        atom = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.left.pop(0)
            if sign == "{":
                bounds = "".join(self.left[: self.left.index("}")])
                del self.left[: len(bounds) + 1]
                low, _, high = bounds.partition(",")
                least, most = int(low), (int(high) if high else None) if "," in bounds else int(low)
            else:
                least, most = (1 if sign == "+" else 0), (1 if sign == "?" else None)
            atom = self._times(atom, least, most)
        return atom

    @staticmethod
    def _times(atom, least: int, most: int | None):
        def build(nfa: _Nfa, begin: int) -> int:
            for _ in range(least):
                begin = atom(nfa, begin)
            if most is None:
                loop = nfa.state()
                nfa.skip[begin].append(loop)
                nfa.skip[atom(nfa, loop)].append(loop)
                return loop
            end = nfa.state()
            for _ in range(most - least):
                nfa.skip[begin].append(end)
                begin = atom(nfa, begin)
            nfa.skip[begin].append(end)
            return end

        return build

    def atom(self):
        sign = self.left.pop(0)
        if sign == "(":
            inner = self.either()
            self.left.pop(0)
            return inner
        accepted = self.byte_class() if sign == "[" else {self.escaped(sign)}
        if self.nocase:
            accepted |= {b ^ 32 for b in accepted if chr(b).isascii() and chr(b).isalpha()}

        def build(nfa: _Nfa, begin: int) -> int:
            end, nfa_from = nfa.state(), nfa.state()
            nfa.skip[begin].append(nfa_from)
            nfa.move[nfa_from] = (frozenset(accepted), end)
            return end

        return build

    def escaped(self, sign: str) -> int:
        if sign != "\\":
            return ord(sign)
        sign = self.left.pop(0)
        if sign == "x":
            return int(self.left.pop(0) + self.left.pop(0), 16)
        return ord(sign)

    def byte_class(self) -> set[int]:
        found: set[int] = set()
        while self.peek() != "]":
            low = self.escaped(self.left.pop(0))
            if self.peek() == "-" and self.left[1] != "]":
                self.left.pop(0)
                found |= set(range(low, self.escaped(self.left.pop(0)) + 1))
            else:
                found.add(low)
        self.left.pop(0)
        return found


@dataclass
class Automaton:
    """step[state * width + kind[byte]] is the next state; state 0 is the start. accept[state]: bits of the rules that end there."""

    kind: np.ndarray
    width: int
    step: np.ndarray
    accept: np.ndarray

    @property
    def resets(self) -> np.ndarray:
        """By byte: it leads to the start from everywhere, so no match holds it."""
        return (self.step.reshape(-1, self.width) == 0).all(axis=0)[self.kind]


def compiled(rules: list[tuple[str, bool]], anchored: bool = False) -> Automaton:
    """One automaton for all (pattern, nocase) rules. Not anchored: a match may begin at every byte.

    An anchored automaton has a dead state, the last one, from which nothing is accepted.
    """
    nfa = _Nfa()
    begin, ends = nfa.state(), {}
    for bit, (pattern, nocase) in enumerate(rules):
        ends[_Reader(pattern, nocase).either()(nfa, _fork(nfa, begin))] = 1 << bit
    kind, sample = _byte_kinds({m[0] for m in nfa.move if m})
    around = [_closure(nfa, {s}) for s in range(len(nfa.skip))]

    first = around[begin]
    ids, step, accept, todo = {first: 0}, [], [], [first]
    for states in todo:  # grows while it is walked
        accept.append(sum({bit for s, bit in ends.items() if s in states}))
        row = []
        moves = [nfa.move[s] for s in states if nfa.move[s]]
        for byte in sample:
            following = frozenset().union(*[around[t] for held, t in moves if byte in held], frozenset() if anchored else first)
            if following not in ids:
                ids[following] = len(ids)
                todo.append(following)
            row.append(ids[following])
        step.append(row)
    if anchored and frozenset() not in ids:
        step.append([len(step)] * len(sample))
        accept.append(0)
    return _minimal(np.array(step), np.array(accept), kind)


def _fork(nfa: _Nfa, begin: int) -> int:
    first = nfa.state()
    nfa.skip[begin].append(first)
    return first


def _closure(nfa: _Nfa, states: set[int]) -> frozenset[int]:
    seen, todo = set(states), list(states)
    while todo:
        for s in nfa.skip[todo.pop()]:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return frozenset(seen)


def _byte_kinds(classes: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no class tells apart share a kind; one byte of each kind."""
    marks = [tuple(b in c for c in classes) for b in range(256)]
    order = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    return np.array([order[m] for m in marks], dtype=np.uint8), [marks.index(m) for m in order]


def _minimal(step: np.ndarray, accept: np.ndarray, kind: np.ndarray) -> Automaton:
    """Merge states that no input tells apart, by refining the partition by acceptance until it is stable."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == block.max():
            break
        block = refined
    dead = block[[i for i in range(len(step)) if not accept[i] and (step[i] == i).all() and i]]
    order = [block[0], *[b for b in range(block.max() + 1) if b != block[0] and b not in dead], *dict.fromkeys(b for b in dead if b != block[0])]
    number = np.empty(block.max() + 1, dtype=np.int64)
    number[order] = np.arange(len(order))
    some = np.array([int(np.flatnonzero(block == b)[0]) for b in order])
    return Automaton(kind, step.shape[1], number[block[step[some]]].astype(np.int32).ravel(), accept[some].astype(np.int64))
