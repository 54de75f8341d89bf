"""Secret scans with one combined deterministic automaton.

Every rule is a head, followed by at least `least` bytes of a tail class. The rules compile into one
minimal automaton (see `automaton`) that passes once over the bytes of a batch of texts: the batch
is cut at bytes which no rule holds, and all cuts advance in step through the transition array. Cuts
in which a rule ends are then parsed by that rule's own automata for exact spans: leftmost, longest,
not overlapping per kind; a match with too short a tail is passed over and dropped.

The base kinds are assign, access and hex; the other kinds are additions. Offsets are code points.

Defined cases: a null or empty text has no spans. Lone surrogates can't occur in Spark strings. Rows
that repeat get equal results. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.automaton import Automaton, compiled


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int
    nocase: bool = False
    #: tail bytes that the combined automaton counts; fewer keep it small and only let more cuts through
    counted: int = 6


# What the kinds look like.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, nocase=True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, counted=24),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY", "-", 5),
)
BASE = ("assign", "access", "hex")
_CUT = 1024


@lru_cache(maxsize=4)
def _programs(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, np.ndarray]]]:
    together = compiled([(f"{r.head}{r.tail}{{{min(r.least, r.counted)}}}", r.nocase) for r in rules])
    own = []
    for r in rules:
        tail = compiled([(r.tail, r.nocase)], anchored=True)
        held = tail.accept[tail.step[tail.kind]] > 0
        own.append((compiled([(r.head, r.nocase)], anchored=True), held))
    return together, own


def _cuts(data: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Starts of cuts of about _CUT bytes, each at the first byte after one that no rule holds."""
    wanted = np.arange(_CUT, len(data), _CUT)
    free = np.flatnonzero(resets[data])
    at = np.searchsorted(free, wanted)
    return np.unique(np.concatenate(([0], free[at[at < len(free)]] + 1)))


def _suspects(data: np.ndarray, program: Automaton) -> list[tuple[int, int, int]]:
    """(start, end, rule bits) of cuts in which a rule's beginning is found."""
    starts = _cuts(data, program.resets)
    ends = np.append(starts[1:], len(data))
    found = []
    order = np.argsort(starts - ends, kind="stable")  # long ones first
    rest = int(program.kind[np.flatnonzero(program.resets)[0]])
    kinds = np.append(program.kind[data], np.uint8(rest))
    table, width, bits = program.step, program.width, program.accept
    at = 0
    while at < len(order):
        longest = int(ends[order[at]] - starts[order[at]])
        group = [g for g in order[at : at + max(1, (8 << 20) // max(1, longest))]]
        begin, size = starts[group], (ends - starts)[group]
        state = np.zeros(len(group), dtype=np.int32)
        hits = np.zeros(len(group), dtype=np.int64)
        active = len(group)
        for i in range(longest):
            while active and size[active - 1] <= i:
                active -= 1
            now = table[state[:active] * width + kinds[begin[:active] + i]]
            state[:active] = now
            hits[:active] |= bits[now]
        found += [(int(begin[k]), int(begin[k] + size[k]), int(hits[k])) for k in np.flatnonzero(hits)]
        at += len(group)
    return found


def _spans(data: bytes, start: int, end: int, head: Automaton, tail: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Leftmost longest matches of head and tail in data[start:end], without those with a short tail."""
    step, width, kind, accept = head.step, head.width, head.kind, head.accept
    dead = len(accept) - 1
    view = np.frombuffer(data, dtype=np.uint8)[start:end]
    if accept[0]:
        likely = np.flatnonzero(tail[view])
    else:
        likely = np.flatnonzero(step[kind[view]] != dead)
    found, after = [], start
    for s in likely.tolist():
        s += start
        if s < after:
            continue
        state, stop, at = 0, s if accept[0] else -1, s
        while at < end:
            state = step[state * width + kind[data[at]]]
            if state == dead:
                break
            at += 1
            if accept[state]:
                stop = at
        if stop < 0 or stop >= end or not tail[data[stop]]:
            continue
        last = stop
        while last < end and tail[data[last]]:
            last += 1
        if last - stop >= least:
            found.append((s, last))
        after = last
    return found


def scan(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, str]]]:
    """For each text its (start, end, kind) in code points, by start, then in the order of the rules."""
    program, own = _programs(rules)
    gap = bytes([int(np.flatnonzero(program.resets)[0])])
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)
    data = gap.join([*raw, b""])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, hits in _suspects(np.frombuffer(data, dtype=np.uint8), program) if data else []:
        for n, rule in enumerate(rules):
            if hits >> n & 1:
                for a, b in _spans(data, start, end, *own[n], rule.least):
                    doc = int(np.searchsorted(offsets, a, side="right")) - 1
                    found[doc].append((a - int(offsets[doc]), n, b - int(offsets[doc])))
    result = []
    for text, spans in zip(raw, found):
        if not spans:
            result.append([])
            continue
        place = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
        result.append([(int(place[a]), int(place[b]), rules[n].kind) for a, n, b in sorted(spans)])
    return result


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<start, stop, kind>>) for every row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                spans = [[{"start": a, "stop": b, "kind": k} for a, b, k in row] for row in scan(part["text"].to_pylist(), rules)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(spans, kind)], ["id", "spans"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, spans array<struct<start:bigint,stop:bigint,kind:string>>")
