import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from bazaarflow.llm import suffix_dedup as sd
from bazaarflow.llm.anchors import Substrings


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    result = []
    for (ident, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        result.append((ident, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(result)


def found(docs, length, gram):
    return Counter((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.repeats_removed(docs, length, gram).collect())


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(length // 3) for _ in range(6)] + [text(length // 5 + i) for i in range(4)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages)[rng.randint(0, 9):] if rng.random() < 0.4 else text(rng.randint(0, length // 3)) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i * 7][1]) for i in range(8)]  # copies
    rows += [(300 + i, rows[20][1][: 40 * i] + "x" + rows[20][1][40 * i :]) for i in range(6)]  # near copies
    rows += [(400, "a" * 3 * length), (401, "ab" * length), (402, "line of text\n" * length), (403, None), (404, ""), (405, "z" * length), (406, "z" * (length - 1))]
    rows += [(407, text(300)), (407, text(300)), (None, rows[3][1]), (408, "twice " * 3), (408, "twice " * 3)]
    return rows


@pytest.mark.parametrize("length, gram, crowd", [(60, 16, 512), (60, 40, 2), (100, 16, 0)])
def test_equals_brute_force(spark, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    rows = corpus(length + crowd, length)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, th int, k1 int").repartition(3)
    assert found(docs, length, gram) == plain(rows, length)


def test_production_length_empty_tables_and_rest(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, "start " + passage + " end"), (2, passage[:450] + "tail é"), (3, passage[301:700]), (4, "y" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, sd.LENGTH, sd.GRAM) == plain(rows, sd.LENGTH)
    rest = {r.id: bytes(r.kept) for r in sd.repeats_removed(docs, kept=True).collect()}
    assert rest[2] == "tail é".encode() and rest[4] == b""
    assert sd.repeats_removed(docs.limit(0)).count() == 0
    assert found(docs.filter("doc_id = 3"), sd.LENGTH, sd.GRAM) == plain([rows[2]], sd.LENGTH)


def test_buckets_know_what_goes_on_across_boundaries():
    # (bucket, first k1, k2, last k1, k2, kinds of the first run, kinds of the last)
    summaries = [(0, 1, 1, 5, 1, 1, 2), (2, 5, 1, 5, 3, 3, 3), (3, 5, 4, 5, 4, 1, 1), (5, 5, 4, 9, 1, 1, 1), (6, 10, 1, 10, 1, 1, 1)]
    assert sd._across(summaries) == [(0, False, True, 1, 5), (2, True, False, 5, 5), (3, False, True, 5, 5), (5, True, False, 5, 1), (6, False, False, 1, 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), max_size=6), st.integers(10, 20), st.integers(8, 10))
def test_segments_cover_each_string_once(texts, length, gram):
    raw = [t.encode() for t in texts]
    data, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
    anchor, first, last = Substrings(data).segments(ends, length, gram)
    inside = [p for p in range(len(data)) for b, e in zip([0, *ends], ends) if b <= p and p + length <= e]
    assert sorted(p for a, b in zip(first, last) for p in range(a, b + 1)) == sorted(set(inside))
    offsets = {}
    for a, b, c in zip(anchor, first, last):
        for p in range(b, c + 1):
            assert 0 <= a - p <= length - gram
            assert offsets.setdefault(data[p : p + length], a - p) == a - p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=4), max_size=30))
def test_multikey_ties(strings):
    tied = sd.multikey_ties(np.zeros(len(strings), dtype=np.int64), lambda level, i: np.array([ord(strings[x][level]) for x in i]), 4)
    assert sorted(tied.tolist()) == [i for i, s in enumerate(strings) if strings.count(s) > 1]
