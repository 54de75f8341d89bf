import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaarflow.llm import kneser_ney

SCHEMA = "doc_id long, text string, id string, data string, held_out int, score string, word int, n int"
BEGIN, END = "<begin>", "<end>"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def kept_out(ident):
    return ident is not None and zlib.crc32(str(ident).encode()) % 7 == 2


class Plain:
    """The model with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.raw = order, Counter(t for text in texts for t in tokens(text))
        top, starts = Counter(), Counter()
        for text in texts:
            run = [BEGIN, *tokens(text)]
            for i in range(1, len(run)):
                if i >= order - 1:
                    top[tuple(run[i - order + 1 : i + 1])] += 1
                for k in range(2, order):
                    if i == k - 1:
                        starts[tuple(run[: i + 1])] += 1
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
            self.counts[k].update({g: n for g, n in starts.items() if len(g) == k})
        self.cut, self.context = {}, {}
        for k, counts in self.counts.items():
            self.cut[k] = kneser_ney.discounts([sum(n == i for n in counts.values()) for i in (1, 2, 3, 4)])
            self.context[k] = defaultdict(lambda: [0, 0, 0, 0])
            for gram, n in counts.items():
                entry = self.context[k][gram[:-1]]
                entry[0] += n
                entry[min(n, 3)] += 1

    def p(self, word, before):
        found = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            if len(before) < k - 1:
                break
            context = tuple(before[len(before) - k + 1 :])
            if context not in self.context[k]:
                continue
            total, *seen = self.context[k][context]
            n = self.counts[k][(*context, word)]
            found = max(n - (0, *self.cut[k])[min(n, 3)], 0) / total + sum(d * s for d, s in zip(self.cut[k], seen)) / total * found
        return found

    def scores(self, text):
        run = [BEGIN, *tokens(text)]
        size = sum(self.raw.values())
        base = sum(math.log10((self.raw[t] + 1) / (size + len(self.raw) + 1)) for t in run[1:])
        score = sum(math.log10(self.p(run[i], run[max(0, i - self.order + 1) : i])) for i in range(1, len(run)))
        return len(run) - 1, sum(t in self.raw for t in run[1:]), size, base, score


def drawn(n, seed=1):
    draw = random.Random(seed)
    vocabulary = ["the", "a", "Über", "naïve", *[f"w{i}" for i in range(60)]]
    return [(i, draw.choice([" ", "\t", "\n ", "\x0b"]).join(vocabulary[int(draw.paretovariate(0.7)) % 64] for _ in range(draw.randrange(0, 40)))) for i in range(n)]


def check(spark, rows, order, shard=200):
    table = spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in rows], SCHEMA).repartition(3)
    model = kneser_ney.fit(table, order=order, shard=shard)
    plain = Plain([t for i, t in rows if not kept_out(i)], order)
    expected = sorted((str(i), kept_out(i), *plain.scores(t)) for i, t in rows)
    found = sorted((str(r[0]), *r[1:7]) for r in kneser_ney.scored(table, model).collect())
    assert len(found) == len(expected)
    for mine, theirs in zip(found, expected):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9, abs=1e-9)
    return model, plain


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_a_plain_model(spark, order):
    rows = [*drawn(300), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "THE The the   x y Ü ü"), (1003, "other text"), (None, "w1 w2 lone"), (5, "twice")]
    rows += [(2000 + i, "hot hot words " * 30) for i in range(40)]
    check(spark, rows, order)


def test_probabilities_sum_to_one(spark):
    _, plain = check(spark, drawn(200, seed=5), 3)
    for before in (["<begin>"], ["the", "a"], ["w1", "w2"], ["never", "seen"]):
        assert sum(plain.p(w, before) for w in [*plain.raw, "never"]) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one")], [(i, "held") for i in range(60) if kept_out(i)]])
def test_small_tables(spark, rows):
    check(spark, rows, 2)


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(kneser_ney, "PIECE", 50)
    text = " ".join(f"Word{i}\t\n" + "x" * (i % 90) for i in range(300)).encode()
    runs = list(kneser_ney.words(text))
    assert len(runs) > 20 and [w for r in runs for w in r] == [*text.lower().split(), b""]


def test_very_long_text(spark):
    check(spark, [(3, "alpha beta Gamma delta " * 100_000), (4, "alpha gamma"), (5, "y" * 3_000_000)], 2, shard=1 << 20)


def test_frequent_words_are_spread_over_shards():
    numbers = np.arange(100_000)
    shard = kneser_ney.shard_of(kneser_ney.gram_hash([np.zeros_like(numbers), numbers]), 16)
    assert np.bincount(shard, minlength=16).max() < 1.1 * 100_000 / 16


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = kneser_ney.scored(docs, kneser_ney.fit(docs)).filter("held_out").toPandas()
    assert len(found) > 50 and found["score"].sum() > found["base_score"].sum()
