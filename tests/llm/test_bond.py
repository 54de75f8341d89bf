from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import bond

SCHEMA = "vec_id long, label int, v array<float>, id string, row int, values int, anchor int, score int, positives int"


def plain(rows, k=5):
    whole = [(n, i, l, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for n, (i, l, v) in enumerate(rows)
             if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))])
    for n, ident, label, vector in whole:
        if ident is None or ident % 100:
            continue
        others = sorted(((-dot(vector, v), last(i), m, l) for m, i, l, v in whole if m != n))
        positives = [o for o in others if o[3] == label][:k]
        for ps, pid, _, _ in positives:
            inside = [o for o in others if o[3] != label and 80 * -ps <= 100 * -o[0] <= 100 * -ps][:k]
            for rank, (ns, nid, _, _) in enumerate(inside, 1):
                yield ident, None if pid[0] else pid[1], rank, None if nid[0] else nid[1], -ps, -ns


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    found = bond.mined(table, "vec_id", F.col("label"), bond.scaled(F.col("v")), F.col("vec_id") % 100 == 0, **sizes)
    return Counter(map(tuple, found.collect()))


def drawn(n, dims, seed=1, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dims)) / 3
    label = draw.integers(0, labels, n)
    near = centres[draw.integers(0, labels, n)] + draw.normal(size=(n, dims)) / 4
    return [(i, int(label[i]), [float(x) for x in near[i]]) for i in range(n)]


@pytest.mark.parametrize("block", [50, 4096])
def test_equals_brute_force(spark, block):
    rows = drawn(700, 21)
    found = run(spark, rows, block=block, wave=3)
    assert found == Counter(plain(rows)) and len(found) > 50


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = drawn(250, 6, seed=3, labels=2)
    rows += [(100, 1, rows[100][2]), (100, 0, rows[100][2]), (300, 1, [0.25] * 6), (301, 1, [0.25] * 6), (302, 0, [0.25] * 6), (303, 0, [0.25] * 6)]
    rows += [(None, 1, [0.25] * 6), (None, 0, [0.25] * 6), (400, None, [1.0] * 6), (500, 1, None), (600, 1, [1.0, None] * 3), (700, 0, [float("nan")] * 6)]
    rows += [(800, 0, [float("inf")] * 6), (900, 1, []), (1000, 1, [1.0, 0.5]), (1100, 9, [0.5] * 6), (1200, 0, [-2.0] * 6)]
    assert run(spark, rows) == Counter(plain(rows))


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, 1, [1.0]), (100, 1, [1.0])], [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], [(None, None, None)] * 3])
def test_small_tables(spark, rows):
    assert run(spark, rows) == Counter(plain(rows))


def test_hot_label_and_one_range(spark):
    rows = [(i, 0 if i % 3 else 1 + i % 5, [((i * 37) % 101) / 50 - 1, ((i * 11) % 29) / 14 - 1]) for i in range(600)]
    assert run(spark, rows) == Counter(plain(rows))


def test_scan_leaves_most_rows_before_all_dimensions_are_read():
    draw = np.random.default_rng(0)
    values = (draw.normal(size=(64, 1000)) * np.linspace(200, 1, 64)[:, None]).astype(np.int32)
    block = bond.Block({"first": 0, "n": 1000, "dims": 64, "ids": np.arange(1000).tobytes(), "labels": np.zeros(1000, dtype=np.int64).tobytes(), "values": values.tobytes()})
    anchor, seen = bond.Anchor(-1, -1, 0, np.ascontiguousarray(values[:, 7]).tobytes()), []

    def ruled_in(lower, upper):
        seen.append(len(lower))
        return upper >= bond._kth(lower, 5, None)

    rows, scores = block.narrowed(anchor, np.arange(1000), ruled_in)
    exact = values.T.astype(np.int64) @ values[:, 7].astype(np.int64)
    assert set(np.argsort(-exact)[:5]) <= set(rows) and (exact[rows] == scores).all() and seen[-2] < 100
