import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import merkle

FIELDS = ["doc_id", "source", "lang", "text"]
SCHEMA = "doc_id long, source string, lang string, text string, tree string, at string, node string, n int, path string, slot0 int, subroot string"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def plain(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {lang: climb([leaf(r) for r in trees[lang]]) for lang in order}
    top = climb([levels[lang][-1][0] for lang in order])
    for i, lang in enumerate(order):
        for at, row in enumerate(trees[lang]):
            path = [*steps(levels[lang], at), *steps(top, i)]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[3] is not None:
                changed = (*row[:3], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[3]))
            found = leaf(changed)
            for left, right in path:
                found = sha(left + found + right)
            yield row[0], leaf(row), levels[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), found, found == top[-1][0]


def run(spark, rows):
    table = spark.createDataFrame([(*r, "t", "a", "n", 1, "p", 2, "s") for r in rows], SCHEMA)
    found = merkle.manifest(
        table.repartition(3), "doc_id", "lang", FIELDS, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)},
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    out = found.select("id", *[merkle.written(F.col(c)) for c in ("leaf", "subroot", "root", "proof", "folded")], "verified")
    return Counter(map(tuple, out.collect()))


def test_manifest_equals_a_plain_one(spark):
    draw = random.Random(4)
    rows = [(i * 3, draw.choice(["a", None, "é"]), "en", draw.choice(["Some Text", "plain", "", None, "Ünïcode Ä"])) for i in range(600)]
    rows += [(10_000 + i, "s", "de", "Text") for i in range(9)] + [(20_000 + i, "s", None, f"T{i}") for i in range(8)]
    rows += [(5, "lone", "zz", "Alone"), (None, "s", "en", "No Id"), (None, None, "en", None), (3, "twice", "en", "Other"), (7, "s", "de", "X"), (7, "s", "de", "X")]
    rows += [(11, "s", "", "Empty Lang"), (12, "s", "long", "Ab c" * 400_000)]
    assert run(spark, rows) == Counter(plain(rows))


def test_change_shows_in_the_folded_root_only(spark):
    found = run(spark, [(i, "s", "en", "Upper" if i % 2 else "lower") for i in range(60)])
    for ident, _, _, root, _, folded, verified in found:
        hit = zlib.crc32(str(ident).encode()) % 3 == 0 and ident % 2 == 1
        assert verified == (not hit) and (folded == root) == verified


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", "Alone")], [(1, "s", "en", "A"), (1, "s", "de", "A")], [(None, None, None, None)] * 9])
def test_small_tables(spark, rows):
    assert run(spark, rows) == Counter(plain(rows))


def test_numbering_spreads_a_large_tree_and_keeps_its_order(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("tree"), (-F.col("id")).alias("id")).repartition(7)
    found = merkle.numbered(frame, "tree", "id").collect()
    for tree, size in (("a", 4000), ("b", 1000)):
        mine = sorted((r["at"], r["id"], r["n"]) for r in found if r["tree"] == tree)
        assert [m[0] for m in mine] == list(range(size)) and {m[2] for m in mine} == {size}
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
