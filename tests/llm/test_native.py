from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import exact_dedup, language_id, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string, digest string, salt int"


@pytest.fixture
def docs(spark):
    def make(*rows):
        """rows of (doc_id, text, lang, source); further columns clash with inner names"""
        full = [(*r, *[None] * (4 - len(r)), None if len(r) < 2 or r[1] is None else len(r[1]), "x", "d", 1) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_decisions_compare_texts_even_when_digests_clash(docs, digest_bytes):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, "é" * 5000), (103, "x"), (103, "x"), (None, "lone")]
    found = exact_dedup.decisions(docs(*rows), digest_bytes=digest_bytes).select("id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_exact_hot_group_and_kept_rows(docs):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)] + [(1003, "t3")]
    table = docs(*rows)
    kept = exact_dedup.kept_rows(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [299] + [1000 + i for i in range(50)]
    assert exact_dedup.kept_rows(docs(*rows).limit(0)).count() == 0


def test_mixing_follows_the_target_and_keeps_rows_whole(docs):
    rows = [(i, "t", None, "big") for i in range(3000)] + [(5000 + i, "t", None, "small") for i in range(300)]
    table = docs(*rows)
    mixed = mixing.mixed(table, {"big": 1.0, "small": 3.0}, total=4000)
    assert mixed.columns == [*table.columns, "mix_copies", "mix_copy", "mix_key"]
    by = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(by["big"] - 1000) < 5 * 1000**0.5 and abs(by["small"] - 3000) < 5 * 3000**0.5
    keys = [r.mix_key for r in mixed.collect()]
    assert keys == sorted(keys)
    assert [r.mix_key for r in mixing.mixed(table, {"big": 1.0, "small": 3.0}, total=4000).collect()] == keys


def test_mixing_high_rates_null_sources_and_empty_tables(docs):
    table = docs(*[(i, "t", None, None) for i in range(40)])
    n = mixing.mixed(table, {None: 1.0}, total=40 * 900).count()
    assert abs(n - 36000) < 6 * 36000**0.5
    assert mixing.mixed(table, {"absent": 1.0}).count() == 0
    assert mixing.mixed(table.limit(0)).count() == 0


def test_poisson_counts_have_the_right_variance(docs):
    table = docs(*[(i, "t", None, "s") for i in range(4000)])
    counts = Counter(r.doc_id for r in mixing.mixed(table, total=4000 * 3).select("doc_id").collect())
    drawn = np.array([counts.get(i, 0) for i in range(4000)])
    assert abs(drawn.mean() - 3) < 0.15 and abs(drawn.var() - 3) < 0.35


def test_language_id_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    found = docs.join(language_id.predictions(docs, model).withColumnRenamed("id", "doc_id"), "doc_id").filter(
        language_id.held_out() & (F.col("lang_pred") != "und"))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_id_edge_cases(docs):
    english, german = "the house and the garden with the tree ", "das haus und der garten mit dem baum "
    rows = [(i, (english if i % 2 else german) * (1 + i % 3), "en" if i % 2 else "de", None) for i in range(40)]
    model = language_id.fit(docs(*rows, (90, "???", "en", None), (91, None, "de", None), (92, "x", None, None)))
    odd = docs((1, None), (2, ""), (3, "12 34 !!"), (4, english * 4000), (5, german), (5, german), (None, english))
    found = [(r.id, r.lang_pred) for r in language_id.predictions(odd, model).collect()]
    assert Counter(found) == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (None, "en")])
    assert sorted(str(r.doc_id) for r in language_id.accepted(odd, model).collect()) == ["4", "5", "5", "None"]
    nothing = language_id.fit(docs(*rows).limit(0))
    assert {r.lang_pred for r in language_id.predictions(odd, nothing).collect()} == {"und"}
    one = language_id.fit(docs(*[(i, english, "en", None) for i in range(20)]))
    assert [r.lang_pred for r in language_id.predictions(docs((1, german)), one).collect()] == ["en"]


CLASHING = ("near_sha", "gone_id", "gone_sha", "dedup_id", "dedup_sha", "stay_sha", "NEAR_SHA_", "lang_pred", "score", "digest", "node", "size", "sig")


def test_stages_return_clashing_columns_unchanged(spark):
    from bazaarflow.llm import jaccard_join

    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (2, words), (3, words + " more"), (4, None), (None, "alone with five whole words"), (5, "other " * 9)]
    table = spark.createDataFrame([(i, t, *[f"{c}-{i}" for c in CLASHING]) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    exact = exact_dedup.kept_rows(table)
    near = jaccard_join.representatives(exact, jaccard_join.Scheme(width=5, share=80))
    for found, kept in ((exact, {"2", "3", "4", "5", "None"}), (near, {"2", "4", "5", "None"})):
        assert found.columns == table.columns
        assert {str(r.doc_id) for r in found.collect()} == kept
        assert all(r[c] == f"{c}-{r.doc_id}" for r in found.collect() for c in CLASHING)
