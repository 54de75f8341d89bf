from collections import Counter

import corpus_pipeline
import __spark_entry__
from bazaarflow.llm import bpe_chunks, language_id, mixing
from bazaarflow.llm.queries import tokenizer_path
from test_jaccard_join import plain_components
from bazaarflow.llm import jaccard_join


def test_stages_equal_a_plain_version(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 !", "de", "src2", 4), (9004, "one word", None, None, 8)], source.schema)
    first = source.limit(1).selectExpr("9005L as doc_id", "text", "lang", "source", "n_chars")
    source.union(odd).union(first).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokenize":
            assert at.columns == docs.columns
            assert all(rows[r.doc_id] == r for r in at.collect())
        stages[name] = sorted(r.doc_id for r in at.select("doc_id").collect())

    good = {i: r.text for i, r in rows.items() if language_id.has_letter(r.text)}
    assert stages["language id"] == sorted(good)
    best = {}
    for i, text in good.items():
        best[text] = max(i, best.get(text, i))
    assert stages["exact dedup"] == sorted(best.values())
    left = [(i, good[i]) for i in stages["exact dedup"]]
    keep = sorted(i for i, _, c in plain_components(left, jaccard_join.Scheme()) if i == c)
    assert stages["near duplicates"] == keep and len(keep) < len(left)

    drawn = mixing.mixed(docs.filter(docs.doc_id.isin(keep))).select("doc_id").collect()
    assert stages["mix sources"] == stages["tokenize"] == sorted(r.doc_id for r in drawn)
    library = bpe_chunks.Encoder(tokenizer_path()).library
    found = at.collect()
    for r in found:
        ids = library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in again) == Counter((r.doc_id, tuple(r.ids)) for r in found)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert {"op2_warc", "op6_exact_dedup", "op7_mixing"} <= set(__spark_entry__.oracle_sql())
