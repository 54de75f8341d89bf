import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from bazaarflow.llm import bpe_chunks
from bazaarflow.llm.queries import tokenizer_path

PIECES = ["a", "Hello", " ", "  ", "\n", "é", "é", "́", "<|endoftext|>", "<|startof", "text|>", "'s", "don't", " ", " ", "Σ",
          "123", "!!", "中文字", "가", ".", "\t", "\x0b", "\x85", "İ", "\x00", "😀", "‍", "<|EndOfText|>", "A<|ENDOFTEXT|>b"]


@pytest.fixture(scope="module", params=[8, 64, 1024])
def encoder(request):
    return bpe_chunks.Encoder(tokenizer_path(), request.param)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), max_size=6))
def test_ids_and_decoded_text_equal_the_library(encoder, texts):
    texts = [*texts, None, "", " ", "x" * 500, *texts]
    for text, ids in zip(texts, encoder.encode(texts)):
        whole = encoder.library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == whole
        assert encoder.decode(ids) == encoder.library.decode(whole, skip_special_tokens=False)


def test_shared_passages_share_chunks():
    encoder = bpe_chunks.Encoder(tokenizer_path(), 64)
    passage = " ".join(f"word{i * i} and {i}" for i in range(400))
    encoder.encode([f"one start {passage}", f"another beginning, longer {passage} end"])
    assert encoder.reused > 0.8 * encoder.encoded
    assert b"".join(passage.encode()[a:b] for a, b in zip([0, *bpe_chunks.cuts(passage.encode(), 64)], bpe_chunks.cuts(passage.encode(), 64))) == passage.encode()


def test_full_dictionaries_and_disagreement_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "WORDS_KEPT", 10)
    monkeypatch.setattr(bpe_chunks, "CHUNK_BYTES_KEPT", 1000)
    encoder = bpe_chunks.Encoder(tokenizer_path(), 16)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(20)]
    whole = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == whole
    monkeypatch.setattr(encoder, "_repair", lambda joins: None)
    assert [x.tolist() for x in encoder.encode(texts)] == whole and encoder.disagreed == 20


def test_encoded_rows(spark):
    rows = [(1, None), (2, ""), (3, "Ünïcode text " * 2000), (3, "Ünïcode text " * 2000), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    library = bpe_chunks.Encoder(tokenizer_path()).library
    found = {(r.id, tuple(r.ids), r.decoded) for r in bpe_chunks.encoded(docs, tokenizer_path()).collect()}
    whole = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert found == {(i, tuple(x), library.decode(x, skip_special_tokens=False)) for i, x in whole}
    assert bpe_chunks.encoded(docs.limit(0), tokenizer_path()).count() == 0


def test_added_tokens_in_capitals_are_plain_text(encoder):
    words = ["<|EndOfText|>", "A<|ENDOFTEXT|>b", "x<|StartOfText|>.", "<|endoftext|>", "A<|endoftext|>B", "Plain", "DON'T."]
    texts = [" ".join(["start", *words[i:], *words[:i], "end"] * 3) for i in range(len(words))]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_lists_decode_together_and_marked_words_are_learnt_once(encoder):
    texts = ["", None, "Plain, words. Plain! plain", "x<|endoftext|>y. one<|STARTOFTEXT|>", "Ünï, ünï; 中文, ..."]
    ids = encoder.encode(texts)
    together = encoder.decode_all(np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids]))))
    assert together.to_pylist() == [encoder.decode(x) for x in ids]
    assert encoder.decode_all(np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)).to_pylist() == []
    asked = []
    library = encoder._encoded
    encoder._encoded = lambda words: asked.extend(words) or library(words)
    encoder._words({"Zyxone.", "zyxone!", "ZYXONE"})
    encoder._words({"zyxone.", "Zyxone"})
    del encoder._encoded
    assert asked.count("zyxone") == 1
