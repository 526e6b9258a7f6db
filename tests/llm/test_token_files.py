import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import token_files as tf
from tests.llm.cases import awkward, empty
from tests.llm.test_byte_bpe import texts

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd():
    return [*texts(), "é!! à, ×, ÷. x× don't o'clock !!'s a!!'s É? [a](b) a1, a_b c-d", "Ã, ß. Þ!", "İstanbul Σας ΑΣ, <|endoftext|> x", "<|ENDOFTEXT|> hi", "foo,bar. baz.  \n\tqux", "  a\u0085b c\x1cd", "straße ÀÉ ÿ.", "1.2, 3. a1. b, ", "école. ñ , .", "é, x"]


@pytest.mark.parametrize("memory", [0, 400_000])
def test_words_make_whole_texts(monkeypatch, reference, memory):
    monkeypatch.setattr(tf, "CACHE_WORDS", memory)
    encoder = tf.WordEncoder(PATH, 2)
    for _ in range(2):
        for text, raw in zip(odd(), encoder.encode(odd()), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == [*reference(text), 2]


@pytest.mark.parametrize("block", [2, 512])
def test_files_give_back_every_document(spark, tmp_path, monkeypatch, reference, block):
    monkeypatch.setattr(tf, "BLOCK_DOCS", block)
    docs = awkward(spark, [(100 + i, t, "en", "a", 1) for i, t in enumerate(odd())])
    path = f"file://{tmp_path}/tokens"
    tf.write_tokens(docs, path, PATH)
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, rows = 0, []
    for doc_id, text in want:
        ids = [*reference(text), 2]
        rows.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(map(tuple, tf.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == rows
    assert tf.read_document(spark, path, 5) == next(r[4] for r in rows if r[0] == 5) and tf.read_document(spark, path, 10**9) is None


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tf.write_tokens(empty(spark), path, PATH)
    assert tf.read_tokens(spark, path).count() == 0


def test_clashing_columns(spark, tmp_path):
    path = f"file://{tmp_path}/clash"
    tf.write_tokens(awkward(spark).selectExpr("*", "'x' AS ids", "'y' AS shard", "1 AS n_tokens"), path, PATH)
    assert tf.read_tokens(spark, path).count() == awkward(spark).count()
