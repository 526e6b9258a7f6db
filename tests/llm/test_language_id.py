import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id as lid
from tests.llm.cases import SCHEMA, awkward, empty


def brute_grams(text, bits=lid.BITS):
    """Sorted buckets of a text's n-grams, hashed one at a time: of each word, lower-cased, with a space on each side."""
    out, m, word = [], 0xFFFFFFFF, ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            for n in (1, 2, 3):
                for i in range(len(word) + 3 - n):
                    gram, h = f" {word} "[i : i + n], 0
                    for x in gram:
                        h = (h * 0x85EBCA6B + ord(x) * 0x9E3779B1) & m
                    if gram != " ":
                        out.append((((h ^ (h >> 15)) * 0xC2B2AE35 + n - 1) & m) >> (32 - bits))
            word = ""
    return sorted(out)


TEXTS = ["Ab c", "", "ÉTÉ 🙂x", "z", " -- a1b\n\n  c.. 𝒳𐐀 e\u0301", "123 !", "one  two\tthree " * 9]


@pytest.mark.parametrize("chunk", [400_000, 7])
def test_grams_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(lid, "CHUNK", chunk)
    found = {i: [] for i in range(len(TEXTS))}
    for run in lid.pieces(TEXTS):
        bucket, piece = lid.grams(run)
        for b, k in zip(bucket.tolist(), piece.tolist(), strict=True):
            found[run[k][0]].append(b)
    assert [sorted(found[i]) for i in range(len(TEXTS))] == [brute_grams(t) for t in TEXTS]


@pytest.mark.parametrize(("chunk", "cells"), [(400_000, 4_000_000), (7, 3)])
def test_scores_are_naive_bayes(monkeypatch, chunk, cells):
    monkeypatch.setattr(lid, "CHUNK", chunk)
    monkeypatch.setattr(lid, "CELLS", cells)
    rng = np.random.default_rng(1)
    matrix = np.log(rng.dirichlet(np.ones(1 << lid.BITS), 3).T).astype(np.float32)
    texts = ["hello there", "x", None, "123", "ça va", *TEXTS, *["x y z"] * 100]
    for text, name, score in zip(texts, *lid.score_texts(texts, ["a", "b", "c"], matrix), strict=True):
        if not any(map(str.isalpha, text or "")):
            assert (name, score) == ("und", 0.0)
            continue
        s = matrix[brute_grams(text)].astype(float).sum(axis=0)
        assert name == "abc"[int(s.argmax())] and score == pytest.approx(1 / np.exp(s - s.max()).sum(), rel=1e-3)


def test_a_language_of_short_documents_has_no_advantage(spark):
    rows = [(i, "ab cd " * (200 if i % 2 else 1), "long" if i % 2 else "short", "s", 1) for i in range(40)]
    langs, matrix = lid.train(spark.createDataFrame(rows, SCHEMA))
    names, scores = lid.score_texts(["ab", "cd ab"], langs, matrix)
    assert langs == ["long", "short"] and names == ["long", "long"] and scores == pytest.approx([0.5, 0.5], abs=1e-3)


def test_many_languages(spark):
    rows = [(i * 3 + k, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 5, f"l{i}", "s", 1) for i in range(300) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, matrix = lid.train(docs)
    assert len(langs) == 300 and lid.score_texts(["waaq waaq"], langs, matrix)[0] == ["l0"]
    assert [lid.bits_for(n) << 0 for n in (0, 1, 1024, 1025, 5000, 10**6)] == [15, 15, 15, 14, 12, 10]


def test_long_texts_take_bounded_memory():
    import tracemalloc

    matrix = np.full((1 << lid.BITS, 50), -10.0, np.float32)
    text = "some words and others " * 200_000
    lid.letters()
    tracemalloc.start()
    lid.score_texts([text], [f"l{i:02}" for i in range(50)], matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text) // 4 + 150_000_000


def corpus(spark):
    words = {"en": "the and with from this house water", "de": "der und mit von dieses haus wasser", "fr": "le et avec de cette maison eau"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[lang].split() * 3)), lang if i % 11 else None, "s", 1) for i in range(300) for lang in [list(words)[i % 3]]]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: list(words)[r[0] % 3] for r in rows}


def test_held_out_accuracy(spark):
    docs, truth = corpus(spark)
    got = lid.identify(docs).collect()
    assert len(got) == 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_label_and_source_are_no_inputs(spark):
    docs, _ = corpus(spark)
    langs, matrix = lid.train(docs.where(~lid.held_out(docs.doc_id)))
    a = lid.predict(docs.select("doc_id", "text"), langs, matrix).collect()
    b = lid.predict(docs.selectExpr("doc_id", "text", "'zz' AS lang", "1 AS lang_pred"), langs, matrix).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_awkward(spark):
    got = {(r.doc_id, r.lang_pred) for r in lid.identify(awkward(spark)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (10, "und")} <= got
    assert lid.identify(awkward(spark)).count() == awkward(spark).count()
    assert lid.identify(empty(spark)).count() == 0
    none = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lid.identify(none).collect()} == {("und", 0.0)}


def test_training_sample_is_bounded(spark):
    docs, _ = corpus(spark)
    langs, matrix = lid.train(docs, per_lang=10)
    assert langs == ["de", "en", "fr"] and matrix.shape == (1 << lid.BITS, 3) and math.isclose(float(np.exp(matrix[:, 0].astype(float)).sum()), 1, rel_tol=1e-3)
