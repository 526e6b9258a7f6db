import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import quality
from tests.llm.cases import awkward, empty

WORD, SPACE_CLASS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if SPACE_CLASS.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


def brute_buckets(text):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\x20\x09-\x0D]|_)+", text or "")
    h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens]
    number = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed)
    pairs = [0 if a == b else number(b, number(a, 42)) for a, b in zip(h, h[1:])]
    return [x >> (64 - quality.BITS) for x in h + pairs]


@pytest.fixture(scope="module")
def docs(spark):
    repeat = "a b c d e f g h i j "
    return awkward(spark, [(20, repeat * 6, "en", "a", 1), (21, "x " * 40, "en", "a", 1), (22, "line one is here\nline one is here\n \n\nother | # $\nline one is here", "en", "a", 1), (23, repeat + "k l m " + repeat + "z", "en", "b", 1)])


def test_base_counts_match_brute_force(spark, docs):
    got = docs.select("text", quality.base_counts(F.col("text")).alias("b")).collect()
    assert all((r.b.n_words, r.b.word_chars, r.b.n_symbols, r.b.n_dup_lines, r.b.n_repeat_words) == brute_base(r.text) for r in got)


def test_ratio_matches_brute_force(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (20, 0, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    table = quality.weights(docs, quality.trusted_ids(labels))
    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(found := brute_buckets(r.text))
        if r.doc_id in (1, 5):
            target.update(found)
    n, m = sum(raw.values()), sum(target.values())
    want = [math.log((target[b] + quality.PRIOR) / (raw[b] * m / n + quality.PRIOR)) for b in range(quality.BUCKETS)]
    assert max(abs(a - b) for a, b in zip(table, want)) < 2e-6
    for r in docs.select("text", quality.score(F.col("text"), table).alias("s")).collect():
        found = brute_buckets(r.text)
        assert r.s == pytest.approx(sum(table[b] for b in found) / len(found) if found else 0.0, abs=1e-9)


def test_verdicts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs.withColumn("kept", F.lit("clash")), quality.trusted_ids(labels))
    assert judged.count() == docs.count()
    for r in judged.collect():
        n, _, _, _, repeated = brute_base(r.text)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (r.base_failed and r.kept)


def test_each_verdict_follows_the_ratio(spark):
    """kept is exactly: the base rules hold and the ratio, computed by hand, reaches the threshold."""
    good = [(i, " ".join(f"the cat number {k} sat on a warm mat near house {k + i}" for k in range(12)), "en", "a", 1) for i in range(40)]
    mixed = [(100 + i, " ".join([f"the cat number {i} sat on a warm mat"] * 1 + [f"zx{j}q%% $k{j * i}" for j in range(i)] + [f"near house {i + j}" for j in range(8)]), "en", "a", 1) for i in range(1, 60)]
    docs = spark.createDataFrame(good + mixed, "doc_id long, text string, lang string, source string, n_chars long")
    trusted = docs.where("doc_id < 30").select("doc_id")
    table = quality.weights(docs, trusted)
    judged = quality.judge(docs, trusted).collect()
    for r in judged:
        found = brute_buckets(r.text)
        ratio = sum(table[b] for b in found) / len(found)
        assert r.kept == (not r.base_failed and ratio >= quality.THRESHOLD)
    assert {r.kept for r in judged if not r.base_failed} == {True, False}


def test_without_trusted_rows_only_base_rules_decide(spark, docs):
    nobody = spark.createDataFrame([], "doc_id long")
    assert all(r.kept == (not r.base_failed) and r.llr == 0 for r in quality.judge(docs, nobody).collect())
    assert quality.judge(empty(spark), nobody).count() == 0


def test_junk_goes_and_prose_stays(spark):
    good = [(i, " ".join(f"the cat number {k} sat on a warm mat near house {k + i}" for k in range(40)), "en", "a", 1) for i in range(120)]
    junk = [(1000 + i, " ".join(f"cat%%% {k} | mat$$$ ### {i}" for k in range(200)), "en", "a", 1) for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.judge(docs, docs.where("doc_id < 60").select("doc_id")).where("kept").collect()}
    assert kept == {i for i, *_ in good}
