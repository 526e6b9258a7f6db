from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing
from tests.llm.cases import SCHEMA, awkward, empty


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in open_)
        share = {s: weight[s] / w * (total - sum(fixed.values())) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def corpus(spark, sources=7):
    rows = [(i, "w " * (i * 7919 % 97), "en", None if i % sources == 3 else f"s{i % sources}" if i % 2 else "big", 1) for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bucket_rows", [50, 20_000])
def test_targets_and_budgets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    got = mixing.mix(corpus(spark)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(corpus(spark).repartition(9)).collect()), key=str)


def test_whole_documents(spark):
    got = mixing.mix(corpus(spark), split_last=False).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    largest = max(r.size for r in got)
    for s in {r.source for r in got}:
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= largest


def test_awkward(spark):
    got = mixing.mix(awkward(spark).withColumn("taken", F.lit(1))).collect()
    assert len(got) == awkward(spark).count() and sum(r.size for r in got if r.doc_id == 3) == 0
    assert mixing.mix(empty(spark)).count() == 0
    nothing = mixing.mix(awkward(spark).where("doc_id IN (2, 3, 4)"))
    assert {(r.target, r.taken) for r in nothing.collect()} == {(0.0, 0)}


def test_rows_are_carried(spark):
    docs = awkward(spark)
    got = mixing.mix(docs, carry=docs.columns).select("row.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.mark.parametrize("carry", [None, ["doc_id", "text"]])
def test_rows_without_ids_are_spread_and_repeated_rows_counted(spark, monkeypatch, carry):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(None, f"w{i} " * (i % 9 + 1), "en", "s", 1) for i in range(300)] + [(None, "same text", "en", "s", 1)] * 200 + [(5, "x", "en", "t", 1)] * 40
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), carry=carry).collect()
    sizes = sorted(len(r[1].split()) for r in rows)
    assert sorted(r["size"] for r in got) == sizes and sum(r.taken for r in got if r.source == "s") == int(next(r.target for r in got if r.source == "s") + 1e-9)
    assert len({F for F in (r.taken for r in got if r.source == "s" and r["size"] == 2)}) <= 3
