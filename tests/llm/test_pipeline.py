"""The pipeline's stages, each on what the one before it kept, against brute force where that is short."""

import os

import pytest

import corpus_pipeline as cp
from cohortlens.llm import pii
from cohortlens.llm.common import stored
from tests.llm.cases import awkward, empty
from tests.llm.test_near_dedup import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), "step"))
    return docs


def test_columns_stay_until_the_last(steps):
    assert all(d.columns == cp.COLUMNS for d in steps[:-1])
    assert steps[-1].columns == ["doc_id", "source", "ids", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"]


def test_quality_keeps_whole_rows(steps):
    before, after = ({r.doc_id: tuple(r) for r in d.collect()} for d in steps[:2])
    assert 0 < len(after) < len(before) and all(before[i] == row for i, row in after.items())


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert {r.doc_id for r in steps[2].collect()} == {a for a, _, c in brute_components(rows, 5) if a == c}


def test_personal_data_is_gone(steps):
    assert [r for r in steps[3].collect() if pii.base_spans(r.text or "")] == []
    assert steps[3].count() == steps[2].count()


def test_mix_repeats_whole_documents(steps):
    before, n = {r.doc_id: tuple(r) for r in steps[3].collect()}, {}
    for r in steps[4].collect():
        assert tuple(r) == before[r.doc_id]
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 2
    assert steps[5].count() == steps[4].count()


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(r.ids_sha256 for r in cp.run(spark, SF).select("ids_sha256").collect()) == sorted(r.ids_sha256 for r in steps[-1].collect())


def test_awkward_and_empty(spark):
    for docs in (awkward(spark, [(60 + i, f"line {i} " + " ".join(f"w{k * i}" for k in range(40)), None, None, None) for i in range(20)]), empty(spark)):
        for name, stage in cp.STAGES:
            docs = stored(stage(spark, docs, SF), "step")
            docs.count()
    mixed = cp.mix_sources(spark, awkward(spark), SF)
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in awkward(spark).collect()}
    again = cp.one_of_each_group(spark, awkward(spark), SF)
    assert sorted(r.doc_id for r in again.where("doc_id = 8").collect()) == [8] and again.where("doc_id IS NULL").count() == 1
