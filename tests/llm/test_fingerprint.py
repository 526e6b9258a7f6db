import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import fingerprint as fp
from tests.llm.cases import awkward, empty


def brute(text):
    dense, sparse = [0] * fp.DENSE, [0] * fp.LANES
    for p in text.split("\n") if text else []:
        d = hashlib.sha256(p.encode()).hexdigest()
        for i in range(fp.DENSE):
            dense[i] = (dense[i] + int(d[8 * i : 8 * i + 8], 16)) % (1 << 32)
        at = int(d[:4], 16) % fp.LANES
        sparse[at] = (sparse[at] + (1 if int(d[4], 16) < 8 else -1)) % (1 << 16)
    return dense + sparse


def text_form(v):
    return "".join(f"{x:08x}" for x in v[: fp.DENSE]) + "".join(f"{x:04x}" for x in v[fp.DENSE :])


def cosine(a, b):
    if a == b:
        return 1.0
    x, y = ([v - (1 << 16) if v >= 1 << 15 else v for v in z[fp.DENSE :]] for z in (a, b))
    n = sum(v * v for v in x) * sum(v * v for v in y)
    return round(min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / math.sqrt(n))), 6) if n else 0.0


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute(text), brute(edited), brute(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_form(a), text_form(b), cosine(a, b), cosine(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_rows_match_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = awkward(spark, [(i, f"para {i % 5}\npara {i % 3}\nshared", "en", "a", 1) for i in range(40, 90)])
        got = sorted((tuple(r) for r in fp.fingerprints(docs).collect()), key=str)
        assert got == brute_rows([(r.doc_id, r.text) for r in docs.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_does_not_matter_and_parts_can_be_added_and_taken_away(spark):
    df = spark.createDataFrame([("a\nb\nb", "b\na\nb", "a\nb", "b")], "x string, y string, less string, part string")
    r = df.select(*[fp.lanes(F.col(c)).alias(c) for c in df.columns]).select("x", "y", "less", fp.combine(F.col("less"), F.col("part")).alias("more"), fp.combine(F.col("x"), F.col("part"), -1).alias("fewer")).first()
    assert r.x == r.y == r.more and r.fewer == r.less and r.x != r.less


def test_one_and_no_document(spark):
    assert fp.fingerprints(empty(spark)).count() == 0
    one = fp.fingerprints(awkward(spark).where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.n_chars > 0
