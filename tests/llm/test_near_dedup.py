import numpy as np
import pytest

from cohortlens.llm import near_dedup as nd
from tests.llm.cases import SCHEMA, awkward, empty


def brute_sets(rows, width):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text in rows:
        w = (text or "").encode().translate(low).split()
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(rows, width, percent=80):
    sets, root = brute_sets(rows, width), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            n = len(sets[i] & sets[j])
            if None not in (a, b) and (a == b or n and 100 * n >= percent * len(sets[i] | sets[j])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(a, len(s), None if a is None else find(a)) for (a, _), s in zip(rows, sets)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10_000)}"
    return " ".join(words)


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rng = np.random.default_rng(width)
    base = [[f"v{rng.integers(3000)}" for _ in range(rng.integers(30, 120))] for _ in range(12)]
    rows = [(i, edited(rng, base[i % 12], int(rng.integers(0, 9)))) for i in range(240)]
    rows += [(300 + i, " ".join(f"u{rng.integers(5000)}" for _ in range(50))) for i in range(60)] + [(400, rows[3][1].upper()), (401, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(6)
    got = nd.near_duplicates(docs, width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, width))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Nodes over SMALL are cut into blocks, and families over BLOCK too; no link is lost."""
    monkeypatch.setattr(nd, "SMALL", 16)
    monkeypatch.setattr(nd, "BLOCK", 32)
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 10)))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = nd.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))


def test_awkward(spark):
    docs = awkward(spark, [(30, "One", "en", "a", 1), (31, "SAME text here", "en", "a", 1)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = nd.near_duplicates(docs, 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows, 2), key=str)
    assert all(r.kept for r in got if r.doc_id is None)
    assert nd.near_duplicates(empty(spark), 5).count() == 0


def test_shingles_by_width():
    a, b, c = nd.shingle_sets(["A b", "a  B\n", "b a"], 2)
    assert a.tolist() == b.tolist() != c.tolist() and len(a) == 1
    one, whole = nd.shingle_sets(["x", "x y z"], 5)
    assert len(one) == len(whole) == 1 and one[0] != whole[0]


def test_sketches_estimate_similarity():
    x = nd.mix(np.arange(1000, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:800], nd.mix(np.arange(5000, 5200, dtype=np.uint64))]))
    a, b = (nd.unpacked(nd.sketch(nd.minwise(np.sort(s)))[None]) for s in (x, y))
    assert abs(float(nd.similarity((a == b).sum())) - 800 / 1200) < 0.15


def test_recall_close_to_the_limit_through_deep_trees(spark, monkeypatch):
    """Pairs of 0.80 to 0.82, each alone among documents that share a third of their words, so that trees branch to level 5 and deeper."""
    monkeypatch.setattr(nd, "SMALL", 4)
    rng = np.random.default_rng(80)
    common, rows = [f"c{i}" for i in range(70)], []
    for p in range(500):
        own = [f"p{p}w{i}" for i in range(130)]
        # 21 words of 200 are others: with one-word shingles the pair shares 179 of 221 words, 0.81
        rows += [(2 * p, " ".join(common + own)), (2 * p + 1, " ".join(common + own[21:] + [f"q{p}w{i}" for i in range(21)]))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    levels = []
    monkeypatch.setattr(nd, "_next_nodes", lambda *a, f=nd._next_nodes: levels.append(a[2]) or f(*a))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), 1).collect()}
    assert max(levels) >= 5
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[2 * p + 1] == 2 * p for p in range(500)) >= 0.97 * 500


def test_a_family_of_large_sets_goes_in_blocks(spark, monkeypatch):
    """Families over FAMILY sets or SHINGLES shingles are compared in blocks, with the same result."""
    monkeypatch.setattr(nd, "FAMILY", 4)
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "SHINGLES", 2000)
    rng = np.random.default_rng(12)
    base = [[f"v{b}x{i}" for i in range(90)] for b in range(4)]
    rows = [(i, edited(rng, base[i % 4], int(rng.integers(0, 13)))) for i in range(200)]
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))


def test_runs_are_whole():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1], [1], [], [1, 2], [3, 3], [4])]
    found = [t.column("k").to_pylist() for t in nd.runs(iter(batches), ["k"])]
    assert [x for t in found for x in t] == [1, 1, 1, 1, 2, 3, 3, 4]
    assert all(set(a).isdisjoint(b) for i, a in enumerate(found) for b in found[:i])


def test_clashing_columns(spark):
    docs = awkward(spark).selectExpr("*", "1 AS component_id", "'x' AS n_shingles", "2 AS id", "'k' AS kept", "'t' AS tokens")
    got = nd.near_duplicates(docs, 2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == docs.count()
