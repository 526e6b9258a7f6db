"""Ranking, resolution, metrics, facets, serving, records, streams, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import facets, metrics, ranking, resolution
from cohortlens.plans import enrich, evaluation, resolve, serving
from cohortlens.sources import records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_wins_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert rows(ranking.last_wins(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", 1, None)]
    assert ranking.top_per_group(df, ["k"], [F.desc("t")], 1).count() == 2


def test_mode_takes_the_least_of_ties(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("h", "z"), ("h", "z"), ("h", "a")], "g string, v string")
    assert rows(ranking.mode(df, ["g"], "v")) == [("g", "a", 1), ("h", "z", 2)]


def test_budget_prefix(spark):
    df = spark.range(100).withColumn("c", F.lit(2.5))
    assert ranking.budget_prefix(df, ["id"], "c", 10.0).count() == 4


def test_percent_is_half_even(spark):
    one = spark.range(1).select(ranking.percent(F.lit(1), F.lit(400)).alias("a"), ranking.percent(F.lit(0), F.lit(0)).alias("b")).first()
    assert (one.a, one.b) == (0.2, 0.0)


def test_connected_components_of_a_long_path(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = resolution.connected_components(edges, spark.createDataFrame([(5000,)], "id long"))
    assert {(r.root, r.n) for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(0, n), (1000, 2), (5000, 1)}


def claims(*triples):
    return [(alias, owner, t) for alias, owner, trials in triples for t in trials]


def test_alias_decisions(spark):
    df = spark.createDataFrame(claims(("sole", "a", "1"), ("dom", "a", range(50)), ("dom", "b", "9"), ("few", "a", "1234"), ("few", "b", "5")), "alias string, owner string, trial string")
    nobody = spark.createDataFrame([], "id string, root string")
    got = {r.alias: (r.root, r.decision) for r in resolution.decide_aliases(resolution.alias_support(df, nobody)).collect()}
    assert got == {"sole": ("a", "sole"), "dom": ("a", "dominance"), "few": (None, "vetoed")}


def test_merging_needs_two_trials_and_reaches_its_fixpoint(spark):
    keys = spark.createDataFrame([(k,) for k in ("aa", "bbb", "cccc", "d1")], "id string")
    df = spark.createDataFrame(claims(("bbb", "aa", "12"), ("cccc", "bbb", "34"), ("d1", "aa", "5")), "alias string, owner string, trial string")
    assert rows(resolution.merge_fixpoint(keys, df)) == [("aa", "aa"), ("bbb", "aa"), ("cccc", "aa"), ("d1", "d1")]


def test_scores_of_empty_sets(spark):
    returned = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (4, None)], "c int, i string")
    gold = spark.createDataFrame([(1, "x"), (3, "w"), (4, None)], "c int, i string")
    got = {r.c: (r.precision, r.recall) for r in metrics.set_scores(returned, gold, "c", "i").collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 1.0), 3: (1.0, 0.0), 4: (1.0, 1.0)}
    p = metrics.pooled(metrics.set_scores(returned, gold, "c", "i")).first()
    assert (p.precision, p.recall, p.gating) == (1 / 3, 1 / 2, False)


def test_roll_up(spark):
    df = spark.createDataFrame([("a", "FLOOR", 0.0), ("b", "FLOOR", 1.0), ("e", "FLOOR", 2.0), ("c", "OBJ", 0.5), ("d", "DIAG", 9.0)], "metric string, role string, value double")
    r = metrics.roll_up(df, limits={"e": 2.0}).first()
    assert (r.breaches, r.objective, r.passed) == (["b"], 0.5, False)


def test_facets_apply_the_picks_of_the_others(spark):
    df = spark.createDataFrame([("1", ["a"], ["x"], True), ("2", ["a"], ["y"], False), ("3", ["b"], ["x", "y"], False)], "id string, f array<string>, g array<string>, cited boolean")
    assert rows(facets.tallies(df, ["f", "g"], {"f": ["a"], "g": ["x"]})) == [("f", "a", 1, 1), ("f", "b", 1, 0), ("g", "x", 1, 1), ("g", "y", 1, 0)]


def test_a_null_facet_hides_no_other_facet(spark):
    df = spark.createDataFrame([("1", ["a"], None, True), ("2", ["a"], ["x"], False), ("3", None, ["x"], True)], "id string, f array<string>, g array<string>, cited boolean")
    assert rows(facets.tallies(df, ["f", "g"], {})) == [("f", "a", 2, 1), ("g", "x", 2, 1)]
    assert rows(facets.tallies(df, ["f", "g"], {"f": ["a"]})) == [("f", "a", 2, 1), ("g", "x", 1, 0)]
    assert rows(facets.tallies(df, ["f", "g"], {"g": ["x"]})) == [("f", "a", 1, 0), ("g", "x", 2, 1)]


def test_resolver_rungs(spark):
    names = spark.createDataFrame([("p", "petinib", "name"), ("p", "px1234", "other"), ("q", "petinib sulfate", "name"), ("r", "old name", "curated")], "id string, key string, source string")
    weights = spark.createDataFrame([("p", 5), ("q", 9)], "id string, n_trials long")
    got = [(r.query, r.id, r.rung) for r in resolve.resolve_many(spark, ["Petinib", "px", "sulfate petinib", "OLD NAME", "zzz"], names, weights).orderBy("query", "rung", "id").collect()]
    assert got == [("OLD NAME", "r", 1), ("Petinib", "p", 2), ("px", "p", 5), ("sulfate petinib", "q", 4)]
    assert resolve.nearest(spark, "petinab", names, 1).first().id == "p"


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "NCT00000001 and NCT00000002, NCT12", ["A"])], "run int, answer string, entities array<string>")
    seen = spark.createDataFrame([(1, "NCT00000001")], "run int, id string")
    assert rows(serving.grounding_violations(answers, seen, "run")) == [(1, "NCT00000002", "not retrieved"), (1, "NCT12", "malformed")]
    assert serving.entity_violations(answers, spark.createDataFrame([(1, "a")], "run int, entity string"), "run").isEmpty()


@pytest.mark.parametrize("text", ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "SET x=1", "SELECT * FROM elsewhere", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM parquet.`/etc`", "CREATE VIEW v AS SELECT 1", "", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_sql_is_rejected(spark, text):
    spark.range(1).createOrReplaceTempView("t")
    with pytest.raises(serving.RejectedSql):
        serving.validate_sql(spark, text, ["t"])


def test_sql_runs_and_harvests_before_it_cuts(spark):
    spark.range(300).select(F.format_string("NCT%08d", "id").alias("nct"), F.array(F.struct(F.lit("NCT99999999").alias("x"))).alias("deep")).createOrReplaceTempView("t")
    got = serving.run_sql(spark, "-- note\nWITH a AS (SELECT *, ';drop' AS s FROM t) SELECT * FROM a ORDER BY nct;", ["t"])
    assert len(got["rows"]) == 200 and got["n_rows"] == 300 and len(got["retrieved"]) == 301


def test_records(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "k string, t long, settled boolean, v string"
    for row in [("a", 1, True, "old"), ("a", 2, True, "new"), ("b", 1, False, "no")]:
        records.append_records(spark.createDataFrame([row], schema), log)
    assert rows(records.settled(spark, log, schema, "k", "t")) == [("a", 2, True, "new")]
    records.ship(spark.createDataFrame([("a", 1)], "k string, v long"), str(tmp_path / "ship"), "someone")
    assert rows(records.load_artifact(spark, str(tmp_path / "ship"), "k string, v long", spark.createDataFrame([("a",), ("z",)], "k string"), "k")) == [("a", 1)]
    meta = records.with_meta(records.with_meta(spark.createDataFrame([], "key string, value string"), {"d": "2020-01-01", "n": {"a": 1}}), {"n": {"a": 2}})
    assert records.get_meta(meta, "n") == {"a": 2} and records.get_meta(meta, "d") == "2020-01-01" and records.get_meta(meta, "q") is None
    picked = records.sample_by_rules(spark.range(100).select(F.col("id").cast("string").alias("k"), "id"), "k", {"even": ("id % 2 = 0", 5), "any": ("true", 5)})
    assert picked.count() == picked.select("k").distinct().count() == 10
    assert json.loads(records.as_text(spark.createDataFrame([(1,)], "a int"), "csv").split()[1]) == 1


def test_enrichment_tiers(spark):
    assets = spark.createDataFrame([("p", False), ("q", False), ("p+q", True)], "asset_id string, is_combo boolean")
    aliases = spark.createDataFrame([("petinib", "p"), ("qmab", "q")], "alias_key string, asset_id string")
    molecules = spark.createDataFrame([("M1", "Petinib"), ("M2", "PETINIB"), ("M3", "Q-mab"), ("M4", "qmab")], "molecule_id string, name string")
    mechanisms = spark.createDataFrame([("M1", "P inhibitor", "INHIBITOR", "P", ["P1"]), ("M2", "P inhibitor", "INHIBITOR", "P", ["P1"]), ("M3", "Q binder", "BINDER", "Q", ["Q1"]), ("M4", "R binder", "BINDER", "R", ["R1"])], "molecule_id string, mechanism_of_action string, action_type string, target string, target_symbols array<string>")
    got = enrich.match_vocabulary(assets, aliases, molecules, mechanisms)
    assert [(r.asset_id, r.moa_key) for r in got["chembl_moa"].collect()] == [("p", "p")] and [r.asset_id for r in got["ambiguous"].collect()] == ["q"]
    curated = spark.createDataFrame([("unknown", ["qmab"], "Anti-CD20 antibody", "BINDER", ["MS4A1"], "antibody")], "name string, aliases array<string>, moa string, action string, targets array<string>, modality string")
    assert [(r.asset_id, r.moa_key) for r in enrich.load_curated(curated, aliases).collect()] == [("q", "cd20")]
    targets = enrich.target_vocabulary(spark.createDataFrame([("p53", "TP53")], "alias string, symbol string"), spark.createDataFrame([("P53", "OTHER"), ("jak1", "JAK1")], "alias string, symbol string"))
    answers = spark.createDataFrame([("p", 1, True, "old", "A", ["nope"], "m", False), ("p", 2, True, "new", "A", ["P53", "nope"], "m", False), ("x", 1, True, "n", "A", [], "m", False)], "asset_id string, settled_at long, settled boolean, moa_class string, action string, targets_raw array<string>, modality string, abstained boolean")
    assert [(r.asset_id, r.targets_canonical, r.moa_key) for r in enrich.load_model_answers(answers, assets, targets).collect()] == [("p", ["TP53"], "tp53")]


def answer(**changes):
    base = {"case_id": "c", "answer_md": "Petinib leads, 12 trials; see NCT00000001.", "caveats": ["phase is not approval"], "citations": [("NCT00000001", "why")], "entities": [("drug", "petinib")], "table": (["name", "n"], [["Petinib (Petinex)", "12"], ["Zolumab", "3"]])}
    return base | changes


ANSWERS = "case_id string, answer_md string, caveats array<string>, citations array<struct<nct_id: string, why: string>>, entities array<struct<kind: string, id: string>>, table struct<columns: array<string>, rows: array<array<string>>>"
GOLD = "case_id string, kind string, entities array<string>, ncts array<string>, k int, must_mention array<string>, must_not_mention array<string>, borderline boolean"


def test_cases_are_scored(spark):
    gold = [("a", "contains_all", ["PETINIB", "zolumab", "absent"], [], None, [], [], False), ("b", "top_k_contains", ["zolumab"], [], 1, [], [], False), ("c", "refuse_approval", [], [], None, [], ["approved"], False), ("d", "honest_empty", [], [], None, [], [], False),
            ("e", "role_split", [], [], None, ["subject", "approval"], [], True), ("f", "contains_all", ["petinib"], [], None, ["nowhere"], [], False), ("g", "contains_all", ["petinib"], [], None, [], [], False)]
    answers = [answer(case_id=c) for c in "abcdef"]
    got = {r.case_id: (round(r.score, 4), r.role, r.hard_failure) for r in evaluation.score_cases(spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(gold, GOLD)).collect()}
    assert got == {"a": (0.6667, "OBJ", 0), "b": (0.0, "OBJ", 0), "c": (1.0, "OBJ", 0), "d": (0.0, "OBJ", 0), "e": (0.5, "DIAG", 0), "f": (0.5, "OBJ", 0), "g": (0.0, "OBJ", 1)}


def test_each_planted_defect_breaks_its_own_floor(spark):
    retrieved = spark.createDataFrame([("c", "NCT00000001")], "case_id string, id string")
    seen = spark.createDataFrame([("c", "PETINIB")], "case_id string, entity string")
    clean = spark.createDataFrame([answer()], ANSWERS)
    floors = lambda df: {k for k, v in evaluation.floors(df, retrieved, seen).first().asDict().items() if k != "case_id" and v}
    assert floors(clean) == set()
    for name, (plant, floor) in evaluation.DEFECTS.items():
        assert floors(plant(clean)) == {floor}, name


def test_reconciled_counts(spark):
    partners = spark.createDataFrame([("a", "x", "N1"), ("a", "x", "N1")], "asset_id string, condition_key string, nct_id string")
    programs = spark.createDataFrame([("a", "x", 12)], "asset_id string, condition_key string, n_trials long")
    assert evaluation.reconciles(partners, programs, "a", "x", "1 of 12 trials") and not evaluation.reconciles(partners, programs, "a", "x", "2 of 12")


def test_notes_and_the_listed_sibling(spark):
    names = spark.createDataFrame([("D002289", "carcinoma, non-small-cell lung", "name"), ("nsclc", "nsclc", "name"), ("D002289", "nsclc", "curated"), ("rare thing", "rare thing", "name")], "id string, key string, source string")
    weights = spark.createDataFrame([("D002289", 9), ("nsclc", 2), ("rare thing", 1)], "id string, n_trials long")
    found = resolve.resolve_many(spark, ["NSCLC", "rare thing"], names.where("id <> 'nsclc'"), weights)
    got = {(r.query, r.id): (r.rung, r.n_trials, r.note) for r in resolve.with_notes(found, names, weights).collect()}
    assert got == {("NSCLC", "D002289"): (1, 9, resolve.NOTE_SIBLING), ("NSCLC", "nsclc"): (7, 2, resolve.NOTE_SIBLING), ("rare thing", "rare thing"): (2, 1, resolve.NOTE_LISTED)}


def test_sql_parameters_are_values(spark):
    spark.range(10).createOrReplaceTempView("t")
    for text, values in (("SELECT id FROM t WHERE id > :a AND id < :b", {"a": 3, "b": 6}), ("SELECT id FROM t WHERE id > ? AND id < ?", [3, 6])):
        got = serving.run_sql(spark, text, ["t"], parameters=values)
        assert sorted(r["id"] for r in got["rows"]) == [4, 5] and not got["ids_cut"]
    assert serving.run_sql(spark, "SELECT id FROM t WHERE cast(id AS string) = :a", ["t"], parameters={"a": "1 OR true"})["rows"] == []
