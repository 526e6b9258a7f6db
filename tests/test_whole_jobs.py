"""Queries over whole tables, against brute force on small tables with rows that the subset queries leave out."""

import os

import duckdb

from cohortlens.plans import analytics, catalog, views
from cohortlens.plans.analogue import registry
from cohortlens.session import CO_PARTITION

SF = "/root/testdata/sf0.001"


def test_connected_components_of_all_edges(spark, tmp_path):
    edges = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (6, 4), (7, 5), (8, 5), (8, 6), (9, 7)]
    lines = [(i, 1 + i % 4, a, b, float(1 + i * 7 % 50)) for i, (a, b) in enumerate(edges)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    groups = [{a, b + 1_000_000} for a, b in edges]
    while any(g & h for i, g in enumerate(groups) for h in groups[:i]):
        g = groups.pop()
        near = [h for h in groups if h & g]
        groups = [g.union(*near)] + [h for h in groups if not h & g]
    got = catalog.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.root) for r in got) == sorted((v, min(g)) for g in groups for v in g)
    assert len(groups) == 5


def test_every_line_is_a_claim(spark, tmp_path):
    # alias a400 % 400 = a0: sole; a201: dominance, but only with its third lines; a203: many owners
    lines = [(i, 3, p, s) for i, (p, s) in enumerate([(400, 1), (400, 2)] + [(201, 1)] * 10 + [(201, 40)] + [(203, 1), (203, 2)])]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.alias: (r.n, r.n_claimants, r.decision) for r in catalog.QUERIES["dominance_aliases"](spark, str(tmp_path)).collect()}
    assert got == {"a0": (2, 1, "sole"), "a201": (10, 2, "dominance"), "a203": (1, 2, "vetoed")}
    assert sorted((r.alias, r.n) for r in catalog.QUERIES["merge_support"](spark, str(tmp_path)).collect()) == [("a0", 2), ("a201", 10)]


def test_every_order_is_returned_and_expected(spark, tmp_path):
    spark.createDataFrame([(i, i % 20, "OF"[i // 20 % 2]) for i in range(400)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    by_case = {r.case_id: r for r in catalog.QUERIES["prf_by_case"](spark, str(tmp_path)).collect()}
    assert sum(r.n_returned for r in by_case.values()) == sum(r.n_gold for r in by_case.values()) == 400
    assert by_case[7].n_returned == 0 and by_case[4].n_gold == 0
    (pooled,) = catalog.QUERIES["prf_pooled"](spark, str(tmp_path)).collect()
    assert (pooled.n_returned, pooled.n_gold, pooled.n_hit) == (400, 400, 190)  # half of 18 cases, and the other half of case 7


def test_every_trial_is_in_a_cell_of_the_matrix(spark):
    t = registry(spark, SF)
    made = analytics.sponsor_phase_matrix(t).collect()
    assert sum(sum(r[1:]) for r in made) == views.trials(t).where("lead_company_id IS NOT NULL").count()
    assert sum(r["unknown"] for r in made) > 0 and sum(r["EARLY_PHASE1"] for r in made) > 0


def test_funnel_has_the_censuses(spark):
    t = {name: df for name, df in registry(spark, SF).items()}
    t["gate_census"] = spark.createDataFrame([("placebo", 3), ("qualifiers_only", 2), ("route_name", 9)], "reason string, n long")
    t["contested_aliases"] = spark.createDataFrame([("vetoed",), ("vetoed",), ("dominance:a",)], "resolution string")
    t["condition_denoised"] = spark.createDataFrame([("healthy",), ("healthy",), ("generic",)], "reason string")
    t["ingest_failures"] = spark.createDataFrame([("m", "e")], "member string, error string")
    found = analytics.funnel(t).collect()
    got = {r.key: r.value for r in found}
    assert len(got) == len(found)
    want = {"gate:placebo": 3, "gate:qualifiers_only": 2, "interventions_gated": 5, "contested_aliases": 2, "alias_dominance": 1, "denoise:healthy": 2, "denoise:generic": 1, "parse_failures": 1}
    assert {k: got[k] for k in want} == want and "gate:route_name" not in got
    assert got["role:subject"] + got["role:comparator"] == got["decided"] and 0 < got["in_scope_assets_with_moa"] <= got["in_scope_assets"]


def test_landscapes_give_all_figures_by_default(spark):
    t = registry(spark, SF)
    figures = lambda df: {r.figure for r in df.select("figure").distinct().collect()}
    assert figures(analytics.condition_landscape(t, "blue bolt")) == {"headline", "phases", "sponsors", "mechanisms", "populations", "start_years", "more", "active_phases", "active_sponsors", "drug_start_years", "sponsor_phases"}
    assert figures(analytics.asset_landscape(t, "brand3x1")) == {"conditions", "roles", "mechanisms", "sponsors", "partners", "headline", "populations", "start_years", "condition_phases"}
    assert figures(analytics.company_landscape(t, "c3")) == {"areas", "phases", "statuses", "conditions", "headline", "active_areas", "drug_phases", "drug_start_years", "condition_phases"}


def test_facets_count_studies_without_lines(spark, tmp_path):
    for name in ("part", "orders", "customer", "nation", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.where("l_orderkey % 3 <> 2") if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "orders", "customer", "nation", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["facet_crossfilter"](spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT facet, value, n, n_cited FROM ({catalog.ORACLE_SQL['facet_crossfilter']})").fetchall()
    assert sorted((r.facet, r.value, r.n, r.n_cited) for r in got) == sorted(want)


def test_cards_of_a_study_listed_twice(spark, tmp_path):
    con = duckdb.connect()
    for name in ("part", "orders", "customer", "nation", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df = df.where("l_orderkey < 40 AND l_orderkey % 3 <> 2") if name == "lineitem" else df.where("o_orderkey < 40") if name == "orders" else df
        (df.union(df.where("o_orderkey % 7 = 0")) if name == "orders" else df).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["trial_card"]).df()
    got = catalog.QUERIES["trial_card"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    key = lambda df: sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in df.astype(object).itertuples(index=False))
    assert key(got) == key(want) and len(got) > 46


def test_cards_move_no_table_by_study(spark, tmp_path):
    os.symlink(SF, tmp_path / "tables")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", CO_PARTITION)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
        spark.conf.set(CO_PARTITION, "true")  # as in a session that isn't the library's
        card = catalog.QUERIES["trial_card"](spark, str(tmp_path / "tables"))
        plan = card._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "hashpartitioning(nct_id" not in plan
    made = registry(spark, str(tmp_path / "tables")).kept
    assert {name for name, df in made.items() if "interventions" in name and df.inputFiles() == made["lines"].inputFiles()} == {"interventions", "arm_interventions"}
