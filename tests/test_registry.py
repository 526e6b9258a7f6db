"""Documents to raw tables to entities to views."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.lexicon import Lexicon
from cohortlens.plans import normalize, views
from cohortlens.sources import checks, registry
from tests.registry_fixture import members


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    parsed = registry.parse(spark.createDataFrame(members(), "member string, json string")).persist()
    folder = str(tmp_path_factory.mktemp("raw"))
    tables = registry.flatten(parsed)
    registry.write_tables(tables, folder)
    return registry.read_tables(spark, folder, list(tables))


@pytest.fixture(scope="module")
def tables(spark, raw, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("all"))
    full = normalize.normalize(raw, Lexicon.from_folder(str(Path(__file__).parent / "lexicon")))
    full["build_meta"] = registry.snapshot_date(raw["studies"])
    empty = spark.createDataFrame
    full["chembl_moa"] = empty([("petinib", "Kinase P inhibitor", "INHIBITOR", ["PK1"], "p"), ("docetaxel", "Tubulin inhibitor", "INHIBITOR", ["TUB"], "tubulin")], "asset_id string, mechanism_of_action string, action_type string, target_symbols array<string>, moa_key string")
    full["asset_curated_moa"] = empty([("zolumab", "Anti-Z", "BINDER", ["Z"], "antibody", "z")], "asset_id string, moa_label string, action string, target_symbols array<string>, modality string, moa_key string")
    full["asset_enrichment"] = empty([("zolumab", "guess", "X", [], ["raw"], "m", False, "g")], "asset_id string, moa_class string, action string, targets_canonical array<string>, targets_raw array<string>, modality string, abstained boolean, moa_key string")
    registry.write_tables(full, folder)
    return registry.read_tables(spark, folder, list(full))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_failures_are_rows(raw):
    assert rows(raw["ingest_failures"], "member", "error") == [("broken.json", "not a study document"), ("nameless.json", "no study id")]
    assert raw["studies"].count() == 10


def test_partial_dates_and_phases(raw):
    s = {r.nct_id: r for r in raw["studies"].collect()}
    assert str(s["NCT00000001"].start_date_parsed) == "2022-03-01" and s["NCT00000001"].date_precision == "month"
    assert s["NCT00000002"].phase_norm == "PHASE3" and s["NCT00000006"].phase_norm == "NA" and s["NCT00000007"].phase_norm is None
    assert s["NCT00000010"].overall_status is None and s["NCT00000010"].std_ages == []


def test_arm_links_by_label_and_by_name(raw):
    assert rows(raw["arm_interventions"].where("nct_id = 'NCT00000001'"), "arm_no", "intervention_no", "via") == [(0, 0, "label"), (0, 1, "label"), (1, 1, "label")]
    assert rows(raw["arm_interventions"].where("nct_id = 'NCT00000009'"), "arm_no", "intervention_no", "via") == [(0, 0, "name"), (1, 1, "name")]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in members():
            z.writestr(name, text)
        z.writestr("readme.txt", "no")
    path = str(tmp_path / "a.zip")
    assert registry.read_members(spark, path).count() == len(members())
    assert registry.census(spark, path).first().n_files == len(members())
    assert [r.member for r in registry.read_members(spark, path, limit=2).collect()] == sorted(n for n, _ in members())[:2]


def test_census_counts_what_is_missing(raw):
    n = {r.reason: r.n for r in registry.drop_census(raw).collect()}
    assert n["n_failed"] == 2 and n["n_no_lead_sponsor"] == 2 and n["n_no_arms"] == 2 and n["n_no_interventions"] == 1


def test_aliases_merge_code_and_name(tables):
    """PX-1234 and petinib name each other in two trials, so they are one asset; a placebo is none."""
    alias = {r.alias_key: r.asset_id for r in tables["asset_aliases"].collect()}
    assert alias["px1234"] == alias["petinib"] == "petinib"
    names = {r.asset_id: r.canonical_name for r in tables["assets"].collect()}
    assert names["petinib"] == "petinib (Petinex)"
    assert not any("placebo" in a for a in names)
    assert alias["zm777"] == "zolumab"


def test_combinations_and_regimens(tables):
    assert {("petinib+zolumab", "petinib"), ("petinib+zolumab", "zolumab"), ("docetaxel+petinib", "docetaxel")} <= set(rows(tables["asset_components"], "combo_asset_id", "component_asset_id"))


def test_roles(tables):
    role = {(r.nct_id, r.asset_id): (r.role, r.in_all_arms) for r in tables["trial_assets"].collect()}
    assert role["NCT00000001", "zolumab"] == ("subject", False)
    assert role["NCT00000001", "docetaxel"] == ("subject", True)
    assert role["NCT00000005", "zolumab"] == ("unknown", None)
    assert role["NCT00000009", "docetaxel"] == ("comparator", False)


def test_conditions_companies_populations(tables):
    assert ("NCT00000004", "asthma", "listed") in rows(tables["trial_conditions_norm"], "nct_id", "condition_key", "source")
    assert rows(tables["condition_denoised"], "nct_id", "reason") == [("NCT00000006", "healthy_volunteers")]
    areas = {(r.condition_key, r.area): r.is_primary for r in tables["condition_areas"].collect()}
    assert areas["D001", "Oncology"] and not areas["D001", "Respiratory"] and areas["rare thing syndrome", "Unclassified"]
    lead = {r.nct_id: r.company_id for r in tables["trial_sponsors_norm"].where("role = 'lead'").collect()}
    assert lead["NCT00000001"] == lead["NCT00000003"] == "acme" and lead["NCT00000004"] == "sanofi"
    assert ("NCT00000001", "her2_positive", "title", "Zolumab in HER2-positive patients") in rows(tables["population_mentions"], "nct_id", "term_id", "surface", "evidence_line")
    assert ("NCT00000002", "severe", "eligibility", "Severe disease.") in rows(tables["population_mentions"], "nct_id", "term_id", "surface", "evidence_line")
    assert ("zolumab", "Antineoplastic Agents", 1) in rows(tables["asset_nlm_classes"], "asset_id", "class_term", "n_trials")


def test_views_hold_their_invariants(tables):
    made = views.apply_views(tables)
    assert set(made) == set(views.VIEWS)
    p = made["v_programs"]
    assert p.where(F.col("n_trials") != F.size("nct_ids")).isEmpty()
    assert p.where("max_phase_active > max_phase_ever").isEmpty()
    assert ("zolumab", "D001") in rows(p, "asset_id", "condition_key")
    assert made["v_trial_conditions_primary"].groupBy("nct_id").agg(F.count_distinct("source").alias("n")).where("n > 1").isEmpty()
    t = {r.nct_id: r for r in made["v_trials"].collect()}
    assert t["NCT00000005"].program_exists is False and t["NCT00000006"].is_industry is None
    assert made["v_combo_partners"].where("asset_id = partner_asset_id").isEmpty()
    card = {r.nct_id: r for r in made["v_trial_card"].collect()}
    assert [a.label for a in card["NCT00000001"].arms] == ["Arm A", "Arm B"] and card["NCT00000001"].arms[1].assets[0].asset_id == "docetaxel"
    assert {r.tier for r in made["v_moa_best"].where("asset_id = 'zolumab'").collect()} == {2}


def test_an_empty_view_fails_the_build(tables):
    with pytest.raises(RuntimeError, match="v_population_landscape"):
        views.apply_views(dict(tables) | {"population_mentions": tables["population_mentions"].limit(0)})


def test_constraints(spark, tables):
    checks.check_tables({k: tables[k] for k in ("studies", "assets", "asset_aliases", "sponsors", "trial_assets")})
    with pytest.raises(checks.BrokenConstraint):
        checks.assert_unique(tables["studies"].union(tables["studies"]), ["nct_id"])
    with pytest.raises(checks.BrokenConstraint):
        checks.assert_in_set(tables["sponsors"], "role", ["lead"])
