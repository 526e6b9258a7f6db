"""Scalar rules on tables of inputs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import folds, names, populations, scalars
from cohortlens.functions.lexicon import Lexicon

LEXICON = Lexicon.from_folder(str(Path(__file__).parent / "lexicon"))
ROUTER = names.Router(LEXICON)


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("Drug: Pembrolizumab 200 mg IV", "pembrolizumab"), ("Metformin Hydrochloride Tablets", "metformin"), ("potassium chloride", "potassiumchloride"), ("neoadjuvant nivolumab", "nivolumab"),
        ("HRS-5635 Injection", "hrs5635"), ("Interferon beta 1a", "interferonbeta1a"), ("Aspirin + Clopidogrel", "aspirin+clopidogrel"), ("Clopidogrel/Aspirin", "aspirin+clopidogrel"), ("adalimumab-adaz prefilled syringe", "adalimumabadaz"),
        ("Aspirin or placebo", "aspirin"), ("Insulin glargine pen", "insulinglargine"), ("Arm A: Docetaxel 75 mg/m2 every 3 weeks", "docetaxel"), ("Ibuprofen®", "ibuprofen"),
    ],
)
def test_keys(raw, key):
    assert ROUTER.route(raw).key == key


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("Placebo", "exact_noise placebo_sham_prefix"), ("Standard of care", "exact_noise"), ("x", "too_short"), ("123", "no_letters"), ("Treatment A", "regex_noise"), ("PD-1 inhibitor", "regex_noise"), ("Nitrogen (placebo)", "regex_noise"),
        ("Aspirin or Ibuprofen", "either_or_arm"), ("dose escalation of Drug", "metadata_cue"), ("a" * 90, "too_long"), (None, "too_short"), ("oral", "qualifiers_only too_short_after_key"), ("chemotherapy + surgery", "all_components_gated"),
    ],
)
def test_gates(raw, reason):
    r = ROUTER.route(raw)
    assert r.key is None and r.reason in reason.split()


def test_regimen_needs_known_words():
    assert ROUTER.route("Lenalidomide Dexamethasone").key == "lenalidomidedexamethasone"
    r = ROUTER.route("Lenalidomide Dexamethasone", frozenset({"lenalidomide", "dexamethasone"}))
    assert r.key == "dexamethasone+lenalidomide" and r.route == "combo_regimen"


def test_routed_runs_once_for_each_name(spark):
    df = spark.createDataFrame([("Aspirin 5 mg",), ("Aspirin 5 mg",), ("Placebo",)], "name_raw string")
    assert {(r.name_raw, r.key) for r in names.routed(df, LEXICON).collect()} == {("Aspirin 5 mg", "aspirin"), ("Placebo", None)}


@pytest.mark.parametrize(("raw", "folded"), [("Crohn’s Disease (CD) [x]", "crohn disease"), ("• Diabetes of the Type-2", "diabetes type 2"), ("(only)", "only"), ("Ménière", "meniere"), (None, "")])
def test_fold_condition(spark, raw, folded):
    df = spark.createDataFrame([(raw,)], "s string").select(folds.fold_condition(F.col("s")).alias("f"))
    assert df.first().f == folded


def test_denoise(spark):
    cases = {"healthy volunteers": "healthy_volunteers", "quality life": "behavior_qol_only", "quality life cancer": None, "egfr mutation": "lab_biomarker_only", "d012345": "mesh_id_artifact", "ms": "too_short", "asthma": None}
    df = spark.createDataFrame([(k,) for k in cases], "f string").select("f", folds.denoise_reason(F.col("f")).alias("r"))
    assert {r.f: r.r for r in df.collect()} == cases


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Acme Pharmaceuticals, Inc.", "acme"), ("ACME Ltd", "acme"), ("Genzyme, a Sanofi Company", "sanofi"), ("Janssen Research & Development", "johnson johnson janssen"), ("Merck KGaA, Darmstadt, Germany", "merck kgaa emd serono"), ("Merck", "merck co msd"), ("", "unknown"), ("Inc", "inc"), ("Cancer Research UK", "cancer research")],
)
def test_company_keys(raw, key):
    assert folds.Companies(LEXICON).key(raw) == key


@pytest.mark.parametrize(("text", "key"), [("anti-CD20 antibody", "cd20"), ("CD20 inhibitor", "cd20"), ("JAK1/2 inhibitor", "jak1|jak2"), ("antithrombin", "antithrombin"), ("", ""), (None, "")])
def test_mechanism_keys(spark, text, key):
    df = spark.createDataFrame([(text,)], "s string").select(folds.mechanism_key(F.col("s")).alias("k"))
    assert df.first().k == key


def test_regimens_by_a_join(spark):
    df = spark.createDataFrame([("Lenalidomide Dexamethasone",), ("Insulin glargine",), ("Sodium chloride",), ("Abiraterone Acetate",), ("dexamethasone lenalidomide dexamethasone",), ("Cisplatin Unheardof",)], "name_raw string")
    known = spark.createDataFrame([(k,) for k in ("lenalidomide", "dexamethasone", "insulin", "glargine", "sodium", "chloride", "abiraterone", "acetate", "cisplatin")], "key string")
    got = {r.name_raw: (r.key, r.route, [p.surface for p in r.parts]) for r in names.routed(df, LEXICON, known).collect()}
    both = ("dexamethasone+lenalidomide", "combo_regimen", ["dexamethasone", "lenalidomide"])
    assert got["Lenalidomide Dexamethasone"] == got["dexamethasone lenalidomide dexamethasone"] == both
    assert {k: v[0] for k, v in got.items() if v != both} == {"Insulin glargine": "insulinglargine", "Sodium chloride": "sodiumchloride", "Abiraterone Acetate": "abiraterone", "Cisplatin Unheardof": "cisplatinunheardof"}


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("Vamorolone 6.0 mg/day/day", "vamorolone"), ("Decitabine 20 mg/m²/day for 5 days", "decitabine"), ("Estradiol 0.1 mg/24 hrs", "estradiol"), ("SHR-1701、", "shr1701"), ("SHR-1701、CAPOX", "capox+shr1701"), ("3 cycles of Pembrolizumab", "ofpembrolizumab"),
        ("Aripiprazole depot 25 or 50 mg", "aripiprazole"), ("Trastuzumab deruxtecan", "trastuzumabderuxtecan"), ("Enfortumab vedotin-ejfv", "enfortumabvedotinejfv"), ("Lidocaine 2.5 % w/w", "lidocaine"), ("Ketamine administered as an infusion over 40 min", "ketamine"),
        ("Linperlisib in combination with CHOP", "chop+linperlisib"), ("Epoetin alfa injection", "epoetinalfa"),
    ],
)
def test_cleaning(raw, key):
    assert ROUTER.route(raw).key == key


def test_without_word_lists_only_patterns_work():
    bare = names.Router()
    assert bare.route("Drug: Aspirin 5 mg").key == "aspirin" and bare.route("oral aspirin").key == "oralaspirin" and bare.route("12").reason == "too_short"


def test_dates(spark):
    cases = {"2021-03-04": ("2021-03-04", "day"), "2021-03": ("2021-03-01", "month"), "2021": ("2021-01-01", "year"), "2021-13": (None, None), "soon": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", scalars.partial_date(F.col("s")).alias("p"))
    assert {r.s: (str(r.p.date) if r.p.date else None, r.p.precision) for r in df.collect()} == cases


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.coarsest(F.lit("day"), F.lit("year"), F.lit(None)).alias("c"), scalars.alias_key(F.lit("Ab-1 β(x)")).alias("a"), scalars.study_ids(F.lit("see NCT01234567, nct 00000001 and NCT123")).alias("i"),
        scalars.malformed_study_ids(F.lit("NCT123 NCT01234567")).alias("m"), scalars.is_code_name(F.lit("MK-3475")).alias("k"), scalars.is_code_name(F.lit("aspirin")).alias("n"),
        scalars.intervention_name(F.lit("Drug: Aspirin")).alias("t"), scalars.edge_key(F.lit("a"), F.array(F.lit("Z"), F.lit("B")), F.lit("t"), F.lit(None)).alias("e"),
        scalars.self_consistent(F.lit(True), F.lit("x"), F.array().cast("array<string>"), F.lit("low")).alias("s"),
    ).first()
    assert one.c == "year" and one.a == "ab1βx" and one.i == ["NCT00000001", "NCT01234567"] and one.m == ["NCT123"] and one.k and not one.n
    assert one.t.asDict() == {"type": "Drug", "name": "Aspirin"} and one.e == "a|B,Z|" and one.s is False


def test_mentions(spark):
    df = spark.createDataFrame([("N1", "First-line in children", "line one\nHER2 positive tumours\nmore"), ("N2", None, None)], "nct_id string, title string, elig string")
    got = {(r.nct_id, r.term_id, r.surface, r.evidence_line) for r in populations.mentions(df, {"title": F.col("title"), "eligibility": F.col("elig")}, LEXICON.populations).collect()}
    assert got == {("N1", "first_line", "title", "First-line in children"), ("N1", "pediatric", "title", "First-line in children"), ("N1", "her2_positive", "eligibility", "HER2 positive tumours")}


def test_lexicon_from_folder(tmp_path):
    (tmp_path / "company_aliases.json").write_text('{"groups": [{"canonical": "Big Co", "members": ["little"]}]}')
    (tmp_path / "company_suffixes.json").write_text('{"legal_forms": ["inc"]}')
    (tmp_path / "qualifiers.yaml").write_text("leading:\n  - shiny\n")
    x = Lexicon.from_folder(str(tmp_path))
    assert folds.Companies(x).key("Little Inc") == "big" or folds.Companies(x).key("Little Inc") == "big co"
    assert names.Router(x).route("shiny aspirin").key == "aspirin"
