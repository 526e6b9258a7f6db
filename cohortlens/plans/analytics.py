"""Landscapes, charts and the completeness funnel: small aggregates over the views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.facets import matrix
from cohortlens.operators.ranking import percent

from . import views
from .views import Tables


def chart(rows: DataFrame, label: str, value: Column | None = None, top: int | None = None) -> DataFrame:
    """label, value of a bar chart; a null label reads unknown; the largest bars first if cut."""
    bars = rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label")).agg((F.count("*") if value is None else value).alias("value"))
    return bars if top is None else bars.orderBy(F.desc("value"), "label").limit(top)


def _figures(parts: dict[str, DataFrame], wanted: Sequence[str] | None) -> DataFrame:
    chosen = [df.select(F.lit(name).alias("figure"), "label", F.col("value").cast("double").alias("value")) for name, df in parts.items() if wanted is None or name in wanted]
    return reduce(DataFrame.union, chosen)


def _phase(c: str, null: str = views.UNKNOWN) -> Column:
    """A phase's name from its rank."""
    return F.coalesce(reduce(lambda w, kv: w.when(F.col(c) == kv[1], F.lit(kv[0])), views.PHASES.items(), F.when(F.lit(False), F.lit(""))), F.lit(null))


def _cells(rows: DataFrame, label: str, top: DataFrame) -> DataFrame:
    """Trials by (label of top, phase); label: the label and the phase."""
    found = rows.join(F.broadcast(top), label).select(F.concat_ws(" / ", F.col(label), _phase("phase_rank")).alias("label"), "nct_id").distinct()
    return found.groupBy("label").agg(F.count("*").alias("value"))


def _mentioned(mentions: DataFrame) -> DataFrame:
    """The twelve terms in most trials; mentions: nct_id, kind, term_id."""
    return chart(mentions.select("nct_id", F.concat_ws(": ", "kind", "term_id").alias("term")).distinct(), "term", top=12)


def _years(rows: DataFrame) -> DataFrame:
    return chart(rows.select("nct_id", F.year("start_date_parsed").alias("year")).distinct(), "year")


def condition_landscape(t: Tables, condition: str, figures: Sequence[str] | None = None) -> DataFrame:
    """figure, label, value: headline, phases (ever and active), sponsors (trials and active ones), mechanisms (distinct assets by best tier),
    populations, start years (all and drug trials), leading sponsors by phase.  figures: those wanted, None for all."""
    here = F.col("condition_key") == condition
    programs = views.programs(t).where(here)
    best = views.moa_best(t).select("asset_id", "provenance").distinct()
    trials = views.trials(t).join(views.trial_conditions_primary(t).where(here).select("nct_id"), "nct_id")
    head = programs.agg(F.count("*").alias("n_programs"), F.count_if(F.col("n_active_trials") > 0).alias("n_active_programs"))
    more = programs.agg(F.count_distinct("lead_company_of_most_advanced").alias("lead_companies"), F.coalesce(F.sum("n_trials"), F.lit(0)).alias("program_trial_rows"))
    sponsors = views.sponsor_condition(t).where(here)
    drug = trials.where("study_type = 'INTERVENTIONAL' AND is_drug_trial")
    top = sponsors.groupBy("company_id").agg(F.sum("n_trials").alias("n")).orderBy(F.desc("n"), "company_id").limit(10).select(F.col("company_id").alias("lead_company_id"))
    return _figures({
        "headline": head.unpivot([], ["n_programs", "n_active_programs"], "label", "value"),
        "phases": chart(programs, "max_phase_ever"),
        "sponsors": chart(views.sponsor_condition(t).where(here), "company_name", F.sum("n_trials"), top=10),
        "mechanisms": programs.select("asset_id").join(best, "asset_id", "left").groupBy(F.coalesce("provenance", F.lit("none")).alias("label")).agg(F.count_distinct("asset_id").alias("value")),
        "populations": chart(views.population_landscape(t).where(here), "term_id", F.sum("n_trials"), top=12),
        "start_years": chart(trials.withColumn("year", F.year("start_date_parsed")), "year"),
        "more": more.unpivot([], ["lead_companies", "program_trial_rows"], "label", "value"),
        "active_phases": chart(programs.withColumn("p", _phase("max_phase_active", "no active trial")), "p"),
        "active_sponsors": chart(sponsors, "company_name", F.sum("n_active_trials"), top=10),
        "drug_start_years": _years(drug),
        "sponsor_phases": _cells(drug, "lead_company_id", top),
    }, figures)


#: Columns of the matrix: all phases, not applicable, and none or any other.
MATRIX_PHASES = [*views.PHASES, "NA", views.UNKNOWN]


def sponsor_phase_matrix(t: Tables, condition: str | None = None) -> DataFrame:
    """Trials by lead company and phase; every trial is counted in one cell."""
    trials = views.trials(t).where("lead_company_id IS NOT NULL")
    if condition is not None:
        trials = trials.join(views.trial_conditions_primary(t).where(F.col("condition_key") == condition).select("nct_id"), "nct_id", "left_semi")
    known = F.when(F.col("phase_norm").isin(MATRIX_PHASES), F.col("phase_norm")).otherwise(views.UNKNOWN)
    return matrix(trials.withColumn("phase_norm", known), "lead_company_id", "phase_norm", MATRIX_PHASES, F.count(F.lit(1)))


def asset_landscape(t: Tables, asset: str, figures: Sequence[str] | None = None) -> DataFrame:
    """figure, label, value: trials by condition and role, sponsors, mechanisms, partners, headline, populations, start years, leading
    conditions by phase.  figures: those wanted, None for all."""
    here = F.col("asset_id") == asset
    programs = views.programs(t).where(here)
    head = programs.agg(F.count("*").alias("conditions"), F.count_if(F.col("max_phase_active").isNotNull()).alias("active_conditions"), F.max("max_phase_ever").alias("max_phase_ever"), F.max("max_phase_active").alias("max_phase_active"))
    head = head.select([F.col(c).cast("double").alias(c) for c in head.columns])
    used = t["trial_assets"].where(here)
    own = used.select("nct_id").distinct()
    developed = used.where(F.col("role").isin(views.DEVELOPING)).select("nct_id").distinct().join(views.trials(t).where("study_type = 'INTERVENTIONAL'"), "nct_id")
    top = programs.orderBy(F.desc("n_trials"), "condition_key").limit(8).select("condition_key")
    parts = {
        "conditions": chart(views.programs(t).where(here), "condition_key", F.sum("n_trials")),
        "roles": chart(t["trial_assets"].where(here), "role", F.count_distinct("nct_id")),
        "mechanisms": chart(views.moa(t).where(here), "moa_label"),
        "sponsors": chart(views.asset_sponsors(t).where(here), "company_name", F.sum("n_trials"), top=10),
        "partners": chart(views.combo_partners(t).where(here), "partner_asset_id", F.count_distinct("nct_id"), top=10),
        "headline": head.unpivot([], head.columns, "label", "value"),
        "populations": _mentioned(t["population_mentions"].join(own, "nct_id")),
        "start_years": _years(views.trials(t).join(own, "nct_id")),
        "condition_phases": _cells(developed.join(views.surface(t), "nct_id"), "condition_key", top),
    }
    return _figures(parts, figures)


def company_landscape(t: Tables, company: str, figures: Sequence[str] | None = None) -> DataFrame:
    """figure, label, value: trials by area, phase, status, condition, headline, active trials by area, phases and start years of drug
    trials, leading conditions by phase.  figures: those wanted, None for all."""
    own = views.trials(t).where(F.col("lead_company_id") == company)
    drug = own.where("study_type = 'INTERVENTIONAL' AND is_drug_trial")
    led = views.sponsor_condition(t).where(F.col("company_id") == company)
    names = {"drug_trials": "n_trials", "active_trials": "n_active_trials", "phase3_plus": "n_phase3_plus"}
    head = led.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in names.items()], F.count_distinct("condition_key").alias("conditions"))
    top = led.groupBy("condition_key").agg(F.sum("n_trials").alias("n")).orderBy(F.desc("n"), "condition_key").limit(8).select("condition_key")
    parts = {
        "areas": chart(views.sponsor_activity(t).where(F.col("company_id") == company), "area", F.sum("n_trials")),
        "phases": chart(own, "phase_norm"),
        "statuses": chart(own, "overall_status"),
        "conditions": chart(views.sponsor_condition(t).where(F.col("company_id") == company), "condition_key", F.sum("n_trials"), top=10),
        "headline": head.unpivot([], head.columns, "label", "value"),
        "active_areas": chart(views.sponsor_activity(t).where(F.col("company_id") == company), "area", F.sum("n_active_trials"), top=10),
        "drug_phases": chart(drug, "phase_norm"),
        "drug_start_years": _years(drug),
        "condition_phases": _cells(drug.join(views.surface(t), "nct_id"), "condition_key", top),
    }
    return _figures(parts, figures)


def funnel_steps(t: Tables) -> DataFrame:
    """key, value: how many studies, assets and labels are left after each step, and percentages (half to even)."""
    drug = (F.col("study_type") == "INTERVENTIONAL") & F.col("is_drug_trial")
    spine = views.trials(t).agg(
        F.count("*").alias("studies"), F.count_if(F.col("study_type") == "INTERVENTIONAL").alias("interventional"), F.count_if(drug).alias("drug"),
        F.count_if(drug & F.col("is_industry")).alias("industry"), F.count_if(drug & F.col("is_industry") & F.col("program_exists")).alias("in_scope"))
    mesh = views.trial_conditions_primary(t).agg(F.count_distinct(F.when(F.col("source") == "mesh_leaf", F.col("nct_id"))).alias("with_mesh"))
    roles = t["trial_assets"].select("nct_id", "asset_id", "role").distinct().agg(F.count("*").alias("trial_assets"), F.count_if(F.col("role") != "unknown").alias("decided"))
    found = t["assets"].agg(F.count_if(~F.col("is_combo")).alias("assets"), F.count_if("is_combo").alias("combos"))
    labeled = views.moa(t).agg(F.count_distinct("asset_id").alias("labeled"))
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [spine, mesh, roles, found, labeled])  # five single rows
    one = one.withColumns({
        "pct_with_mesh": percent(F.col("with_mesh"), F.col("studies")), "pct_decided": percent(F.col("decided"), F.col("trial_assets")),
        "pct_labeled": percent(F.col("labeled"), F.col("assets") + F.col("combos")),
    })
    return one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "key", "value")


def _counts(rows: DataFrame, prefix: str, name: str, value: Column) -> DataFrame:
    return rows.groupBy(F.concat(F.lit(f"{prefix}:"), F.col(name)).alias("key")).agg(value.cast("double").alias("value"))


def funnel(t: Tables) -> DataFrame:
    """key, value: the steps; what is left within the scope (industry, interventional, drug), mechanisms by tier, and censuses, one key a
    reason, role or kind (`gate:`, `denoise:`, `role:`, `pct_population:`).  Keys of tables that are not there are left out."""
    spine, assigned = views.trials(t), t["trial_assets"]
    drug = (F.col("study_type") == "INTERVENTIONAL") & F.col("is_drug_trial")
    flags = spine.agg(F.count_if("is_drug_trial").alias("drug_any_type"), F.count_if("is_industry").alias("industry_any_type"), F.count_if(drug).alias("_drug"), F.count("*").alias("_studies"))
    named = F.col("via") == "name"
    labels = views.moa(t).select("asset_id").distinct().withColumn("_moa", F.lit(True))
    scoped = assigned.where(F.col("role").isin(views.DEVELOPING)).join(spine.where(drug & F.col("is_industry")).select("nct_id"), "nct_id").join(labels, "asset_id", "left").agg(
        F.count_if(named).alias("in_scope_trial_asset_rows"), F.count_if(named & F.col("_moa")).alias("in_scope_trial_asset_rows_with_moa"),
        F.count_distinct("asset_id").alias("in_scope_assets"), F.count_distinct(F.when(F.col("_moa"), F.col("asset_id"))).alias("in_scope_assets_with_moa"))
    inputs = t["interventions"].where(F.col("type").isin(views.DRUG_TYPES)).select("nct_id", "intervention_no")
    keyed = inputs.join(assigned.where(named).select("nct_id", "intervention_no").distinct(), ["nct_id", "intervention_no"], "left_semi")
    singles = [
        flags, scoped, inputs.agg(F.count("*").alias("interventions_drug")), keyed.agg(F.count("*").alias("interventions_keyed")),
        views.trial_conditions_primary(t).agg(F.count_distinct(F.when(F.col("source") == "listed", F.col("nct_id"))).alias("listed_only")),
        spine.where(drug).join(t["arms"].select("nct_id").distinct(), "nct_id", "left_semi").agg(F.count("*").alias("drug_with_arms")),
        t["chembl_moa"].agg(F.count_distinct("asset_id").alias("moa_assets_chembl")), t["asset_curated_moa"].agg(F.count_distinct("asset_id").alias("moa_assets_curated")),
        t["asset_nlm_classes"].agg(F.count_distinct("asset_id").alias("moa_assets_nlm_class")),
        t["asset_enrichment"].agg(F.count_if(~F.col("abstained")).alias("moa_assets_llm"), F.count_if("abstained").alias("moa_assets_llm_abstained")),
        t["build_meta"].where("key = 'snapshot_date'").agg(F.max(F.date_format(F.col("value").cast("date"), "yyyyMMdd").cast("double")).alias("snapshot_date")),
    ]
    if "contested_aliases" in t:
        singles.append(t["contested_aliases"].agg(F.count_if(F.col("resolution") == "vetoed").alias("contested_aliases"), F.count_if(F.col("resolution").startswith("dominance:")).alias("alias_dominance")))
    if "gate_census" in t:
        singles.append(t["gate_census"].agg(F.coalesce(F.sum(F.when(~F.col("reason").startswith("route_"), F.col("n"))), F.lit(0)).alias("interventions_gated")))
    if "ingest_failures" in t:
        singles.append(t["ingest_failures"].agg(F.count("*").alias("parse_failures")))
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), singles).withColumns({
        "pct_in_scope_rows_labeled": percent(F.col("in_scope_trial_asset_rows_with_moa"), F.col("in_scope_trial_asset_rows")),
        "pct_in_scope_assets_labeled": percent(F.col("in_scope_assets_with_moa"), F.col("in_scope_assets")),
        "pct_interventions_keyed": percent(F.col("interventions_keyed"), F.col("interventions_drug")),
        "pct_drug_with_arms": percent(F.col("drug_with_arms"), F.col("_drug")),
    })
    shown = [c for c in one.columns if not c.startswith("_")]
    kinds = t["population_mentions"].select("nct_id", "kind").distinct().join(F.broadcast(flags.select("_studies")), F.lit(True))
    parts = [
        funnel_steps(t), one.select([F.col(c).cast("double").alias(c) for c in shown]).unpivot([], shown, "key", "value"),
        _counts(assigned.select("nct_id", "asset_id", "role").distinct(), "role", "role", F.count("*")),
        _counts(kinds, "pct_population", "kind", percent(F.count("*"), F.max("_studies"))),
    ]
    if "gate_census" in t:
        parts.append(_counts(t["gate_census"].where("NOT startswith(reason, 'route_')"), "gate", "reason", F.sum("n")))
    if "condition_denoised" in t:
        parts.append(_counts(t["condition_denoised"], "denoise", "reason", F.count("*")))
    return reduce(DataFrame.union, parts)
