"""The sixteen definition-of-record views.

Each is a function from the registry's tables (a mapping of names to DataFrames) to a DataFrame; a metric is
defined here once, and scope filters live here only.  Views build on each other by calling each other, so Catalyst
sees one plan and pushes filters on keys down to the scans.  Lists come out sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

# fixed values of the registry's vocabulary
PHASES = {"EARLY_PHASE1": 0.5, "PHASE1": 1.0, "PHASE2": 2.0, "PHASE3": 3.0, "PHASE4": 4.0}
DRUG_TYPES = ["DRUG", "BIOLOGICAL", "COMBINATION_PRODUCT", "GENETIC"]
READING_OUT = ["RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION", "ACTIVE_NOT_RECRUITING"]
STOPPED = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
DEVELOPING = ["subject", "unknown"]
UNCLASSIFIED = "Unclassified"
UNKNOWN = "unknown"
SNAPSHOT_MONTHS = 36


def phase_rank(phase: Column) -> Column:
    return reduce(lambda c, kv: c.when(phase == kv[0], F.lit(kv[1])), PHASES.items(), F.when(F.lit(False), F.lit(0.0)))


def n_distinct(key: str, where: Column | None = None) -> Column:
    return F.count_distinct(F.col(key) if where is None else F.when(where, F.col(key)))


def sorted_set(key: str | Column) -> Column:
    return F.array_sort(F.collect_set(key))


def sorted_structs(*fields: Column | str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def trials(t: Tables) -> DataFrame:
    """The study spine: every study with its flags.  The snapshot is one row, so it is broadcast."""
    snapshot = t["build_meta"].where("key = 'snapshot_date'").select(F.col("value").cast("date").alias("snapshot_date"))
    lead = t["trial_sponsors_norm"].where("role = 'lead'").select("nct_id", F.col("company_id").alias("lead_company_id"), F.col("agency_class").alias("lead_agency_class"))
    drug = t["interventions"].where(F.col("type").isin(DRUG_TYPES)).select("nct_id").distinct().withColumn("_drug", F.lit(True))
    status, done = F.col("overall_status"), F.col("completion_date_parsed")
    active = status.isin(READING_OUT)
    recent = done.isNotNull() & (done >= F.add_months("snapshot_date", -SNAPSHOT_MONTHS))
    kept = [c for c in t["studies"].columns if c not in ("official_title", "brief_summary", "eligibility_criteria")]
    return (
        t["studies"].select(*kept)
        .join(F.broadcast(snapshot), F.lit(True), "inner")
        .join(lead, "nct_id", "left").join(drug, "nct_id", "left")
        .withColumns({
            "phase_rank": phase_rank(F.col("phase_norm")),
            "is_drug_trial": F.col("_drug").isNotNull(),
            "is_industry": F.col("lead_agency_class") == "INDUSTRY",
            "is_active_readout": active,
            "program_exists": active | ((status == "COMPLETED") & recent),
            "is_inactive": status.isin(STOPPED),
        }).drop("_drug")
    )


def trial_conditions_primary(t: Tables) -> DataFrame:
    """One surface a trial: its mesh leaves if it has any, else what it lists."""
    c = t["trial_conditions_norm"].select("nct_id", "condition_key", "display_name", "source")
    has_mesh = F.max(F.col("source") == "mesh_leaf").over(Window.partitionBy("nct_id"))
    wanted = F.when(F.col("_mesh"), F.lit("mesh_leaf")).otherwise(F.lit("listed"))
    return c.withColumn("_mesh", has_mesh).where(F.col("source") == wanted).drop("_mesh").distinct()


def surface(t: Tables) -> DataFrame:
    """nct_id, condition_key of the surfaces that count, once each."""
    return trial_conditions_primary(t).select("nct_id", "condition_key").distinct()


def conditions(t: Tables) -> DataFrame:
    areas = t["condition_areas"].groupBy("condition_key").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("late"), "area"))).alias("_areas"))
    drug = (F.col("study_type") == "INTERVENTIONAL") & F.col("is_drug_trial")
    return (
        trial_conditions_primary(t).join(trials(t).select("nct_id", "study_type", "is_drug_trial"), "nct_id").groupBy("condition_key")
        .agg(F.min("source").alias("source"), F.min("display_name").alias("display_name"), n_distinct("nct_id").alias("n_trials"), n_distinct("nct_id", drug).alias("n_drug_trials"))
        .join(areas, "condition_key", "left").withColumn("areas", F.transform("_areas", lambda a: a["area"])).drop("_areas")
    )


def _developed(t: Tables) -> DataFrame:
    """Assets in development, with their trials and conditions: comparators out, unknown roles in.

    One row an (asset, trial, condition), as a role is an asset's in a trial; so trials are counted by plain sums."""
    return (
        t["trial_assets"].where(F.col("role").isin(DEVELOPING)).select("nct_id", "asset_id", "role").distinct()
        .join(trials(t).where("study_type = 'INTERVENTIONAL'"), "nct_id").join(surface(t), "nct_id")
    )


def programs(t: Tables) -> DataFrame:
    """(asset, condition): the most advanced phase, counts, and every trial.

    The lead company of the most advanced trial (ties: the latest update, then the least id) is the minimum of one struct in the same
    aggregate, so there is no ranking pass and no second join."""
    first = F.struct(
        -F.coalesce("phase_rank", F.lit(-1.0)), -F.coalesce(F.datediff("last_update_date_parsed", F.lit("1900-01-01")), F.lit(-(2**31) + 1)),
        "nct_id", F.col("lead_company_id").alias("company"),
    )
    return _developed(t).groupBy("asset_id", "condition_key").agg(
        F.max("phase_rank").alias("max_phase_ever"),
        F.max(F.when(F.col("program_exists"), F.col("phase_rank"))).alias("max_phase_active"),
        F.count("nct_id").alias("n_trials"),
        F.count_if("program_exists").alias("n_active_trials"),
        F.count_if("is_active_readout").alias("n_active_readout_trials"),
        F.count_if(F.col("role") == "unknown").alias("n_unknown_role_trials"),
        F.count_if("is_industry").alias("n_industry_trials"),
        F.max("last_update_date_parsed").alias("latest_activity"),
        F.min(first)["company"].alias("lead_company_of_most_advanced"),
        sorted_set("nct_id").alias("nct_ids"),
    )


def asset_max_phase(t: Tables) -> DataFrame:
    return programs(t).groupBy("asset_id").agg(
        F.max("max_phase_ever").alias("max_phase_ever"), F.max("max_phase_active").alias("max_phase_active"),
        F.sum("n_trials").alias("n_program_trial_rows"), F.count("*").alias("n_conditions"),
    )


def assets(t: Tables) -> DataFrame:
    """The asset catalog; assets without a trial stay with counts of 0."""
    seen = t["trial_assets"].select("nct_id", "asset_id", "role").distinct().join(trials(t).select("nct_id", "is_industry", "study_type", "phase_rank"), "nct_id", "left")
    return t["assets"].join(seen, "asset_id", "left").groupBy("asset_id", "canonical_name", "dedup_key", "is_combo").agg(
        F.count("nct_id").alias("n_trials"),
        F.count_if(F.col("role") == "subject").alias("n_subject_trials"),
        F.count_if(F.col("role") == "comparator").alias("n_comparator_trials"),
        F.count_if(F.col("is_industry") & (F.col("study_type") == "INTERVENTIONAL")).alias("n_industry_interventional_trials"),
        F.max("phase_rank").alias("max_phase_any_role"),
    )


def _sponsored(t: Tables, extra: DataFrame, group: list[str], sums: dict[str, Column], on: str = "nct_id") -> DataFrame:
    """Lead-company counts by group.  A trial is one row a group, and then one a group and asset in development; the first of
    these carries what is counted by trials, so one aggregate has all figures and trials are joined once."""
    spine = trials(t).where("study_type = 'INTERVENTIONAL' AND is_drug_trial").join(t["companies"].select(F.col("company_id").alias("lead_company_id"), F.col("canonical_name").alias("company_name")), "lead_company_id")
    used = t["trial_assets"].where(F.col("role").isin(DEVELOPING)).groupBy(on).agg(F.collect_set("asset_id").alias("_assets"))
    rows = extra.join(spine, on).withColumnsRenamed({"lead_company_id": "company_id", "lead_agency_class": "agency_class"}).join(used, on, "left")
    keys = ["company_id", "company_name", "agency_class", *group]
    one = rows.select(*keys, on, "last_update_date_parsed", *[c.cast("int").alias(n) for n, c in sums.items()], F.posexplode_outer("_assets").alias("_place", "_asset"))
    first = F.coalesce(F.col("_place"), F.lit(0)) == 0
    return one.groupBy(*keys).agg(
        F.count_if(first).alias("n_trials"), *[F.coalesce(F.sum(F.when(first, F.col(n))), F.lit(0)).alias(n) for n in sums],
        F.max("last_update_date_parsed").alias("latest_activity"), sorted_set(on).alias("nct_ids"), n_distinct("_asset").alias("n_assets"))


def sponsor_activity(t: Tables) -> DataFrame:
    areas = trial_conditions_primary(t).join(t["condition_areas"], "condition_key", "left").select(
        "nct_id", F.coalesce("area", F.lit(UNCLASSIFIED)).alias("area"), F.coalesce("is_primary", F.lit(True)).alias("is_primary")).groupBy("nct_id", "area").agg(F.max("is_primary").alias("is_primary"))
    return _sponsored(t, areas, ["area"], {
        "n_active_trials": F.col("program_exists"), "n_active_readout_trials": F.col("is_active_readout"), "n_trials_primary_area": F.col("is_primary"),
        "n_phase3_plus": F.col("phase_rank") >= 3, "n_phase2": F.col("phase_rank") == 2, "n_phase1_or_earlier": F.col("phase_rank") <= 1,
    })


def sponsor_condition(t: Tables) -> DataFrame:
    return _sponsored(t, surface(t), ["condition_key"], {
        "n_active_trials": F.col("program_exists"), "n_active_readout_trials": F.col("is_active_readout"), "n_phase3_plus": F.col("phase_rank") >= 3})


def asset_sponsors(t: Tables) -> DataFrame:
    """Lead sponsors of an asset; the proxy for its originator is the earliest industry one (not ownership)."""
    rows = t["trial_assets"].where(F.col("role").isin(DEVELOPING)).select("nct_id", "asset_id").join(trials(t).where("lead_company_id IS NOT NULL"), "nct_id")
    per = rows.groupBy("asset_id", F.col("lead_company_id").alias("company_id"), F.col("lead_agency_class").alias("agency_class")).agg(
        n_distinct("nct_id").alias("n_trials"), F.min("start_date_parsed").alias("first_start"), F.max("start_date_parsed").alias("last_start"))
    industry = F.col("agency_class") == "INDUSTRY"
    order = Window.partitionBy("asset_id").orderBy(industry.desc_nulls_first(), F.col("first_start").asc_nulls_last(), F.desc("n_trials"), "company_id")
    per = per.withColumn("originator_proxy", industry & (F.col("company_id") == F.first("company_id").over(order)))
    return per.join(t["companies"].select("company_id", F.col("canonical_name").alias("company_name")), "company_id")


def moa(t: Tables) -> DataFrame:
    """Mechanisms from four sources, in order of trust."""
    text, texts = "string", "array<string>"

    def tier(df: DataFrame, n: int, name: str, label: Column, action: Column, targets: Column, modality: Column) -> DataFrame:
        return df.select("asset_id", F.lit(name).alias("provenance"), F.lit(n).alias("tier"), label.cast(text).alias("moa_label"), action.cast(text).alias("action"),
                         targets.cast(texts).alias("targets"), modality.cast(text).alias("modality"), "moa_key")

    none, c = F.lit(None), F.col
    found = c("targets_canonical")
    llm = t["asset_enrichment"].where("NOT abstained")
    parts = [
        tier(t["chembl_moa"], 1, "chembl", c("mechanism_of_action"), c("action_type"), c("target_symbols"), none),
        tier(t["asset_curated_moa"], 2, "curated", c("moa_label"), c("action"), c("target_symbols"), c("modality")),
        tier(t["asset_nlm_classes"], 3, "nlm_class", c("class_term"), none, none, none),
        tier(llm, 4, "llm", F.coalesce("moa_class", F.array_join(found, ", ")), c("action"), F.when(F.size(found) > 0, found).otherwise(c("targets_raw")), c("modality")),
    ]
    return reduce(DataFrame.unionByName, parts)


def moa_best(t: Tables) -> DataFrame:
    best = F.min("tier").over(Window.partitionBy("asset_id"))
    return moa(t).withColumn("_best", best).where("tier = _best").drop("_best")


def moa_trials(t: Tables) -> DataFrame:
    spine = trials(t).where("study_type = 'INTERVENTIONAL'").select("nct_id", "phase_norm", "phase_rank", "overall_status", "program_exists", "is_industry", "lead_company_id")
    return (
        moa(t).where("moa_key <> ''").select("moa_key", "provenance", "moa_label", "asset_id").join(t["trial_assets"].select("asset_id", "nct_id", "role"), "asset_id")
        .join(spine, "nct_id").join(surface(t), "nct_id")
    )


def _in_arms(t: Tables) -> DataFrame:
    """Assets of experimental arms, by name: nct_id, arm_no, asset_id, whether the asset is in all arms."""
    named = t["trial_assets"].where("via = 'name'").select("nct_id", "intervention_no", "asset_id", F.coalesce("in_all_arms", F.lit(False)).alias("everywhere"))
    tested = t["arms"].where("type = 'EXPERIMENTAL'").select("nct_id", "arm_no")
    return t["arm_interventions"].select("nct_id", "arm_no", "intervention_no").join(named, ["nct_id", "intervention_no"]).join(tested, ["nct_id", "arm_no"])


def _named_combos(t: Tables) -> DataFrame:
    whole = t["trial_assets"].where((F.col("via") == "name") & F.col("role").isin(DEVELOPING)).select("nct_id", F.col("asset_id").alias("combo_asset_id"), F.coalesce("in_all_arms", F.lit(False)).alias("everywhere"))
    return whole.join(t["asset_components"], "combo_asset_id")


def _in_trials(t: Tables, rows: DataFrame) -> DataFrame:
    spine = trials(t).where("study_type = 'INTERVENTIONAL'").select("nct_id", "phase_norm", "phase_rank", "overall_status", "program_exists", "is_industry")
    return rows.distinct().join(spine, "nct_id").join(surface(t), "nct_id")


def combos(t: Tables) -> DataFrame:
    """Sets of assets given together: two or more in an experimental arm, or named as one product."""
    arm = _in_arms(t).groupBy("nct_id", "arm_no").agg(sorted_set("asset_id").alias("asset_ids"), F.bool_or("everywhere").alias("has_background")).where(F.size("asset_ids") >= 2).withColumn("source", F.lit("arm"))
    named = _named_combos(t).groupBy("nct_id", "combo_asset_id").agg(sorted_set("component_asset_id").alias("asset_ids"), F.bool_or("everywhere").alias("has_background"))
    named = named.select("nct_id", F.lit(-1).cast("int").alias("arm_no"), "asset_ids", "has_background", F.lit("name").alias("source"))
    return _in_trials(t, arm.withColumn("arm_no", F.col("arm_no").cast("int")).unionByName(named))


def combo_partners(t: Tables) -> DataFrame:
    """Ordered pairs of assets studied together.  Pairs that are both in every arm are background and go; pairs with
    a mechanism in common are flagged."""
    one = _in_arms(t).groupBy("nct_id", "arm_no").agg(F.collect_set(F.struct("asset_id", "everywhere")).alias("all")).where(F.size("all") >= 2)
    two = one.select("nct_id", "all", F.explode("all").alias("a")).select("nct_id", "a", F.explode("all").alias("b")).where("a.asset_id <> b.asset_id AND NOT (a.everywhere AND b.everywhere)")
    arm = two.select("nct_id", "a.asset_id", F.col("b.asset_id").alias("partner_asset_id"), F.lit("arm").alias("source"), (F.col("a.everywhere") | F.col("b.everywhere")).alias("has_background"))
    n = _named_combos(t).where("NOT everywhere")
    other = t["asset_components"].withColumnRenamed("component_asset_id", "partner_asset_id")
    named = n.join(other, "combo_asset_id").where("component_asset_id <> partner_asset_id").select("nct_id", F.col("component_asset_id").alias("asset_id"), "partner_asset_id", F.lit("name").alias("source"), F.col("everywhere").alias("has_background"))
    keys = t["chembl_moa"].where("moa_key IS NOT NULL").groupBy("asset_id").agg(F.collect_set("moa_key").alias("_keys"))
    pairs = _in_trials(t, arm.unionByName(named))
    flagged = pairs.join(keys, "asset_id", "left").join(keys.select(F.col("asset_id").alias("partner_asset_id"), F.col("_keys").alias("_other")), "partner_asset_id", "left")
    return flagged.withColumn("same_mechanism", F.coalesce(F.arrays_overlap("_keys", "_other"), F.lit(False))).drop("_keys", "_other")


def population_landscape(t: Tables) -> DataFrame:
    spine = trials(t).where("study_type = 'INTERVENTIONAL' AND is_drug_trial").select("nct_id", "program_exists")
    rows = t["population_mentions"].select("nct_id", "kind", "term_id").distinct().join(spine, "nct_id").join(surface(t), "nct_id")
    return rows.groupBy("kind", "term_id", "condition_key").agg(
        F.count("*").alias("n_trials"), F.count_if("program_exists").alias("n_active_trials"), sorted_set("nct_id").alias("nct_ids"),
    ).withColumn("example_ncts", F.slice("nct_ids", 1, 10))


def trial_card(t: Tables) -> DataFrame:
    """One wide nested row a study.  Every list is aggregated by itself and joined on the study; arms, whose assets nest two
    levels deep, are aggregated from the inside out."""
    use = t["trial_assets"].join(t["interventions"].select("nct_id", "intervention_no", F.col("name_raw").alias("intervention"), F.col("type").alias("intervention_type")), ["nct_id", "intervention_no"])
    inside = t["arm_interventions"].select("nct_id", "arm_no", "intervention_no").join(use, ["nct_id", "intervention_no"]).groupBy("nct_id", "arm_no").agg(sorted_structs("asset_id", "role", "intervention").alias("assets"))
    arms = t["arms"].join(inside, ["nct_id", "arm_no"], "left").groupBy("nct_id").agg(sorted_structs("arm_no", "label", "type", "description", "assets").alias("arms"))
    named = use.where("via = 'name'").join(t["assets"].select("asset_id", "canonical_name"), "asset_id").groupBy("nct_id").agg(sorted_structs("asset_id", "canonical_name", "role", "in_all_arms", "intervention", "intervention_type").alias("trial_assets"))
    lists = [
        t["sponsors"].groupBy("nct_id").agg(sorted_structs("role", F.col("name_raw").alias("name"), "agency_class").alias("sponsors")),
        t["study_conditions"].groupBy("nct_id").agg(F.transform(sorted_structs("position", "name_raw"), lambda s: s["name_raw"]).alias("conditions_listed")),
        trial_conditions_primary(t).groupBy("nct_id").agg(sorted_structs("condition_key", "display_name", "source").alias("conditions_primary")),
        t["mesh_terms"].where("module = 'condition' AND kind = 'mesh'").groupBy("nct_id").agg(sorted_structs("mesh_id", "term").alias("mesh_conditions")),
        t["population_mentions"].groupBy("nct_id").agg(sorted_structs("term_id", "kind", "surface", F.col("evidence_line").alias("evidence")).alias("population_mentions")),
        arms, named,
    ]
    long = [c for c in ("official_title", "brief_summary", "eligibility_criteria") if c in t["studies"].columns]
    card = trials(t).join(t["studies"].select("nct_id", *long), "nct_id") if long else trials(t)
    card = card.join(t["companies"].select(F.col("company_id").alias("lead_company_id"), F.col("canonical_name").alias("lead_company_name")), "lead_company_id", "left")
    return reduce(lambda df, part: df.join(part, "nct_id", "left"), lists, card).withColumn("ctgov_url", F.concat(F.lit("https://clinicaltrials.gov/study/"), "nct_id"))


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "v_trials": trials, "v_trial_conditions_primary": trial_conditions_primary, "v_conditions": conditions, "v_programs": programs,
    "v_asset_max_phase": asset_max_phase, "v_assets": assets, "v_sponsor_activity": sponsor_activity, "v_sponsor_condition": sponsor_condition,
    "v_asset_sponsors": asset_sponsors, "v_moa": moa, "v_moa_best": moa_best, "v_moa_trials": moa_trials, "v_combos": combos,
    "v_combo_partners": combo_partners, "v_population_landscape": population_landscape, "v_trial_card": trial_card,
}


def apply_views(t: Tables) -> dict[str, DataFrame]:
    """Register every view; a view without a row means a broken definition and fails the build."""
    made = {name: view(t) for name, view in VIEWS.items()}
    empty = [name for name, df in made.items() if df.isEmpty()]
    if empty:
        raise RuntimeError(f"views without rows: {', '.join(empty)}")
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return made
