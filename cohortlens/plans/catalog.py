"""Queries on the order tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .analogue import REGISTRY_SQL, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, registry_sql: bool = True):
    """Register a query and its SQL (after the registry's tables as common table expressions, if they are used)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = REGISTRY_SQL + sql if registry_sql else sql
        return f

    return add


def joined(c: str | Column) -> Column:
    """A list as text."""
    return F.array_join(c, ",")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


@query("trial_spine", """
SELECT nct_id, study_type, overall_status, phase_norm, phase_rank, is_drug_trial, is_industry, lead_company_id, is_active_readout, program_exists, is_inactive,
       strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date FROM spine""")  # fmt: skip
def trial_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trials(registry(spark, sf_dir))
    return t.select("nct_id", "study_type", "overall_status", "phase_norm", "phase_rank", "is_drug_trial", "is_industry", "lead_company_id", "is_active_readout", "program_exists", "is_inactive", day("snapshot_date").alias("snapshot_date"))


@query("primary_surface", "SELECT * FROM cond")
def primary_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trial_conditions_primary(registry(spark, sf_dir))


@query("condition_catalog", """
SELECT c.condition_key, min(c.source) AS source, min(c.display_name) AS display_name, count(DISTINCT c.nct_id) AS n_trials,
       count(DISTINCT c.nct_id) FILTER (s.study_type = 'INTERVENTIONAL' AND s.is_drug_trial) AS n_drug_trials,
       (SELECT string_agg(a.area, ',' ORDER BY NOT is_primary, a.area) FROM area a WHERE a.condition_key = c.condition_key) AS areas
FROM cond c JOIN spine s ON s.nct_id = c.nct_id GROUP BY c.condition_key""")  # fmt: skip
def condition_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.conditions(registry(spark, sf_dir)).withColumn("areas", joined("areas"))


@query("programs", """
SELECT asset_id, condition_key, max(phase_rank) AS max_phase_ever, max(phase_rank) FILTER (program_exists) AS max_phase_active, count(DISTINCT nct_id) AS n_trials,
       count(DISTINCT nct_id) FILTER (program_exists) AS n_active_trials, count(DISTINCT nct_id) FILTER (is_active_readout) AS n_active_readout_trials,
       count(DISTINCT nct_id) FILTER (role = 'unknown') AS n_unknown_role_trials, count(DISTINCT nct_id) FILTER (is_industry) AS n_industry_trials,
       strftime(max(updated), '%Y-%m-%d') AS latest_activity,
       list(lead_company_id ORDER BY phase_rank DESC NULLS LAST, updated DESC NULLS LAST, nct_id)[1] AS lead_company_of_most_advanced,
       string_agg(DISTINCT nct_id, ',' ORDER BY nct_id) AS nct_ids
FROM dev GROUP BY ALL""")  # fmt: skip
def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.programs(registry(spark, sf_dir)).withColumns({"latest_activity": day("latest_activity"), "nct_ids": joined("nct_ids")})


@query("asset_max_phase", """
SELECT asset_id, max(e) AS max_phase_ever, max(a) AS max_phase_active, CAST(sum(n) AS BIGINT) AS n_program_trial_rows, count(*) AS n_conditions
FROM (SELECT asset_id, condition_key, max(phase_rank) AS e, max(phase_rank) FILTER (program_exists) AS a, count(DISTINCT nct_id) AS n FROM dev GROUP BY ALL) GROUP BY asset_id""")  # fmt: skip
def asset_max_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.asset_max_phase(registry(spark, sf_dir))


@query("asset_catalog", """
SELECT a.asset_id, upper(a.asset_id) AS canonical_name, a.is_combo, count(DISTINCT u.nct_id) AS n_trials, count(DISTINCT u.nct_id) FILTER (u.role = 'subject') AS n_subject_trials,
       count(DISTINCT u.nct_id) FILTER (u.role = 'comparator') AS n_comparator_trials,
       count(DISTINCT u.nct_id) FILTER (s.is_industry AND s.study_type = 'INTERVENTIONAL') AS n_industry_interventional_trials, max(s.phase_rank) AS max_phase_any_role
FROM asset a LEFT JOIN uses u ON u.asset_id = a.asset_id LEFT JOIN spine s ON s.nct_id = u.nct_id GROUP BY ALL""")  # fmt: skip
def asset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.assets(registry(spark, sf_dir)).drop("dedup_key")


@query("sponsor_area_activity", """
SELECT s.lead_company_id AS company_id, s.lead_company_name AS company_name, s.lead_agency_class AS agency_class, coalesce(a.area, 'Unclassified') AS area,
       count(DISTINCT s.nct_id) AS n_trials, count(DISTINCT s.nct_id) FILTER (s.program_exists) AS n_active_trials, count(DISTINCT s.nct_id) FILTER (s.is_active_readout) AS n_active_readout_trials,
       count(DISTINCT s.nct_id) FILTER (coalesce(a.is_primary, TRUE)) AS n_trials_primary_area, count(DISTINCT u.asset_id) FILTER (u.role <> 'comparator') AS n_assets,
       count(DISTINCT s.nct_id) FILTER (s.phase_rank >= 3) AS n_phase3_plus, count(DISTINCT s.nct_id) FILTER (s.phase_rank = 2) AS n_phase2, count(DISTINCT s.nct_id) FILTER (s.phase_rank <= 1) AS n_phase1_or_earlier,
       strftime(max(s.updated), '%Y-%m-%d') AS latest_activity, string_agg(DISTINCT s.nct_id, ',' ORDER BY s.nct_id) AS nct_ids
FROM sponsored s JOIN cond c ON c.nct_id = s.nct_id LEFT JOIN area a ON a.condition_key = c.condition_key LEFT JOIN uses u ON u.nct_id = s.nct_id GROUP BY 1, 2, 3, 4""")  # fmt: skip
def sponsor_area_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sponsor_activity(registry(spark, sf_dir)).withColumns({"latest_activity": day("latest_activity"), "nct_ids": joined("nct_ids")})


@query("sponsor_condition", """
SELECT s.lead_company_id AS company_id, s.lead_company_name AS company_name, s.lead_agency_class AS agency_class, c.condition_key,
       count(DISTINCT s.nct_id) AS n_trials, count(DISTINCT s.nct_id) FILTER (s.program_exists) AS n_active_trials, count(DISTINCT s.nct_id) FILTER (s.is_active_readout) AS n_active_readout_trials,
       count(DISTINCT u.asset_id) FILTER (u.role <> 'comparator') AS n_assets, count(DISTINCT s.nct_id) FILTER (s.phase_rank >= 3) AS n_phase3_plus,
       strftime(max(s.updated), '%Y-%m-%d') AS latest_activity, string_agg(DISTINCT s.nct_id, ',' ORDER BY s.nct_id) AS nct_ids
FROM sponsored s JOIN cond c ON c.nct_id = s.nct_id LEFT JOIN uses u ON u.nct_id = s.nct_id GROUP BY 1, 2, 3, 4""")  # fmt: skip
def sponsor_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sponsor_condition(registry(spark, sf_dir)).withColumns({"latest_activity": day("latest_activity"), "nct_ids": joined("nct_ids")})


@query("originator_proxy", """
SELECT asset_id, company_id, company_name, agency_class, n_trials, strftime(a, '%Y-%m-%d') AS first_start, strftime(b, '%Y-%m-%d') AS last_start,
       agency_class = 'INDUSTRY' AND company_id = first_value(company_id) OVER (PARTITION BY asset_id ORDER BY agency_class = 'INDUSTRY' DESC, a NULLS LAST, n_trials DESC, company_id) AS originator_proxy
FROM (SELECT u.asset_id, s.lead_company_id AS company_id, s.lead_company_name AS company_name, s.lead_agency_class AS agency_class, count(DISTINCT u.nct_id) AS n_trials, min(s.started) AS a, max(s.started) AS b
      FROM uses u JOIN spine s ON s.nct_id = u.nct_id WHERE u.role <> 'comparator' AND s.lead_company_id IS NOT NULL GROUP BY ALL)""")  # fmt: skip
def originator_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.asset_sponsors(registry(spark, sf_dir)).withColumns({"first_start": day("first_start"), "last_start": day("last_start")})


@query("tier_waterfall", "SELECT asset_id, provenance, tier, moa_label, action, targets, modality, moa_key FROM moa")
def tier_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.moa(registry(spark, sf_dir)).withColumn("targets", joined("targets"))


@query("best_tier", "SELECT m.asset_id, provenance, m.tier, moa_label, action, targets, modality, moa_key FROM moa m JOIN (SELECT asset_id, min(tier) AS tier FROM moa GROUP BY asset_id) b ON b.asset_id = m.asset_id AND b.tier = m.tier")
def best_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.moa_best(registry(spark, sf_dir)).withColumn("targets", joined("targets"))


@query("tier_trials", """
SELECT m.moa_key, m.provenance, m.moa_label, u.asset_id, c.condition_key, u.nct_id, u.role, s.phase_norm, s.phase_rank, s.overall_status, s.program_exists, s.is_industry, s.lead_company_id
FROM moa m JOIN uses u ON u.asset_id = m.asset_id JOIN spine s ON s.nct_id = u.nct_id JOIN cond c ON c.nct_id = u.nct_id WHERE s.study_type = 'INTERVENTIONAL' AND m.moa_key <> ''""")  # fmt: skip
def tier_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.moa_trials(registry(spark, sf_dir))


COMBOS_SQL = """, combo AS (
  SELECT nct_id, arm_no, string_agg(DISTINCT asset_id, ',' ORDER BY asset_id) AS asset_ids, 'arm' AS source, bool_or(coalesce(in_all_arms, FALSE)) AS has_background
  FROM uses WHERE flag = 'A' GROUP BY nct_id, arm_no HAVING count(DISTINCT asset_id) > 1
  UNION ALL
  SELECT u.nct_id, -1, string_agg(DISTINCT k.asset_id, ',' ORDER BY k.asset_id), 'name', bool_or(coalesce(u.in_all_arms, FALSE)) FROM uses u JOIN component k ON k.combo = u.asset_id
  WHERE u.role <> 'comparator' GROUP BY u.nct_id, u.asset_id
)"""


@query("combos_arm_level", COMBOS_SQL + """
SELECT DISTINCT x.nct_id, c.condition_key, x.asset_ids, x.source, x.has_background, x.arm_no, s.phase_norm, s.phase_rank, s.overall_status, s.program_exists, s.is_industry
FROM combo x JOIN spine s ON s.nct_id = x.nct_id JOIN cond c ON c.nct_id = x.nct_id WHERE s.study_type = 'INTERVENTIONAL'""")  # fmt: skip
def combos_arm_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.combos(registry(spark, sf_dir)).withColumn("asset_ids", joined("asset_ids"))


PARTNERS_SQL = """, pair AS (
  SELECT a.nct_id, a.asset_id, b.asset_id AS partner_asset_id, 'arm' AS source, coalesce(a.in_all_arms, FALSE) OR coalesce(b.in_all_arms, FALSE) AS has_background
  FROM uses a JOIN uses b ON b.nct_id = a.nct_id AND b.arm_no = a.arm_no AND b.asset_id <> a.asset_id WHERE a.flag = 'A' AND NOT (coalesce(a.in_all_arms, FALSE) AND coalesce(b.in_all_arms, FALSE))
  UNION
  SELECT u.nct_id, x.asset_id, y.asset_id, 'name', FALSE FROM uses u JOIN component x ON x.combo = u.asset_id JOIN component y ON y.combo = u.asset_id AND y.asset_id <> x.asset_id
  WHERE u.role <> 'comparator' AND NOT coalesce(u.in_all_arms, FALSE)
), partner AS (
  SELECT DISTINCT p.nct_id, c.condition_key, p.asset_id, p.partner_asset_id, p.source, p.has_background,
         EXISTS (SELECT 1 FROM chembl m JOIN chembl n ON n.moa_key = m.moa_key WHERE m.asset_id = p.asset_id AND n.asset_id = p.partner_asset_id) AS same_mechanism,
         s.phase_norm, s.phase_rank, s.overall_status, s.program_exists, s.is_industry
  FROM pair p JOIN spine s ON s.nct_id = p.nct_id JOIN cond c ON c.nct_id = p.nct_id WHERE s.study_type = 'INTERVENTIONAL'
)"""


@query("combo_partners", PARTNERS_SQL + " SELECT * FROM partner")
def combo_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.combo_partners(registry(spark, sf_dir))


@query("partners_by_asset", PARTNERS_SQL + """
SELECT partner_asset_id, count(DISTINCT nct_id) AS n_trials, max(phase_rank) AS max_phase FROM partner WHERE asset_id = 'brand3x1' GROUP BY 1 ORDER BY n_trials DESC, 1 LIMIT 10""")  # fmt: skip
def partners_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.combo_partners(registry(spark, sf_dir)).where("asset_id = 'brand3x1'").groupBy("partner_asset_id")
    return p.agg(F.count_distinct("nct_id").alias("n_trials"), F.max("phase_rank").alias("max_phase")).orderBy(F.desc("n_trials"), "partner_asset_id").limit(10)


@query("partners_excluding_same_class", PARTNERS_SQL + """
SELECT m.moa_key, p.partner_asset_id, count(DISTINCT p.nct_id) AS n_trials FROM partner p JOIN chembl m ON m.asset_id = p.asset_id WHERE NOT p.same_mechanism GROUP BY ALL""")  # fmt: skip
def partners_excluding_same_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    keys = t["chembl_moa"].select("asset_id", "moa_key").distinct()
    return views.combo_partners(t).where("NOT same_mechanism").join(keys, "asset_id").groupBy("moa_key", "partner_asset_id").agg(F.count_distinct("nct_id").alias("n_trials"))


@query("population_landscape", """
SELECT m.kind, m.term_id, c.condition_key, count(DISTINCT m.nct_id) AS n_trials, count(DISTINCT m.nct_id) FILTER (s.program_exists) AS n_active_trials,
       string_agg(DISTINCT m.nct_id, ',' ORDER BY m.nct_id) AS nct_ids, array_to_string(list_sort(list(DISTINCT m.nct_id))[1:10], ',') AS example_ncts
FROM mention m JOIN spine s ON s.nct_id = m.nct_id JOIN cond c ON c.nct_id = m.nct_id WHERE s.study_type = 'INTERVENTIONAL' AND s.is_drug_trial GROUP BY ALL""")  # fmt: skip
def population_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.population_landscape(registry(spark, sf_dir)).withColumns({"nct_ids": joined("nct_ids"), "example_ncts": joined("example_ncts")})


@query("trial_card", """
, inside AS (
  SELECT u.nct_id, u.arm_no, any_value(u.flag) AS flag, string_agg(u.asset_id || '/' || u.role || '/' || u.p_name, '+' ORDER BY u.asset_id, u.role, u.p_name) AS assets FROM uses u GROUP BY u.nct_id, u.arm_no
)
SELECT s.nct_id, s.lead_company_name, s.phase_rank, s.program_exists,
       (SELECT string_agg(arm_no || ':' || flag || ':' || assets, ';' ORDER BY arm_no) FROM inside i WHERE i.nct_id = s.nct_id) AS arms,
       (SELECT string_agg(asset_id || '/' || role || '/' || coalesce(in_all_arms::VARCHAR, '-'), ';' ORDER BY asset_id, role, in_all_arms NULLS FIRST) FROM uses u WHERE u.nct_id = s.nct_id) AS trial_assets,
       (SELECT string_agg(condition_key || '/' || source, ';' ORDER BY condition_key) FROM cond c WHERE c.nct_id = s.nct_id) AS conditions_primary,
       (SELECT string_agg(p_brand, ';' ORDER BY no, p_brand) FROM lines l WHERE l.nct_id = s.nct_id) AS conditions_listed,
       (SELECT string_agg(term_id || '/' || kind || '/' || evidence, ';' ORDER BY term_id, kind, evidence) FROM mention m WHERE m.nct_id = s.nct_id) AS population_mentions
FROM spine s""")  # fmt: skip
def trial_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = views.trial_card(registry(spark, sf_dir))
    text = lambda c, f, sep=";": F.array_join(F.transform(c, f), sep)
    slash = lambda *cs: F.concat_ws("/", *cs)
    arm = lambda a: F.concat_ws(":", a["arm_no"].cast("string"), a["label"], text(a["assets"], lambda x: slash(x["asset_id"], x["role"], x["intervention"]), "+"))
    return card.select(
        "nct_id", "lead_company_name", "phase_rank", "program_exists", text("arms", arm).alias("arms"),
        text("trial_assets", lambda x: slash(x["asset_id"], x["role"], F.coalesce(x["in_all_arms"].cast("string"), F.lit("-")))).alias("trial_assets"),
        text("conditions_primary", lambda x: slash(x["condition_key"], x["source"])).alias("conditions_primary"), F.array_join("conditions_listed", ";").alias("conditions_listed"),
        text("population_mentions", lambda x: slash(x["term_id"], x["kind"], x["evidence"])).alias("population_mentions"),
    )


@query("arm_roles", "SELECT nct_id, no AS intervention_no, asset_id, 'name' AS via, role, in_all_arms FROM uses")
def arm_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir)["trial_assets"]


from . import catalog2, catalog3  # noqa: E402, F401  (register the rest)
