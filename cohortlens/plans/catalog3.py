"""Queries of the text rules, serving calls and document parsing on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import folds, names, scalars
from cohortlens.functions.lexicon import Lexicon
from cohortlens.operators import facets
from cohortlens.sources import registry as documents

from . import resolve, serving, views
from .analogue import registry
from .catalog import joined, query
from .catalog2 import table

#: Word lists of these queries; a deployment reads its own from a folder.
WORDS = Lexicon(
    noise_exact=["standard of care"], noise_starts=["placebo"], salts=["hydrochloride", "sodium"], dose_forms=["injection", "tablets"], cations=["sodium"], qualifiers=["oral", "high dose"],
    legal_forms=["inc", "ltd"], industry_words=["pharmaceuticals"], parent_patterns=[r"^(.+?),\s+an?\s+(.+?)\s+(?:company|group|subsidiary)$"],
)


def _cases(key: str, *texts):
    """One of the texts for each row, in turn."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        out = F.when(F.col(key) % len(texts) == k, text).otherwise(out)
    return out


@query("folded_conditions", r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[\s•*·.>]+', ''), chr(39) || 's\b', '', 'g'), '(\s*(\([^()]*\)|\[[^\[\]]*\])\s*)+$', ''), '[^\w\s]', ' ', 'g')), '\s+'),
         lambda w: w NOT IN ('', 'the', 'of', 'and', 'with', 'due', 'to', 'a', 'an', 'in', 'for', 'or')), ' ') AS folded
FROM (SELECT p_partkey, regexp_replace(replace(lower(strip_accents(CASE p_partkey % 4 WHEN 0 THEN '• The ' || p_name || ' (' || p_type || ') [x]' WHEN 1 THEN p_name || '’s Disease of the ' || p_type WHEN 2 THEN 'Ménière—' || p_name || ', due to ' || p_brand ELSE '  ' || upper(p_name) || '/' || p_brand END)), '’', chr(39)), '[‐‑‒–—―-]', ' ', 'g') AS s FROM part)""", registry_sql=False)  # fmt: skip
def folded_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _cases("p_partkey", F.concat(F.lit("• The "), "p_name", F.lit(" ("), "p_type", F.lit(") [x]")), F.concat("p_name", F.lit("’s Disease of the "), "p_type"), F.concat(F.lit("Ménière—"), "p_name", F.lit(", due to "), "p_brand"), F.concat(F.lit("  "), F.upper("p_name"), F.lit("/"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", folds.fold_condition(text).alias("folded"))


DENOISED = [
    ("healthy volunteers", "healthy_volunteers"), ("quality life", "behavior_qol_only"), ("quality life cancer", None), ("egfr mutation", "lab_biomarker_only"), ("d012345", "mesh_id_artifact"), ("ms", "too_short"), ("asthma", None),
    ("central venous catheter", "device_procedure_only"), ("catheter infection", None), ("screening", "device_procedure_only"), ("her2 positive", "lab_biomarker_only"), ("sleep apnoea awareness", None),
]


@query("denoised_conditions", "SELECT p_partkey, r.text, r.reason FROM part JOIN (VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if r is None else repr(r)})" for i, (t, r) in enumerate(DENOISED)) + f") r(i, text, reason) ON p_partkey % {len(DENOISED)} = r.i", registry_sql=False)
def denoised_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is given one of a few folded texts; the SQL holds the reason expected of each."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _cases("p_partkey", *[F.lit(t) for t, _ in DENOISED]).alias("text"))
    return rows.withColumn("reason", folds.denoise_reason(F.col("text")))


@query("mechanism_keys", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cd' || p_size WHEN 1 THEN array_to_string(list_sort(list_distinct(['jak' || p_size, 'jak' || (p_size % 7)])), '|') WHEN 2 THEN array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: w <> 'small'))), '|') ELSE 'antithrombin' || '|' || 'x' || p_size END AS moa_key FROM part""", registry_sql=False)  # fmt: skip
def mechanism_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = _cases("p_partkey", F.concat(F.lit("Anti-CD"), size, F.lit(" monoclonal antibody")), F.concat(F.lit("JAK"), size, F.lit("/"), (F.col("p_size") % 7).cast("string"), F.lit(" inhibitors")), F.concat("p_name", F.lit(" receptor agonist")), F.concat(F.lit("(X"), size, F.lit(") and antithrombin kinase inhibitor")))
    return table(spark, sf_dir, "part").select("p_partkey", folds.mechanism_key(text).alias("moa_key"))


@query("routed_names", """
, n AS (SELECT DISTINCT nct_id, no, p_name, p_size, regexp_replace(p_name, '[^a-z0-9]', '', 'g') AS k FROM lines)
SELECT nct_id, no AS intervention_no, CASE no % 8 WHEN 3 THEN least(k, 'zulin' || p_size) || '+' || greatest(k, 'zulin' || p_size) WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE k END AS key,
       CASE no % 8 WHEN 5 THEN 'placebo_sham_prefix' WHEN 7 THEN 'either_or_arm' END AS reason, no % 8 = 3 AS is_combo FROM n""")  # fmt: skip
def routed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line's part name in one of eight dresses, routed to a key; texts are routed once each and joined back."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    raw = _cases(
        "intervention_no", F.concat(F.lit("Drug: "), n, F.lit(" 200 mg")), F.concat(n, F.lit(" 0.75mg/kg once daily")), F.concat(F.lit("Experimental: Oral "), n, F.lit(" (MK-3475)")), F.concat(n, F.lit(" in combination with zulin"), size),
        F.concat(n, F.lit(" or matching placebo")), F.concat(F.lit("Placebo for "), n), F.concat(n, F.lit(" hydrochloride tablets 5 mg")), F.concat(n, F.lit(" or zulin"), size),
    )
    lines = registry(spark, sf_dir)["lines"].select("nct_id", "intervention_no", raw.alias("name_raw"))
    found = names.routed(lines, WORDS).select("name_raw", "key", "reason", "is_combo")
    return lines.join(found, "name_raw").select("nct_id", "intervention_no", "key", "reason", "is_combo")


@query("company_keys", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'parent ' || c_nationkey ELSE lower(c_name) END AS company_id FROM customer""", registry_sql=False)  # fmt: skip
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with legal forms, industry words and declared parents, folded once for each distinct name."""
    raw = _cases("c_custkey", F.concat("c_name", F.lit(" Pharmaceuticals, Inc.")), F.concat(F.upper("c_name"), F.lit(" Ltd (formerly X)")), F.concat("c_name", F.lit(", a Parent "), F.col("c_nationkey").cast("string"), F.lit(" Company")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("name_raw"))
    return folds.applied(rows, "name_raw", "company_id", folds.Companies(WORDS).key).select("c_custkey", "company_id")


@query("scalar_rules", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS coarsest, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type, p_name AS name,
       p_brand || '|' || CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort(string_split(p_name, ' ')), ',') ELSE p_type END || '|' || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'X' END AS edge_key,
       CASE WHEN p_size % 4 = 0 THEN p_size % 3 <> 0 ELSE true END AS consistent FROM part""", registry_sql=False)  # fmt: skip
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, words, none = F.col("p_size"), F.split("p_name", " "), F.array().cast("array<string>")
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(": "), "p_name")).otherwise(F.col("p_name"))
    abstained, said = size % 4 == 0, F.when((size % 3 == 0) | (size % 4 != 0), F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.coarsest(F.lit("day"), F.when(size % 3 == 0, "year").when(size % 3 == 1, "month"), F.lit(None).cast("string")).alias("coarsest"), scalars.intervention_name(label)["type"].alias("type"), scalars.intervention_name(label)["name"].alias("name"),
        scalars.edge_key(F.col("p_brand"), F.when(size % 2 == 0, words).otherwise(none), F.col("p_type"), F.when(size % 5 != 0, "X")).alias("edge_key"), scalars.self_consistent(abstained, said, none, F.lit("low")).alias("consistent"),
    )


@query("trial_entities", """
SELECT nct_id, asset_id AS entity FROM uses UNION SELECT nct_id, condition_key FROM cond UNION SELECT nct_id, term_id FROM mention UNION SELECT nct_id, lead_company_id FROM spine WHERE lead_company_id IS NOT NULL""")  # fmt: skip
def trial_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.trial_entity_ids(registry(spark, sf_dir))


@query("get_trial", "SELECT nct_id, overall_status, phase_norm, lead_company_name FROM spine WHERE nct_id = 'T000000012'")
def get_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.get_trial(registry(spark, sf_dir), "T000000012", "^T[0-9]{9}$").select("nct_id", "overall_status", "phase_norm", "lead_company_name")


@query("sql_surface", """
SELECT overall_status, lead_company_id, count(*) AS n FROM spine WHERE phase_rank >= 2 AND lead_company_id <> 'c3' GROUP BY ALL HAVING count(*) > 1""")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with named parameters on the read-only surface, ordered by an aggregate that it doesn't show."""
    views.trials(registry(spark, sf_dir)).createOrReplaceTempView("v_trials")
    text = "SELECT overall_status, lead_company_id, count(*) AS n FROM v_trials WHERE phase_rank >= :least AND lead_company_id <> :but GROUP BY ALL HAVING count(*) > 1 ORDER BY max(last_update_date_parsed) DESC, lead_company_id"
    return serving.bound_sql(spark, text, ["v_trials"], {"least": 2, "but": "c3"})


@query("view_census", """
SELECT 'v_trials' AS name, count(*) AS n FROM spine UNION ALL SELECT 'v_trial_conditions_primary', count(*) FROM cond UNION ALL SELECT 'v_conditions', count(DISTINCT condition_key) FROM cond
UNION ALL SELECT 'v_programs', count(DISTINCT (asset_id, condition_key)) FROM dev UNION ALL SELECT 'v_asset_max_phase', count(DISTINCT asset_id) FROM dev UNION ALL SELECT 'v_assets', count(*) FROM asset UNION ALL SELECT 'v_moa', count(*) FROM moa
UNION ALL SELECT 'v_moa_best', count(*) FROM moa m WHERE tier = (SELECT min(tier) FROM moa x WHERE x.asset_id = m.asset_id) UNION ALL SELECT 'v_trial_card', count(*) FROM spine
UNION ALL SELECT 'v_population_landscape', count(DISTINCT (m.kind, m.term_id, c.condition_key)) FROM mention m JOIN spine s ON s.nct_id = m.nct_id JOIN cond c ON c.nct_id = m.nct_id WHERE s.study_type = 'INTERVENTIONAL' AND s.is_drug_trial
UNION ALL SELECT 'v_sponsor_condition', count(DISTINCT (lead_company_id, lead_agency_class, condition_key)) FROM sponsored s JOIN cond c ON c.nct_id = s.nct_id""")  # fmt: skip
def view_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of views, as the build counts them before it registers them."""
    t, counted = registry(spark, sf_dir), ["v_trials", "v_trial_conditions_primary", "v_conditions", "v_programs", "v_asset_max_phase", "v_assets", "v_moa", "v_moa_best", "v_trial_card", "v_population_landscape", "v_sponsor_condition"]
    out = None
    for name in counted:
        one = views.VIEWS[name](t).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("resolve_any_kind", """
, probe AS (SELECT unnest(['brand3x1', 'canada', 'blue bolt', 'RAND24', 'nothing']) AS q),
name AS (SELECT 'asset' AS kind, asset_id AS id, asset_id AS key FROM asset UNION ALL SELECT 'company', 'c' || n_nationkey, lower(n_name) FROM nation UNION ALL SELECT DISTINCT 'condition', condition_key, lower(display_name) FROM cond),
weight AS (SELECT 'asset' AS kind, asset_id AS id, count(DISTINCT nct_id) AS n FROM uses GROUP BY ALL UNION ALL SELECT 'company', lead_company_id, count(*) FROM spine WHERE lead_company_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'condition', condition_key, count(DISTINCT nct_id) FROM cond GROUP BY ALL),
tk AS (SELECT kind, id, key, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(key, '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS w FROM name),
hit AS (SELECT q, kind, id, min(CASE WHEN key = lower(q) OR id = lower(q) THEN 2 WHEN w = array_to_string(list_sort(string_split(lower(q), ' ')), ' ') THEN 4 WHEN key LIKE lower(q) || '%' THEN 5 WHEN key LIKE '%' || lower(q) || '%' THEN 6 END) AS rung FROM probe, tk GROUP BY ALL),
best AS (SELECT h.*, coalesce(n, 0) AS n_trials FROM hit h LEFT JOIN weight w ON w.kind = h.kind AND w.id = h.id WHERE rung IS NOT NULL AND NOT (rung > 4 AND EXISTS (SELECT 1 FROM hit x WHERE x.q = h.q AND x.kind = h.kind AND x.rung <= 4))),
ten AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY q, kind ORDER BY rung, n_trials DESC, id) <= 10)
SELECT q AS query, kind, id, rung, n_trials FROM ten QUALIFY row_number() OVER (PARTITION BY q ORDER BY rung, n_trials DESC, id, kind) <= 10""")  # fmt: skip
def resolve_any_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    conditions = views.trial_conditions_primary(t)
    named = lambda df, i, k: df.select(F.col(i).alias("id"), F.lower(k).alias("key"), F.lit("name").alias("source")).distinct()
    weigh = lambda df, i: df.where(F.col(i).isNotNull()).groupBy(F.col(i).alias("id")).agg(F.count_distinct("nct_id").alias("n_trials"))
    kinds = {
        "asset": (named(t["assets"], "asset_id", "canonical_name"), weigh(t["trial_assets"], "asset_id")),
        "company": (named(t["companies"], "company_id", "canonical_name"), weigh(views.trials(t), "lead_company_id")),
        "condition": (named(conditions, "condition_key", "display_name"), weigh(conditions, "condition_key")),
    }
    return resolve.resolve_any(spark, ["brand3x1", "canada", "blue bolt", "RAND24", "nothing"], kinds)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, json: an order with its lines as a study document; some are broken or lack their id."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    label = F.concat(F.lit("Arm "), F.col("l_returnflag"))
    treatment = F.struct("l_linenumber", F.lit("DRUG").alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.array(label).alias("armGroupLabels"), F.array(F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))).alias("otherNames"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(treatment)).alias("t"), F.array_sort(F.collect_set(label)).alias("a"))
    key = F.col("o_orderkey")
    section = F.struct(
        F.struct(F.when(key % 19 != 0, F.concat(F.lit(" NCT"), F.lpad(key.cast("string"), 8, "0"))).alias("nctId"), F.concat(F.lit("Order "), key.cast("string")).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("o_orderstatus").alias("overallStatus"), F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.struct(F.col("o_clerk" if "o_clerk" in orders.columns else "o_orderpriority").alias("name"), F.lit("INDUSTRY").alias("class")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.array("o_orderpriority").alias("conditions")).alias("conditionsModule"), F.struct(F.lit("INTERVENTIONAL").alias("studyType"), F.array(F.lit("PHASE2"), F.lit("PHASE3")).alias("phases")).alias("designModule"),
        F.struct(F.transform("a", lambda x: F.struct(x.alias("label"), F.lit("EXPERIMENTAL").alias("type"))).alias("armGroups"), F.transform("t", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), x["armGroupLabels"].alias("armGroupLabels"), x["otherNames"].alias("otherNames"))).alias("interventions")).alias("armsInterventionsModule"),
    )
    text = F.to_json(F.struct(section.alias("protocolSection")))
    return orders.join(per, key == per.l_orderkey).select(F.concat(key.cast("string"), F.lit(".json")).alias("member"), F.when(key % 23 == 0, F.lit("{broken")).otherwise(text).alias("json"))


@query("parsed_studies", """
SELECT 'NCT' || lpad(o_orderkey::VARCHAR, 8, '0') AS nct_id, 'Order ' || o_orderkey AS brief_title, o_orderstatus AS overall_status, 'PHASE3' AS phase_norm, strftime(o_orderdate, '%Y-%m') || '-01' AS started, 'month' AS date_precision
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0""", registry_sql=False)  # fmt: skip
def parsed_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents.flatten(documents.parse(_documents(spark, sf_dir)))["studies"]
    return s.select("nct_id", "brief_title", "overall_status", "phase_norm", F.date_format("start_date_parsed", "yyyy-MM-dd").alias("started"), "date_precision")


@query("dead_letters", """
SELECT o_orderkey || '.json' AS member, CASE WHEN o_orderkey % 23 = 0 THEN 'not a study document' ELSE 'no study id' END AS error FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND (o_orderkey % 23 = 0 OR o_orderkey % 19 = 0)""", registry_sql=False)  # fmt: skip
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flatten(documents.parse(_documents(spark, sf_dir)))["ingest_failures"]


@query("arm_links", """
, l AS (SELECT l_orderkey AS k, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part ' || l_partkey, 'Arm ' || l_returnflag) - 1 AS no FROM lineitem WHERE l_orderkey % 23 <> 0 AND l_orderkey % 19 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)),
a AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY f) - 1 AS arm_no FROM (SELECT DISTINCT k, f FROM l))
SELECT 'NCT' || lpad(l.k::VARCHAR, 8, '0') AS nct_id, CAST(a.arm_no AS INTEGER) AS arm_no, CAST(l.no AS INTEGER) AS intervention_no, 'label' AS via FROM l JOIN a ON a.k = l.k AND a.f = l.f""")  # fmt: skip
def arm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flatten(documents.parse(_documents(spark, sf_dir)))["arm_interventions"]


@query("drop_census", """
, o AS (SELECT count(*) FILTER (o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0) AS good, count(*) FILTER (o_orderkey % 23 = 0 OR o_orderkey % 19 = 0) AS bad FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT unnest(['n_no_arms', 'n_no_interventions', 'n_no_conditions', 'n_no_mesh', 'n_no_lead_sponsor', 'n_no_phase', 'n_no_enrollment', 'n_no_eligibility_text', 'n_no_last_update_date', 'n_failed']) AS reason,
       unnest([0, 0, 0, good, 0, 0, good, good, good, bad]) AS n FROM o""")  # fmt: skip
def drop_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.drop_census(documents.flatten(documents.parse(_documents(spark, sf_dir))))


@query("evidence_matrix", """
, r AS (SELECT coalesce(lead_company_id, 'unknown') AS lead_company_id, coalesce(phase_norm, 'unknown') AS phase_norm, nct_id LIKE '%7' AS cited FROM spine)
SELECT lead_company_id, phase_norm, count(*) AS n, count(*) FILTER (cited) AS n_cited FROM r
WHERE lead_company_id IN (SELECT lead_company_id FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) GROUP BY ALL""")  # fmt: skip
def evidence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trials(registry(spark, sf_dir)).withColumn("cited", F.col("nct_id").endswith("7"))
    return facets.evidence_matrix(rows, "lead_company_id", "phase_norm")
