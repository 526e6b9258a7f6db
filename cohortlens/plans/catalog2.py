"""More queries: analytics, serving, resolution and evaluation on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalars
from cohortlens.operators import facets, metrics, ranking, resolution

from . import analytics, resolve, serving, views
from .analogue import registry
from .catalog import PARTNERS_SQL, day, joined, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("top3_per_sponsor", """
SELECT lead_company_id, nct_id, phase_rank, strftime(updated, '%Y-%m-%d') AS updated FROM spine WHERE lead_company_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lead_company_id ORDER BY phase_rank DESC NULLS LAST, updated DESC NULLS LAST, nct_id) <= 3""")  # fmt: skip
def top3_per_sponsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trials(registry(spark, sf_dir)).where("lead_company_id IS NOT NULL")
    order = [F.col("phase_rank").desc_nulls_last(), F.col("last_update_date_parsed").desc_nulls_last(), "nct_id"]
    return ranking.top_per_group(t, ["lead_company_id"], order, 3).select("lead_company_id", "nct_id", "phase_rank", day("last_update_date_parsed").alias("updated"))


@query("unlabeled_assets", "SELECT DISTINCT asset_id FROM dev WHERE asset_id NOT IN (SELECT asset_id FROM moa)")
def unlabeled_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    return views.programs(t).select("asset_id").distinct().join(views.moa(t), "asset_id", "left_anti")


@query("labeled_fraction", """
SELECT count(DISTINCT d.asset_id) AS n_assets, count(DISTINCT m.asset_id) AS n_labeled, count(DISTINCT m.asset_id) / count(DISTINCT d.asset_id) AS labeled_fraction
FROM dev d LEFT JOIN moa m ON m.asset_id = d.asset_id""")  # fmt: skip
def labeled_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    labeled = views.moa(t).select("asset_id").distinct().withColumn("labeled", F.lit(1))
    n = views.programs(t).select("asset_id").distinct().join(labeled, "asset_id", "left").agg(F.count("*").alias("n_assets"), F.count("labeled").alias("n_labeled"))
    return n.withColumn("labeled_fraction", F.col("n_labeled") / F.col("n_assets"))


@query("symbol_rollup", """
SELECT w AS symbol, count(DISTINCT asset_id) AS n_assets, count(DISTINCT nct_id) AS n_trials FROM (SELECT unnest(string_split(p_name, ' ')) AS w, asset_id, nct_id FROM uses) GROUP BY w""")  # fmt: skip
def symbol_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    used = t["trial_assets"].join(t["interventions"], ["nct_id", "intervention_no"]).select(F.explode(F.split("name_raw", " ")).alias("symbol"), "asset_id", "nct_id")
    return used.groupBy("symbol").agg(F.count_distinct("asset_id").alias("n_assets"), F.count_distinct("nct_id").alias("n_trials"))


@query("phase_histogram", "SELECT coalesce(phase_norm, 'unknown') AS label, count(*) AS value FROM spine GROUP BY ALL")
def phase_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.chart(views.trials(registry(spark, sf_dir)), "phase_norm")


@query("start_year_histogram", "SELECT CAST(year(started) AS VARCHAR) AS label, count(*) AS value FROM spine GROUP BY ALL")
def start_year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trials(registry(spark, sf_dir)).withColumn("year", F.year("start_date_parsed").cast("string"))
    return analytics.chart(t, "year")


@query("sponsor_phase_matrix", """
SELECT lead_company_id, count(*) FILTER (phase_norm = 'EARLY_PHASE1') AS EARLY_PHASE1, count(*) FILTER (phase_norm = 'PHASE1') AS PHASE1, count(*) FILTER (phase_norm = 'PHASE2') AS PHASE2, count(*) FILTER (phase_norm = 'PHASE3') AS PHASE3,
       count(*) FILTER (phase_norm = 'PHASE4') AS PHASE4, count(*) FILTER (phase_norm = 'NA') AS NA, count(*) FILTER (phase_norm IS NULL) AS unknown
FROM spine WHERE lead_company_id IS NOT NULL GROUP BY ALL""")  # fmt: skip
def sponsor_phase_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sponsor_phase_matrix(registry(spark, sf_dir))


@query("sponsor_top10", """
SELECT lead_company_id AS label, count(*) AS value FROM spine WHERE lead_company_id IS NOT NULL AND is_industry GROUP BY ALL ORDER BY value DESC, label LIMIT 10""")  # fmt: skip
def sponsor_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.chart(views.trials(registry(spark, sf_dir)).where("lead_company_id IS NOT NULL AND is_industry"), "lead_company_id", top=10)


PHASE_NAME = "CASE {} WHEN 0.5 THEN 'EARLY_PHASE1' WHEN 1 THEN 'PHASE1' WHEN 2 THEN 'PHASE2' WHEN 3 THEN 'PHASE3' WHEN 4 THEN 'PHASE4' ELSE '{}' END"


@query("condition_landscape", """
, p AS (SELECT asset_id, max(phase_rank) AS m, max(phase_rank) FILTER (program_exists) AS active, count(DISTINCT nct_id) AS n, list(lead_company_id ORDER BY phase_rank DESC NULLS LAST, updated DESC NULLS LAST, nct_id)[1] AS lead FROM dev WHERE condition_key = 'blue bolt' GROUP BY asset_id),
b AS (SELECT m.asset_id, m.provenance FROM moa m JOIN (SELECT asset_id, min(tier) AS tier FROM moa GROUP BY asset_id) x ON x.asset_id = m.asset_id AND x.tier = m.tier),
own AS (SELECT s.* FROM spine s JOIN cond c ON c.nct_id = s.nct_id WHERE c.condition_key = 'blue bolt'), drug AS (SELECT DISTINCT * FROM own WHERE study_type = 'INTERVENTIONAL' AND is_drug_trial),
led AS (SELECT lead_company_id AS company_id, lead_company_name AS name, count(*) AS n, count(*) FILTER (program_exists) AS n_active FROM drug WHERE lead_company_id IN (SELECT lead_company_id FROM sponsored) GROUP BY ALL)
SELECT 'headline' AS figure, 'n_programs' AS label, CAST(count(*) AS DOUBLE) AS value FROM p
UNION ALL SELECT 'headline', 'n_active_programs', count(*) FROM (SELECT asset_id FROM dev WHERE condition_key = 'blue bolt' AND program_exists GROUP BY asset_id)
UNION ALL SELECT 'phases', coalesce(CAST(m AS VARCHAR), 'unknown'), count(*) FROM p GROUP BY ALL
UNION ALL SELECT 'mechanisms', coalesce(b.provenance, 'none'), count(DISTINCT p.asset_id) FROM p LEFT JOIN b ON b.asset_id = p.asset_id GROUP BY ALL
UNION ALL SELECT 'start_years', CAST(year(started) AS VARCHAR), count(*) FROM own GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'sponsors', name, sum(n) FROM led GROUP BY name ORDER BY sum(n) DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'populations', term_id, sum(n) FROM (SELECT m.kind, m.term_id, count(DISTINCT m.nct_id) AS n FROM mention m JOIN drug d ON d.nct_id = m.nct_id GROUP BY ALL) GROUP BY term_id ORDER BY sum(n) DESC, term_id LIMIT 12)
UNION ALL SELECT 'more', 'lead_companies', count(DISTINCT lead) FROM p UNION ALL SELECT 'more', 'program_trial_rows', coalesce(sum(n), 0) FROM p
UNION ALL SELECT 'active_phases', """ + PHASE_NAME.format("active", "no active trial") + """, count(*) FROM p GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'active_sponsors', name, sum(n_active) FROM led GROUP BY name ORDER BY sum(n_active) DESC, name LIMIT 10)
UNION ALL SELECT 'drug_start_years', coalesce(CAST(year(started) AS VARCHAR), 'unknown'), count(DISTINCT nct_id) FROM drug GROUP BY ALL
UNION ALL SELECT 'sponsor_phases', lead_company_id || ' / ' || """ + PHASE_NAME.format("phase_rank", "unknown") + """, count(DISTINCT nct_id) FROM drug
  WHERE lead_company_id IN (SELECT company_id FROM led GROUP BY company_id ORDER BY sum(n) DESC, company_id LIMIT 10) GROUP BY ALL""")  # fmt: skip
def condition_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.condition_landscape(registry(spark, sf_dir), "blue bolt")


@query("asset_landscape", PARTNERS_SQL + """
, own AS (SELECT * FROM spine WHERE nct_id IN (SELECT nct_id FROM uses WHERE asset_id = 'brand3x1')), d AS (SELECT * FROM dev WHERE asset_id = 'brand3x1'),
p AS (SELECT condition_key, max(phase_rank) AS m, max(phase_rank) FILTER (program_exists) AS active, count(DISTINCT nct_id) AS n FROM d GROUP BY ALL)
SELECT 'conditions' AS figure, condition_key AS label, CAST(count(DISTINCT nct_id) AS DOUBLE) AS value FROM d GROUP BY ALL
UNION ALL SELECT 'roles', role, count(DISTINCT nct_id) FROM uses WHERE asset_id = 'brand3x1' GROUP BY ALL
UNION ALL SELECT 'mechanisms', moa_label, count(*) FROM moa WHERE asset_id = 'brand3x1' GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'sponsors', s.lead_company_name, count(DISTINCT u.nct_id) FROM uses u JOIN spine s ON s.nct_id = u.nct_id WHERE u.asset_id = 'brand3x1' AND u.role <> 'comparator' AND s.lead_company_name IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'partners', partner_asset_id, count(DISTINCT nct_id) FROM partner WHERE asset_id = 'brand3x1' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'headline', 'conditions', count(*) FROM p UNION ALL SELECT 'headline', 'active_conditions', count(active) FROM p
UNION ALL SELECT 'headline', 'max_phase_ever', max(m) FROM p HAVING max(m) IS NOT NULL UNION ALL SELECT 'headline', 'max_phase_active', max(active) FROM p HAVING max(active) IS NOT NULL
UNION ALL SELECT * FROM (SELECT 'populations', kind || ': ' || term_id, count(DISTINCT nct_id) FROM mention WHERE nct_id IN (SELECT nct_id FROM own) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)
UNION ALL SELECT 'start_years', coalesce(CAST(year(started) AS VARCHAR), 'unknown'), count(*) FROM own GROUP BY ALL
UNION ALL SELECT 'condition_phases', condition_key || ' / ' || """ + PHASE_NAME.format("phase_rank", "unknown") + """, count(DISTINCT nct_id) FROM d
  WHERE condition_key IN (SELECT condition_key FROM p ORDER BY n DESC, condition_key LIMIT 8) GROUP BY ALL""")  # fmt: skip
def asset_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.asset_landscape(registry(spark, sf_dir), "brand3x1")


@query("company_landscape", """
, own AS (SELECT s.*, c.condition_key FROM sponsored s JOIN cond c ON c.nct_id = s.nct_id WHERE s.lead_company_id = 'c3'), drug AS (SELECT * FROM spine WHERE lead_company_id = 'c3' AND study_type = 'INTERVENTIONAL' AND is_drug_trial),
per AS (SELECT condition_key, count(DISTINCT nct_id) AS n, count(DISTINCT nct_id) FILTER (program_exists) AS n_active, count(DISTINCT nct_id) FILTER (phase_rank >= 3) AS n3 FROM own GROUP BY ALL)
SELECT 'areas' AS figure, coalesce(a.area, 'Unclassified') AS label, CAST(sum(n) AS DOUBLE) AS value
FROM (SELECT lead_agency_class, coalesce(a.area, 'Unclassified') AS area, count(DISTINCT nct_id) AS n FROM own o LEFT JOIN area a ON a.condition_key = o.condition_key GROUP BY ALL) a GROUP BY ALL
UNION ALL SELECT 'phases', coalesce(phase_norm, 'unknown'), count(*) FROM spine WHERE lead_company_id = 'c3' GROUP BY ALL
UNION ALL SELECT 'statuses', overall_status, count(*) FROM spine WHERE lead_company_id = 'c3' GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'conditions', condition_key, n FROM per ORDER BY n DESC, condition_key LIMIT 10)
UNION ALL SELECT 'headline', 'drug_trials', sum(n) FROM per UNION ALL SELECT 'headline', 'active_trials', sum(n_active) FROM per UNION ALL SELECT 'headline', 'phase3_plus', sum(n3) FROM per UNION ALL SELECT 'headline', 'conditions', count(*) FROM per
UNION ALL SELECT * FROM (SELECT 'active_areas', coalesce(a.area, 'Unclassified'), count(DISTINCT nct_id) FILTER (program_exists) FROM own o LEFT JOIN area a ON a.condition_key = o.condition_key GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT 'drug_phases', coalesce(phase_norm, 'unknown'), count(*) FROM drug GROUP BY ALL
UNION ALL SELECT 'drug_start_years', coalesce(CAST(year(started) AS VARCHAR), 'unknown'), count(*) FROM drug GROUP BY ALL
UNION ALL SELECT 'condition_phases', condition_key || ' / ' || """ + PHASE_NAME.format("phase_rank", "unknown") + """, count(DISTINCT nct_id) FROM own
  WHERE condition_key IN (SELECT condition_key FROM per ORDER BY n DESC, condition_key LIMIT 8) GROUP BY ALL""")  # fmt: skip
def company_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.company_landscape(registry(spark, sf_dir), "c3")


@query("funnel", """
, scope AS (
  SELECT u.nct_id, u.no, u.asset_id, u.asset_id IN (SELECT asset_id FROM moa) AS labeled FROM uses u JOIN spine s ON s.nct_id = u.nct_id
  WHERE s.study_type = 'INTERVENTIONAL' AND s.is_drug_trial AND s.is_industry AND u.role <> 'comparator'
), f AS (
  SELECT (SELECT count(*) FROM spine) AS studies, (SELECT count(*) FROM spine WHERE study_type = 'INTERVENTIONAL') AS interventional,
         (SELECT count(*) FROM spine WHERE study_type = 'INTERVENTIONAL' AND is_drug_trial) AS drug, (SELECT count(*) FROM spine WHERE study_type = 'INTERVENTIONAL' AND is_drug_trial AND is_industry) AS industry,
         (SELECT count(*) FROM spine WHERE study_type = 'INTERVENTIONAL' AND is_drug_trial AND is_industry AND program_exists) AS in_scope,
         (SELECT count(*) FROM spine WHERE is_drug_trial) AS drug_any_type, (SELECT count(*) FROM spine WHERE is_industry) AS industry_any_type,
         (SELECT count(DISTINCT nct_id) FROM cond WHERE source = 'mesh_leaf') AS with_mesh, (SELECT count(DISTINCT nct_id) FROM cond WHERE source = 'listed') AS listed_only,
         (SELECT count(*) FROM roles) AS trial_assets, (SELECT count(*) FROM roles WHERE role <> 'unknown') AS decided,
         (SELECT count(*) FROM asset WHERE NOT is_combo) AS assets, (SELECT count(*) FROM asset WHERE is_combo) AS combos, (SELECT count(DISTINCT asset_id) FROM moa) AS labeled,
         (SELECT count(*) FROM scope) AS in_scope_trial_asset_rows, (SELECT count(*) FROM scope WHERE labeled) AS in_scope_trial_asset_rows_with_moa,
         (SELECT count(DISTINCT asset_id) FROM scope) AS in_scope_assets, (SELECT count(DISTINCT asset_id) FROM scope WHERE labeled) AS in_scope_assets_with_moa,
         (SELECT count(*) FROM lines WHERE p_size % 7 <> 0) AS interventions_drug, (SELECT count(*) FROM uses WHERE p_size % 7 <> 0) AS interventions_keyed,
         (SELECT count(*) FROM spine WHERE study_type = 'INTERVENTIONAL' AND is_drug_trial AND nct_id IN (SELECT nct_id FROM lines)) AS drug_with_arms,
         (SELECT count(DISTINCT asset_id) FROM moa WHERE tier = 1) AS moa_assets_chembl, (SELECT count(DISTINCT asset_id) FROM moa WHERE tier = 2) AS moa_assets_curated,
         (SELECT count(DISTINCT asset_id) FROM moa WHERE tier = 3) AS moa_assets_nlm_class, (SELECT count(*) FROM moa WHERE tier = 4) AS moa_assets_llm,
         (SELECT count(*) FROM asset WHERE n IN ('0', '3') AND k % 7 = 0) AS moa_assets_llm_abstained, (SELECT strftime(max(snapshot_date), '%Y%m%d')::BIGINT FROM spine) AS snapshot_date
)
SELECT key, value::DOUBLE AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME key VALUE value)
UNION ALL SELECT 'pct_with_mesh', round_even(100.0 * with_mesh / greatest(studies, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_decided', round_even(100.0 * decided / greatest(trial_assets, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_labeled', round_even(100.0 * labeled / greatest(assets + combos, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_in_scope_rows_labeled', round_even(100.0 * in_scope_trial_asset_rows_with_moa / greatest(in_scope_trial_asset_rows, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_in_scope_assets_labeled', round_even(100.0 * in_scope_assets_with_moa / greatest(in_scope_assets, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_interventions_keyed', round_even(100.0 * interventions_keyed / greatest(interventions_drug, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'pct_drug_with_arms', round_even(100.0 * drug_with_arms / greatest(drug, 1), 1)::DOUBLE FROM f
UNION ALL SELECT 'role:' || role, count(*) FROM roles GROUP BY role
UNION ALL SELECT 'pct_population:' || kind, round_even(100.0 * count(DISTINCT nct_id) / (SELECT greatest(studies, 1) FROM f), 1)::DOUBLE FROM mention GROUP BY kind""")  # fmt: skip
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.funnel(registry(spark, sf_dir))


FACET_SQL = """, ev AS (
  SELECT s.nct_id, [s.overall_status] AS status, [coalesce(s.phase_norm, 'unknown')] AS phase, (SELECT list(DISTINCT u.asset_id) FROM uses u WHERE u.nct_id = s.nct_id) AS asset,
         s.nct_id LIKE '%7' AS cited, s.nct_id LIKE '%3' OR s.nct_id LIKE '%7' AS mentioned, s.phase_rank FROM spine s WHERE s.lead_company_id = 'c3'
)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    found = t["trial_assets"].groupBy("nct_id").agg(F.collect_set("asset_id").alias("asset"))
    s = views.trials(t).where("lead_company_id = 'c3'").join(found, "nct_id", "left")
    return s.select("nct_id", "phase_rank", F.array("overall_status").alias("status"), F.array(F.coalesce("phase_norm", F.lit("unknown"))).alias("phase"), "asset", F.col("nct_id").endswith("7").alias("cited"), F.col("nct_id").rlike("[37]$").alias("mentioned"))


@query("facet_crossfilter", FACET_SQL + """
SELECT 'status' AS facet, v AS value, count(*) AS n, count(*) FILTER (cited) AS n_cited FROM (SELECT unnest(status) AS v, cited FROM ev WHERE list_has_any(phase, ['PHASE2', 'PHASE3'])) GROUP BY ALL
UNION ALL SELECT 'phase', v, count(*), count(*) FILTER (cited) FROM (SELECT unnest(phase) AS v, cited FROM ev WHERE list_has_any(status, ['RECRUITING'])) GROUP BY ALL
UNION ALL SELECT 'asset', v, count(*), count(*) FILTER (cited) FROM (SELECT unnest(asset) AS v, cited FROM ev WHERE list_has_any(status, ['RECRUITING']) AND list_has_any(phase, ['PHASE2', 'PHASE3'])) GROUP BY ALL""")  # fmt: skip
def facet_crossfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.tallies(_evidence(spark, sf_dir), ["status", "phase", "asset"], {"status": ["RECRUITING"], "phase": ["PHASE2", "PHASE3"]})


@query("evidence_ranking", FACET_SQL + " SELECT nct_id, cited, mentioned, phase_rank FROM ev ORDER BY cited DESC, mentioned DESC, phase_rank DESC NULLS LAST, nct_id LIMIT 40")
def evidence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.ranked_evidence(_evidence(spark, sf_dir)).select("nct_id", "cited", "mentioned", "phase_rank")


@query("reference_check", """
, ref AS (SELECT lead_company_id AS id, lead_company_name AS name, count(*) AS n FROM spine WHERE lead_company_id IS NOT NULL GROUP BY ALL)
SELECT c.label, c.value, r.n::DOUBLE AS expected, CASE WHEN r.n IS NULL THEN 'unknown' WHEN abs(r.n - c.value) <= 1e-9 THEN 'match' ELSE 'differs' END AS status
FROM (SELECT CASE i WHEN 0 THEN ' ' || upper(id) ELSE lower(name) END AS label, (n + i)::DOUBLE AS value FROM ref, (SELECT unnest([0, 1]) AS i) UNION ALL SELECT 'nobody', 1.0) c
LEFT JOIN ref r ON lower(trim(c.label)) IN (r.id, lower(r.name))""")  # fmt: skip
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    n = views.trials(t).where("lead_company_id IS NOT NULL").groupBy(F.col("lead_company_id").alias("id")).agg(F.count("*").cast("double").alias("value")).join(t["companies"].select(F.col("company_id").alias("id"), F.col("canonical_name").alias("name")), "id")
    by_id = n.select(F.concat(F.lit(" "), F.upper("id")).alias("label"), "value")
    cells = by_id.union(n.select(F.lower("name"), F.col("value") + 1)).union(spark.createDataFrame([("nobody", 1.0)], by_id.schema))
    return facets.reference_check(cells, n)


@query("mode_surface", """
SELECT p_brand, p_name, n FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) = 1""", registry_sql=False)  # fmt: skip
def mode_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mode(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("area_rollup", """
, x AS (SELECT DISTINCT a.asset_id, a.nct_id, c.condition_key, (SELECT count(DISTINCT asset_id) FROM uses u WHERE u.nct_id = a.nct_id) = 1 AS solo FROM uses a JOIN cond c ON c.nct_id = a.nct_id), g AS (SELECT asset_id, bool_or(solo) AS s, count(DISTINCT nct_id) AS n FROM x GROUP BY asset_id)
SELECT x.asset_id, x.condition_key FROM x JOIN g ON g.asset_id = x.asset_id GROUP BY x.asset_id, x.condition_key, g.s, g.n HAVING CASE WHEN g.s THEN bool_or(x.solo) ELSE count(DISTINCT x.nct_id) = g.n END""")  # fmt: skip
def area_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    alone = t["trial_assets"].groupBy("nct_id").agg((F.count_distinct("asset_id") == 1).alias("solo"))
    rows = t["trial_assets"].select("asset_id", "nct_id").distinct().join(alone, "nct_id").join(views.trial_conditions_primary(t).select("nct_id", "condition_key"), "nct_id")
    return ranking.set_rollup(rows, "asset_id", "nct_id", "condition_key", "solo")


@query("partial_dates", """
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS date, CASE WHEN d IS NOT NULL THEN CASE length(s) WHEN 10 THEN 'day' WHEN 7 THEN 'month' WHEN 4 THEN 'year' END END AS precision
FROM (SELECT o_orderkey, s, try_cast(CASE length(s) WHEN 10 THEN s WHEN 7 THEN s || '-01' WHEN 4 THEN s || '-01-01' END AS DATE) AS d
      FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13' ELSE 'May ' || strftime(o_orderdate, '%Y') END AS s FROM orders))""", registry_sql=False)  # fmt: skip
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    s = F.when(key == 0, at("yyyy-MM-dd")).when(key == 1, at("yyyy-MM")).when(key == 2, at("yyyy")).when(key == 3, F.concat(at("yyyy"), F.lit("-13"))).otherwise(F.concat(F.lit("May "), at("yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.partial_date(s).alias("p")).select("o_orderkey", day("p.date").alias("date"), "p.precision")


@query("phase_roundup", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PHASE2' WHEN 1 THEN 'PHASE3' WHEN 2 THEN 'NA' END AS phase FROM orders""", registry_sql=False)  # fmt: skip
def phase_roundup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, texts = F.col("o_orderkey") % 4, lambda *p: F.array(*map(F.lit, p))
    phases = F.when(key == 0, texts("phase1", "PHASE2")).when(key == 1, texts("PHASE3", "NA", "PHASE2")).when(key == 2, texts("NA", "other")).otherwise(texts("other"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.phase_norm(phases).alias("phase"))


@query("alias_keys", "SELECT p_partkey, regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9]', '', 'g') AS alias_key, regexp_matches(p_brand, '^[A-Za-z]{1,5}[- ]?[0-9]{2,8}[A-Za-z]?$') AS is_code FROM part", registry_sql=False)
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.alias_key(name).alias("alias_key"), scalars.is_code_name(F.col("p_brand")).alias("is_code"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NULL AS dead_letter FROM events", registry_sql=False)
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"]
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k"), parsed.isNull().alias("dead_letter"))


@query("id_scan", """
SELECT page_id, CASE WHEN len(g) > 0 THEN array_to_string(list_sort(list_distinct(g)), ',') ELSE '' END AS ids
FROM (SELECT page_id, list_transform(list_filter(regexp_extract_all(t, 'NCT[\\s\\-_:#]*([0-9]+)', 1), lambda d: length(d) = 8), lambda d: 'NCT' || d) AS g
      FROM (SELECT page_id, html || ' see NCT' || lpad((page_id % 97)::VARCHAR, 8, '0') || ' and NCT-' || page_id || ' or NCT 00000' || lpad((page_id % 1000)::VARCHAR, 3, '0') AS t FROM pages))""", registry_sql=False)  # fmt: skip
def id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    text = F.concat("html", F.lit(" see NCT"), F.lpad((p % 97).cast("string"), 8, "0"), F.lit(" and NCT-"), p.cast("string"), F.lit(" or NCT 00000"), F.lpad((p % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "pages").select("page_id", joined(scalars.study_ids(text)).alias("ids"))


SAID_SQL = r"""WITH said AS (
  SELECT conv_id, role, 'NCT' || lpad((turn * 7 % 50 + CASE WHEN role = 'assistant' THEN 0 ELSE 7 + conv_id % 2 END)::VARCHAR, 8, '0') AS id, coalesce(text, '') || ' as shown in NCT' || lpad((turn * 7 % 50)::VARCHAR, 8, '0') || ' and NCT' || (conv_id % 1000) AS text FROM conversations
), named AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, 'NCT[\s\-_:#]*([0-9]+)', 1)) AS d FROM said WHERE role = 'assistant')
"""


@query("grounding_violations", SAID_SQL + """
SELECT conv_id, 'NCT' || d AS id, 'not retrieved' AS violation FROM named WHERE length(d) = 8 AND NOT EXISTS (SELECT 1 FROM said r WHERE r.conv_id = named.conv_id AND r.role <> 'assistant' AND r.id = 'NCT' || d)
UNION ALL SELECT conv_id, 'NCT' || d, 'malformed' FROM named WHERE length(d) <> 8""", registry_sql=False)  # fmt: skip
def grounding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer is its text and two ids, one of a wrong length; in every other conversation the questions retrieved other ids."""
    c = table(spark, sf_dir, "conversations")
    number = F.col("turn") * 7 % 50
    name = lambda n: F.concat(F.lit("NCT"), F.lpad(n.cast("string"), 8, "0"))
    answers = c.where("role = 'assistant'").select("conv_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" as shown in "), name(number), F.lit(" and NCT"), (F.col("conv_id") % 1000).cast("string")).alias("answer"))
    retrieved = c.where("role <> 'assistant'").select("conv_id", name(number + 7 + F.col("conv_id") % 2).alias("id"))
    return serving.grounding_violations(answers, retrieved, "conv_id")


@query("conversation_running_sets", """
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(list(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn)))), ',') AS seen FROM conversations""", registry_sql=False)  # fmt: skip
def conversation_running_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("ids"))
    return ranking.running_set(rows, "conv_id", "turn", "ids").select("conv_id", "turn", joined("seen").alias("seen"))


@query("lastwins_dedup", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", registry_sql=False)
def lastwins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_wins(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("budget_prefix", """
SELECT o_orderkey, spent FROM (SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM orders) WHERE spent <= 1000000""", registry_sql=False)  # fmt: skip
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.budget_prefix(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "o_custkey", 1_000_000).select("o_orderkey", "spent")


@query("cost_of", "SELECT doc_id, (length(coalesce(text, '')) * 3.0 + len(string_split(coalesce(text, ''), ' ')) * 15.0) / 1e6 AS cost FROM documents", registry_sql=False)
def cost_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.cost_of(F.length(text), F.size(F.split(text, " ")), 3.0, 15.0).alias("cost"))


CLAIMS_SQL = """WITH claims AS (SELECT 'a' || (l_partkey % 400) AS alias, 'k' || (CASE WHEN l_partkey % 4 < 1 OR (l_partkey % 4 = 1 AND l_suppkey % 40 > 0) THEN l_partkey % 400 % 7 ELSE l_suppkey % 9 END) AS owner, l_orderkey AS trial FROM lineitem)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a claim; the alias says whether it has one owner, one and a few strays, or many."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    owner = F.when((part % 4 < 1) | ((part % 4 == 1) & (supp % 40 > 0)), part % 400 % 7).otherwise(supp % 9)
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), (part % 400).cast("string")).alias("alias"), F.concat(F.lit("k"), owner.cast("string")).alias("owner"), F.col("l_orderkey").alias("trial"))


@query("dominance_aliases", CLAIMS_SQL + """, s AS (SELECT alias, owner AS root, count(DISTINCT trial) AS n FROM claims GROUP BY ALL)
SELECT alias, CASE WHEN m = 1 OR (n >= 5 AND n >= 10 * n2) THEN root END AS root, n, m AS n_claimants, CASE WHEN m = 1 THEN 'sole' WHEN n >= 5 AND n >= 10 * n2 THEN 'dominance' ELSE 'vetoed' END AS decision
FROM (SELECT *, lead(n) OVER w AS n2, count(*) OVER (PARTITION BY alias) AS m, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY alias ORDER BY n DESC, root)) WHERE r = 1""", registry_sql=False)  # fmt: skip
def dominance_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = spark.createDataFrame([], "id string, root string")
    return resolution.decide_aliases(resolution.alias_support(_claims(spark, sf_dir), nobody))


@query("merge_support", CLAIMS_SQL + " SELECT alias, owner AS root, count(DISTINCT trial) AS n FROM claims GROUP BY ALL HAVING count(DISTINCT trial) >= 2", registry_sql=False)
def merge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = spark.createDataFrame([], "id string, root string")
    return resolution.alias_support(_claims(spark, sf_dir), nobody).where("n >= 2")


@query("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM v GROUP BY a
  UNION SELECT v.b, min(r.root) FROM r JOIN v ON v.a = r.id JOIN recurring.r AS s ON s.id = v.b WHERE r.root < s.root GROUP BY v.b) SELECT id, root FROM r""", registry_sql=False)  # fmt: skip
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all edges of lineitem; its SQL keeps one row an id, so whole tables fit."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b"))
    return resolution.connected_components(edges)


CASES_SQL = """WITH o AS (SELECT o_custkey % 20 AS c, o_orderkey AS item, o_orderstatus = 'O' AS same FROM orders), r AS (SELECT DISTINCT CASE c WHEN 7 THEN 8 ELSE c END AS case_id, item FROM o),
g AS (SELECT DISTINCT CASE WHEN c = 4 OR (c = 3 AND NOT same) THEN 5 WHEN same THEN c ELSE (c + 1) % 20 END AS case_id, item FROM o),
n AS (SELECT coalesce(r.case_id, g.case_id) AS case_id, count(r.item) AS n_returned, count(g.item) AS n_gold, count(r.item) FILTER (g.item IS NOT NULL) AS n_hit FROM r FULL JOIN g ON r.case_id = g.case_id AND r.item = g.item GROUP BY 1)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is returned for a case and expected for the same or another one; case 7 returns nothing and case 4 expects nothing."""
    c, same = F.col("o_custkey") % 20, F.col("o_orderstatus") == "O"
    o = table(spark, sf_dir, "orders").withColumn("item", F.col("o_orderkey"))
    returned = o.select(F.when(c == 7, 8).otherwise(c).alias("case_id"), "item")
    gold = o.select(F.when((c == 4) | ((c == 3) & ~same), 5).when(same, c).otherwise((c + 1) % 20).alias("case_id"), "item")
    return metrics.set_scores(returned, gold, "case_id", "item")


@query("prf_by_case", CASES_SQL + """, s AS (SELECT *, CASE WHEN n_returned > 0 THEN n_hit / n_returned ELSE 1.0 END AS precision, CASE WHEN n_gold > 0 THEN n_hit / n_gold ELSE 1.0 END AS recall FROM n)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s""", registry_sql=False)  # fmt: skip
def prf_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query("prf_pooled", CASES_SQL + """, s AS (SELECT CAST(sum(n_returned) AS BIGINT) AS n_returned, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_hit) AS BIGINT) AS n_hit FROM n), p AS (SELECT *, n_hit / n_returned AS precision, n_hit / n_gold AS recall FROM s)
SELECT *, 2 * precision * recall / (precision + recall) AS f1, n_gold >= 30 AS gating FROM p""", registry_sql=False)  # fmt: skip
def prf_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled(_scores(spark, sf_dir))


@query("floor_rollup", """SELECT n_nationkey AS grp, coalesce(string_agg(DISTINCT 'm' || (s_suppkey % 4), ',' ORDER BY 'm' || (s_suppkey % 4)) FILTER (s_suppkey % 3 = 0 AND s_acctbal < 0), '') AS breaches,
coalesce(avg(s_suppkey % 5) FILTER (s_suppkey % 3 = 1), 0) AS objective, count(*) AS n_checks, count(*) FILTER (s_suppkey % 3 = 0 AND s_acctbal < 0) = 0 AS passed FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""", registry_sql=False)  # fmt: skip
def floor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    role = F.when(k % 3 == 0, "FLOOR").when(k % 3 == 1, "OBJ").otherwise("DIAG")
    value = F.when(k % 3 == 0, F.when(F.col("s_acctbal") < 0, 1).otherwise(0)).otherwise(k % 5)
    checks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("metric"), role.alias("role"), value.alias("value"))
    return metrics.roll_up(checks, "grp").withColumn("breaches", joined("breaches"))


@query("resolve_ladder", """
, names AS (SELECT DISTINCT asset_id AS id, upper(asset_id) AS name FROM asset), n AS (SELECT asset_id AS id, count(DISTINCT nct_id) AS n FROM uses GROUP BY asset_id),
probe AS (SELECT unnest(['brand3x1', 'BRAND1', 'x2', 'nothing', 'rand24x3']) AS q), hit AS (
  SELECT q, id, CASE WHEN lower(q) = id THEN 2 WHEN id LIKE lower(q) || '%' THEN 5 WHEN id LIKE '%' || lower(q) || '%' THEN 6 END AS rung FROM probe, names)
SELECT h.q AS query, h.id, h.rung, coalesce(n.n, 0) AS n_trials FROM hit h LEFT JOIN n ON n.id = h.id
WHERE h.rung IS NOT NULL AND NOT (h.rung > 4 AND EXISTS (SELECT 1 FROM hit x WHERE x.q = h.q AND x.rung <= 4))
QUALIFY row_number() OVER (PARTITION BY h.q ORDER BY h.rung, coalesce(n.n, 0) DESC, h.id) <= 10""")  # fmt: skip
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = registry(spark, sf_dir)
    names = t["assets"].select(F.col("asset_id").alias("id"), F.lower("canonical_name").alias("key"), F.lit("name").alias("source"))
    weights = t["trial_assets"].groupBy(F.col("asset_id").alias("id")).agg(F.count_distinct("nct_id").alias("n_trials"))
    return resolve.resolve_many(spark, ["brand3x1", "BRAND1", "x2", "nothing", "rand24x3"], names, weights).drop("source")


@query("profile_trials", """
SELECT s.nct_id, s.overall_status, s.phase_norm, CAST(year(s.started) AS INTEGER) AS start_year,
       (SELECT string_agg(DISTINCT condition_key, ',' ORDER BY condition_key) FROM cond c WHERE c.nct_id = s.nct_id) AS conditions,
       (SELECT string_agg(DISTINCT u.asset_id, ',' ORDER BY u.asset_id) FROM uses u WHERE u.nct_id = s.nct_id) AS assets,
       (SELECT min(m.provenance) FROM uses u JOIN moa m ON m.asset_id = u.asset_id WHERE u.nct_id = s.nct_id) AS provenance FROM spine s WHERE s.nct_id IN ('T000000001', 'T000000005', 'T000000012')""")  # fmt: skip
def profile_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = serving.profile_trials(spark, registry(spark, sf_dir), ["T000000001", "T000000005", "T000000012", "T999999999"])
    return found.withColumns({"conditions": joined("conditions"), "assets": joined("assets")})


@query("term_landscape", r"""
WITH term(kind, term_id, pattern) AS (VALUES ('biomarker', 'with', '\bwith\b'), ('biomarker', 'licence', 'licen[cs]ed?'), ('demographic', 'email', '[a-z0-9.]+@[a-z0-9.]+'), ('disease_stage', 'number', '\b[0-9]{4}\b')),
hit AS (SELECT d.doc_id, d.lang, t.kind, t.term_id FROM documents d, term t WHERE regexp_matches(d.text, t.pattern, 'i'))
SELECT kind, term_id, lang, count(DISTINCT doc_id) AS n_docs, array_to_string(list_sort(list(DISTINCT doc_id))[1:10], ',') AS examples FROM hit GROUP BY ALL""", registry_sql=False)  # fmt: skip
def term_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.functions import populations

    lexicon = [("with", "biomarker", [r"\bwith\b"]), ("licence", "biomarker", ["licen[cs]ed?"]), ("email", "demographic", ["[a-z0-9.]+@[a-z0-9.]+"]), ("number", "disease_stage", [r"\b[0-9]{4}\b"])]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hits = populations.term_hits(docs, "text", lexicon)
    return hits.groupBy("kind", "term_id", "lang").agg(F.count_distinct("doc_id").alias("n_docs"), F.array_join(F.slice(F.array_sort(F.collect_set("doc_id")), 1, 10), ",").alias("examples"))


@query("running_row_ids", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS ordinal FROM lineitem", registry_sql=False)
def running_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("ordinal"))
