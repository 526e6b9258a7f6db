"""The registry's tables, made from order tables.

A trial is an order, an intervention an order line (number = line number), an asset a brand and size class, an arm the lines
of an order with one return flag, a lead sponsor a customer's nation, a condition a part's name (mesh surface) or
brand (listed surface).  So all views run, unchanged, on tables of any size; `REGISTRY_SQL` says the
same in DuckDB's SQL.

Like the index that a real build writes, these tables are kept in the shared folder, bucketed by study: each is written when a query of the
session first asks for it, and lines are aggregated and joined with parts once.  What only picks or rearranges lines of a study is a view of
the kept lines, not a table of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.roles import assign_roles
from cohortlens.session import Kept


def asset() -> Column:
    return F.concat(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit("x"), (F.col("p_size") % 4).cast("string"))


NAMES = (
    "studies", "interventions", "arms", "arm_interventions", "assets", "asset_components", "_used", "trial_conditions_norm", "condition_areas", "trial_sponsors_norm", "companies", "chembl_moa", "asset_curated_moa",
    "asset_nlm_classes", "asset_enrichment", "population_mentions", "build_meta", "sponsors", "study_conditions", "mesh_terms",
)
PLACED = ("arms", "trial_conditions_norm", "trial_assets")
VIEWS = ("interventions", "arm_interventions", "_used", "population_mentions", "study_conditions", "mesh_terms", "sponsors")
_INDEX: dict[tuple[str, str], Kept] = {}


def registry(spark: SparkSession, sf_dir: str) -> Kept:
    """The tables made from those of a folder, one index for each session and folder."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _INDEX:
        plans: dict[str, DataFrame] = {}

        def plan(name: str, kept: Mapping[str, DataFrame]) -> DataFrame:
            if not plans:
                plans.update(_derived(spark, sf_dir, kept["lines"]))
            return plans[name]

        made = {name: partial(plan, name) for name in NAMES}
        made["trial_assets"] = lambda kept: assign_roles(kept["_used"], kept["arm_interventions"], kept["arms"])
        made["sponsors"] = lambda kept: kept["trial_sponsors_norm"].join(kept["companies"], "company_id").select("nct_id", "role", F.col("canonical_name").alias("name_raw"), "agency_class")
        _INDEX[where] = Kept(spark, made | {"lines": lambda _: _lines(spark, sf_dir)}, "nct_id", PLACED, VIEWS)
    return _INDEX[where]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their parts: nct_id, intervention_no, asset_id, arm_no, flag, quantity, p_name, p_brand, p_size."""
    lines, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min(F.ascii("l_returnflag")).alias("_flag"), F.min("l_quantity").alias("quantity"))
    lines = lines.withColumn("flag", F.char("_flag"))  # numbers aggregate by hash, strings by sort
    lines = lines.join(part, lines.l_partkey == part.p_partkey).withColumn("nct_id", F.concat(F.lit("T"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")))
    return lines.select(
        "nct_id", F.col("l_linenumber").alias("intervention_no"), "l_linenumber", asset().alias("asset_id"), F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2).alias("arm_no"),
        "flag", "quantity", "p_name", "p_brand", "p_size",
    )


def _derived(spark: SparkSession, sf_dir: str, lines: DataFrame) -> dict[str, DataFrame]:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders, customer, nation, part = read("orders"), read("customer"), read("nation"), read("part")
    none = F.lit(None).cast("string")
    trial = F.concat(F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    day = F.to_date("o_orderdate")
    phase = F.when(F.col("o_orderkey") % 13 == 0, none)
    for digit, name in (("1", "PHASE4"), ("2", "PHASE3"), ("3", "PHASE2"), ("4", "PHASE1"), ("5", "EARLY_PHASE1")):
        phase = phase.when(F.col("o_orderpriority").startswith(digit), name)
    status = F.when(F.col("o_orderstatus") == "O", "RECRUITING").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "TERMINATED")
    studies = orders.select(
        trial.alias("nct_id"), F.concat(F.lit("Study "), F.col("o_orderkey").cast("string")).alias("brief_title"),
        F.when(F.col("o_orderkey") % 10 == 0, "OBSERVATIONAL").otherwise("INTERVENTIONAL").alias("study_type"), status.alias("overall_status"), phase.alias("phase_norm"),
        F.date_sub(day, 400).alias("start_date_parsed"), F.when(F.col("o_orderkey") % 17 != 0, day).alias("completion_date_parsed"),
        F.date_add(day, (F.col("o_custkey") % 200).cast("int")).alias("last_update_date_parsed"),
    )
    interventions = lines.select("nct_id", "intervention_no", F.when(F.col("p_size") % 7 == 0, "DEVICE").otherwise("DRUG").alias("type"), F.col("p_name").alias("name_raw"), none.alias("description"))
    arms = lines.select("nct_id", "arm_no", F.col("flag").alias("label"), F.when(F.col("flag") == "A", "EXPERIMENTAL").when(F.col("flag") == "R", "ACTIVE_COMPARATOR").otherwise("OTHER").alias("type"), none.alias("description")).distinct()
    arm_interventions = lines.select("nct_id", "arm_no", "intervention_no", F.lit("label").alias("via"))
    assets = part.select(asset().alias("asset_id")).distinct().select(
        "asset_id", F.upper("asset_id").alias("canonical_name"), F.col("asset_id").alias("dedup_key"), F.col("asset_id").endswith("x0").alias("is_combo"))
    stem = F.regexp_replace("asset_id", "x0$", "")
    components = assets.where("is_combo").select(F.col("asset_id").alias("combo_asset_id"), F.explode(F.array(F.concat(stem, F.lit("x1")), F.concat(stem, F.lit("x2")))).alias("component_asset_id"))
    used = lines.select("nct_id", "intervention_no", "asset_id", F.lit("name").alias("via"))
    mesh = lines.where("flag = 'A'").select("nct_id", F.col("p_name").alias("condition_key"), F.initcap("p_name").alias("display_name"), F.lit("mesh_leaf").alias("source"))
    leaf = F.when(F.col("flag") == "A", F.struct(F.col("p_name").alias("condition_key"), F.initcap("p_name").alias("display_name"), F.lit("mesh_leaf").alias("source")))
    listed = F.struct(F.lower("p_brand").alias("condition_key"), F.col("p_brand").alias("display_name"), F.lit("listed").alias("source"))
    word = F.split("p_name", " ")
    areas = part.select(F.col("p_name").alias("condition_key"), F.explode(F.array(F.struct(F.get(word, F.lit(1)).alias("area"), F.lit(True).alias("is_primary")), F.struct(F.get(word, F.lit(0)).alias("area"), F.lit(False).alias("is_primary")))).alias("a")).select("condition_key", "a.*").where("area <> 'red'").distinct()
    leads = orders.join(customer, orders.o_custkey == customer.c_custkey).where("o_custkey % 50 <> 0").select(
        trial.alias("nct_id"), F.lit("lead").alias("role"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("company_id"),
        F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "INDUSTRY").when(F.col("c_mktsegment") == "FURNITURE", "NIH").otherwise("OTHER").alias("agency_class"))
    companies = nation.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("company_id"), F.col("n_name").alias("canonical_name"))
    n, plain = F.regexp_extract("asset_id", "x([0-9])$", 1), assets.where("NOT is_combo")
    number = F.regexp_extract("asset_id", "^brand([0-9]+)x", 1).cast("int")
    chembl = plain.where((n == "1") | ((n == "2") & (number % 3 == 0))).select("asset_id", F.concat(F.lit("Inhibitor of T"), (number % 5).cast("string")).alias("mechanism_of_action"), F.lit("INHIBITOR").alias("action_type"), F.array(F.concat(F.lit("T"), (number % 5).cast("string"))).alias("target_symbols"), F.concat(F.lit("t"), (number % 5).cast("string")).alias("moa_key"))
    curated = plain.where((n == "2") & (number % 2 == 0)).select("asset_id", F.lit("Hand-written").alias("moa_label"), F.lit("BINDER").alias("action"), F.array(F.lit("H1")).alias("target_symbols"), F.lit("antibody").alias("modality"), F.lit("h1").alias("moa_key"))
    nlm = assets.where(n.isin("2", "3") & (number % 5 < 3)).select("asset_id", F.concat(F.lit("Class "), (number % 3).cast("string")).alias("class_term"), F.concat(F.lit("class"), (number % 3).cast("string")).alias("moa_key"))
    guess = assets.where(n.isin("0", "3")).select("asset_id", F.when(number % 2 == 0, "Guessed").alias("moa_class"), F.lit("UNKNOWN").alias("action"), F.when(number % 4 < 2, F.array(F.lit("G1"), F.lit("G2"))).otherwise(F.array().cast("array<string>")).alias("targets_canonical"), F.array(F.lit("g raw")).alias("targets_raw"), F.lit("small molecule").alias("modality"), (number % 7 == 0).alias("abstained"), F.when(number % 9 == 0, "").otherwise("g1|g2").alias("moa_key"))
    mentions = lines.where("quantity % 10 < 4").select("nct_id", F.concat(F.lit("q"), F.floor(F.col("quantity") / 10).cast("string")).alias("term_id"), F.when(F.col("quantity") > 25, "biomarker").otherwise("demographic").alias("kind"), F.lit("title").alias("surface"), F.col("p_name").alias("evidence_line")).distinct()
    meta = orders.agg(F.max(day).alias("d")).select(F.lit("snapshot_date").alias("key"), F.col("d").cast("string").alias("value"))
    return {
        "studies": studies, "interventions": interventions, "arms": arms, "arm_interventions": arm_interventions, "assets": assets, "asset_components": components,
        "_used": used, "trial_conditions_norm": lines.select("nct_id", F.inline(F.array_compact(F.array(leaf, listed)))).distinct(), "condition_areas": areas,
        "trial_sponsors_norm": leads, "companies": companies, "chembl_moa": chembl, "asset_curated_moa": curated, "asset_nlm_classes": nlm, "asset_enrichment": guess,
        "population_mentions": mentions, "build_meta": meta,
        "study_conditions": lines.select("nct_id", F.col("l_linenumber").alias("position"), F.col("p_brand").alias("name_raw")),
        "mesh_terms": mesh.select("nct_id", F.lit("condition").alias("module"), F.lit("mesh").alias("kind"), F.col("condition_key").alias("mesh_id"), F.col("display_name").alias("term")).distinct(),
    }


REGISTRY_SQL = """
WITH lines AS (
  SELECT 'T' || lpad(l.l_orderkey::VARCHAR, 9, '0') AS nct_id, l.l_linenumber AS no, l.flag, l.quantity, p.p_name, p.p_brand, p.p_size,
         regexp_replace(lower(p.p_brand), '[^a-z0-9]', '', 'g') || 'x' || (p.p_size % 4) AS asset_id, CASE l.flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS arm_no
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS flag, min(l_quantity) AS quantity FROM lineitem GROUP BY ALL) l
  JOIN part p ON p.p_partkey = l.l_partkey
), lead AS (
  SELECT 'T' || lpad(o.o_orderkey::VARCHAR, 9, '0') AS nct_id, 'c' || c.c_nationkey AS company_id, n.n_name AS company_name,
         CASE WHEN c.c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'INDUSTRY' WHEN c.c_mktsegment = 'FURNITURE' THEN 'NIH' ELSE 'OTHER' END AS agency_class
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_custkey % 50 <> 0
), drugged AS (
  SELECT nct_id FROM lines WHERE p_size % 7 <> 0 GROUP BY nct_id
), spine AS (
  SELECT b.*, CASE b.phase_norm WHEN 'EARLY_PHASE1' THEN 0.5::DOUBLE WHEN 'PHASE1' THEN 1.0 WHEN 'PHASE2' THEN 2.0 WHEN 'PHASE3' THEN 3.0 WHEN 'PHASE4' THEN 4.0 END AS phase_rank,
         d.nct_id IS NOT NULL AS is_drug_trial, l.agency_class = 'INDUSTRY' AS is_industry, l.company_id AS lead_company_id, l.company_name AS lead_company_name, l.agency_class AS lead_agency_class,
         b.overall_status = 'RECRUITING' AS is_active_readout, b.overall_status = 'TERMINATED' AS is_inactive,
         b.overall_status = 'RECRUITING' OR (b.overall_status = 'COMPLETED' AND b.done IS NOT NULL AND b.done >= b.snapshot_date - INTERVAL 36 MONTH) AS program_exists
  FROM (SELECT 'T' || lpad(o_orderkey::VARCHAR, 9, '0') AS nct_id, CASE WHEN o_orderkey % 10 = 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
               CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'TERMINATED' END AS overall_status,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CASE o_orderpriority[1] WHEN '1' THEN 'PHASE4' WHEN '2' THEN 'PHASE3' WHEN '3' THEN 'PHASE2' WHEN '4' THEN 'PHASE1' WHEN '5' THEN 'EARLY_PHASE1' END END AS phase_norm,
               o_orderdate::DATE - 400 AS started, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS done, (o_orderdate::DATE + (o_custkey % 200)::INT) AS updated,
               (SELECT max(o_orderdate)::DATE FROM orders) AS snapshot_date FROM orders) b
  LEFT JOIN lead l ON l.nct_id = b.nct_id LEFT JOIN drugged d ON d.nct_id = b.nct_id
), width AS (
  SELECT nct_id, count(DISTINCT arm_no) AS n FROM lines GROUP BY nct_id
), roles AS (
  SELECT l.nct_id, l.asset_id, CASE WHEN bool_or(flag = 'A') THEN 'subject' WHEN bool_and(flag = 'R') THEN 'comparator' ELSE 'unknown' END AS role,
         CASE WHEN any_value(w.n) >= 2 THEN count(DISTINCT arm_no) = any_value(w.n) END AS in_all_arms
  FROM lines l JOIN width w ON w.nct_id = l.nct_id GROUP BY l.nct_id, l.asset_id
), uses AS (
  SELECT l.nct_id, l.no, l.arm_no, l.flag, l.asset_id, l.p_name, l.p_size, r.role, r.in_all_arms FROM lines l JOIN roles r ON r.nct_id = l.nct_id AND r.asset_id = l.asset_id
), cond AS (
  SELECT DISTINCT nct_id, p_name AS condition_key, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS display_name, 'mesh_leaf' AS source FROM lines WHERE flag = 'A'
  UNION ALL
  SELECT DISTINCT nct_id, lower(p_brand), p_brand, 'listed' FROM lines WHERE nct_id NOT IN (SELECT nct_id FROM lines WHERE flag = 'A')
), area AS (
  SELECT DISTINCT p_name AS condition_key, a AS area, i = 2 AS is_primary FROM (SELECT p_name, i, string_split(p_name, ' ')[i] AS a FROM part, (SELECT unnest([1, 2]) AS i)) WHERE a <> 'red'
), asset AS (
  SELECT asset_id, a.asset_id LIKE '%x0' AS is_combo, regexp_extract(asset_id, 'x([0-9])$', 1) AS n, regexp_extract(asset_id, '^brand([0-9]+)x', 1)::INT AS k
  FROM (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || 'x' || (p_size % 4) AS asset_id FROM part) a
), component AS (
  SELECT asset_id AS combo, regexp_replace(asset_id, 'x0$', '') || c AS asset_id FROM asset, (SELECT unnest(['x1', 'x2']) AS c) WHERE is_combo
), chembl AS (
  SELECT asset_id, 'Inhibitor of T' || (k % 5) AS label, 't' || (k % 5) AS moa_key, 'T' || (k % 5) AS targets FROM asset WHERE NOT is_combo AND (n = '1' OR (n = '2' AND k % 3 = 0))
), moa AS (
  SELECT asset_id, 'chembl' AS provenance, 1 AS tier, label AS moa_label, 'INHIBITOR' AS action, targets, NULL AS modality, moa_key FROM chembl
  UNION ALL SELECT asset_id, 'curated', 2, 'Hand-written', 'BINDER', 'H1', 'antibody', 'h1' FROM asset WHERE n = '2' AND k % 2 = 0
  UNION ALL SELECT asset_id, 'nlm_class', 3, 'Class ' || (k % 3), NULL, NULL, NULL, 'class' || (k % 3) FROM asset WHERE n IN ('2', '3') AND k % 5 < 3
  UNION ALL SELECT asset_id, 'llm', 4, CASE WHEN k % 2 = 0 THEN 'Guessed' WHEN k % 4 < 2 THEN 'G1, G2' ELSE '' END, 'UNKNOWN', CASE WHEN k % 4 < 2 THEN 'G1,G2' ELSE 'g raw' END, 'small molecule', CASE WHEN k % 9 = 0 THEN '' ELSE 'g1|g2' END
    FROM asset WHERE n IN ('0', '3') AND k % 7 <> 0
), dev AS (
  SELECT DISTINCT u.nct_id, u.asset_id, u.role, s.* EXCLUDE (nct_id), c.condition_key FROM uses u JOIN spine s ON s.nct_id = u.nct_id JOIN cond c ON c.nct_id = u.nct_id
  WHERE u.role <> 'comparator' AND s.study_type = 'INTERVENTIONAL'
), sponsored AS (
  SELECT s.* FROM spine s JOIN (SELECT DISTINCT 'c' || n_nationkey AS c FROM nation) x ON x.c = s.lead_company_id WHERE s.study_type = 'INTERVENTIONAL' AND s.is_drug_trial
), mention AS (
  SELECT DISTINCT nct_id, 'q' || floor(quantity / 10)::INT AS term_id, CASE WHEN quantity > 25 THEN 'biomarker' ELSE 'demographic' END AS kind, p_name AS evidence FROM lines WHERE quantity % 10 < 4
)
"""
