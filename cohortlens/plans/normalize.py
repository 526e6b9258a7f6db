"""Raw tables to entities and edges: assets, conditions, companies, populations, drug classes.

Every step is a DataFrame; text rules run once for each distinct value.  The driver keeps counters, and loops only to merge alias clusters to
their fixpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import folds, names, populations
from cohortlens.functions.fixed import CLASS_HINT
from cohortlens.functions.lexicon import Lexicon
from cohortlens.functions.scalars import is_code_name
from cohortlens.operators import resolution
from cohortlens.operators.ranking import mode, set_rollup
from cohortlens.operators.roles import assign_roles

from .views import DRUG_TYPES, UNCLASSIFIED, Tables


def known_words(first: DataFrame, interventions: DataFrame) -> DataFrame:
    """key: keys of one-word names in at least two trials.  first: the names, routed."""
    single = first.where("key IS NOT NULL AND NOT is_combo AND NOT contains(trim(cleaned), ' ')").select("name_raw", "key")
    return interventions.join(single, "name_raw").groupBy("key").agg(F.count_distinct("nct_id").alias("n")).where("n >= 2").select("key")


def alias_claims(rows: DataFrame, other: DataFrame) -> DataFrame:
    """alias, owner, trial, surface, code: what other names claim.  On long lists a name asserted by one trial only counts if it is a
    code or shares a word with the intervention."""
    kept = other.where("alias IS NOT NULL AND NOT alias_combo").join(rows.where("key IS NOT NULL AND NOT is_combo").select("nct_id", "intervention_no", "key", "cleaned"), ["nct_id", "intervention_no"])
    listed = Window.partitionBy("nct_id", "intervention_no")
    trials = kept.groupBy("alias").agg(F.count_distinct("nct_id").alias("n_trials"))
    kept = kept.withColumn("listed", F.count("*").over(listed)).join(trials, "alias")
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit("[a-z0-9]{4,}"), F.lit(0))
    inside = (F.length("alias") >= 5) & (F.contains("key", "alias") | F.contains("alias", "key"))
    related = F.col("code") | inside | F.arrays_overlap(words("cleaned"), words("alias_cleaned"))
    odd = (F.col("listed") >= resolution.LONG_LIST) & (F.col("n_trials") == 1) & ~related
    return kept.where(~odd & (F.col("alias") != F.col("key"))).select("alias", F.col("key").alias("owner"), F.col("nct_id").alias("trial"), F.col("alias_display").alias("surface"), "code")


def normalize_assets(t: Tables, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    lexicon = lexicon or Lexicon()
    used = t["interventions"].where(F.col("type").isin(DRUG_TYPES)).select("nct_id", "intervention_no", "name_raw")
    routed = resolution.checkpointed(names.routed(used, lexicon, known_words(names.routed(used, lexicon), used)))
    rows = used.join(routed, "name_raw")
    other = t["intervention_other_names"].withColumnRenamed("other_name_raw", "name_raw")
    others = names.routed(other, lexicon).select("name_raw", F.col("key").alias("alias"), F.col("is_combo").alias("alias_combo"), F.col("cleaned").alias("alias_cleaned"), F.col("display").alias("alias_display"), is_code_name(F.col("name_raw")).alias("code"))
    claims = resolution.checkpointed(alias_claims(rows, other.join(others, "name_raw")))

    # clusters: every component key is a vertex; curated synonyms are united first
    parts = rows.where("key IS NOT NULL").select("nct_id", "intervention_no", "is_combo", "display", F.explode("parts").alias("p")).select("nct_id", "intervention_no", "is_combo", F.col("p.key").alias("key"), F.when(F.col("is_combo"), F.col("p.surface")).otherwise(F.col("display")).alias("surface"))
    spark = used.sparkSession
    router = names.Router(lexicon)
    groups = [[r.key for m in g if (r := router.route(m)).key and not r.is_combo] for g in lexicon.synonyms]
    curated = spark.createDataFrame([p for g in groups for p in zip(g, g[1:], strict=False)], "a string, b string")
    shown = spark.createDataFrame([(r.key, router.display(m)) for g in lexicon.synonyms for m in g if (r := router.route(m)).key and not r.is_combo], "key string, surface string")
    keys = parts.select(F.col("key").alias("id")).union(shown.select("key")).distinct()
    roots = resolution.merge_fixpoint(keys, claims.select("alias", "owner", "trial"), curated)

    # the canonical surface of a cluster: no code, not all capitals, frequent, in many trials, short, then last by name
    named = parts.join(roots.withColumnRenamed("id", "key"), "key")
    trials = parts.groupBy("key").agg(F.count_distinct("nct_id").alias("n_key"))
    surfaces = named.groupBy("root", "key", "surface").agg(F.count("*").alias("n")).join(trials, "key").withColumn("code", is_code_name(F.col("surface")))
    best = surfaces.groupBy("root").agg(F.max(F.struct(~F.col("code"), F.col("surface") != F.upper("surface"), F.col("n"), F.col("n_key"), (-F.length("surface")).alias("short"), F.col("surface").alias("name"), F.col("key").alias("asset_id"), F.col("code").alias("is_code"))).alias("b"))
    best = best.select("root", F.when(F.col("b.is_code"), F.upper("b.name")).otherwise(F.col("b.name")).alias("canonical_name"), F.col("b.asset_id").alias("asset_id"))
    lone = roots.join(best.select("root"), "root", "left_anti").groupBy("root").agg(F.min("id").alias("asset_id")).select("root", F.col("asset_id").alias("canonical_name"), "asset_id")
    best = best.unionByName(lone)
    asset_of = resolution.checkpointed(roots.join(best, "root").select(F.col("id").alias("key"), "asset_id"))

    # a brand in brackets: the first ® or ™ name of an asset
    branded = other.where(F.col("name_raw").rlike("[®™]")).join(rows.where("key IS NOT NULL AND NOT is_combo").select("nct_id", "intervention_no", "key"), ["nct_id", "intervention_no"]).join(asset_of, "key").join(others.select("name_raw", "alias_display"), "name_raw")
    brand = branded.groupBy("asset_id").agg(F.min(F.struct("nct_id", "intervention_no", "name_raw", "alias_display"))["alias_display"].alias("brand"))
    plain = best.select("asset_id", "canonical_name").join(brand, "asset_id", "left")
    differs = F.col("brand").isNotNull() & (F.lower("brand") != F.lower("canonical_name"))
    single = plain.select("asset_id", F.when(differs, F.concat("canonical_name", F.lit(" ("), "brand", F.lit(")"))).otherwise(F.col("canonical_name")).alias("canonical_name"), F.col("asset_id").alias("dedup_key"), F.lit(False).alias("is_combo"))

    # combinations, keyed again by their components' assets; those that merged to one asset are that asset
    made = parts.join(asset_of, "key").groupBy("nct_id", "intervention_no").agg(F.array_sort(F.collect_set("asset_id")).alias("ids"))
    made = made.withColumn("whole", F.array_join("ids", "+"))
    combos = made.where(F.size("ids") > 1).select("whole", "ids").distinct()
    title = combos.select("whole", F.posexplode("ids").alias("at", "asset_id")).join(best.select("asset_id", "canonical_name"), "asset_id").groupBy("whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical_name"))), lambda s: s["canonical_name"]), " + ").alias("canonical_name"))
    assets = single.unionByName(title.select(F.col("whole").alias("asset_id"), "canonical_name", F.col("whole").alias("dedup_key"), F.lit(True).alias("is_combo")))
    components = combos.select(F.col("whole").alias("combo_asset_id"), F.explode("ids").alias("component_asset_id"))
    by_name = made.select("nct_id", "intervention_no", F.col("whole").alias("asset_id"), F.lit("name").alias("via"))
    by_part = made.where(F.size("ids") > 1).select("nct_id", "intervention_no", F.explode("ids").alias("asset_id"), F.lit("combo_component").alias("via"))

    # aliases: one asset each; names before other names before curated ones
    support = resolution.checkpointed(resolution.alias_support(claims.select("alias", "owner", "trial"), roots))
    own = roots.select(F.col("id").alias("alias"), F.col("root").alias("own"))
    decided = resolution.decide_aliases(support).join(own, "alias", "left")
    clash = F.col("own").isNotNull() & (F.col("own") != F.col("root"))
    decided = decided.withColumn("decision", F.when(clash, "vetoed").otherwise(F.col("decision")))
    by_root = best.select("root", "asset_id")
    given = decided.where("decision <> 'vetoed'").join(by_root, "root").join(mode(claims, ["alias"], "surface").select("alias", "surface"), "alias")
    listed = (
        asset_of.join(parts.select("key").distinct(), "key").join(mode(parts, ["key"], "surface").select("key", "surface"), "key").select(F.col("key").alias("alias_key"), "asset_id", F.col("surface").alias("alias_raw"), F.lit("name").alias("source"), F.lit(0).alias("rank"))
        .union(given.select(F.col("alias").alias("alias_key"), "asset_id", F.col("surface").alias("alias_raw"), F.lit("other_name").alias("source"), F.lit(1).alias("rank")))
        .union(asset_of.join(shown, "key").select(F.col("key").alias("alias_key"), "asset_id", F.col("surface").alias("alias_raw"), F.lit("curated").alias("source"), F.lit(2).alias("rank")))
        .union(combos.join(title, "whole").select(F.col("whole").alias("alias_key"), F.col("whole").alias("asset_id"), F.col("canonical_name").alias("alias_raw"), F.lit("name").alias("source"), F.lit(0).alias("rank")))
    )
    aliases = listed.groupBy("alias_key").agg(F.min(F.struct("rank", "asset_id", "alias_raw", "source")).alias("a")).select("alias_key", "a.asset_id", "a.alias_raw", "a.source")
    claimants = support.join(by_root, "root").groupBy("alias").agg(F.array_sort(F.collect_set("asset_id")).alias("asset_ids"), F.sum("n").alias("n_trials"))
    contested = decided.where("decision <> 'sole'").join(claimants, "alias").join(by_root, "root", "left").select(F.col("alias").alias("alias_key"), "asset_ids", "n_trials", F.when(F.col("decision") == "dominance", F.concat(F.lit("dominance:"), "asset_id")).otherwise(F.col("decision")).alias("resolution"))
    gates = rows.groupBy(F.coalesce("reason", F.concat(F.lit("route_"), "route")).alias("reason")).agg(F.count("*").alias("n"))
    return {
        "assets": assets, "asset_components": components, "asset_aliases": aliases, "contested_aliases": contested, "gate_census": gates,
        "trial_assets": assign_roles(by_name.union(by_part), t["arm_interventions"], t["arms"]),
    }


def normalize_conditions(t: Tables, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    lexicon = lexicon or Lexicon()
    listed = t["study_conditions"].where("name_raw IS NOT NULL").select("nct_id", F.trim("name_raw").alias("name_raw"))
    folded = listed.select("name_raw").distinct().withColumn("folded", folds.fold_condition(F.col("name_raw")))
    listed = listed.join(folded, "name_raw").withColumn("reason", folds.denoise_reason(F.col("folded")))
    kept = listed.where("reason IS NULL")
    shown = mode(kept, ["folded"], "name_raw").select("folded", F.col("name_raw").alias("display_name"))
    leaves = t["mesh_terms"].where("module = 'condition' AND kind = 'mesh' AND mesh_id IS NOT NULL").select("nct_id", "mesh_id", "term").distinct()
    norm = kept.select("nct_id", "folded").distinct().join(shown, "folded").select("nct_id", F.col("folded").alias("condition_key"), "display_name", F.lit("listed").alias("source"))
    norm = norm.union(leaves.select("nct_id", F.col("mesh_id").alias("condition_key"), F.col("term").alias("display_name"), F.lit("mesh_leaf").alias("source")))
    # areas of a leaf: headings above it in trials where it is the only leaf, else in all its trials; its own term counts
    alone = leaves.groupBy("nct_id").agg((F.count_distinct("mesh_id") == 1).alias("solo"))
    above = t["mesh_terms"].where("module = 'condition' AND kind = 'ancestor'").select("nct_id", F.col("term").alias("heading")).distinct()
    headings = set_rollup(leaves.join(alone, "nct_id").join(above, "nct_id", "left").select("mesh_id", "nct_id", "solo", "heading"), "mesh_id", "nct_id", "heading", "solo").where("heading IS NOT NULL").union(leaves.select("mesh_id", "term")).distinct()
    rules = F.broadcast(t["mesh_terms"].sparkSession.createDataFrame([(h, a, i) for i, (h, a) in enumerate(lexicon.areas) if h not in lexicon.excluded_headings], "heading string, area string, place int"))
    hits = headings.join(rules, "heading").groupBy("mesh_id", "area").agg(F.min("place").alias("place"))
    areas = hits.select(F.col("mesh_id").alias("condition_key"), "area", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("place")) == 1).alias("is_primary"))
    bare = norm.select("condition_key").distinct().join(areas.select("condition_key").distinct(), "condition_key", "left_anti")
    areas = areas.union(bare.select("condition_key", F.lit(UNCLASSIFIED), F.lit(True)))
    return {"trial_conditions_norm": norm, "condition_denoised": listed.where("reason IS NOT NULL").select("nct_id", "name_raw", "folded", "reason"), "condition_areas": areas}


def normalize_companies(t: Tables, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    rules = folds.Companies(lexicon)
    s = folds.applied(t["sponsors"].where("name_raw IS NOT NULL"), "name_raw", "company_id", rules.key)
    common = mode(s, ["company_id"], "name_raw")
    named = t["sponsors"].sparkSession.createDataFrame(list(rules.names.items()), "company_id string, curated string")
    companies = common.join(F.broadcast(named), "company_id", "left").select("company_id", F.coalesce("curated", "name_raw").alias("canonical_name"))
    aliases = s.select("company_id", "name_raw").distinct().withColumn("alias_key", F.regexp_replace(F.lower("name_raw"), r"[^\p{L}\p{N}]+", " ")).groupBy("alias_key").agg(F.min(F.struct("name_raw", "company_id")).alias("a"))
    return {"companies": companies, "company_aliases": aliases.select("alias_key", "a.company_id", F.col("a.name_raw").alias("alias_raw")), "trial_sponsors_norm": s.select("nct_id", "role", "company_id", "agency_class")}


def normalize_populations(t: Tables, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    lexicon = lexicon or Lexicon()
    listed = t["study_conditions"].groupBy("nct_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name_raw"))), lambda c: c["name_raw"]), "\n").alias("listed"))
    studies = t["studies"].select("nct_id", "brief_title", "eligibility_criteria").join(listed, "nct_id", "left")
    surfaces = {"title": F.col("brief_title"), "condition": F.col("listed"), "eligibility": F.col("eligibility_criteria")}
    terms = t["studies"].sparkSession.createDataFrame([(term, kind) for term, kind, _ in lexicon.populations], "term_id string, kind string")
    return {"population_mentions": populations.mentions(studies, surfaces, lexicon.populations), "population_terms": terms}


def normalize_drug_classes(t: Tables, aliases: DataFrame, trial_assets: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """asset_id, class_term, mesh_id, n_trials, moa_key: class terms above the leaf of the only matched asset of a trial."""
    terms = t["mesh_terms"].where("module = 'intervention' AND term IS NOT NULL").select("nct_id", "kind", "mesh_id", F.col("term").alias("name_raw"))
    key = names.routed(terms.where("kind = 'mesh'"), lexicon).where("key IS NOT NULL").select("name_raw", F.col("key").alias("alias_key"))
    matched = terms.where("kind = 'mesh'").join(key, "name_raw").join(aliases.select("alias_key", "asset_id"), "alias_key").join(trial_assets.where("via = 'name'").select("nct_id", "asset_id").distinct(), ["nct_id", "asset_id"])
    one = matched.groupBy("nct_id").agg(F.count_distinct("asset_id").alias("n"), F.min("asset_id").alias("asset_id")).where("n = 1").drop("n")
    classes = terms.where("kind = 'ancestor'").where(F.col("name_raw").rlike(f"(?i){CLASS_HINT}")).join(one, "nct_id").groupBy("asset_id", F.col("name_raw").alias("class_term"), "mesh_id").agg(F.count_distinct("nct_id").cast("int").alias("n_trials"))
    return classes.withColumn("moa_key", folds.mechanism_key(F.col("class_term")))


def normalize(t: Tables, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    """The raw tables and all entity tables."""
    out = dict(t) | normalize_assets(t, lexicon) | normalize_conditions(t, lexicon) | normalize_companies(t, lexicon) | normalize_populations(t, lexicon)
    out["asset_nlm_classes"] = normalize_drug_classes(t, out["asset_aliases"], out["trial_assets"], lexicon)
    return out
