"""Mechanism tiers: an external vocabulary, curated entries, and a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import folds
from cohortlens.functions.scalars import alias_key, cost_of, edge_key
from cohortlens.operators.ranking import budget_prefix, last_wins, top_per_group

from . import views
from .views import Tables


def match_vocabulary(assets: DataFrame, aliases: DataFrame, molecules: DataFrame, mechanisms: DataFrame) -> dict[str, DataFrame]:
    """External mechanisms joined to assets on exactly equal folded names.

    assets: asset_id, is_combo; aliases: alias_key, asset_id; molecules: molecule_id, name (one row a name); mechanisms: molecule_id,
    mechanism_of_action, action_type, target, target_symbols.  An asset whose names reach several molecules is kept only if those have the
    same mechanisms.  -> chembl_moa, asset_chembl, ambiguous."""
    folded = molecules.withColumn("alias_key", alias_key(F.col("name"))).select("alias_key", "molecule_id").distinct()
    reach = aliases.join(assets.where("NOT is_combo").select("asset_id"), "asset_id").join(folded, "alias_key").groupBy("asset_id", "molecule_id").agg(F.min("alias_key").alias("matched_alias"))
    sign = mechanisms.groupBy("molecule_id").agg(F.array_sort(F.collect_set(F.struct("mechanism_of_action", F.coalesce("action_type", F.lit("")).alias("action"), F.array_sort("target_symbols").alias("symbols")))).alias("signature"))
    signed = reach.join(sign, "molecule_id", "left")
    n = signed.groupBy("asset_id").agg(F.count_distinct(F.coalesce(F.to_json("signature"), F.lit(""))).alias("signatures"), F.count("*").alias("molecules"))
    sure = n.where("signatures = 1").select("asset_id")
    edges = reach.join(sure, "asset_id").join(mechanisms, "molecule_id").withColumn("edge_key", edge_key(F.col("asset_id"), F.col("target_symbols"), F.col("target"), F.col("action_type")))
    edges = edges.groupBy("edge_key").agg(F.min(F.struct("asset_id", "molecule_id", "mechanism_of_action", "action_type", "target_symbols")).alias("e")).select("edge_key", "e.*")
    return {"chembl_moa": edges.withColumn("moa_key", folds.mechanism_key(F.col("mechanism_of_action"))), "asset_chembl": reach.join(sure, "asset_id"), "ambiguous": n.where("signatures > 1")}


def target_vocabulary(*sources: DataFrame) -> DataFrame:
    """alias_key, symbol: the first source that has a key wins.  Each source: alias, symbol."""
    ranked = None
    for place, s in enumerate(sources):
        part = s.select(alias_key(F.col("alias")).alias("alias_key"), "symbol", F.lit(place).alias("place"))
        ranked = part if ranked is None else ranked.union(part)
    return ranked.groupBy("alias_key").agg(F.min(F.struct("place", "symbol"))["symbol"].alias("symbol"))


def load_curated(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Curated mechanisms, each on the asset of its first name that resolves.  entries: name, aliases, moa, action, targets, modality."""
    tried = entries.select("*", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "surface")).withColumn("alias_key", alias_key(F.col("surface")))
    first = tried.join(aliases.select("alias_key", "asset_id"), "alias_key").groupBy("name").agg(F.min(F.struct("at", "asset_id"))["asset_id"].alias("asset_id"))
    rows = entries.join(first, "name").select("asset_id", F.col("moa").alias("moa_label"), "action", F.col("targets").alias("target_symbols"), "modality")
    return rows.withColumn("moa_key", folds.mechanism_key(F.col("moa_label")))


def load_model_answers(records: DataFrame, assets: DataFrame, targets: DataFrame) -> DataFrame:
    """A model's settled answers for known assets, the last for each; targets checked against the vocabulary.

    records: asset_id, settled_at, settled, moa_class, action, targets_raw, modality, abstained."""
    last = last_wins(records.where("settled"), ["asset_id"], ["settled_at"]).join(assets.select("asset_id"), "asset_id", "left_semi")
    said = last.select("asset_id", F.explode("targets_raw").alias("alias")).withColumn("alias_key", alias_key(F.col("alias"))).join(targets, "alias_key").groupBy("asset_id").agg(F.array_sort(F.collect_set("symbol")).alias("targets_canonical"))
    rows = last.join(said, "asset_id", "left").withColumn("targets_canonical", F.coalesce("targets_canonical", F.array().cast("array<string>")))
    label = F.when(F.size("targets_canonical") > 0, F.array_join("targets_canonical", " ")).otherwise(F.coalesce("moa_class", F.lit("")))
    return rows.withColumn("moa_key", folds.mechanism_key(label))


def plan_enrichment(t: Tables, input_tokens: int, output_tokens: int, input_price: float, output_price: float, ceiling: float) -> DataFrame:
    """Assets in scope without a tier-1 mechanism, in a fixed pseudo-random order up to the cost ceiling, with their three best trials."""
    scope = views.trials(t).where("study_type = 'INTERVENTIONAL' AND is_drug_trial AND is_industry AND program_exists")
    dev = t["trial_assets"].where(F.col("role").isin(views.DEVELOPING)).join(scope, "nct_id")
    open_ = dev.select("asset_id").distinct().join(t["chembl_moa"].select("asset_id"), "asset_id", "left_anti")
    priced = open_.withColumns({"order": F.xxhash64("asset_id"), "cost": cost_of(F.lit(input_tokens), F.lit(output_tokens), input_price, output_price)})
    chosen = budget_prefix(priced, ["order", "asset_id"], "cost", ceiling)
    best = top_per_group(dev.join(chosen.select("asset_id"), "asset_id", "left_semi"), ["asset_id"], [F.col("phase_rank").desc_nulls_last(), F.col("last_update_date_parsed").desc_nulls_last(), "nct_id"], 3)
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("phase_rank").desc_nulls_last(), "nct_id"))
    context = best.withColumn("at", place).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "nct_id", "brief_title"))), lambda s: F.concat_ws(" ", s["nct_id"], s["brief_title"])).alias("context"))
    return chosen.join(context, "asset_id", "left").select("asset_id", "cost", "spent", "context")
