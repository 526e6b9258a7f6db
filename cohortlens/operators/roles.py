"""Arm roles: what an asset is in a trial, over all its arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: arm types that make a subject, and those that make a comparator
SUBJECT_ARMS = ["EXPERIMENTAL"]
COMPARATOR_ARMS = ["ACTIVE_COMPARATOR", "PLACEBO_COMPARATOR", "SHAM_COMPARATOR", "NO_INTERVENTION"]


def assign_roles(intervention_assets: DataFrame, arm_interventions: DataFrame, arms: DataFrame) -> DataFrame:
    """nct_id, intervention_no, asset_id, via, role, in_all_arms.

    intervention_assets: nct_id, intervention_no, asset_id, via ('name' or 'combo_component').  A role is
    subject if any arm with the asset is experimental; comparator if every typed arm is a
    comparator; else unknown.  in_all_arms is null for fewer than two arms.  Of several ways to the same asset in an
    intervention the name stays."""
    linked = arm_interventions.select("nct_id", "arm_no", "intervention_no").join(arms.select("nct_id", "arm_no", F.col("type").alias("arm_type")), ["nct_id", "arm_no"], "left")
    wide = arms.groupBy("nct_id").agg(F.count_distinct("arm_no").alias("n_arms"))
    typed = F.col("arm_type").isNotNull()
    per = intervention_assets.join(linked, ["nct_id", "intervention_no"], "left").groupBy("nct_id", "asset_id").agg(
        F.bool_or(F.col("arm_type").isin(SUBJECT_ARMS)).alias("subject"),
        F.bool_and(F.when(typed, F.col("arm_type").isin(COMPARATOR_ARMS))).alias("compared"),
        F.count_distinct("arm_no").alias("n_in"),
    ).join(wide, "nct_id", "left")
    role = F.when(F.col("subject"), "subject").when(F.col("compared"), "comparator").otherwise("unknown")
    per = per.select("nct_id", "asset_id", role.alias("role"), F.when(F.col("n_arms") >= 2, F.col("n_in") == F.col("n_arms")).alias("in_all_arms"))
    ways = intervention_assets.groupBy("nct_id", "intervention_no", "asset_id").agg(F.max("via").alias("via"))  # 'name' > 'combo_component'
    return ways.join(per, ["nct_id", "asset_id"]).select("nct_id", "intervention_no", "asset_id", "via", "role", "in_all_arms")
