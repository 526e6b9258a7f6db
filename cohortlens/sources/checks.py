"""Keys, unique columns and enumerations as assertions, for Parquet does not enforce them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BrokenConstraint(AssertionError):
    pass


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise BrokenConstraint(f"not unique: {twice[0].asDict()}")
    return df


def assert_in_set(df: DataFrame, column: str, values: Sequence[str], nullable: bool = True) -> DataFrame:
    odd = ~F.col(column).isin(list(values))
    odd = odd if nullable else odd | F.col(column).isNull()
    found = df.where(odd).select(column).take(1)
    if found:
        raise BrokenConstraint(f"{column} holds {found[0][0]!r}")
    return df


#: table -> unique keys; (table, column) -> values
KEYS = {"studies": ["nct_id"], "interventions": ["nct_id", "intervention_no"], "arms": ["nct_id", "arm_no"], "assets": ["asset_id"], "asset_aliases": ["alias_key"], "companies": ["company_id"]}
VALUES = {("sponsors", "role"): ["lead", "collaborator"], ("arm_interventions", "via"): ["label", "name"], ("mesh_terms", "kind"): ["mesh", "ancestor"], ("mesh_terms", "module"): ["condition", "intervention"],
          ("trial_assets", "role"): ["subject", "comparator", "unknown"], ("trial_assets", "via"): ["name", "combo_component"], ("trial_conditions_norm", "source"): ["listed", "mesh_leaf"], ("asset_aliases", "source"): ["name", "other_name", "curated"]}


def check_tables(tables: dict[str, DataFrame]) -> None:
    for name, keys in KEYS.items():
        if name in tables:
            assert_unique(tables[name], keys)
    for (name, column), values in VALUES.items():
        if name in tables:
            assert_in_set(tables[name], column, values)
