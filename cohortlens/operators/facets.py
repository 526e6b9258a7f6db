"""Evidence facets: cross-filtered tallies, matrices, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(facets: Sequence[str], picks: Mapping[str, Sequence[str]], but: str | None = None) -> Column:
    """Rows that fit all facets' picks but one's: any value within a facet, all facets together.  Facets are arrays."""
    tests = [F.arrays_overlap(f, F.array(*map(F.lit, picks[f]))) for f in facets if f != but and picks.get(f)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def tallies(rows: DataFrame, facets: Sequence[str], picks: Mapping[str, Sequence[str]], cited: str = "cited") -> DataFrame:
    """facet, value, n, n_cited: each facet counted under the picks of the others.  One pass: a row is exploded into
    (facet, value) pairs, each kept only where the other facets' picks hold.  A null facet has no values, and its row counts in the others."""
    none = F.array().cast("array<struct<facet:string,value:string>>")

    def pairs_of(facet: str) -> Column:
        pairs = F.transform(F.array_distinct(facet), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))
        return F.coalesce(F.when(chosen(facets, picks, facet), pairs), none)

    parts = [pairs_of(f) for f in facets]
    pairs = rows.select(cited, F.inline(F.concat(*parts)))
    return pairs.groupBy("facet", "value").agg(F.count("*").alias("n"), F.count_if(cited).alias("n_cited"))


def matrix(rows: DataFrame, row: str, column: str, columns: Sequence[str], value: Column) -> DataFrame:
    """A dense matrix with the given columns; missing cells are 0."""
    return rows.groupBy(row).pivot(column, list(columns)).agg(value).fillna(0, subset=list(columns))


def evidence_matrix(rows: DataFrame, row: str, column: str, cited: str = "cited", k: int = 8) -> DataFrame:
    """row, column, n, n_cited of the k row labels with most rows (ties: the least label); nulls read unknown."""
    named = rows.select(F.coalesce(F.col(row), F.lit("unknown")).alias(row), F.coalesce(F.col(column), F.lit("unknown")).alias(column), cited)
    cells = named.groupBy(row, column).agg(F.count("*").alias("n"), F.count_if(cited).alias("n_cited"))
    most = cells.groupBy(row).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), row).limit(k).select(row)
    return cells.join(F.broadcast(most), row)


def ranked_evidence(rows: DataFrame, k: int = 40) -> DataFrame:
    """Cited first, then mentioned, then by phase, then by id."""
    return rows.orderBy(F.desc("cited"), F.desc("mentioned"), F.col("phase_rank").desc_nulls_last(), "nct_id").limit(k)


def reference_check(cells: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """cells (label, value) against reference (id, name, value): a label matches an id before a lower-cased name; values
    agree within the tolerance.  status: match, differs or unknown."""
    key = F.lower(F.trim("label"))
    names = reference.select(F.lower(F.trim("id")).alias("key"), "value", F.lit(0).alias("by")).union(reference.select(F.lower(F.trim("name")), "value", F.lit(1)))
    best = names.groupBy("key").agg(F.min(F.struct("by", "value")).alias("r"))
    found = cells.withColumn("key", key).join(best, "key", "left")
    status = F.when(F.col("r").isNull(), "unknown").when(F.abs(F.col("value") - F.col("r.value")) <= tolerance, "match").otherwise("differs")
    return found.select("label", "value", F.col("r.value").alias("expected"), status.alias("status"))
