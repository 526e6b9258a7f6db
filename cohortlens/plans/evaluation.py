"""Scoring of answers against gold cases, floors, and planted defects that floors must catch.

answers: case_id, answer_md, caveats array<string>, citations array<struct<nct_id, why>>, entities array<struct<kind, id>>,
table struct<columns, rows array<array<string>>> (may be null).
gold: case_id, kind, entities, ncts, k, must_mention, must_not_mention, borderline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import malformed_study_ids, study_ids

from .serving import entity_violations

TEXTS = "array<string>"


def norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(TEXTS))


def _rows() -> Column:
    return F.coalesce(F.col("table.rows"), F.array().cast(f"array<{TEXTS}>"))


def _said(rows: Column) -> Column:
    """Normalised names in the first two cells of rows, with and without what is in brackets."""
    cells = F.filter(F.flatten(F.transform(rows, lambda r: F.slice(r, 1, 2))), lambda c: c.isNotNull() & ~c.rlike(r"^NCT\d{8}$"))
    return F.flatten(F.transform(cells, lambda c: F.array(norm(c), norm(F.substring_index(c, "(", 1)))))


def entity_surface() -> Column:
    named = F.transform(F.coalesce(F.col("entities.id"), F.array().cast(TEXTS)), norm)
    return F.filter(F.array_distinct(F.concat(named, _said(_rows()))), lambda s: s != "")


def study_surface() -> Column:
    text = F.concat_ws("\n", F.col("answer_md"), F.array_join(F.flatten(_rows()), " "))
    return F.array_distinct(F.concat(F.coalesce(F.col("citations.nct_id"), F.array().cast(TEXTS)), study_ids(text)))


def hits(expected: Column, surface: Column) -> Column:
    """Those of expected that the surface holds: equal, or one inside the other from four characters on."""
    return F.filter(expected, lambda e: F.exists(surface, lambda s: (norm(e) == s) | ((F.length(norm(e)) >= 4) & (F.contains(s, norm(e)) | F.contains(norm(e), s)))))


def score_cases(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, kind, score, role (DIAG for borderline cases), hard_failure (no answer)."""
    a = answers.select("case_id", "answer_md", "caveats", "citations", F.col("entities").alias("_entities"), "table")
    rows = gold.withColumnRenamed("entities", "expected").join(a, "case_id", "left").withColumnRenamed("_entities", "entities")
    rows = rows.withColumns({"_surface": entity_surface(), "_text": F.lower(F.concat_ws(" ", "answer_md", F.array_join(_list("caveats"), " ")))})
    mentions = lambda m: F.contains(F.col("_text"), F.lower(m))
    expected, size = _list("expected"), F.size(_list("expected"))
    share = lambda n: F.when(size > 0, n / size).otherwise(1.0)
    prose = norm(F.col("answer_md"))
    all_hits = F.array_distinct(F.concat(hits(expected, F.col("_surface")), F.filter(expected, lambda e: (F.length(norm(e)) >= 4) & F.contains(prose, norm(e)))))
    top = F.when(F.col("table").isNotNull() & F.col("k").isNotNull() & (F.size(_rows()) > 0), _said(F.slice(_rows(), 1, F.col("k")))).otherwise(F.col("_surface"))
    wanted, banned = _list("must_mention"), _list("must_not_mention")
    missing = F.size(F.filter(wanted, lambda m: ~mentions(m)))
    absence = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("no "), F.lit("not ")))
    has_table = F.size(_rows()) > 0
    honest = (F.size(F.coalesce(F.col("citations.nct_id"), F.array().cast(TEXTS))) == 0) & ~((F.size(F.coalesce(F.col("entities.id"), F.array().cast(TEXTS))) > 0) & has_table) & F.exists(absence, mentions)
    kind = F.col("kind")
    score = (
        F.when(kind == "contains_all", share(F.size(all_hits))).when(kind == "top_k_contains", share(F.size(hits(expected, top))))
        .when(kind == "refuse_approval", F.when(F.exists(banned, mentions), 0.0).otherwise(1.0)).when(kind == "honest_empty", honest.cast("double"))
        .when(kind.isin("role_split", "states_rollup"), 1.0 - missing / F.greatest(F.size(wanted), F.lit(1))).otherwise(1.0)
    )
    halved = (missing > 0) & ~kind.isin("role_split", "states_rollup", "honest_empty")
    none = F.col("answer_md").isNull()
    return rows.select("case_id", "kind", F.when(none, 0.0).otherwise(F.when(halved, score * 0.5).otherwise(score)).alias("score"), F.when(F.col("borderline"), "DIAG").otherwise("OBJ").alias("role"), none.cast("int").alias("hard_failure"))


def floors(answers: DataFrame, retrieved: DataFrame, seen: DataFrame) -> DataFrame:
    """case_id and counts that have to be 0: ungrounded studies (in prose or table), fabricated citations, malformed ids, ungrounded entities."""
    text = F.concat_ws("\n", F.col("answer_md"), F.array_join(F.flatten(_rows()), " "))
    known = retrieved.select("case_id", "id").distinct()

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("case_id").agg(F.count("*").alias(name))

    named = answers.select("case_id", F.explode(study_ids(text)).alias("id")).distinct().join(known, ["case_id", "id"], "left_anti")
    cited = answers.select("case_id", F.explode("citations.nct_id").alias("id")).distinct().join(known, ["case_id", "id"], "left_anti")
    odd = answers.select("case_id", F.explode(malformed_study_ids(text)).alias("id"))
    strange = entity_violations(answers.select("case_id", F.col("entities.id").alias("entities")), seen, "case_id")
    out = answers.select("case_id")
    for rows, name in ((named, "ungrounded_study"), (cited, "fabricated_citation"), (odd, "malformed_id"), (strange, "ungrounded_entity")):
        out = out.join(count(rows, name), "case_id", "left")
    return out.fillna(0)


def reconciles(partners: DataFrame, programs: DataFrame, asset: str, condition: str, text: str) -> bool:
    """Whether a text names both counts (trials with partners, trials of the program), and the first is no larger."""
    here = (F.col("asset_id") == asset) & (F.col("condition_key") == condition)
    combo = partners.where(here).agg(F.count_distinct("nct_id")).first()[0]
    program = programs.where(here).agg(F.coalesce(F.max("n_trials"), F.lit(0))).first()[0]
    numbers = {int(n.replace(",", "")) for n in re.findall(r"\b\d[\d,]*\b", text)}
    return {combo, program} <= numbers and combo <= program


def present(ids: DataFrame, studies: DataFrame) -> DataFrame:
    """Gold ids that the index holds; recall is asked of those only."""
    return ids.join(studies.select(F.col("nct_id").alias("id")), "id", "left_semi")


#: Planted defects, and the floor that each has to break.
DEFECTS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "study nobody retrieved": (lambda df: df.withColumn("answer_md", F.concat("answer_md", F.lit(" Also NCT09999999."))), "ungrounded_study"),
    "seven digits": (lambda df: df.withColumn("answer_md", F.concat("answer_md", F.lit(" And NCT1234567."))), "malformed_id"),
    "citation of another study": (lambda df: df.withColumn("citations", F.array(F.struct(F.lit("NCT00000099").alias("nct_id"), F.lit("planted").alias("why")))), "fabricated_citation"),
    "entity nobody saw": (lambda df: df.withColumn("entities", F.concat("entities", F.array(F.struct(F.lit("drug").alias("kind"), F.lit("planted").alias("id"))))), "ungrounded_entity"),
    "study in a table cell": (lambda df: df.withColumn("table", F.struct(F.col("table.columns").alias("columns"), F.concat("table.rows", F.array(F.array(F.lit("planted"), F.lit("NCT08888888")))).alias("rows"))), "ungrounded_study"),
}
