"""Profiles, the grounding gate, and a read-only SQL surface."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import malformed_study_ids, study_ids

from . import views
from .views import Tables, sorted_set

MOST_PROFILED, MOST_ROWS, MOST_TURNS, MOST_IDS = 2000, 200, 20, 100_000


def profile_trials(spark: SparkSession, t: Tables, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row of facts for each asked-for study, and the ids that aren't there.  At most MOST_PROFILED ids."""
    wanted = sorted({i.strip().upper() for i in ids})
    if len(wanted) > MOST_PROFILED:
        raise ValueError(f"more than {MOST_PROFILED} ids")
    asked = F.broadcast(spark.createDataFrame([(i,) for i in wanted], "nct_id string"))
    base = views.trials(t).join(asked, "nct_id", "left_semi")
    conds = views.trial_conditions_primary(t).join(asked, "nct_id", "left_semi").groupBy("nct_id").agg(sorted_set("condition_key").alias("conditions"))
    used = t["trial_assets"].join(asked, "nct_id", "left_semi")
    assets = used.groupBy("nct_id").agg(sorted_set("asset_id").alias("assets"))
    source = used.join(views.moa(t).select("asset_id", "provenance"), "asset_id").groupBy("nct_id").agg(F.min("provenance").alias("provenance"))
    rows = base.select("nct_id", "overall_status", "phase_norm", F.year("start_date_parsed").alias("start_year"))
    for part in (conds, assets, source):
        rows = rows.join(part, "nct_id", "left")
    return rows, asked.join(base.select("nct_id"), "nct_id", "left_anti")


STUDY_NUMBER = r"^NCT[0-9]{8}$"


def get_trial(t: Tables, nct_id: str, shape: str = STUDY_NUMBER) -> DataFrame:
    """The card of one study (no row if it isn't there); the filter on its id reaches every scan."""
    if not re.match(shape, nct_id or ""):
        raise ValueError(f"an id has to match {shape}")
    return views.trial_card(t).where(F.col("nct_id") == nct_id)


def trial_entity_ids(t: Tables) -> DataFrame:
    """nct_id, entity: what a study's card names, once each: ids of its assets, conditions, population terms and lead company.  Read from the edges
    that the card is made of, without its nested lists."""
    edges = [(t["trial_assets"].where("via = 'name'"), "asset_id"), (views.trial_conditions_primary(t), "condition_key"), (t["population_mentions"], "term_id"), (views.trials(t), "lead_company_id")]
    return reduce(DataFrame.union, [df.select("nct_id", F.col(c).alias("entity")) for df, c in edges]).where("entity <> ''").distinct()


def grounding_violations(answers: DataFrame, retrieved: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """key, id, violation: study ids that an answer names but its run did not retrieve, and ids of a wrong length."""
    named = answers.select(key, F.explode(study_ids(F.col(text))).alias("id")).distinct()
    missing = named.join(retrieved.select(key, "id").distinct(), [key, "id"], "left_anti").withColumn("violation", F.lit("not retrieved"))
    odd = answers.select(key, F.explode(malformed_study_ids(F.col(text))).alias("id")).distinct().withColumn("violation", F.lit("malformed"))
    return missing.unionByName(odd)


def entity_violations(answers: DataFrame, seen: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    """key, entity: entities of an answer (array) that its run has not seen, without regard to case."""
    named = answers.select(key, F.explode(entities).alias("entity")).distinct().withColumn("_e", F.lower("entity"))
    known = seen.select(key, F.lower("entity").alias("_e")).distinct()
    return named.join(known, [key, "_e"], "left_anti").drop("_e")


def recent_turns(turns: DataFrame, conversation: str, order: str, k: int = MOST_TURNS) -> DataFrame:
    from cohortlens.operators.ranking import top_per_group

    return top_per_group(turns, [conversation], [F.desc(order)], k)


class RejectedSql(ValueError):
    """A statement that the read-only surface does not run."""


#: Functions that reach outside a query.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "current_user", "session_user", "user", "version", "getvariable", "read_files", "sleep"}


def _nodes(plan: Any) -> Iterable[Any]:
    """Every node of a parsed plan, with the plans inside expressions."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        for seq in (node.children(), node.innerChildren(), node.subqueries() if hasattr(node, "subqueries") else None):
            if seq is not None:
                it = seq.iterator()
                while it.hasNext():
                    child = it.next()
                    if hasattr(child, "getClass"):
                        stack.append(child)


def validate_sql(spark: SparkSession, text: str, relations: Iterable[str]) -> str:
    """text, if it is one SELECT or WITH over the given relations and calls no forbidden function.  The parser
    decides, so semicolons and keywords inside literals and comments are harmless."""
    body = re.sub(r"^(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", text, flags=re.S).strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", body):
        raise RejectedSql("only SELECT and WITH are run")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise RejectedSql(f"it does not parse: {str(e).splitlines()[0]}") from None
    tree = plan.treeString()
    roots = {n.getClass().getSimpleName() for n in _nodes(plan)}
    if bad := {r for r in roots if re.search(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|Set(Command|Catalog)|Cache|Truncate|Load", r)}:
        raise RejectedSql(f"not a query: {', '.join(sorted(bad))}")
    known = {r.lower() for r in relations} | {m.lower() for m in re.findall(r"(?i)(?:with|,)\s*(?:recursive\s+)?`?(\w+)`?\s*(?:\([^)]*\)\s*)?as\s*\(", body)}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree):
        if name.strip().lower() not in known:
            raise RejectedSql(f"unknown relation: {name}")
    called = {m.lower() for m in re.findall(r"'(\w+)\(", tree)} | {m.lower() for m in re.findall(r"(\w+)\s*\(", re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", body))}
    if bad := called & FORBIDDEN_FUNCTIONS:
        raise RejectedSql(f"forbidden function: {', '.join(sorted(bad))}")
    if re.search(r"(?i)\b(parquet|csv|json|orc|text|avro|binaryfile|delta|jdbc)\s*\.\s*`", body):
        raise RejectedSql("files can't be read directly")
    return body


def harvest(value: Any) -> set[str]:
    """Study ids in a collected value, however nested."""
    if isinstance(value, str):
        return {f"NCT{d}" for d in re.findall(r"NCT([0-9]{8})(?![0-9])", value)}
    if isinstance(value, dict):
        return set().union(*map(harvest, value.values()))
    if isinstance(value, (list, tuple, set)):
        return set().union(*map(harvest, value))
    return set()


def bound_sql(spark: SparkSession, text: str, relations: Iterable[str], parameters: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a statement that passes; parameters fill its ? or :name marks as values, never as text."""
    body = validate_sql(spark, text, relations)
    if not parameters:
        return spark.sql(body)
    return spark.sql(body, args=dict(parameters) if isinstance(parameters, Mapping) else list(parameters))


def retrieved_ids(df: DataFrame) -> DataFrame:
    """id: the study ids in any column of any row."""
    flat = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(F.explode(F.regexp_extract_all(flat, F.lit("NCT[0-9]{8}(?![0-9])"), F.lit(0))).alias("id")).distinct()


def run_sql(spark: SparkSession, text: str, relations: Iterable[str], max_rows: int = MOST_ROWS, timeout_s: float = 20.0, parameters: Sequence[Any] | Mapping[str, Any] | None = None) -> dict[str, Any]:
    """columns, rows (at most max_rows), n_rows (all), retrieved ids (of all rows, MOST_IDS at most; ids_cut says if there are more, and
    `retrieved_ids` of the same rows has all as a table).  The job group is cancelled at the timeout.

    Counting and ids are distributed jobs; only the rows shown and the ids come to the driver."""
    import threading
    import uuid

    df = bound_sql(spark, text, relations, parameters)
    group = f"sql-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, text[:100], interruptOnCancel=True)
    timer = threading.Timer(timeout_s, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        rows = [r.asDict(recursive=True) for r in df.limit(max_rows + 1).collect()]
        n = len(rows) if len(rows) <= max_rows else df.count()
        ids = {r.id for r in retrieved_ids(df).limit(MOST_IDS + 1).collect()}
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {"columns": df.columns, "rows": rows[:max_rows], "n_rows": n, "retrieved": ids | harvest(rows), "ids_cut": len(ids) > MOST_IDS}
