"""Registry documents (one JSON a study) to the ten raw tables.

Parsing never fails a job: a document that is no JSON, or has no study id, is a row of `ingest_failures`.  Flattening
is projections and explodes over one parsed column; only opening a zip archive takes Python.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import coarsest, partial_date, phase_norm

_DATE = "struct<date: string, type: string>"
_TERMS = "struct<meshes: array<struct<id: string, term: string>>, ancestors: array<struct<id: string, term: string>>>"
_PARTY = "struct<name: string, class: string>"
#: The parts of a study document that are read; others are ignored.
SCHEMA = f"""
protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string, organization: struct<fullName: string, class: string>>,
  statusModule: struct<overallStatus: string, startDateStruct: {_DATE}, primaryCompletionDateStruct: {_DATE}, completionDateStruct: {_DATE}, lastUpdatePostDateStruct: {_DATE}, studyFirstSubmitDate: string>,
  sponsorCollaboratorsModule: struct<leadSponsor: {_PARTY}, collaborators: array<{_PARTY}>>,
  descriptionModule: struct<briefSummary: string>,
  conditionsModule: struct<conditions: array<string>, keywords: array<string>>,
  designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: int, type: string>, designInfo: struct<primaryPurpose: string>>,
  armsInterventionsModule: struct<armGroups: array<struct<label: string, type: string, description: string, interventionNames: array<string>>>,
    interventions: array<struct<type: string, name: string, description: string, armGroupLabels: array<string>, otherNames: array<string>>>>,
  eligibilityModule: struct<eligibilityCriteria: string, healthyVolunteers: boolean, sex: string, minimumAge: string, maximumAge: string, stdAges: array<string>>>,
derivedSection struct<conditionBrowseModule: {_TERMS}, interventionBrowseModule: {_TERMS}>,
hasResults boolean, _corrupt string"""


def read_members(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """member, json: the .json members of zip archives (each under 2 GB), or the .json files of a folder.  A limit keeps
    the first ones by name."""
    if path.endswith(".zip"):

        def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = sorted(n for n in z.namelist() if n.endswith(".json"))
                        for at in range(0, len(names), 500):
                            part = names[at : at + 500]
                            yield pd.DataFrame({"member": part, "json": [z.read(n).decode("utf-8", "replace") for n in part]})

        found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "member string, json string")
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        found = found.select(F.element_at(F.split("path", "/"), -1).alias("member"), F.decode("content", "UTF-8").alias("json"))
    return found if limit is None else found.orderBy("member").limit(limit)


def census(spark: SparkSession, path: str) -> DataFrame:
    """bytes and n_files of what is at path."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))
    return size.join(F.broadcast(read_members(spark, path).agg(F.count("*").alias("n_files"))), F.lit(True))


def parse(members: DataFrame) -> DataFrame:
    """member, study (null if it failed), error."""
    study = F.from_json("json", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = members.select("member", study.alias("study"))
    number = F.col("study.protocolSection.identificationModule.nctId")
    error = F.when(F.col("study").isNull() | F.col("study._corrupt").isNotNull(), "not a study document").when(F.coalesce(F.trim(number), F.lit("")) == "", "no study id")
    return rows.withColumn("error", error).withColumn("study", F.when(error.isNull(), F.col("study")))


def flatten(parsed: DataFrame) -> dict[str, DataFrame]:
    """The raw tables of parsed documents.  Persist or write `parsed` first if it is dear: each table reads it."""
    good = parsed.where("error IS NULL").select("study.protocolSection.*", "study.derivedSection", "study.hasResults")
    s = good.withColumn("nct_id", F.trim("identificationModule.nctId"))
    ai = "armsInterventionsModule"

    def children(items: str | Column, position: str) -> DataFrame:
        return s.select("nct_id", F.posexplode(items).alias(position, "item"))

    dates = {"start_date": "startDateStruct", "primary_completion_date": "primaryCompletionDateStruct", "completion_date": "completionDateStruct", "last_update_date": "lastUpdatePostDateStruct"}
    raw = {name: F.col(f"statusModule.{field}.date") for name, field in dates.items()}
    studies = s.select(
        "nct_id", F.col("identificationModule.briefTitle").alias("brief_title"), F.col("identificationModule.officialTitle").alias("official_title"),
        F.col("identificationModule.organization.fullName").alias("org_name"), F.col("identificationModule.organization.class").alias("org_class"),
        F.col("statusModule.overallStatus").alias("overall_status"), F.col("designModule.studyType").alias("study_type"), phase_norm(F.col("designModule.phases")).alias("phase_norm"),
        F.col("designModule.enrollmentInfo.count").alias("enrollment_count"), F.col("designModule.enrollmentInfo.type").alias("enrollment_type"),
        *[c.alias(n) for n, c in raw.items()], *[partial_date(c)["date"].alias(f"{n}_parsed") for n, c in raw.items()],
        coarsest(*[partial_date(c)["precision"] for c in raw.values()]).alias("date_precision"), partial_date(F.col("statusModule.studyFirstSubmitDate"))["date"].alias("study_first_submit_date"),
        F.col("descriptionModule.briefSummary").alias("brief_summary"), F.col("eligibilityModule.eligibilityCriteria").alias("eligibility_criteria"),
        F.col("eligibilityModule.healthyVolunteers").alias("healthy_volunteers"), F.col("eligibilityModule.sex").alias("sex"), F.col("eligibilityModule.minimumAge").alias("minimum_age"),
        F.col("eligibilityModule.maximumAge").alias("maximum_age"), F.coalesce("eligibilityModule.stdAges", F.array().cast("array<string>")).alias("std_ages"),
        F.col("designModule.designInfo.primaryPurpose").alias("primary_purpose"), F.coalesce("hasResults", F.lit(False)).alias("has_results"),
    )
    treatments = children(f"{ai}.interventions", "intervention_no")
    arms = children(f"{ai}.armGroups", "arm_no")
    party = lambda role, c: s.select("nct_id", F.lit(role).alias("role"), c.alias("p")).where("p IS NOT NULL").select("nct_id", "role", F.col("p.name").alias("name_raw"), F.col("p.class").alias("agency_class"))
    terms = lambda module, kind: children(f"derivedSection.{module}BrowseModule.{kind}", "_").select("nct_id", F.lit(module).alias("module"), F.lit({"meshes": "mesh", "ancestors": "ancestor"}[kind]).alias("kind"), F.col("item.id").alias("mesh_id"), F.col("item.term").alias("term"))
    mesh = terms("condition", "meshes").union(terms("condition", "ancestors")).union(terms("intervention", "meshes")).union(terms("intervention", "ancestors"))
    return {
        "studies": studies,
        "study_conditions": children("conditionsModule.conditions", "position").withColumnRenamed("item", "name_raw"),
        "study_keywords": children("conditionsModule.keywords", "position").withColumnRenamed("item", "keyword_raw"),
        "interventions": treatments.select("nct_id", "intervention_no", F.col("item.type").alias("type"), F.col("item.name").alias("name_raw"), F.col("item.description").alias("description")),
        "intervention_other_names": treatments.select("nct_id", "intervention_no", F.explode("item.otherNames").alias("other_name_raw")),
        "arms": arms.select("nct_id", "arm_no", F.col("item.label").alias("label"), F.col("item.type").alias("type"), F.col("item.description").alias("description")),
        "arm_interventions": link_arms(arms, treatments),
        "sponsors": party("lead", F.col("sponsorCollaboratorsModule.leadSponsor")).union(party("collaborator", F.explode("sponsorCollaboratorsModule.collaborators"))),
        "mesh_terms": mesh,
        "ingest_failures": parsed.where("error IS NOT NULL").select("member", "error"),
    }


def link_arms(arms: DataFrame, treatments: DataFrame) -> DataFrame:
    """nct_id, arm_no, intervention_no, via: by exact arm label (the first arm of a label); in studies without any
    label on an intervention by the names that arms list, typed names first."""
    first = arms.where("item.label IS NOT NULL").groupBy("nct_id", F.col("item.label").alias("label")).agg(F.min("arm_no").alias("arm_no"))
    labels = treatments.select("nct_id", "intervention_no", F.explode("item.armGroupLabels").alias("label"))
    by_label = labels.join(first, ["nct_id", "label"]).select("nct_id", "arm_no", "intervention_no").distinct().withColumn("via", F.lit("label"))
    unlabeled = treatments.join(labels.select("nct_id").distinct(), "nct_id", "left_anti")
    plain = F.lower(F.trim("item.name"))
    named = unlabeled.select("nct_id", F.coalesce(F.upper("item.type"), F.lit("")).alias("type"), F.coalesce(plain, F.lit("")).alias("name"), "intervention_no")
    typed = named.groupBy("nct_id", "type", "name").agg(F.max("intervention_no").alias("typed_no"))
    untyped = named.groupBy("nct_id", "name").agg(F.max("intervention_no").alias("untyped_no"))
    kind = F.regexp_extract("entry", r"^\s*([A-Za-z_ ]+?)\s*:\s*(.+?)\s*$", 1)
    entries = arms.select("nct_id", "arm_no", F.explode("item.interventionNames").alias("entry"))
    entries = entries.select("nct_id", "arm_no", F.upper(F.replace(F.trim(kind), F.lit(" "), F.lit("_"))).alias("type"), F.lower(F.trim(F.when(kind != "", F.regexp_extract("entry", r"^\s*[A-Za-z_ ]+?\s*:\s*(.+?)\s*$", 1)).otherwise(F.col("entry")))).alias("name"))
    found = entries.join(typed, ["nct_id", "type", "name"], "left").join(untyped, ["nct_id", "name"], "left")
    by_name = found.select("nct_id", "arm_no", F.coalesce("typed_no", "untyped_no").alias("intervention_no")).where("intervention_no IS NOT NULL").distinct()
    return by_label.union(by_name.withColumn("via", F.lit("name")))


def check_counts(members: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Every member is a study or a dead letter; anything else fails the build."""
    read, kept, failed = members.count(), tables["studies"].count(), tables["ingest_failures"].count()
    if read != kept + failed:
        raise RuntimeError(f"{read} documents, but {kept} studies and {failed} failures")


def snapshot_date(studies: DataFrame) -> DataFrame:
    """The build's one metadata row that views need: the last update in the data, never the clock."""
    last = studies.agg(F.max("last_update_date_parsed").cast("string").alias("value"))
    return last.select(F.lit("snapshot_date").alias("key"), "value")


def drop_census(tables: dict[str, DataFrame]) -> DataFrame:
    """reason, n: studies that lack a part (normal, counted)."""
    s = tables["studies"]
    lacking = {"n_no_arms": "arms", "n_no_interventions": "interventions", "n_no_conditions": "study_conditions", "n_no_mesh": "mesh_terms"}
    missing = [s.join(tables[t].select("nct_id").distinct(), "nct_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(r).alias("reason"), "n") for r, t in lacking.items()]
    missing.append(s.join(tables["sponsors"].where("role = 'lead'").select("nct_id"), "nct_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("n_no_lead_sponsor").alias("reason"), "n"))
    blanks = {"n_no_phase": "phase_norm", "n_no_enrollment": "enrollment_count", "n_no_eligibility_text": "eligibility_criteria", "n_no_last_update_date": "last_update_date"}
    flat = s.agg(*[F.count_if(F.col(c).isNull()).alias(r) for r, c in blanks.items()]).unpivot([], list(blanks), "reason", "n")
    out = flat
    for m in missing:
        out = out.union(m)
    return out.union(tables["ingest_failures"].agg(F.count("*").alias("n")).select(F.lit("n_failed").alias("reason"), "n"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
