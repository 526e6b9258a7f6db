"""Corpus pipeline: quality rules, near-dedup, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and works on all of it; all
but the last return the columns of documents.  A table without rows stays one through all stages, and the operators
say what they do with nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, mixing, near_dedup, pii, quality
from cohortlens.llm.common import maybe_among, read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.judge(docs.select(*COLUMNS), quality.trusted_ids(read(spark, sf_dir, "labels")))
    return judged.where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the least doc_id stays, once."""
    found = stored(near_dedup.near_duplicates(docs, width=5, percent=80), "near-duplicates")
    dropped = found.where("NOT kept").select("doc_id").distinct()
    told = maybe_among(docs.select(*COLUMNS), "doc_id", dropped)
    if told is None:  # too many for a filter that is broadcast
        kept = docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    else:  # most documents are surely kept and aren't shuffled; the rest meet the exact list
        unsure = told.where("maybe").join(dropped, "doc_id", "left_anti")
        kept = told.where("NOT maybe").select(*COLUMNS).union(unsure.select(*COLUMNS))
    repeated = stored(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # rows that share an id are one document: its least row stays
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(again.select("doc_id", "row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; a source's last one is taken whole or not at all."""
    mixed = mixing.mix(docs, split_last=False, carry=COLUMNS)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", one_of_each_group),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("byte-level BPE", token_ids),
]

#: Hashed ratios, a trained field and merges aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
