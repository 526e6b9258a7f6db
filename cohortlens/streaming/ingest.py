"""Incremental ingest as a stream (an extension: the batch path needs none of it).

New JSON files are parsed as they land; each micro-batch appends to the raw tables, and the last document of a study wins when
tables are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.ranking import last_wins
from cohortlens.sources.registry import flatten, parse


def stream_members(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """member, json, seen_at of new files in a folder."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json").text(folder)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("member"), F.col("value").alias("json"), F.col("_metadata.file_modification_time").alias("seen_at"))


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append every raw table under out; a batch that is run again replaces its own part (batch= folder)."""

    def land(batch: DataFrame, batch_id: int) -> None:
        parsed = parse(batch.select("member", "json")).persist()
        try:
            for name, df in flatten(parsed).items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return stream_members(spark, folder).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_studies(spark: SparkSession, out: str) -> DataFrame:
    """Each study as its last batch has it."""
    return last_wins(spark.read.parquet(f"{out}/studies"), ["nct_id"], ["batch"])
