"""Record files: checkpoint logs, shipped artifacts, lexicons, metadata, text output."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ranking import last_wins


def load_lexicon(path: str) -> dict[str, Any]:
    """A YAML or JSON file that holds a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def append_records(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def settled(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A log's last settled record of each key."""
    return last_wins(spark.read.schema(schema).json(path).where("settled"), [key], [order])


def load_artifact(spark: SparkSession, path: str, schema: str, known: DataFrame, key: str) -> DataFrame:
    """A shipped file's rows with a known key; its attribution row has none."""
    return spark.read.schema(schema).json(path).where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_semi")


def ship(df: DataFrame, path: str, attribution: str) -> None:
    """Rows as JSON lines under an attribution row."""
    spark = df.sparkSession
    head = spark.createDataFrame([(json.dumps({"attribution": attribution}),)], "value string")
    head.union(df.select(F.to_json(F.struct("*")).alias("value"))).write.text(path)


def with_meta(meta: DataFrame, new: Mapping[str, Any]) -> DataFrame:
    """Key/value metadata (values as JSON) with some keys replaced or added."""
    fresh = meta.sparkSession.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in new.items()], "key string, value string")
    return meta.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def get_meta(meta: DataFrame, key: str) -> Any:
    """A value, decoded if it is JSON; None if there is none."""
    row = next(iter(meta.where(F.col("key") == key).select("value").take(1)), None)
    if row is None:
        return None
    try:
        return json.loads(row.value)
    except (TypeError, ValueError):
        return row.value


def sample_by_rules(rows: DataFrame, key: str, rules: Mapping[str, tuple[str, int]], seed: int = 7) -> DataFrame:
    """key, rule: for each rule (SQL condition, n) in turn n rows in a seeded order, none picked twice."""
    picked = rows.select(key, F.lit("").alias("rule")).limit(0)
    for name, (condition, n) in rules.items():
        free = rows.where(condition).join(picked.select(key), key, "left_anti")
        picked = picked.union(free.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).select(key, F.lit(name).alias("rule")))
    return picked


def as_text(df: DataFrame, fmt: str = "table", rows: int = 200) -> str:
    """The first rows as a table or CSV, for a console."""
    shown = df.limit(rows).toPandas()
    return shown.to_csv(index=False) if fmt == "csv" else shown.to_string(index=False)
