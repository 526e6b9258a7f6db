"""Entity lookup by a ladder of rungs.

Decisive rungs (curated 1, exact id or key 2, alias 3, token set 4) end the search for a query when one hits; prefix (5) and contains
(6) add up.  Per query at most MOST candidates come back, by rung, then trials, then id.  % and _ in a query are
wildcards, as the patterns are not escaped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST, LAST_DECISIVE = 10, 4
STOP_TOKENS = ["the", "of", "and", "with", "due", "to", "a", "an", "in", "for", "or"]


def token_key(key: Column) -> Column:
    """A key's words as a set, sorted, without stop words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: (w != "") & ~w.isin(STOP_TOKENS))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def resolve_many(spark: SparkSession, queries: Sequence[str], names: DataFrame, weights: DataFrame, kind: str | None = None) -> DataFrame:
    """query, id, rung, n_trials, source (and kind).  names: id, key (lower case), source (curated, name or other); weights: id, n_trials.

    Queries are a handful from the caller.  Decisive rungs are joins on equal keys, ids and word sets with the (broadcast) queries; prefixes and
    substrings are one scan of the names that compares each with the queries as literals, so no join has a condition other than equality."""
    q = F.broadcast(spark.createDataFrame([(x, x.strip().lower()) for x in queries], "query string, q string"))
    words = F.broadcast(q.withColumn("w", token_key(F.col("q"))).where("w <> ''"))
    same = names.join(q, F.col("key") == F.col("q")).union(names.join(q, F.col("id") == F.col("q")))
    same = same.withColumn("rung", F.when(F.col("source") == "curated", 1).when(F.col("source") == "name", 2).otherwise(3))
    alike = names.join(words, token_key(F.col("key")) == F.col("w")).drop("w").withColumn("rung", F.lit(4))

    def found(text: str) -> Column:
        at = text.strip().lower()
        rung = F.when(F.col("key").like(f"{at}%"), 5).when(F.col("key").like(f"%{at}%"), 6)
        return F.struct(F.lit(text).alias("query"), F.lit(at).alias("q"), rung.alias("rung"))

    parts = names.select(*names.columns, F.inline(F.filter(F.array(*map(found, queries)), lambda f: f["rung"].isNotNull())))
    hits = same.union(alike).unionByName(parts)
    best = hits.groupBy("query", "id").agg(F.min(F.struct("rung", "source")).alias("r")).select("query", "id", "r.rung", "r.source")
    first = F.min("rung").over(Window.partitionBy("query"))
    best = best.withColumn("_first", first).where((F.col("_first") > LAST_DECISIVE) | (F.col("rung") == F.col("_first"))).drop("_first")
    ranked = best.join(weights, "id", "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rung", F.desc("n_trials"), "id"))
    out = ranked.withColumn("_place", place).where(F.col("_place") <= MOST).select("query", "id", "rung", "n_trials", "source")
    return out if kind is None else out.withColumn("kind", F.lit(kind))


#: A mesh descriptor's id.
MESH_ID = "^[CD][0-9]{5,9}$"
NOTE_LISTED = "listed-only condition without a mesh id: stay with listed keys"
NOTE_SIBLING = "the mesh id is the definition of record; the same name also has a listed-only key, and the two are never summed"


def resolve_any(spark: SparkSession, queries: Sequence[str], kinds: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """query, kind, id, rung, n_trials: each query through the ladder of every kind (name -> its names and weights), the best MOST of all."""
    parts = [resolve_many(spark, queries, names, weights, kind) for kind, (names, weights) in kinds.items()]
    place = F.row_number().over(Window.partitionBy("query").orderBy("rung", F.desc("n_trials"), "id", "kind"))
    return reduce(DataFrame.unionByName, parts).withColumn("_place", place).where(F.col("_place") <= MOST).select("query", "kind", "id", "rung", "n_trials")


def with_notes(found: DataFrame, names: DataFrame, weights: DataFrame) -> DataFrame:
    """Hits of conditions (query, id, rung, n_trials) with `note` and, where the best one is a mesh id, the listed-only key (names: id, key) that is the
    query itself, as a further hit of rung 7."""
    best = found.groupBy("query").agg(F.min(F.struct("rung", (-F.col("n_trials")).alias("n"), "id"))["id"].alias("best"))
    listed = names.where(~F.col("id").rlike(MESH_ID)).select("id", "key").distinct()
    siblings = best.where(F.col("best").rlike(MESH_ID)).join(listed, token_key(F.col("query")) == token_key(F.col("key"))).join(found.select("query", "id"), ["query", "id"], "left_anti")
    more = siblings.join(weights, "id", "left").select("query", "id", F.lit(7).alias("rung"), F.coalesce("n_trials", F.lit(0)).alias("n_trials"))
    told = best.join(more.select("query").distinct().withColumn("_sibling", F.lit(True)), "query", "left")
    note = F.when(~F.col("best").rlike(MESH_ID), NOTE_LISTED).when(F.col("_sibling"), NOTE_SIBLING).otherwise("")
    return found.select("query", "id", "rung", "n_trials").unionByName(more).join(told.select("query", note.alias("note")), "query")


def nearest(spark: SparkSession, query: str, names: DataFrame, k: int = 3) -> DataFrame:
    """For a query without a hit: the ids with most of its words, then most similar keys."""
    words = [w for w in query.lower().split() if w not in STOP_TOKENS]
    shared = F.size(F.array_intersect(F.split("key", " "), F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")))
    scored = names.withColumns({"shared": shared, "distance": F.levenshtein("key", F.lit(query.lower()))})
    return scored.orderBy(F.desc("shared"), "distance", "id").limit(k).select("id", "key", "shared", "distance")
