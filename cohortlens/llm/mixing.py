"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within a source, documents are sorted by key and the
prefix sums of their sizes are cut at the source's budget: a target of q sizes takes every document
floor(q) times (whole epochs) and then a prefix of the key order until the exact rest is used up.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share 150 % of
all sizes by weight, a target stops at twice its source's size, and the excess is shared again by weight until no
target is above.  That fixpoint is min(cap, weight * level) with one common level, found by
sorting sources by cap / weight and one running sum.

Prefix sums are distributed: a key's first hex digits name a bucket, sizes are summed for each (source, bucket)
before any shuffle, running sums over buckets give each bucket its start, and
within a bucket (about BUCKET_ROWS rows) a window sorts and sums.  So a source with a third of
all rows is spread over as many tasks as it has buckets, and texts are never shuffled.  The key is a hash of id and
text, so rows that share an id, or have none, are spread too; rows equal in both are counted before the shuffle and come out of one.

Edge cases: null text has size 0 and is taken 0 times; null source is a source; a null doc_id hashes
like the empty string; repeated rows are ordered arbitrarily among themselves, which can't change the result as
a multiset; very long texts are only hashed and counted; an empty table gives an empty result; sources of size 0 have target 0; clashing input columns do not
matter, for the result has its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows that one bucket's window should hold.
BUCKET_ROWS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> the same and target double.  One row a source: windows over all
    sources are over a table as long as the list of sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size"))
    everyone = Window.partitionBy(F.lit(1))
    # sources in the order in which a rising level reaches their caps
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source is the first that stays under its cap
    level = (F.lit(SHARE) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    t = t.withColumn("level", F.min_by("level", F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("place"))).over(everyone))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, split_last: bool = True, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words of each document that the mix takes; and, if
    asked for, `row`: a struct of the columns to carry along (they are shuffled with the rest).

    split_last: a source's budget is met to the word, by a part of the last document; else that document
    is taken whole if at least half of it fits (budget met to half a document)."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key"), *([F.struct(*carry).alias("row")] if carry else []))
    if not carry:  # a few bytes a row are kept, so that texts are read and counted once
        rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("rows")), "sizes")
    digits = max(1, math.ceil(math.log(max(docs.select("doc_id").count(), 1) / BUCKET_ROWS + 1, 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    # a null source can't be joined on with ==, so it gets a name that no source has
    rows = rows.withColumn("known", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    place = ["known", "name", "bucket"]
    weight = F.col("size") if carry else F.col("size") * F.col("rows")
    sums = rows.groupBy(*place).agg(F.sum(weight).alias("bucket_size"))
    t = targets(sums.groupBy("known", "name").agg(F.sum("bucket_size").alias("source_size")).select(F.when(F.col("known"), F.col("name")).alias("source"), "source_size"))
    t = t.select(F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    so_far = Window.partitionBy("known", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).drop("bucket_size")
    starts = starts.join(t, ["known", "name"])
    inside = Window.partitionBy(*place).orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(starts, place)
    if not carry:
        rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    start, size = F.col("start") + F.col("bucket_start"), F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.least(size, F.greatest(F.lit(0).cast("long"), budget - start))
    if not split_last:
        part = F.when((2 * part >= size) & (part > 0), size).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * size + part).alias("taken"), *(["row"] if carry else []))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
            row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM s
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, place) FROM l WHERE weight * level <= cap)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM p
"""
