"""Ranking, deduplication and aggregates that need a defined tie rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolution import checkpointed


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group.  Spark limits groups before the shuffle when it sees the filter on the rank."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as a maximum of structs: partial aggregates shrink hot keys before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the least value), with its count n."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("v"))).alias("_best"))
    return best.select(*keys, F.col("_best.v").alias(value), (-F.col("_best.minus")).alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, half to even; a whole of 0 counts as 1."""
    return F.bround(100.0 * part / F.greatest(whole, F.lit(1)), 1)


def budget_prefix(df: DataFrame, order: Sequence[Column | str], cost: str, ceiling: float) -> DataFrame:
    """Rows, in order, whose running cost stays within the ceiling, with `spent`.

    Running sums are distributed: rows are sorted by range, each partition is summed, and a partition's start
    is the sum of those before it (one row a partition).  The ranges are sampled, so rows are checkpointed with their partition's number: sums and
    rows then speak of the same partitions, whatever is computed again."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.groupBy("_part").agg(F.sum(cost).alias("_sum"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = parts.withColumn("_in", F.sum(cost).over(within)).join(starts.select("_part", "_start"), "_part")
    return rows.withColumn("spent", F.col("_in") + F.col("_start")).where(F.col("spent") <= ceiling).drop("_part", "_in", "_start")


def running_set(df: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """Union of the arrays of all rows of the key up to this one, sorted, as `seen`.

    A value counts where it comes first, so what is gathered over a key holds each of its values once."""
    new = df.select(key, order, F.explode(values).alias("_v")).groupBy(key, "_v").agg(F.min(order).alias(order)).groupBy(key, order).agg(F.collect_list("_v").alias("_new"))
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    rows = df.join(new, [key, order], "left")
    return rows.withColumn("seen", F.array_sort(F.array_distinct(F.flatten(F.collect_list("_new").over(w))))).drop("_new")


def set_rollup(df: DataFrame, group: str, member: str, values: str, solo: str) -> DataFrame:
    """For each group: the union of its solo members' values if it has solo members, else the values that all members have.

    df: one row (group, member, value); solo: boolean, the member belongs to this group alone."""
    n = df.groupBy(group).agg(F.count_distinct(member).alias("_members"), F.bool_or(solo).alias("_any_solo"))
    per = df.groupBy(group, values).agg(F.count_distinct(member).alias("_with"), F.bool_or(solo).alias("_solo"))
    return per.join(n, group).where(F.when(F.col("_any_solo"), F.col("_solo")).otherwise(F.col("_with") == F.col("_members"))).select(group, values)
