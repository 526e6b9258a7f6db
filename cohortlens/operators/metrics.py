"""Set-based evaluation metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def set_scores(returned: DataFrame, gold: DataFrame, case: str, item: str) -> DataFrame:
    """Per case: n_returned, n_gold, n_hit, precision, recall, f1.

    Nothing returned has precision 1 (nothing wrong was said), and nothing expected has recall 1; so two empty sets agree."""
    r = returned.select(case, item).distinct().withColumn("_r", F.lit(1))
    g = gold.select(case, item).distinct().withColumn("_g", F.lit(1))
    n = r.join(g, [case, item], "full").groupBy(case).agg(
        F.coalesce(F.sum(F.when(F.col(item).isNotNull(), F.col("_r"))), F.lit(0)).alias("n_returned"), F.coalesce(F.sum(F.when(F.col(item).isNotNull(), F.col("_g"))), F.lit(0)).alias("n_gold"),
        F.coalesce(F.sum(F.when(F.col(item).isNotNull(), F.col("_r") * F.col("_g"))), F.lit(0)).alias("n_hit"))
    p, q = ratio(F.col("n_hit"), F.col("n_returned"), 1.0), ratio(F.col("n_hit"), F.col("n_gold"), 1.0)
    n = n.withColumns({"precision": p, "recall": q})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def pooled(scores: DataFrame, gate_from: int = 30) -> DataFrame:
    """One row: ratios of sums (never means of ratios); `gating` only with enough gold items."""
    s = scores.agg(*[F.sum(c).alias(c) for c in ("n_returned", "n_gold", "n_hit")])
    s = s.withColumns({"precision": ratio(F.col("n_hit"), F.col("n_returned"), 0.0), "recall": ratio(F.col("n_hit"), F.col("n_gold"), 0.0)})
    return s.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0), "gating": F.col("n_gold") >= gate_from})


def roll_up(checks: DataFrame, group: str | None = None, limits: Mapping[str, float] | None = None) -> DataFrame:
    """checks: metric, role (OBJ, FLOOR, DIAG), value.  Breached floors (value over its limit, 0 if not given), mean objective (0 without any), passed."""
    keys = [group] if group else []
    limit = F.lit(0.0)
    for metric, most in (limits or {}).items():
        limit = F.when(F.col("metric") == metric, F.lit(most)).otherwise(limit)
    breach = (F.col("role") == "FLOOR") & (F.col("value") > limit)
    rolled = checks.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(breach, F.col("metric")))).alias("breaches"), F.coalesce(F.avg(F.when(F.col("role") == "OBJ", F.col("value"))), F.lit(0.0)).alias("objective"), F.count("*").alias("n_checks"))
    return rolled.withColumn("passed", F.size("breaches") == 0)
