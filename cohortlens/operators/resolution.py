"""Entity resolution over alias claims: support, dominance, merging, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import shared_dir

# fixed values
DOMINANCE_TRIALS, DOMINANCE_RATIO, MERGE_TRIALS, LONG_LIST = 5, 10, 2, 4


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, root: the least id reachable (by the ids' own order) over edges (a, b); vertices (id) may stand alone.

    Labels fall in rounds: a vertex takes the least label among its neighbours' and its own, hands it to its
    present label, and labels jump to their labels; rounds grow with the logarithm of path length."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    ids = both.select(F.col("a").alias("id"))
    ids = (ids.union(vertices.select("id")) if vertices is not None else ids).distinct()
    labels = checkpointed(ids.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("root").alias("least")).withColumnRenamed("a", "id")
        seen = labels.join(near, "id", "left").select("id", "root", F.least("root", "least").alias("least"))
        told = seen.select("id", "least").union(seen.select("root", "least")).groupBy("id").agg(F.min("least").alias("root"))
        jump = told.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = checkpointed(told.join(jump, "root").join(labels.withColumnRenamed("root", "was"), "id").select("id", F.col("above").alias("root"), (F.col("above") != F.col("was")).alias("moved")))
        labels = after.select("id", "root")
        if after.where("moved").isEmpty():
            return labels


def ranked_roots(members: DataFrame) -> DataFrame:
    """id, root -> the same with the root chosen by (shorter, then least) within each component."""
    best = members.groupBy("root").agg(F.min(F.struct(F.length("id").alias("n"), "id")).alias("best"))
    return members.join(best, "root").select("id", F.col("best.id").alias("root"))


def alias_support(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """alias, root, n: distinct trials that assert the alias for the root.  claims: alias, owner, trial."""
    owned = claims.join(roots.select(F.col("id").alias("owner"), "root"), "owner", "left").withColumn("root", F.coalesce("root", "owner"))
    return owned.groupBy("alias", "root").agg(F.count_distinct("trial").alias("n"))


def decide_aliases(support: DataFrame) -> DataFrame:
    """alias, root, n, n_claimants, decision: sole, dominance or vetoed (root is then null).

    An alias goes to its only claimant, or to the first of several if it is asserted by at least DOMINANCE_TRIALS trials and
    DOMINANCE_RATIO times as many as for the second."""
    w = Window.partitionBy("alias").orderBy(F.desc("n"), "root")
    ranked = support.withColumns({"place": F.row_number().over(w), "second": F.lead("n").over(w), "n_claimants": F.count("*").over(Window.partitionBy("alias"))}).where("place = 1")
    strong = (F.col("n") >= DOMINANCE_TRIALS) & (F.col("n") >= DOMINANCE_RATIO * F.col("second"))
    decision = F.when(F.col("n_claimants") == 1, "sole").when(strong, "dominance").otherwise("vetoed")
    return ranked.select("alias", F.when(decision != "vetoed", F.col("root")).alias("root"), "n", "n_claimants", decision.alias("decision"))


def merge_fixpoint(keys: DataFrame, claims: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """id, root for every key: curated pairs (a, b) are united at once; then, in rounds with frozen roots, an alias that is itself a key
    joins the cluster it was decided for, if at least MERGE_TRIALS trials assert it, until no round merges."""
    start = curated.select("a", "b") if curated is not None else keys.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    merges = checkpointed(start)
    while True:
        roots = ranked_roots(connected_components(merges, keys))
        decided = decide_aliases(alias_support(claims, roots)).where(F.col("root").isNotNull() & (F.col("n") >= MERGE_TRIALS))
        own = roots.select(F.col("id").alias("alias"), F.col("root").alias("own"))
        new = checkpointed(decided.join(own, "alias").where("own <> root").select(F.col("own").alias("a"), F.col("root").alias("b")))
        if new.isEmpty():
            return checkpointed(roots)
        merges = checkpointed(merges.union(new).distinct())
