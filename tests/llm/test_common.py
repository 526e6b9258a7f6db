import pytest
from pyspark.sql import functions as F

from cohortlens.llm import components
from cohortlens.llm.common import let, maybe_among, words


def test_words(spark):
    df = spark.createDataFrame([("  a\tb\x0bc\r\n d ",), ("",), (None,), (" x y",)], "t string")
    assert [r.w for r in df.select(words(F.col("t")).alias("w")).collect()] == [["a", "b", "c", "d"], [], [], [" x", "y"]]


def test_let(spark):
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x).alias("v")).first().v == 9


def test_maybe_is_never_wrongly_false(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").union(spark.createDataFrame([(None,)], "k long"))
    told = {r.k: r.maybe for r in maybe_among(df, "k", spark.range(0, 1000, 7)).collect()}
    assert all(told[k] for k in range(0, 1000, 7)) and sum(told.values()) < 160 and told[None] is False


@pytest.mark.parametrize("n", [2, 300])
def test_components_of_a_path(spark, n):
    links = spark.range(n - 1).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).repartition(8)
    got = components.components(links.union(spark.createDataFrame([(901, 900), (902, 900)], "a long, b long")))
    assert sorted((r.vertex, r.component) for r in got.collect()) == sorted([(i, 0) for i in range(n)] + [(900, 900), (901, 900), (902, 900)])


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
