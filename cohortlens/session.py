"""A Spark session with the settings the library is written for, the folder that its executors share, and tables kept there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
    # tables bucketed by study stay co-located in joins on the study and something else
    CO_PARTITION: "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session; on a cluster the master and the shared checkpoint folder come from its own settings."""
    builder = SparkSession.builder.appName("cohortlens")
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local master, whose executors are the driver, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cohortlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Kept(Mapping[str, DataFrame]):
    """Tables that are written to the shared folder when they are first asked for, and read from there.

    Those with the key are bucketed and sorted by it, so that joins and aggregates on it need no shuffle.  Of these, `placed` are made from kept
    tables by such steps only, so they are written without a shuffle; `views` are cheap to make from kept tables and not written.  Joins on the
    key and something else need no shuffle with one of SETTINGS, which is put into the session, as it may come from elsewhere."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]], key: str, placed: Collection[str] = (), views: Collection[str] = ()):
        self.spark, self.tables, self.key, self.placed, self.views = spark, tables, key, placed, views
        self.kept: dict[str, DataFrame] = {}
        spark.conf.set(CO_PARTITION, SETTINGS[CO_PARTITION])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.kept:
            df, spark, unique = self.tables[name](self), self.spark, uuid.uuid4().hex
            path = f"{shared_dir(spark)}/{name}-{unique}"
            if name in self.views:
                self.kept[name] = df
            elif self.key in df.columns:
                n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cohortlens_{name}_{unique}"
                (df if name in self.placed else df.repartition(n, self.key)).write.format("parquet").bucketBy(n, self.key).sortBy(self.key).option("path", path).saveAsTable(table)
                self.kept[name] = spark.table(table)
            else:
                df.write.parquet(path)
                self.kept[name] = spark.read.schema(df.schema).parquet(path)
        return self.kept[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)
