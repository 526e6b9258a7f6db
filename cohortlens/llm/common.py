"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows per Arrow batch: documents are long, and a batch lives in a Python worker's memory.
ARROW_ROWS = 250


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has Spark's default (a caller's own setting stays).  Spark bounds their bytes itself
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB); `by_bytes` cuts them further."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local master, whose executors are the driver, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cohortlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a re-computation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array (null and blank text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Ids that a broadcast filter is made of, at most; it has 32 bits for each, so it is 16 MB (two million rows) at most.
FILTER_IDS = 1 << 21


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is among ids (one column), and of few others; rows aren't shuffled for up to FILTER_IDS ids.

    ids set bits of a filter, which is broadcast as its words that aren't 0.  For more ids the
    filter would not be small, and a semi-join is exact.  Callers join on the key afterwards."""
    told = maybe_among(df, key, ids)
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi") if told is None else told.where("maybe").select(*df.columns)


def maybe_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame | None:
    """df with `maybe`: false only if key is surely not among ids; None if there are more than FILTER_IDS of them."""
    n = ids.count()
    if n > FILTER_IDS:
        return None
    bits = 1 << max(10, (32 * n).bit_length())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    name = ids.columns[0]
    set_bits = ids.where(F.col(name).isNotNull()).select(bit(F.col(name)).alias("bit"))
    words = set_bits.groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("_bits"))
    flagged = df.withColumn("_bit", bit(F.col(key))).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.expr("(shiftright(_bits, cast(_bit & 63 AS int)) & 1L) = 1L")
    return flagged.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_bit", "_word", "_bits")


#: Bytes of text that a worker handles at once.
BATCH_BYTES = 8 << 20


def by_bytes(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, a row at least: rows differ in length by orders of magnitude."""
    if batch.nbytes <= most or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from by_bytes(batch.slice(0, half), most)
    yield from by_bytes(batch.slice(half), most)


#: What this worker remembers between tasks, by name, and how to forget it.
_MEMORIES: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _MEMORIES[name] = forget


def frugal(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run over batches.  The worker first forgets what other operators remembered, and in the end gives freed memory back, as
    idle workers are kept for later tasks."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        for name, forget in _MEMORIES.items():
            if name != keeps:
                forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped
