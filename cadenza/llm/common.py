"""Helpers shared by the corpus operators: shared scratch storage, table access and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are compared: it sorts behind every real one.
NO_ID = 2**63 - 1
#: Bits of maybe_in()'s filter (1 MB), and of the bitmaps that Spark makes of it.
FILTER_BITS = 1 << 23
BITMAP_BITS = 1 << 15
#: Spark removes the shuffle files of a query at its end where this is set.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage for good.

    Its shuffle files go as soon as it is written: left to the driver's garbage collection, those of many tables in a row stay on the disks together.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches short, by rows and by bytes: a batch of long texts must fit a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_key(name: str = "text") -> Column:
    """64-bit key of a text; a null text is the empty one."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def maybe_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every key of ``keys`` (one column of 64-bit hashes), and for few others while they are not many millions.

    Rows that fail it need no join with the table. The filter has the same size whatever the keys: it is only a way to shuffle
    less, and lets the more rows through the more keys there are.
    """
    spark = keys.sparkSession
    bit = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS))
    maps = keys.select(bit.alias("bit")).groupBy(F.expr(f"bit div {BITMAP_BITS}").alias("map")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BITMAP_BITS))).alias("bits"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.collect():  # at most FILTER_BITS / BITMAP_BITS rows
        part = np.frombuffer(r["bits"], np.uint8)
        held[r["map"] * BITMAP_BITS // 8 :][: len(part)] = part
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = np.mod(h.to_numpy(), FILTER_BITS)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return test
