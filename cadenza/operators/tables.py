"""Tables that several operators need: kept intermediate results and global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: below spark.checkpoint.dir, which is set to a temporary one only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` for repeated use, as a table in a shared folder: nothing of it is computed again, whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """Global 0-based ``position`` by ``order``, which leaves no ties.

    Rows are sorted in ranges and stored with their place in their range; only the counts of the ranges, one row each, are summed together.
    """
    placed = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "positions").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_range").withColumn("position", F.col("_before") + inside).drop("_range", "_before", "_at")
