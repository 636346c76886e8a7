"""A table in buckets of its key that is updated in place: only buckets with changed rows are written again.

A version is a folder of the buckets it wrote and a manifest, which says for every bucket which version holds it. A version counts once its
manifest is there in full, so a writer that dies leaves nothing that a reader sees, and its work is simply done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def files_at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, in order."""
    fs, at = files_at(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(files_at(spark, f"{path}/manifest/{n}/_SUCCESS")[1]))


def _manifest(spark: SparkSession, path: str) -> tuple[int, str, int, dict[int, str]]:
    """(version, key, buckets, where each written bucket is) of the last version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version of the table at {path}")
    rows = spark.read.parquet(f"{path}/manifest/{found[-1]}").collect()  # a row for each bucket and one for the table
    head = next(r for r in rows if r["bucket"] is None)
    return found[-1], head["place"], head["buckets"], {r["bucket"]: r["place"] for r in rows if r["bucket"] is not None}


def _commit(spark: SparkSession, path: str, version: int, key: str, buckets: int, places: dict[int, str]) -> None:
    rows = [(None, key, buckets), *((b, p, buckets) for b, p in sorted(places.items()))]
    # A dead writer's manifest of this number has no _SUCCESS and gives way.
    spark.createDataFrame(rows, "bucket int, place string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket to a folder of a name of its own; where each bucket is."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", bucket_of(key, buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    fs, at = files_at(spark, f"{path}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {int(n.split("=")[1]): f"{name}/{n}" for n in found if n.startswith("_bucket=")}


def create(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Make the table of ``rows`` at ``path``, or its next version if it is there."""
    spark = rows.sparkSession
    done = versions(spark, path)
    places = _write(rows, path, key, buckets)
    schema = rows.schema
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/empty")
    _commit(spark, path, (done[-1] if done else 0) + 1, key, buckets, places)


def _load(spark: SparkSession, path: str, places: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/empty").schema
    return spark.read.schema(schema).parquet(*[f"{path}/{p}" for p in places] or [f"{path}/empty"])


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last committed version."""
    return _load(spark, path, list(_manifest(spark, path)[3].values()))


def touched(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the buckets that ``keys`` (one column) fall in: no other file is read."""
    _, _, buckets, places = _manifest(spark, path)
    hit = {r[0] for r in keys.select(bucket_of(keys.columns[0], buckets)).distinct().collect()}  # as many as there are buckets, at most
    return _load(spark, path, [places[b] for b in sorted(hit) if b in places])


def upsert(spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], every: bool = False) -> int:
    """Bring ``changes`` in and return how many buckets were written.

    ``merge(old, changes)`` gives the new rows of the buckets that ``changes`` touch (of all, with ``every``), with a column ``changed`` and, where rows are
    to go, ``_deleted``. A bucket none of whose rows changed is left as it is, and where none did no version is made, so running the same
    update again does nothing.
    """
    version, key, buckets, places = _manifest(spark, path)
    old = current(spark, path) if every else touched(spark, path, changes.select(key))
    merged = merge(old, changes).withColumn("_bucket", bucket_of(key, buckets))
    merged = merged if "_deleted" in merged.columns else merged.withColumn("_deleted", F.lit(False))
    folder = f"{path}/staged/{uuid.uuid4().hex}"
    merged = merged.withColumns({c: F.col(c).cast(old.schema[c].dataType) for c in old.columns})
    merged.write.parquet(folder)
    merged = spark.read.parquet(folder)
    dirty = [r["_bucket"] for r in merged.where("changed").select("_bucket").distinct().collect()]
    if dirty:
        written = _write(merged.where(F.col("_bucket").isin(dirty) & ~F.col("_deleted")).select(*old.columns), path, key, buckets)
        _commit(spark, path, version + 1, key, buckets, {b: p for b, p in places.items() if b not in dirty} | written)
    _delete(spark, folder)
    return len(dirty)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = files_at(spark, path)
    fs.delete(at, True)


def replace_rows(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A merge by which whole rows of ``changes`` replace those of their key or are added."""
    columns = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*columns).alias("was")).join(changes.select(key, F.struct(*columns).alias("now")), key, "full_outer")
    changed = F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))
    return both.select(key, *[F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in columns], changed.alias("changed"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete manifests but the last ``keep`` and the folders that none of those names; how many folders went."""
    done = versions(spark, path)[-keep:]
    used = reduce(set.union, [{r["place"].rsplit("/", 1)[0] for r in spark.read.parquet(f"{path}/manifest/{v}").where("bucket is not null").collect()} for v in done], set())
    fs, at = files_at(spark, f"{path}/data")
    gone = [s.getPath().getName() for s in fs.listStatus(at) if f"data/{s.getPath().getName()}" not in used]
    for name in gone:
        _delete(spark, f"{path}/data/{name}")
    for v in versions(spark, path)[:-keep]:
        _delete(spark, f"{path}/manifest/{v}")
    return len(gone)
