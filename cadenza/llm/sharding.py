"""Sharding over fixed virtual slots, with DataFrame operations only.

Records hash into thousands of virtual slots that never change; bytes are summed per slot; a versioned map says
which shard holds each slot. Rebalancing edits the map: what fits stays, the rest moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, shared_dir

SLOTS = 4096
#: Rows of a stored table are numbered by runs of so many in one file.
RUN_BITS = 16


def with_virtual_slot(docs: DataFrame, slots: int = SLOTS, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row, and the columns ``more``.

    The slot depends on doc_id alone, so equal texts, however many, spread over all slots; rows without a doc_id
    spread by their text. Size is the text's UTF-8 bytes (null: none) plus 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"), *more,
    )


def slot_bytes(placed: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): at most as many rows as there are slots."""
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = 16) -> DataFrame:
    """Version 0: slots dealt in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, stats: DataFrame, shards: int = 16) -> DataFrame:
    """The next version of the map for ``shards`` shards: (version, virtual_slot, shard, bytes, rows, moved).

    A shard keeps its largest slots up to the level that all can reach; the slots beyond it, and those of shards that no longer
    exist, go one by one, largest first, to the shard with the least load. The work is on the map alone, whose
    rows are as many as the slots, whatever the corpus.
    """
    full = slot_map.join(F.broadcast(stats), "virtual_slot", "left").fillna(0, ["bytes", "rows"])
    # The level that shards can reach: the mean of what is left when the largest slots, where they exceed it, have shards of their own.
    order = Window.partitionBy("version").orderBy(F.desc("bytes"), "virtual_slot")
    larger = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("bytes").over(Window.partitionBy("version")) - larger
    alone = F.row_number().over(order) - 1
    full = full.withColumn("left", F.when(alone < shards, rest / (shards - alone)))
    full = full.withColumn("mean", F.min("left").over(Window.partitionBy("version"))).drop("left")
    running = Window.partitionBy("version", "shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("stays", (F.sum("bytes").over(running) <= F.col("mean")) & (F.col("shard") < shards))
    fold = full.groupBy("version").agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"))))).alias("pool"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long") for k in range(shards)]).alias("loads"),
    )
    least = "array_position(acc.loads, array_min(acc.loads)) - 1"
    fold = fold.withColumn("to", F.expr(f"""aggregate(pool, named_struct('loads', loads, 'to', cast(array() as array<int>)),
        (acc, x) -> named_struct('loads', transform(acc.loads, (l, i) -> if(i = {least}, l - x.less, l)), 'to', concat(acc.to, array(cast({least} as int)))),
        acc -> acc.to)"""))
    moved = fold.select("version", F.explode(F.arrays_zip("pool", "to")).alias("m")).select("version", F.col("m.pool.slot").alias("virtual_slot"), F.col("m.to").alias("to"))
    out = full.join(moved, ["version", "virtual_slot"], "left")
    return out.select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("stays"), F.col("shard")).otherwise(F.col("to")).alias("shard"),
        "bytes", "rows", (~F.col("stays") & (F.col("shard") != F.col("to"))).alias("moved"),
    )


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions kept at ``path`` that were written in full, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit()]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS")))


def store_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Add one version (virtual_slot, shard) to the map kept at ``path``; one that is there in full is never replaced, the rest of a lost writer's is."""
    if version in map_versions(slot_map.sparkSession, path):
        raise ValueError(f"version {version} of the map at {path} is there already")
    slot_map.select("virtual_slot", "shard").write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, virtual_slot, shard) of the last version that was kept at ``path`` in full; None where there is none."""
    found = map_versions(spark, path)
    if not found:
        return None
    return spark.read.parquet(f"{path}/version={found[-1]}").select(F.lit(found[-1]).alias("version"), "virtual_slot", "shard")


def next_map(spark: SparkSession, path: str, stats: DataFrame, slots: int, shards: int) -> DataFrame:
    """Edit the map kept at ``path`` for ``stats`` (slot_bytes()), keep the result as its next version and return it with bytes and rows.

    A path without a map begins with version 0, slots dealt in turn. A map of another number of slots is refused: slots are fixed.
    """
    now = latest_map(spark, path)
    if now is None:
        store_map(first_map(spark, slots, shards), path, 0)
        now = latest_map(spark, path)
    if (n := now.count()) != slots:
        raise ValueError(f"the map at {path} has {n} slots, not {slots}")
    version = now.first()["version"] + 1
    store_map(rebalance(now, stats, shards), path, version)
    return latest_map(spark, path).join(stats, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def with_stored_place(docs: DataFrame) -> DataFrame:
    """``docs`` with part, file and row, which ascend in the order in which its rows are stored.

    Spark reads the files of a table in any order, but writes a sorted one so that its part numbers and the rows in
    each file ascend. A table in memory has its partitions and the rows in them.
    """
    try:
        name = F.col("_metadata.file_name")
        part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
        return docs.withColumns({"part": part, "file": name, "row": F.col("_metadata.row_index")})
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return docs.withColumns({"part": F.shiftright(at, 33), "file": F.lit(""), "row": at.bitwiseAND(F.lit((1 << 33) - 1))})


def _slots_as_stored(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``placed`` with shard, version and slot, which follows part, file and row in each shard.

    Counts of the (shard, file, run of rows) cells give the first slot of a cell, so a shard of any size is numbered in many tasks.
    """
    cell = ["shard", "part", "file", "run"]
    dealt = placed.withColumn("run", F.shiftright("row", RUN_BITS)).join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("part", "file", "run").rowsBetween(Window.unboundedPreceding, -1)
    counts = save(dealt.groupBy(cell).agg(F.count("*").alias("n")), "shard-cells")
    starts = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(cell).orderBy("row"))
    return dealt.withColumn("place", place).join(starts, cell)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, as_stored: bool = False, map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard, under the law ``bytes``: shard sizes are near equal.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's gapless place in its shard, from 0), grown_shard
    (null under this law), virtual_slot, map_version. Only ids and sizes are shuffled, by virtual slot; the map joined
    to them has one row per slot. Equal shards are out of reach where one row is larger than the mean shard.
    Null texts have size 1; rows with one doc_id share a virtual slot and are told apart by text_crc32, then size;
    equal rows get neighbouring places. An empty table gives an empty result; other columns are not read.

    The map is read from ``map_path``, edited and kept there as its next version (next_map()), so that a second run on
    a grown table moves only the slots that have to; without a path the run keeps a map of its own in the shared folder.

    With ``as_stored`` the slots of a shard follow the order in which ``docs`` is stored (with_stored_place()), else
    virtual slot and doc_id.
    """
    placed = save(with_virtual_slot(with_stored_place(docs), slots, ["part", "file", "row"]) if as_stored else with_virtual_slot(docs, slots), "placed")
    spark = docs.sparkSession
    stats = save(slot_bytes(placed), "slot-bytes")
    slot_map = next_map(spark, map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}", stats, slots, shards)
    if as_stored:
        numbered = _slots_as_stored(placed, slot_map)
    else:
        before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
        starts = slot_map.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
        place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size"))
        numbered = placed.withColumn("place", place).join(F.broadcast(starts), "virtual_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
