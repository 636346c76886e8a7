"""Mixing of sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, shared_dir, text_key

#: Plans of more places than this are written in pieces of so many and joined by shuffle.
BROADCAST_PLACES = 100_000


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers in exactly the proportion that they are written in (0.1 is a tenth), with no common divisor."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if min(exact.values()) <= 0:
        raise ValueError("weights must be above 0")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def pfair_places(weights: Mapping[str, int], places: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, place) of the blocks of one period, whose places are as many as the weights' sum, or of its first ``places``.

    Block k (from 0) of a source with w of Q places is released at floor(k Q / w) and due by ceil((k + 1) Q / w); each
    place goes to the released block that is due first (ties: the one whose window is followed by an overlapping one, then
    the smaller source name). Windows that are all kept mean that at any place a source has had less than one block
    more or less than its weight's share. The schedule repeats, so one period serves a corpus of any size.
    """
    period = sum(weights.values())
    window = lambda s, k: (k * period // weights[s], -(-(k + 1) * period // weights[s]))
    waiting = [(0, s, 0) for s in sorted(weights)]
    ready: list[tuple[int, int, str, int]] = []
    for place in range(period if places is None else min(period, places)):
        while waiting and waiting[0][0] <= place:
            _, s, k = heapq.heappop(waiting)
            due = window(s, k)[1]
            heapq.heappush(ready, (due, -(due * weights[s] % period != 0), s, k))
        due, _, s, k = heapq.heappop(ready)
        yield s, k, window(s, k)[0], due, place
        if k + 1 < weights[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))


def _plan(spark: SparkSession, shares: Mapping[str, int], wanted: int) -> DataFrame:
    """The first ``wanted`` of pfair_places() as a table; a long plan is written piece by piece, so the driver never holds more than one."""
    places, path = pfair_places(shares, wanted), f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    piece = lambda rows: spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["source", "turn", "release", "deadline", "place"]))
    if wanted <= BROADCAST_PLACES:
        return piece(places)
    while rows := list(itertools.islice(places, BROADCAST_PLACES)):
        piece(rows).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def source_weights(docs: DataFrame, power: float = 0.5) -> dict[str, int]:
    """Target weights from the corpus: the whole part of each source's count of documents to ``power`` (1: as they are, 0: all alike)."""
    return {r["s"]: int(r["count"] ** power) for r in docs.groupBy(_source().alias("s")).count().collect()}


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16, buckets: int = 1024) -> DataFrame:
    """Order for the rows of ``docs`` (doc_id, source) in which sources follow ``weights`` throughout.

    Returns doc_id, source, block (of ``block`` rows, by source), release, deadline, place (of the block, in blocks) and
    position, by which the rows are to be read: unique, ascending with place, with gaps where sources have ended. Until a
    source ends, it has at any place less than one block more or less than its share; then the others keep their
    places and so their proportions. Every row is kept: sources without a weight follow all others, each in turn of its
    name. Without ``weights`` they are source_weights().

    Rows are numbered in their source by bucket of doc_id, then doc_id: counts of the (source, bucket) cells give the first number of a
    cell, so a source of any size is numbered in many tasks. Weights are kept exactly, as whole numbers, whose schedule repeats after as
    many places as their sum; the driver makes one period of it, or as much of one as the corpus needs. A null source is the empty one;
    rows without a doc_id come last in a cell of their own; repeated rows have positions of their own. An empty table gives none; other
    columns are not read.
    """
    spark = docs.sparkSession
    cell = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(buckets)), F.lit(buckets)).cast("int")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), cell.alias("cell"))
    counts = save(light.groupBy("source", "cell").agg(F.count("*").alias("n")), "cells")
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("source", "cell").orderBy("doc_id"))
    numbered = light.withColumn("number", number).join(starts, ["source", "cell"])
    numbered = numbered.withColumn("number", F.col("start") + F.col("number") - 1).withColumn("block", F.floor(F.col("number") / block))
    asked = dict(weights) if weights is not None else source_weights(docs)
    if not asked:
        asked = {"": 1.0}
    shares = whole_weights(asked)
    whole = sum(shares.values())
    # The last block of each source that has a weight is due within so many places.
    longest = {r["source"]: -(-r["rows"] // block) for r in counts.groupBy("source").agg(F.sum("n").alias("rows")).collect()}
    wanted = min(whole, max((-(-n * whole // shares[s]) for s, n in longest.items() if s in shares), default=1))
    sent = F.broadcast if wanted <= BROADCAST_PLACES else lambda df: df
    plan = sent(_plan(spark, shares, wanted))
    share = sent(spark.createDataFrame(list(shares.items()), "source string, of long"))
    mixed = numbered.join(share, "source").withColumn("cycle", F.floor(F.col("block") / F.col("of"))).withColumn("turn", F.col("block") % F.col("of"))
    shift = F.col("cycle") * whole
    out = mixed.join(plan, ["source", "turn"]).select(
        "doc_id", "source", "block", (F.col("release") + shift).alias("release"), (F.col("deadline") + shift).alias("deadline"), (F.col("place") + shift).alias("place"), "number",
    ).withColumn("position", F.col("place") * block + F.col("number") % block)
    columns = ["doc_id", "source", "block", "release", "deadline", "place", "position"]
    if weights is None:
        return out.select(columns)
    # Sources without a weight: after the last place that any other can have.
    others = counts.join(share, "source", "left_anti").groupBy("source").agg(F.sum("n").alias("rows"))
    last = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).withColumn("end", (F.ceil(F.col("all") / block) + 1) * whole * block)
    turn = F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = numbered.join(others.withColumn("before", turn), "source").crossJoin(F.broadcast(last))
    position = F.col("end") + F.col("before") + F.col("number")
    none = F.lit(None).cast("long")
    return out.select(columns).union(rest.select("doc_id", "source", "block", none.alias("release"), none.alias("deadline"), none.alias("place"), position.alias("position")))


def order_by_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16) -> DataFrame:
    """``docs``, all rows and columns, sorted by the position that mix_sources() gives them.

    Repeated rows of one doc_id and source take the first of their positions, in order of their text.
    """
    order = save(mix_sources(docs, weights, block).groupBy("doc_id", "source").agg(F.min("position").alias("†position")), "mix")
    order = order.withColumnsRenamed({"doc_id": "†id", "source": "†source"})
    marked = docs.withColumns({"†doc": F.col("doc_id").cast("long"), "†from": _source()})
    return marked.join(order, F.col("†doc").eqNullSafe(F.col("†id")) & (F.col("†from") == F.col("†source"))).orderBy("†position", *([text_key(), "text"] if "text" in docs.columns else [])).drop("†id", "†source", "†doc", "†from", "†position")
