"""Playlists that follow a stream of changed tracks: counts move by what changed, limited lists keep a reserve."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rules
from ..sources import buckets
from .plays import apply_play_counts

#: Members that a limited list keeps beyond its limit, as a share of it and at least.
RESERVE_SHARE, LEAST_RESERVE = 1.0, 25

Playlists = Mapping[str, Mapping[str, Any]]


def live(playlists: Playlists) -> dict[str, Mapping[str, Any]]:
    """The playlists that update themselves; frozen ones are skipped."""
    return {n: c for n, c in playlists.items() if c.get("autoUpdate", True)}


def _depth(criteria: Mapping[str, Any]) -> int | None:
    limit = criteria.get("limit")
    return limit and limit + max(LEAST_RESERVE, int(limit * RESERVE_SHARE))


def _deep(playlists: Playlists) -> dict[str, Mapping[str, Any]]:
    return {n: {**c, "limit": _depth(c)} for n, c in playlists.items() if c.get("limit")}


def _moves_with_time(criteria: Mapping[str, Any]) -> bool:
    return any(str(r.get("value", "")).endswith("days") for r in criteria.get("rules", ()))


def _matches(tracks: DataFrame, playlists: Playlists, now: dt.datetime) -> DataFrame:
    """(playlist, id, key) of the shown tracks that match, one row for each playlist; key is what the playlist sorts by. One scan for each rules.CHUNK of them."""
    names, shown, found = list(playlists), tracks.where("not is_duplicate"), []
    for at in range(0, len(names), rules.CHUNK):
        hit = [F.when(rules.compile_rules(playlists[n], now), F.struct(F.lit(n).alias("playlist"), rules.sort_key(playlists[n]).alias("key"))) for n in names[at : at + rules.CHUNK]]
        found.append(shown.select("id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("x")).select("x.playlist", "id", "x.key"))
    return reduce(DataFrame.union, found)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written in full."""
    fs, at = buckets.files_at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def _keep(path: str, batch: int, totals: DataFrame, heads: DataFrame | None) -> None:
    if heads is not None:
        heads.write.mode("overwrite").parquet(f"{path}/heads/{batch}")
    totals.write.mode("overwrite").parquet(f"{path}/totals/{batch}")


def _done(spark: SparkSession, path: str) -> int:
    """The last batch whose state is whole; -1 is the start."""
    fs, at = buckets.files_at(spark, f"{path}/totals")
    return max(int(n) for s in fs.listStatus(at) if _there(spark, f"{path}/totals/{(n := s.getPath().getName())}"))


def _evaluate(tracks: DataFrame, playlists: Playlists, now: dt.datetime) -> tuple[DataFrame, DataFrame | None]:
    """(totals (playlist, n), heads (playlist, id, key)) from all tracks: the matches of each playlist, and the first of the limited ones with their reserve."""
    unlimited = {n: {k: v for k, v in c.items() if k != "limit"} for n, c in playlists.items()}
    totals = rules.evaluate_counts(tracks, unlimited, now)
    deep = _deep(playlists)
    if not deep:
        return totals, None
    first = rules.evaluate_members(tracks, deep, now).select("playlist", "id")
    return totals, first.join(_matches(tracks, deep, now), ["playlist", "id"])


def start(tracks: DataFrame, playlists: Playlists, now: dt.datetime, path: str, n_buckets: int = buckets.BUCKETS) -> None:
    """Evaluate the live ``playlists`` over all ``tracks`` once and store both, for apply_changes() to carry on."""
    spark, lists = tracks.sparkSession, live(playlists)
    buckets.create(tracks, f"{path}/tracks", "id", n_buckets)
    _keep(path, -1, *_evaluate(buckets.current(spark, f"{path}/tracks"), lists, now))


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, playlists: Playlists, now: dt.datetime, batch: int) -> list[str]:
    """Bring changed or new tracks (whole rows) in as ``batch``, and return the playlists that had to be evaluated in full.

    Only the changed tracks, as they were and as they are, meet the predicates: totals move by the difference. A limited list keeps
    the first ``limit`` members and a reserve: those that changed leave it, and enter again where they match and sort before its last one, or anywhere if
    it holds all matches. A list that this leaves with less than its limit, though there are more matches, is evaluated in full, as are playlists that
    count days back from ``now``. A batch that is run again starts from the state before it and its changes, so it gives the same.
    """
    lists = live(playlists)
    before = min(_done(spark, path), batch - 1)
    totals = spark.read.parquet(f"{path}/totals/{before}")
    columns = buckets.current(spark, f"{path}/tracks").columns
    folder = f"{path}/changes/{batch}"
    if not _there(spark, folder):
        was = buckets.touched(spark, f"{path}/tracks", changes.select("id")).join(changes.select("id"), "id", "left_semi").select(F.lit(-1).alias("sign"), *columns)
        was.union(changes.select(F.lit(1), *columns)).write.mode("overwrite").parquet(folder)
    both = spark.read.parquet(folder)
    buckets.upsert(spark, f"{path}/tracks", both.where("sign = 1").drop("sign"), buckets.replace_rows)
    tracks = buckets.current(spark, f"{path}/tracks")
    old, new = (both.where(F.col("sign") == s).drop("sign") for s in (-1, 1))
    timed = {n: c for n, c in lists.items() if _moves_with_time(c)}
    steady = {n: c for n, c in lists.items() if n not in timed}
    moved = [_matches(t, steady, now).groupBy("playlist").agg((F.lit(s) * F.count("*")).alias("n")) for t, s in ((old, -1), (new, 1))] if steady else []
    sums = totals.where(~F.col("playlist").isin(list(timed)))
    for m in moved:
        sums = sums.union(m)
    sums = sums.groupBy("playlist").agg(F.sum("n").cast("long").alias("n"))
    deep, heads, again = _deep(steady), None, dict(timed)
    if deep:
        was = spark.read.parquet(f"{path}/heads/{before}").where(F.col("playlist").isin(list(deep)))
        edges = was.groupBy("playlist").agg(F.max(F.struct("key", "id")).alias("last"), F.count("*").alias("held"))
        full = totals.join(edges, "playlist", "left").select("playlist", "last", (F.coalesce("held", F.lit(0)) >= F.col("n")).alias("all_held"))
        stay = was.join(new.select("id").distinct(), "id", "left_anti").select("playlist", "id", "key")
        enter = _matches(new, deep, now).join(full, "playlist").where("all_held or struct(key, id) < last").select("playlist", "id", "key")
        heads = _first(stay.union(enter), deep)
        heads.write.mode("overwrite").parquet(f"{path}/steady-heads/{batch}")
        heads = spark.read.parquet(f"{path}/steady-heads/{batch}")
        held = {r["playlist"]: r["n"] for r in heads.groupBy("playlist").agg(F.count("*").alias("n")).collect()}
        every = {r["playlist"]: r["n"] for r in sums.collect()}  # a row for each playlist
        again |= {n: steady[n] for n in deep if held.get(n, 0) < min(steady[n]["limit"], every.get(n, 0))}
        heads = heads.where(~F.col("playlist").isin(list(again)))
    if again:
        more, first = _evaluate(tracks, again, now)
        sums = sums.where(~F.col("playlist").isin(list(again))).union(more)
        heads = first if heads is None else heads if first is None else heads.unionByName(first)
    _keep(path, batch, sums, heads)
    return sorted(again)


def _first(rows: DataFrame, deep: Playlists) -> DataFrame:
    """The first members of each playlist, as many as it keeps."""
    depth = F.create_map(*[x for n, c in deep.items() for x in (F.lit(n), F.lit(c["limit"]))])
    place = F.row_number().over(Window.partitionBy("playlist").orderBy("key", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= depth[F.col("playlist")]).drop("place")


def counts(spark: SparkSession, path: str, playlists: Playlists) -> DataFrame:
    """(playlist, n) of the live playlists after the last batch; n honours limits."""
    lists = live(playlists)
    names = spark.createDataFrame([(n, c.get("limit")) for n, c in lists.items()], "playlist string, most int")
    totals = spark.read.parquet(f"{path}/totals/{_done(spark, path)}")
    return names.join(totals, "playlist", "left").select("playlist", F.least(F.coalesce("n", F.lit(0)), F.coalesce("most", F.lit(2**62))).cast("long").alias("n"))


def members(spark: SparkSession, path: str, playlists: Playlists) -> DataFrame:
    """(playlist, position, id) of the live playlists with a limit, after the last batch."""
    limits = {n: c["limit"] for n, c in live(playlists).items() if c.get("limit")}
    heads = spark.read.parquet(f"{path}/heads/{_done(spark, path)}")
    placed = heads.withColumn("position", F.row_number().over(Window.partitionBy("playlist").orderBy("key", "id")) - 1)
    most: Column = F.create_map(*[x for n, m in limits.items() for x in (F.lit(n), F.lit(m))])[F.col("playlist")]
    return placed.where(F.col("position") < most).select("playlist", "position", "id")


def played(spark: SparkSession, path: str, counts_of_batch: DataFrame) -> DataFrame:
    """The stored tracks that a batch's play counts (track_id, plays, last_played) change, as they are after it."""
    ids = counts_of_batch.select(F.col("track_id").alias("id"))
    rows = buckets.touched(spark, f"{path}/tracks", ids).join(ids, "id", "left_semi")
    return apply_play_counts(rows, counts_of_batch).select([F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
