"""Play counts, scrobbles and favourites from a stream of player events (event_id, ts, track_id, stop_reason, favourite).

The functions on frames work on streams and on tables alike. Sinks write one folder for each micro-batch, replaced if the
batch is run again, so a batch counts once however often it is tried. Playlists that follow the stream are in live.py.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import scalars as S
from ..sources.buckets import files_at

LEAST_SECONDS = 30


def _epoch(df: DataFrame, c: str) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone (without: as UTC)."""
    naive = dict(df.dtypes)[c] == "timestamp_ntz"
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") if naive else F.unix_seconds(c)


#: Parts of a track's events that keep state apart, so that no track is one task.
SALT = 16
HEARD = "event_id long, ts timestamp, track_id long, recent boolean"


def heard_once(events: DataFrame, delay: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """(event_id, ts, track_id, recent) of a stream's events of tracks heard to their end, without repeats that state can tell.

    State holds for each track, in SALT parts by event, the newest time and the event ids of the ``delay`` before it; older ids expire. An event in that time
    is ``recent``: it passes once. One from before it, whose id may have expired, passes as not recent, for ledger_batch() to look up. No event is left
    out for being late. Events without an id cannot be told apart and pass; those without a time are never recent.
    """
    span = int(delay.total_seconds() * 1_000_000)

    def work(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, ids, times = state.get if state.exists else (None, [], [])
        known = dict(zip(ids, times, strict=True))
        for f in frames:
            out = []
            for i, us, track in zip(f["event_id"], f["us"], f["track_id"], strict=True):
                i, us = (None if pd.isna(x) else int(x) for x in (i, us))
                if us is not None and i is not None and i in known:
                    continue
                recent = us is not None and (newest is None or us > newest - span)
                out.append((i, us, track, recent))
                if recent and i is not None:
                    known[i] = us
                newest = us if us is not None and (newest is None or us > newest) else newest
            yield pd.DataFrame({"event_id": pd.array([o[0] for o in out], "Int64"), "ts": pd.to_datetime(pd.array([o[1] for o in out], "Int64"), unit="us"), "track_id": [o[2] for o in out], "recent": [o[3] for o in out]})
        left = {i: t for i, t in known.items() if newest is None or t > newest - span}
        state.update((newest, list(left), list(left.values())))

    ended = events.where("stop_reason = 'eof' and track_id is not null").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("track_id").cast("long").alias("track_id"), F.pmod(F.xxhash64("event_id"), F.lit(SALT)).alias("salt"))
    return ended.groupBy("track_id", "salt").applyInPandasWithState(work, HEARD, "newest long, ids array<long>, times array<long>", "append", "NoTimeout")


def ledger_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Count a micro-batch of heard_once(): plays of each track to ``path``/plays, and its events to the ledger ``path``/ledger, by day and batch.

    Events that are not recent are looked up in the ledger of earlier batches, of which only the days that they are of are listed and read, and in
    their own batch. What is written is the batch's own and replaced if it is run again, which therefore changes nothing. An event that comes again
    is of the same time.
    """
    spark = batch.sparkSession
    marked = batch.withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit("none")))
    folder = f"{path}/staged/{batch_id}"
    marked.write.mode("overwrite").parquet(folder)
    marked = spark.read.schema(marked.schema).parquet(folder)
    rows, late = marked.where("recent"), marked.where("not recent")
    days = [r["day"] for r in late.select("day").distinct().collect()]
    if days:
        known = read_ledger(spark, path, days).where(F.col("batch") < batch_id).select("event_id")
        named = late.where("event_id is not null").dropDuplicates(["event_id"]).join(known.union(rows.select("event_id")), "event_id", "left_anti")
        rows = rows.unionByName(late.where("event_id is null")).unionByName(named)
    counted = rows.select("event_id", "track_id", "ts", "day", F.lit(batch_id).cast("long").alias("batch"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/ledger")
    rows.groupBy("track_id").agg(F.count("*").alias("plays"), F.max("ts").alias("last_played")).write.mode("overwrite").parquet(f"{path}/plays/batch={batch_id}")


def read_ledger(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    """(event_id, track_id, ts, day, batch) of the counted events of these days."""
    schema = "event_id long, track_id long, ts timestamp, day string, batch long"
    folders = [f"{path}/ledger/day={d}" for d in days]
    there = [f for f in folders if (found := files_at(spark, f)) and found[0].exists(found[1])]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/ledger").parquet(*there)


def run_play_counts(stream: DataFrame, path: str, checkpoint: str, delay: dt.timedelta = dt.timedelta(hours=1), then: Callable[[DataFrame, int], None] | None = None) -> None:
    """Count all that ``stream`` has to offer into ``path``; ``then`` gets each batch's (track_id, plays, last_played) and its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger_batch(batch, batch_id, path)
        if then is not None:
            then(batch.sparkSession.read.schema("track_id long, plays long, last_played timestamp").parquet(f"{path}/plays/batch={batch_id}"), batch_id)

    heard_once(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def play_counts(events: DataFrame) -> DataFrame:
    """(track_id, plays, last_played): only tracks heard to their end count."""
    return events.where("stop_reason = 'eof'").groupBy("track_id").agg(F.count("*").alias("plays"), F.max("ts").alias("last_played"))


def scrobble_feed(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """(event_id, artist, title, album, seconds, epoch) of tracks of 30 seconds or more heard to their end; an unknown album is left out."""
    t = tracks.where(F.col("duration") >= LEAST_SECONDS).select(F.col("id").alias("track_id"), "artist", "title", F.when(F.col("album") != S.UNKNOWN_ALBUM, F.col("album")).alias("album"), F.floor("duration").cast("long").alias("seconds"))
    return events.where("stop_reason = 'eof'").join(t, "track_id").select("event_id", "artist", "title", "album", "seconds", _epoch(events, "ts").alias("epoch"))


def favourite_changes(events: DataFrame) -> DataFrame:
    """(track_id, is_favorite, ts, event_id): the latest state of each track, ties to the higher event_id, and the event that set it."""
    latest = F.max_by(F.struct(F.col("favourite").alias("is_favorite"), "ts", "event_id"), F.struct("ts", "event_id")).alias("latest")
    return events.where("favourite is not null").groupBy("track_id").agg(latest).select("track_id", "latest.*")


def to_batches(stream: DataFrame, path: str, checkpoint: str, per_batch: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Run all that ``stream`` has to offer, writing ``per_batch`` of each micro-batch to ``path``/batch=<id>."""

    def write(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_plays(spark: SparkSession, path: str) -> DataFrame:
    """Totals over the batches that run_play_counts() has written."""
    return spark.read.parquet(f"{path}/plays").groupBy("track_id").agg(F.sum("plays").alias("plays"), F.max("last_played").alias("last_played"))


def latest_favourites(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, is_favorite) over the batches that to_batches(..., favourite_changes) has written, by the time of the events, whichever batch they came in."""
    return spark.read.parquet(path).groupBy("track_id").agg(F.max_by("is_favorite", F.struct("ts", "event_id")).alias("is_favorite"))


def apply_play_counts(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Tracks with plays added and last_played (epoch seconds) moved forward."""
    new = counts.select(F.col("track_id").alias("id"), "plays", _epoch(counts, "last_played").alias("heard"))
    joined = tracks.join(new, "id", "left")
    return joined.withColumn("play_count", F.col("play_count") + F.coalesce("plays", F.lit(0))).withColumn("last_played", F.greatest("last_played", "heard")).drop("plays", "heard")
