"""Playlist upkeep: appending, removing, ordering, matching of imported entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def append_tracks(members: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``members`` (playlist_id, track_id, position, date_added) with ``new`` (playlist_id, ordinal, track_id) behind them.

    Tracks that are there already, or repeat, are skipped; positions go on from the last, dates a second apart.
    """
    fresh = new.groupBy("playlist_id", "track_id").agg(F.min("ordinal").alias("ordinal")).join(members, ["playlist_id", "track_id"], "left_anti")
    last = members.groupBy("playlist_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("playlist_id").orderBy("ordinal"))
    added = fresh.withColumn("i", place).join(last, "playlist_id", "left")
    rows = added.select("playlist_id", "track_id", (F.coalesce("last", F.lit(-1)) + F.col("i")).cast("int").alias("position"), (F.lit(now) + F.col("i") - 1).cast("long").alias("date_added"))
    return members.select("playlist_id", "track_id", "position", "date_added").union(rows)


def remove_tracks(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without ``gone`` (playlist_id, track_id), numbered anew from 0."""
    kept = members.join(gone, ["playlist_id", "track_id"], "left_anti")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("playlist_id").orderBy("position", "track_id")) - 1)


def reorder(members: DataFrame, order: DataFrame) -> DataFrame:
    """Positions from ``order`` (playlist_id, track_id, ordinal); tracks that it lacks keep theirs."""
    return members.join(order, ["playlist_id", "track_id"], "left").withColumn("position", F.coalesce(F.col("ordinal").cast("int"), F.col("position"))).drop("ordinal")


def _decoded(c: Column) -> Column:
    """Percent escapes decoded, plus signs kept; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def path_variants(entry: Column, base: Column) -> Column:
    """Paths that an entry may mean, in order: as written, without its scheme, share marks as volumes, decoded, and relative to ``base``."""
    slashed = F.replace(entry, F.lit("\\"), F.lit("/"))
    local = F.regexp_replace(slashed, r"(?i)^(file|smb|afp|nfs)://(localhost(?=/))?", "")
    local = F.when(slashed.rlike(r"(?i)^(smb|afp|nfs)://"), F.concat(F.lit("/Volumes/"), F.regexp_replace(local, r"^[^/]*/", ""))).otherwise(local)
    share = F.when(local.startswith("//"), F.concat(F.lit("/Volumes/"), F.substring(local, 3, 1 << 30))).otherwise(local)
    volume = F.when(share.startswith("/Volumes/"), F.substring(share, 9, 1 << 30)).otherwise(F.concat(F.lit("/Volumes"), share))
    below = F.when(~share.startswith("/"), F.concat(base, F.lit("/"), F.regexp_replace(share, r"^(\./)+", "")))
    every = F.array(entry, share, _decoded(share), volume, _decoded(volume), below, _decoded(below))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull()))


def match_import(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """``entries`` (playlist, base, ordinal, entry) with track_id and how: path, nocase, filename, or null where missing.

    Each entry's path variants are joined by exact path, then ignoring case; entries left over match by file name where that is
    unique in the library. Equi-joins on spread-out keys only.
    """
    variants = entries.select("playlist", "ordinal", F.posexplode(path_variants(F.col("entry"), F.col("base"))).alias("priority", "path"))
    by = lambda how, on, n: variants.withColumn("key", on(F.col("path"))).join(tracks.select(on(F.col("path")).alias("key"), F.col("id").alias("track_id")), "key").select("playlist", "ordinal", F.struct(F.lit(n).alias("step"), "priority", "track_id").alias("hit"))
    hits = by("path", lambda p: p, 0).union(by("nocase", S.nocase, 1))
    best = hits.groupBy("playlist", "ordinal").agg(F.min("hit").alias("hit"))
    name = lambda p: F.lower(S.file_name(p))
    unique = tracks.groupBy(name(F.col("path")).alias("key")).agg(F.min("id").alias("by_name"), F.count("*").alias("n")).where("n = 1 and key <> ''").drop("n")
    left = entries.join(best, ["playlist", "ordinal"], "left")
    key = name(_decoded(F.replace(F.col("entry"), F.lit("\\"), F.lit("/"))))
    out = left.withColumn("key", F.when(F.col("hit").isNull(), key)).join(unique, "key", "left")
    how = F.when(F.col("hit.step") == 0, "path").when(F.col("hit.step") == 1, "nocase").when(F.col("by_name").isNotNull(), "filename")
    return out.select("playlist", "ordinal", "entry", F.coalesce("hit.track_id", "by_name").alias("track_id"), how.alias("how"))


def import_report(matched: DataFrame) -> DataFrame:
    """(playlist, total, added, missing, result) of match_import() rows."""
    sums = matched.groupBy("playlist").agg(F.count("*").alias("total"), F.count_distinct("track_id").alias("added"), F.count_if(F.col("track_id").isNull()).alias("missing"))
    result = F.when(F.col("added") == 0, "failed").when(F.col("missing") > 0, "warnings").otherwise("success")
    return sums.withColumn("result", result)


def unique_playlist_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(ordinal, name): ``wanted`` (ordinal, name), a number behind those that exist (ignoring case) or repeat, from the highest in use."""
    low = F.lower("name")
    base = wanted.withColumn("base", low)
    bases = base.select("base").distinct()
    used = taken.select(low.alias("t"))
    exact = used.join(bases, F.col("t") == F.col("base"), "left_semi").select(F.col("t").alias("base"), F.lit(True).alias("exists")).distinct()
    numbered = used.select(F.regexp_extract("t", r"^(.*) (\d{1,9})$", 1).alias("base"), F.regexp_extract("t", r"^(.*) (\d{1,9})$", 2).alias("n")).where("n <> ''").groupBy("base").agg(F.max(F.col("n").cast("int")).alias("top"))
    order = F.row_number().over(Window.partitionBy("base").orderBy("ordinal"))
    rows = base.withColumn("i", order).join(exact, "base", "left").join(numbered, "base", "left")
    extra = F.when(F.col("exists"), F.col("i")).otherwise(F.col("i") - 1)
    return rows.select("ordinal", F.when(extra == 0, F.col("name")).otherwise(F.concat("name", F.lit(" "), (F.coalesce("top", F.lit(0)) + extra).cast("string"))).alias("name"))
