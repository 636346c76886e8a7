"""Listings, category counts and orderings of a library.

Tables: tracks (id, title, artist, album, album_id, genre, year as text, ...), artists (artist_id, name, normalized_name),
albums (album_id, title), track_artists (track_id, artist_id, role, position), album_artists (album_id, artist_id, role, position).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import rules

NO_DISC, NO_TRACK = 1, 0
#: About so many tracks of one value meet its pins at a time.
PIECE = 8192


def _album_order() -> list[Column]:
    return [F.coalesce(F.col("disc_number"), F.lit(NO_DISC)), F.coalesce(F.col("track_number"), F.lit(NO_TRACK)), F.col("id")]


# --- selections ---


def tracks_by_artist(tracks: DataFrame, artists: DataFrame, track_artists: DataFrame, name: str, role: str | None = None) -> DataFrame:
    """Tracks credited to an artist of this name or of the same normalised name; a placeholder is compared with the tag itself."""
    if name in S.PLACEHOLDERS:
        column = {"composer": "composer", "album_artist": "album_artist"}.get(role or "", "artist")
        return tracks.where(F.col(column) == name).orderBy("title", "id")
    who = artists.where((F.col("name") == name) | (F.col("normalized_name") == S.normalize_artist_name(F.lit(name))))
    links = track_artists if role is None else track_artists.where(F.col("role") == role)
    ids = links.join(who, "artist_id", "left_semi").select(F.col("track_id").alias("id"))
    return tracks.join(ids, "id", "left_semi").orderBy("title", "id")


def tracks_by_album(tracks: DataFrame, album: int | str, artist: str | None = None, hide_duplicates: bool = True) -> DataFrame:
    """Tracks of an album by its id or, where that is not known, its title and, where given, its album artist; by disc and track number."""
    found = S.hide_duplicates(tracks, hide_duplicates)
    if isinstance(album, int):
        found = found.where(F.col("album_id") == album)
    else:
        found = found.where(F.col("album") == album)
        found = found if artist is None else found.where(F.col("album_artist") == artist)
    return found.orderBy(*_album_order())


def tracks_by_genre(tracks: DataFrame, genre: str) -> DataFrame:
    return tracks.where(F.col("genre") == genre).orderBy("title", "id")


def tracks_by_year(tracks: DataFrame, year: str) -> DataFrame:
    return tracks.where(F.col("year") == year).orderBy("title", "id")


def tracks_by_decade(tracks: DataFrame, decade: int, by_album: bool = False) -> DataFrame:
    """Years are compared as text, so a full date of the decade's last year lies outside."""
    found = tracks.where((F.col("year") >= str(decade)) & (F.col("year") <= str(decade + 9)))
    return found.where(~F.col("year").isin("", S.UNKNOWN_YEAR)).orderBy("year", "album", "id") if by_album else found.orderBy("title", "id")


def artist_tracklist(tracks: DataFrame, artists: DataFrame, track_artists: DataFrame, name: str) -> DataFrame:
    found = tracks_by_artist(S.hide_duplicates(tracks), artists, track_artists, name, "artist")
    return found.orderBy("album", *_album_order())


def tracks_of_entities(tracks: DataFrame, bridge: DataFrame, entity: str, ids: Sequence[int]) -> DataFrame:
    """Tracks that a bridge ties to any of the entities, in whatever role."""
    wanted = bridge.where(F.col(entity).isin(*ids)).select(F.col("track_id").alias("id"))
    return tracks.join(wanted, "id", "left_semi")


def playlist_tracks_ordered(playlist_tracks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Members of playlists with their tracks; date_added is the playlist's."""
    members = playlist_tracks.select("playlist_id", F.col("track_id").alias("id"), "position", F.col("date_added").alias("added"))
    joined = members.join(tracks.drop("date_added") if "date_added" in tracks.columns else tracks, "id")
    return joined.withColumnRenamed("added", "date_added").orderBy("playlist_id", "position")


def _spread(pins: DataFrame, members: DataFrame) -> DataFrame:
    """``pins`` (kind, value, ...) with the id of each of ``members`` (kind, value, id); members of one value meet its pins in pieces of PIECE, so no value is one task."""
    counts = members.groupBy("kind", "value").agg(F.ceil(F.count("*") / PIECE).alias("n"))
    dealt = members.join(counts, ["kind", "value"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("n")))
    null = F.array(F.lit(None).cast(members.schema["id"].dataType))
    pieces = dealt.groupBy("kind", "value", "piece").agg(F.when(F.bool_or(F.col("id").isNull()), F.concat(F.collect_list("id"), null)).otherwise(F.collect_list("id")).alias("ids"))
    met = pins.join(counts, ["kind", "value"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return met.join(pieces, ["kind", "value", "piece"]).select(*pins.columns, F.explode("ids").alias("id"))


def pinned_tracks(
    pins: DataFrame, tracks: DataFrame, track_artists: DataFrame, artists: DataFrame, playlist_tracks: DataFrame, smart: Mapping[str, Mapping[str, Any]] | None = None, now: dt.datetime | None = None, fingerprints: DataFrame | None = None
) -> DataFrame:
    """(pin_id, id) of the tracks behind pins (pin_id, kind, value): kinds artist, album, genre, year, decade, playlist and smart.

    A pin of kind smart names one of the ``smart`` playlists (criteria by name), whose members at ``now`` it shows, limits honoured;
    all that are pinned are evaluated in one scan.
    """
    of = lambda kind: pins.where(F.col("kind") == kind).select("pin_id", "value")
    member = lambda df, kind, value, track: df.select(F.lit(kind).alias("kind"), value.alias("value"), F.col(track).alias("id"))
    members = member(track_artists.where("role = 'artist'").join(artists, "artist_id"), "artist", F.col("name"), "track_id")
    for kind, value in (("album", F.col("album")), ("genre", F.col("genre")), ("year", F.col("year")), ("decade", S.decade_text(F.col("year")))):
        members = members.union(member(tracks, kind, value, "id"))
    members = members.union(member(playlist_tracks, "playlist", F.col("playlist_id").cast("string"), "track_id"))
    # What stands behind a value is made distinct once, not what is shown for each of its pins; only pins of one id for several values can show a track twice.
    asked = pins.select("pin_id", "kind", "value").distinct().withColumn("several", F.count("*").over(Window.partitionBy("pin_id")) > 1)
    found = _spread(asked, members.join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi").distinct())
    found = found.where("not several").select("pin_id", "id").union(found.where("several").select("pin_id", "id").distinct())
    if not smart:
        return found
    shown = rules.evaluate_members(tracks, smart, now or dt.datetime.now(dt.UTC), fingerprints).select(F.col("playlist").alias("value"), "id")
    return found.union(of("smart").join(shown, "value").select("pin_id", "id"))


def unanalysed_tracks(tracks: DataFrame, fingerprints: DataFrame, version: int | None = None) -> DataFrame:
    """Tracks, no duplicates, without a fingerprint of analyser ``version`` or later."""
    done = fingerprints if version is None else fingerprints.where(F.col("analyser_version") >= version)
    return S.hide_duplicates(tracks).join(done.select(F.col("track_id").alias("id")), "id", "left_anti")


# --- counts ---

_ROLES = {"artist": S.UNKNOWN_ARTIST, "album_artist": S.UNKNOWN_ALBUM_ARTIST, "composer": S.UNKNOWN_COMPOSER}


def artist_counts(tracks: DataFrame, artists: DataFrame, track_artists: DataFrame, role: str = "artist") -> DataFrame:
    """(artist_id, name, n_tracks) of every artist with tracks in this role, and one row for tracks without.

    The bridge holds an (artist, track, role) once, so a plain count, pre-aggregated by task, is the distinct count.
    """
    counts = track_artists.where(F.col("role") == role).join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi").groupBy("artist_id").agg(F.count("*").alias("n_tracks"))
    known = counts.join(artists.select("artist_id", "name"), "artist_id").select("artist_id", "name", "n_tracks")
    missing = F.col(role).isNull() | F.col(role).isin("", _ROLES[role])
    unknown = tracks.where(missing).agg(F.count("*").alias("n_tracks")).where("n_tracks > 0").select(F.lit(None).cast("long").alias("artist_id"), F.lit(_ROLES[role]).alias("name"), "n_tracks")
    return known.unionByName(unknown).orderBy(F.lower("name"), "name")


def album_counts(tracks: DataFrame, albums: DataFrame, hide_duplicates: bool = True) -> DataFrame:
    shown = S.hide_duplicates(tracks, hide_duplicates)
    counts = shown.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("n_tracks"))
    known = counts.join(albums.select("album_id", F.col("title").alias("name")), "album_id").select("album_id", "name", "n_tracks")
    unknown = shown.where(F.col("album") == S.UNKNOWN_ALBUM).agg(F.count("*").alias("n_tracks")).where("n_tracks > 0")
    return known.unionByName(unknown.select(F.lit(None).cast("long").alias("album_id"), F.lit(S.UNKNOWN_ALBUM).alias("name"), "n_tracks")).orderBy(F.lower("name"), "album_id")


def value_counts(tracks: DataFrame, column: str, unknown: str) -> DataFrame:
    """(name, n_tracks) for each raw text of a column; null, empty and the placeholder are one row."""
    c = F.col(column)
    name = F.when(c.isNull() | c.isin("", unknown), unknown).otherwise(c)
    return tracks.groupBy(name.alias("name")).agg(F.count("*").alias("n_tracks"))


def genre_counts(tracks: DataFrame) -> DataFrame:
    return value_counts(tracks, "genre", S.UNKNOWN_GENRE).orderBy(F.lower("name"), "name")


def year_counts(tracks: DataFrame) -> DataFrame:
    return value_counts(tracks, "year", S.UNKNOWN_YEAR).orderBy(F.desc("name"))


def decade_counts(tracks: DataFrame) -> DataFrame:
    counts = tracks.groupBy(S.decade_text(F.col("year")).alias("name")).agg(F.count("*").alias("n_tracks"))
    return counts.orderBy(F.desc(F.when(F.col("name") == S.UNKNOWN_DECADE, "9999").otherwise(F.col("name"))))


def decade_stats(tracks: DataFrame) -> DataFrame:
    """(decade, n_tracks), newest first, of tracks whose year is a whole number above 0; duplicates count."""
    year = F.when(F.trim("year").rlike(r"^\d{1,9}$"), F.trim("year").cast("int"))
    return tracks.withColumn("y", year).where("y > 0").groupBy((F.floor(F.col("y") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n_tracks")).orderBy(F.desc("decade"))


def album_entities(tracks: DataFrame, albums: DataFrame, album_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """(album_id, title, artist, n_tracks, duration) of albums with tracks: the primary artist of lowest position, else the tags'."""
    sums = S.hide_duplicates(tracks).where("album_id is not null").groupBy("album_id").agg(
        F.count("*").alias("n_tracks"), F.sum("duration").alias("duration"), S.empty_to_null(F.max("album_artist")).alias("tag_album_artist"), F.max("artist").alias("tag_artist"))
    first = album_artists.where("role = 'primary'").join(artists, "artist_id").groupBy("album_id").agg(F.min_by("name", F.struct("position", "artist_id")).alias("primary_artist"))
    out = albums.join(sums, "album_id").join(first, "album_id", "left")
    return out.select("album_id", "title", F.coalesce("primary_artist", "tag_album_artist", "tag_artist").alias("artist"), "n_tracks", F.coalesce("duration", F.lit(0.0)).alias("duration"))


def artist_entities(stats: DataFrame) -> DataFrame:
    """Artists with tracks, of (artist_id, name, total_tracks, ...), by name."""
    return stats.where("total_tracks > 0").orderBy(F.lower("name"), "artist_id")


def library_totals(tracks: DataFrame, track_artists: DataFrame) -> DataFrame:
    """One row: n_tracks, duration, file_size, n_albums, n_artists."""
    of_tracks = tracks.agg(F.count("*").alias("n_tracks"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size"), F.count_distinct("album_id").alias("n_albums"))
    return of_tracks.crossJoin(F.broadcast(track_artists.agg(F.count_distinct("artist_id").alias("n_artists"))))  # one row each


def format_counts(tracks: DataFrame) -> DataFrame:
    name = F.when(F.col("format") == "", "(none)").otherwise(F.lower("format"))
    return tracks.groupBy(name.alias("format")).agg(F.count("format").alias("n_tracks")).where("format is not null")


def folder_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(S.parent_dir(F.col("path")).alias("folder")).agg(F.count("*").alias("n_tracks"))


def folder_tree(tracks: DataFrame, root: str) -> DataFrame:
    """(path, name, parent, n_tracks, n_folders) of every directory at or under ``root`` that holds tracks, directly or below.

    Tracks are counted by directory first; only directories are spread over their ancestors.
    """
    root = root.rstrip("/")
    direct = folder_counts(tracks).where((F.col("folder") == root) | F.col("folder").startswith(root + "/"))
    parts = F.split(F.substring("folder", len(root) + 2, 1 << 30), "/")
    deep = F.when(F.col("folder") == root, F.lit(0)).otherwise(F.size(parts))
    paths = F.transform(F.sequence(F.lit(0), deep), lambda i: F.when(i == 0, root).otherwise(F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/"))))
    nodes = direct.select(F.explode(paths).alias("path")).distinct()
    nodes = nodes.withColumn("parent", F.when(F.col("path") != root, S.parent_dir(F.col("path"))))
    below = nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_folders")).where("path is not null")
    out = nodes.join(direct.withColumnRenamed("folder", "path"), "path", "left").join(below, "path", "left").fillna(0, ["n_tracks", "n_folders"])
    return out.select("path", S.file_name(F.col("path")).alias("name"), "parent", "n_tracks", "n_folders").orderBy(F.lower("path"))


def playlist_counts(playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    counts = playlist_tracks.groupBy("playlist_id").agg(F.count("*").alias("n_tracks"))
    return playlists.select("playlist_id").join(counts, "playlist_id", "left").fillna(0, ["n_tracks"])


def pinned_counts(pins: DataFrame, categories: DataFrame, playlists: DataFrame) -> DataFrame:
    """(pin_id, n_tracks): library pins by category counts (kind, value, n_tracks), playlist pins by playlist counts; 0 where there are none."""
    every = categories.select("kind", "value", "n_tracks").union(playlists.select(F.lit("playlist"), F.col("playlist_id").cast("string"), "n_tracks"))
    return pins.join(every, ["kind", "value"], "left").select("pin_id", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))


def skipped_extensions(inventory: DataFrame, n: int = 3) -> DataFrame:
    skipped = inventory.where(~F.col("extension").isin(*S.SUPPORTED))
    return skipped.groupBy("extension").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "extension").limit(n)


def distinct_values(counts: DataFrame, unknown: str, newest_first: bool = False) -> DataFrame:
    """Names of a category table, sorted, its placeholder last."""
    name = F.desc("name") if newest_first else F.lower("name").asc()
    return counts.select("name").distinct().orderBy(F.col("name") == unknown, name, "name")


def category_counts_from_tracks(credits: DataFrame) -> DataFrame:
    """(name, n_tracks) from split credits (track_id, artist): distinct tracks by normalised name, longest spelling shown."""
    keyed = credits.select("track_id", "artist", S.normalize_artist_name(F.col("artist")).alias("key")).groupBy("key", "track_id").agg(F.max(F.struct(F.length("artist").alias("n"), "artist")).alias("best"))
    return keyed.groupBy("key").agg(F.max("best").alias("best"), F.count("*").alias("n_tracks")).select(F.col("best.artist").alias("name"), "n_tracks")


# --- orderings ---

_ALBUM_SORTS = {"album": (F.lower, "title", ""), "artist": (F.lower, "artist", ""), "year": (None, "year", ""), "dateAdded": (None, "date_added", 0)}


def sort_albums(albums: DataFrame, by: str = "album", ascending: bool = True) -> DataFrame:
    fold, column, missing = _ALBUM_SORTS[by]
    key = F.coalesce(F.col(column), F.lit(missing))
    keys = [fold(key) if fold else key, F.lower("title"), F.col("album_id")]
    return albums.orderBy(*[k.asc() if ascending else k.desc() for k in keys])


TRACK_SORTS = ("title", "artist", "album", "genre", "year", "duration", "format", "bitrate", "play_count", "composer", "track_number", "disc_number", "last_played", "date_added", "is_favorite")


def sort_tracks(tracks: DataFrame, by: str = "title", ascending: bool = True) -> DataFrame:
    """Null track and disc numbers come last when ascending, null dates first, favourites first."""
    if by not in TRACK_SORTS:
        raise ValueError(f"tracks are not sorted by {by}")
    c = F.col(by)
    if by in ("track_number", "disc_number"):
        key = F.coalesce(c, F.lit(2**31 - 1))
    elif by in ("last_played", "date_added"):
        key = F.coalesce(c, F.lit(-(2**62)))
    elif by == "is_favorite":
        key = F.when(c, 0).otherwise(1)
    else:
        key = F.lower(c) if dict(tracks.dtypes)[by] == "string" else c
    return tracks.orderBy(key.asc() if ascending else key.desc(), "id")


def discover(tracks: DataFrame, limit: int = 50, exclude: Sequence[int] = (), seed: int = 0) -> DataFrame:
    """Unplayed tracks in an order that ``seed`` sets; a shortfall is filled by the least recently, then least often played."""
    pool = S.hide_duplicates(tracks).where(~F.col("id").isin(*exclude)) if exclude else S.hide_duplicates(tracks)
    fresh = pool.where(F.coalesce("play_count", F.lit(0)) == 0).withColumn("rank", F.struct(F.lit(0), F.lit(0).cast("long"), F.lit(0), F.xxhash64("id", F.lit(seed)), "id"))
    played = pool.where("play_count > 0").withColumn("rank", F.struct(F.lit(1), F.coalesce(F.col("last_played").cast("long"), F.lit(-(2**62))), F.col("play_count"), F.lit(0).cast("long"), "id"))
    return fresh.union(played).orderBy("rank").limit(limit).drop("rank")


def tracks_in_order(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tracks of a list (ordinal, id) in the list's order; ids that the library lacks are left out."""
    return ids.join(tracks, "id").orderBy("ordinal")
