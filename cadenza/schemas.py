"""Declared schemas of the library's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "tracks": "id long, path string, title string, artist string, album string, album_id long, album_artist string, composer string, genre string, year string, duration double, format string, codec string, bitrate int, "
    "sample_rate int, bit_depth int, lossless boolean, track_number int, disc_number int, compilation boolean, rating int, is_favorite boolean, play_count int, last_played long, date_added long, mtime double, file_size long, "
    "is_duplicate boolean, primary_track_id long, duplicate_group_id string, artwork_ref string, extended_metadata string",
    "artists": "artist_id long, name string, normalized_name string",
    "albums": "album_id long, title string, normalized_title string",
    "genres": "genre_id long, name string",
    "track_artists": "track_id long, artist_id long, role string, position int",
    "album_artists": "album_id long, artist_id long, role string, position int",
    "track_genres": "track_id long, genre_id long",
    "playlists": "playlist_id long, name string, smart_criteria string",
    "playlist_tracks": "playlist_id long, track_id long, position int, date_added long",
    "pins": "pin_id long, kind string, value string",
    "artist_aliases": "alias string, canonical string",
    "album_aliases": "alias string, canonical string",
    "folders": "folder string, mtime double, hash string",
    "fingerprints": "track_id long, bpm double, bpm_confidence double, rms_loudness_db double, dynamic_range_db double, spectral_brightness_hz double, bass_ratio double, beat_regularity double, mix_version string, mix_class string",
    "nodes": "mbid string, kind string, title string, artist string, year int, label string, primary_type string",
    "edges": "source_mbid string, target_mbid string, relation string, target_kind string",
}
CRITERIA = "struct<matchType:string,rules:array<struct<field:string,condition:string,value:string>>,limit:int,sortBy:string,sortAscending:boolean,autoUpdate:boolean>"
# What every track row has to keep to.
CHECKS = {"duration": "duration is null or duration >= 0", "rating": "rating is null or rating between 0 and 5", "path": "path is not null", "id": "id is not null"}


def violations(tracks: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule that the columns of ``tracks`` allow to check."""
    rules = {n: c for n, c in CHECKS.items() if n in tracks.columns}
    counts = tracks.agg(*[F.count_if(~F.expr(c)).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")
