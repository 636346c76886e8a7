"""Registered queries of rules and playlists, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import playlists as L
from ..operators import rules as P
from .registry import Registry

R = Registry()
NOW = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
SECONDS = 1709251200

rule = lambda field, condition, value: {"field": field, "condition": condition, "value": value}
ALL = {"matchType": "all", "rules": [rule("title", "contains", "RING"), rule("play_count", "greaterThanOrEqual", "2"), rule("year", "greaterThan", "1970"), rule("duration", "lessThan", "300"), rule("bitrate", "equals", "no number")]}
ANY = {"matchType": "any", "rules": [rule("genre", "equals", "economy"), rule("duration", "equals", "250"), rule("date_added", "equals", "2024-01-02"), rule("is_favorite", "equals", "true"), rule("colour", "equals", "red")]}
BPM = {"matchType": "all", "rules": [rule("bpm", "greaterThan", "120"), rule("energy", "greaterThan", "0.4")], "sortBy": "bpm", "sortAscending": False, "limit": 40}
LISTS = {"all": ALL, "any": ANY, **P.DEFAULT_PLAYLISTS, "early": {"rules": [rule("date_added", "lessThan", "45days")], "sortBy": "title", "sortAscending": False, "limit": 30}}
ALL_SQL = "lower(title) LIKE '%ring%' AND play_count >= 2 AND year <> 'Unknown Year' AND CAST(CASE WHEN year = 'Unknown Year' THEN '0' ELSE year END AS INT) > 1970 AND duration < 300"
ANY_SQL = "(lower(genre) = 'economy' OR duration >= 250 AND duration < 251 OR date_added >= 1704153600 AND date_added < 1704240000 OR is_favorite)"


@R.query("p1_rules_all", f"SELECT id FROM v_tracks WHERE NOT is_duplicate AND {ALL_SQL}")
def _(v):
    return P.evaluate(v("v_tracks"), ALL, NOW).select("id")


@R.query("p1_rules_any", f"SELECT id FROM v_tracks WHERE NOT is_duplicate AND {ANY_SQL}")
def _(v):
    return P.evaluate(v("v_tracks"), ANY, NOW).select("id")


ENERGY = """SELECT track_id, bpm, ((rms_loudness_db - min(rms_loudness_db) OVER ()) / (max(rms_loudness_db) OVER () - min(rms_loudness_db) OVER ())
    + (coalesce(bpm, min(bpm) OVER ()) - min(bpm) OVER ()) / (max(bpm) OVER () - min(bpm) OVER ()) + (bass_ratio - min(bass_ratio) OVER ()) / (max(bass_ratio) OVER () - min(bass_ratio) OVER ())
    + 1 - (dynamic_range_db - min(dynamic_range_db) OVER ()) / (max(dynamic_range_db) OVER () - min(dynamic_range_db) OVER ())) / 4 AS energy FROM v_fingerprints"""


@R.query("p2_evaluate_bpm", "SELECT id, bpm FROM v_tracks JOIN energies ON id = track_id WHERE NOT is_duplicate AND bpm > 120 AND energy > 0.4 ORDER BY bpm DESC, id LIMIT 40", energies=ENERGY)
def _(v):
    return P.evaluate(v("v_tracks"), BPM, NOW, v("v_fingerprints")).select("id", "bpm")


@R.query("p3_many_counts", f"""
    SELECT 'all' AS playlist, count(*) AS n FROM v_tracks WHERE NOT is_duplicate AND {ALL_SQL} UNION ALL SELECT 'any', count(*) FROM v_tracks WHERE NOT is_duplicate AND {ANY_SQL}
    UNION ALL SELECT 'Favorites', count(*) FROM v_tracks WHERE NOT is_duplicate AND is_favorite UNION ALL SELECT 'Most Played', least(25, count(*)) FROM v_tracks WHERE NOT is_duplicate AND play_count >= 5
    UNION ALL SELECT 'Recently Played', least(25, count(*)) FROM v_tracks WHERE NOT is_duplicate AND last_played >= {SECONDS - 7 * 86400} UNION ALL SELECT 'early', least(30, count(*)) FROM v_tracks WHERE NOT is_duplicate AND date_added < {SECONDS - 45 * 86400}""")
def _(v):
    return P.evaluate_counts(v("v_tracks"), LISTS, NOW)


MEMBERS = f"""SELECT 'all' AS playlist, row_number() OVER (ORDER BY id) - 1 AS position, id FROM v_tracks WHERE NOT is_duplicate AND {ALL_SQL}
    UNION ALL SELECT 'Most Played', row_number() OVER (ORDER BY play_count DESC, id) - 1, id FROM v_tracks WHERE NOT is_duplicate AND play_count >= 5 QUALIFY row_number() OVER (ORDER BY play_count DESC, id) <= 25
    UNION ALL SELECT 'early', row_number() OVER (ORDER BY title DESC, id) - 1, id FROM v_tracks WHERE NOT is_duplicate AND date_added < {SECONDS - 45 * 86400} QUALIFY row_number() OVER (ORDER BY title DESC, id) <= 30"""


@R.query("p3_many_members", f"SELECT playlist, CAST(position AS INT) AS position, id FROM ({MEMBERS}) d")
def _(v):
    return P.evaluate_members(v("v_tracks"), {k: LISTS[k] for k in ("all", "Most Played", "early")}, NOW)


@R.query("p4_count_matches", "SELECT count(*) AS n FROM v_tracks WHERE NOT is_duplicate AND play_count >= 5")
def _(v):
    return P.count_matches(v("v_tracks"), P.DEFAULT_PLAYLISTS["Most Played"], NOW)


@R.query("p5_energy", "SELECT track_id, round(energy, 9) AS energy FROM energies", energies=ENERGY)
def _(v):
    return P.energy(v("v_fingerprints")).select("track_id", F.round("energy", 9).alias("energy"))


@R.query("p6_freeze", f"SELECT track_id, CAST(r AS INT) AS position, {SECONDS} + r AS date_added FROM (SELECT track_id, row_number() OVER (ORDER BY min(position), track_id) - 1 AS r FROM v_playlist_tracks GROUP BY track_id) d")
def _(v):
    members = v("v_playlist_tracks").select(F.struct("position", "track_id").alias("ordinal"), "track_id")
    return P.freeze(members, SECONDS).select("track_id", "position", "date_added")


@R.query("p7_default_playlists", f"""
    SELECT 'Favorites' AS playlist, count(*) AS n FROM v_tracks WHERE NOT is_duplicate AND is_favorite UNION ALL SELECT 'Most Played', least(25, count(*)) FROM v_tracks WHERE NOT is_duplicate AND play_count >= 5
    UNION ALL SELECT 'Recently Played', least(25, count(*)) FROM v_tracks WHERE NOT is_duplicate AND last_played >= {SECONDS - 7 * 86400}""")
def _(v):
    return P.evaluate_counts(v("v_tracks"), P.DEFAULT_PLAYLISTS, NOW)


@R.query("l1_append", f"""
    WITH n AS (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS playlist_id, CAST(o_custkey AS BIGINT) AS track_id FROM orders UNION SELECT o_orderkey, o_custkey + 1 FROM orders),
    f AS (SELECT * FROM n ANTI JOIN v_playlist_tracks USING (playlist_id, track_id)),
    r AS (SELECT playlist_id, track_id, row_number() OVER (PARTITION BY playlist_id ORDER BY track_id) AS i FROM f)
    SELECT playlist_id, track_id, position, date_added FROM v_playlist_tracks
    UNION ALL SELECT playlist_id, track_id, CAST(coalesce((SELECT max(position) FROM v_playlist_tracks p WHERE p.playlist_id = r.playlist_id), -1) + i AS INT), {SECONDS} + i - 1 FROM r""")
def _(v):
    o = v("orders").select(F.col("o_orderkey").cast("long").alias("playlist_id"), F.col("o_custkey").cast("long").alias("track_id"))
    new = o.union(o.select("playlist_id", F.col("track_id") + 1)).union(o).withColumn("ordinal", F.col("track_id"))
    return L.append_tracks(v("v_playlist_tracks"), new, SECONDS)


@R.query("l2_remove", "SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY position, track_id) - 1 AS INT) AS position FROM v_playlist_tracks WHERE track_id % 3 <> 0")
def _(v):
    p = v("v_playlist_tracks")
    return L.remove_tracks(p, p.where("track_id % 3 = 0").select("playlist_id", "track_id")).select("playlist_id", "track_id", "position")


@R.query("l3_reorder", "SELECT playlist_id, track_id, CASE WHEN track_id % 2 = 0 THEN 1000 - position ELSE position END AS position, date_added FROM v_playlist_tracks")
def _(v):
    p = v("v_playlist_tracks")
    return L.reorder(p, p.where("track_id % 2 = 0").select("playlist_id", "track_id", (1000 - F.col("position")).alias("ordinal")))


def entries(v):
    """One playlist of entries written in six ways."""
    n, path = F.col("id") % 6, F.col("path")
    written = F.when(n == 0, path).when(n == 1, F.concat(F.lit("file://"), F.replace(path, F.lit(" "), F.lit("%20")))).when(n == 2, F.upper(path))
    written = written.when(n == 3, F.replace(F.substring(path, 8, 999), F.lit("/"), F.lit("\\"))).when(n == 4, F.concat(F.lit("/elsewhere/"), S.file_name(path))).otherwise("/gone/none.mp3")
    return v("v_tracks").select(F.lit("list").alias("playlist"), F.lit("/music").alias("base"), F.col("id").alias("ordinal"), written.alias("entry"))


@R.query("l4_match_import", "SELECT id AS ordinal, CASE WHEN id % 6 < 5 THEN id END AS track_id, CASE CAST(id % 6 AS INT) WHEN 2 THEN 'nocase' WHEN 4 THEN 'filename' WHEN 5 THEN NULL ELSE 'path' END AS how FROM v_tracks")
def _(v):
    return L.match_import(entries(v), v("v_tracks")).select("ordinal", "track_id", "how")


@R.query("l5_import_report", "SELECT 'list' AS playlist, count(*) AS total, count(*) FILTER (id % 6 < 5) AS added, count(*) FILTER (id % 6 = 5) AS missing, 'warnings' AS result FROM v_tracks")
def _(v):
    return L.import_report(L.match_import(entries(v), v("v_tracks")))


@R.query("l6_unique_names", """
    SELECT p_partkey AS ordinal, CASE WHEN x = 0 THEN p_brand ELSE p_brand || ' ' || CAST(x + CASE WHEN p_brand LIKE '%2' THEN 4 ELSE 0 END AS VARCHAR) END AS name
    FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - CASE WHEN p_brand LIKE '%1' THEN 0 ELSE 1 END AS x FROM part) d""")
def _(v):
    brands = v("part").select(F.col("p_brand").alias("name")).distinct()
    taken = brands.where("name like '%1'").select(F.upper("name").alias("name")).union(brands.where("name like '%2'").select(F.concat("name", F.lit(" 4"))))
    return L.unique_playlist_names(v("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("name")), taken)
