"""Registered queries of search and similarity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbours
from ..operators import search as Q
from ..operators import similar as K
from .registry import Registry, stored_once

R = Registry()

TOKENS = r"""SELECT doc_id AS id, token, pos, count(*) OVER (PARTITION BY doc_id) AS length FROM (
    SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) a) b"""
BM25 = """SELECT id, round(ln((d - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS part FROM hits,
    (SELECT count(DISTINCT id) AS d, (SELECT avg(length) FROM (SELECT DISTINCT id, length FROM tokens) z) AS mean FROM tokens) s, (SELECT count(*) AS n FROM hits) m"""


def indexed(docs: DataFrame) -> Q.Index:
    """The stored index of all texts, written once and read by all searches."""
    folder = stored_once(docs, "search-index", lambda folder: Q.write_index(docs, folder, ("text",), "doc_id"))
    return Q.read_index(docs.sparkSession, folder)


def neighbour_index(fps: DataFrame) -> K.Index:
    """The stored neighbours of all fingerprints, written once and read for whatever anchors."""
    return neighbours.read(fps.sparkSession, stored_once(fps, "neighbours", lambda folder: K.build_neighbour_index(fps, folder=folder)))


@R.query("q1_index", "SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM tokens GROUP BY token", tokens=TOKENS)
def _(v):
    return indexed(v("documents")).terms.select("token", F.col("occurrences").alias("n"), "docs")


@R.query("q2_search", """
    WITH a AS (SELECT id, any_value(length) AS length, count(*) AS f FROM tokens WHERE token LIKE 'licens%' GROUP BY id), b AS (SELECT id, any_value(length) AS length, count(*) AS f FROM tokens WHERE token LIKE 'und%' GROUP BY id),
    s AS (SELECT count(*) AS d, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM tokens) z),
    u AS (SELECT id, greatest(ln((d - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS p FROM a, s, (SELECT count(*) AS n FROM a) m
        UNION ALL SELECT id, greatest(ln((d - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) FROM b, s, (SELECT count(*) AS n FROM b) m)
    SELECT id, round(sum(p), 6) AS score FROM u GROUP BY id HAVING count(*) = 2""", tokens=TOKENS)
def _(v):
    return Q.search(indexed(v("documents")), "Licens und").select("id", F.round("score", 6).alias("score"))


@R.query("q3_search_for_playlist", """
    WITH p AS (SELECT a.id, any_value(a.length) AS length, count(*) AS f FROM tokens a JOIN tokens b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = 'cc' AND b.token = 'by' GROUP BY a.id),
    s AS (SELECT count(*) AS d, avg(length) AS mean FROM (SELECT DISTINCT id, length FROM tokens) z)
    SELECT id, round(greatest(ln((d - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM p, s, (SELECT count(*) AS n FROM p) m
    WHERE id % 3 <> 0 ORDER BY score DESC, id LIMIT 200""", tokens=TOKENS)
def _(v):
    docs = v("documents")
    tracks = docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("is_duplicate"))
    found = Q.search_for_playlist(indexed(docs), tracks, "CC-BY", tracks.where("id % 3 = 0").select("id"))
    return found.select("id", F.round("score", 6).alias("score"))


@R.query("q4_match_entities", "SELECT name FROM v_artists WHERE lower(name) LIKE '%r#00000001%'")
def _(v):
    return Q.match_entities(v("v_artists"), " The R#00000001").select("name")


SCALES = """SELECT min(rms_loudness_db) AS l0, max(rms_loudness_db) AS l1, min(bpm) AS t0, max(bpm) AS t1, min(bass_ratio) AS b0, max(bass_ratio) AS b1, min(dynamic_range_db) AS d0, max(dynamic_range_db) AS d1,
    min(spectral_brightness_hz) AS s0, max(spectral_brightness_hz) AS s1, min(beat_regularity) AS r0, max(beat_regularity) AS r1 FROM v_fingerprints"""
ROWS = """SELECT track_id AS id, year, duration_seconds AS sec, bpm_confidence AS conf, CASE mix_version WHEN 'Radio Edit' THEN 'radioEdit' WHEN 'Club Mix' THEN 'extended' WHEN 'Quick Remix' THEN 'remix' ELSE 'original' END AS mix,
    (rms_loudness_db - l0) / (l1 - l0) AS l, (bpm - t0) / (t1 - t0) AS t, (bass_ratio - b0) / (b1 - b0) AS b, (dynamic_range_db - d0) / (d1 - d0) AS d, (spectral_brightness_hz - s0) / (s1 - s0) AS s, (beat_regularity - r0) / (r1 - r0) AS r
    FROM v_fingerprints, scales"""
PAIRS = """SELECT x.id AS anchor, y.id AS neighbour, CASE WHEN x.year IS NULL OR y.year IS NULL THEN 1.5 ELSE 3 * least(1.0, abs(x.year - y.year) / 5.0) END + coalesce(2 * least(coalesce(x.conf, 1), coalesce(y.conf, 1)) * abs(x.t - y.t), 0) + 1.5 * abs(x.d - y.d) + 1.5 * abs(x.b - y.b)
    + 1.5 * abs(x.s - y.s) + abs(x.l - y.l) + coalesce(3 * abs(x.r - y.r), 0) + coalesce(abs(x.conf - y.conf), 0) + CASE WHEN x.mix <> y.mix THEN 1 ELSE 0 END + least(1.0, abs(x.sec - y.sec) / 120.0) AS distance FROM frows x JOIN frows y ON x.id <> y.id"""
PARTS = {"scales": SCALES, "frows": ROWS, "fpairs": PAIRS}


@R.query("k1_axis_scales", "SELECT l0 AS low_loudness, l1 AS high_loudness, t0 AS low_tempo, t1 AS high_tempo, b0 AS low_bass, b1 AS high_bass, d0 AS low_dynamics, d1 AS high_dynamics, s0 AS low_brightness, s1 AS high_brightness, r0 AS low_beat, r1 AS high_beat FROM scales", **PARTS)
def _(v):
    return K.axis_scales(v("v_fingerprints"))


@R.query("k2_filter", "SELECT track_id FROM v_fingerprints WHERE year BETWEEN 1970 AND 1990 AND bpm BETWEEN 100 AND 140 AND mix_version = 'Club Mix'")
def _(v):
    return K.filter_fingerprints(v("v_fingerprints"), year=(1970, 1990), bpm=(100, 140), mix="extended").select("track_id")


@R.query("k3_artist_majority", """
    WITH f AS (SELECT lower(artist) AS artist_key, CASE WHEN track_id % 3 = 0 THEN 'rock' WHEN track_id % 3 = 1 THEN 'pop' END AS family FROM v_fingerprints),
    c AS (SELECT artist_key, family, count(*) AS n FROM f WHERE family IS NOT NULL GROUP BY ALL)
    SELECT artist_key, family FROM c WHERE 2 * n > (SELECT sum(n) FROM c d WHERE d.artist_key = c.artist_key)""")
def _(v):
    return K.artist_genre_majority(v("v_fingerprints").withColumn("genre", F.when(F.col("track_id") % 3 == 0, "Rock").when(F.col("track_id") % 3 == 1, "Pop")))


@R.query("k4_distance", "SELECT anchor, neighbour, round(distance, 6) AS distance FROM fpairs WHERE neighbour = anchor + 1", **PARTS)
def _(v):
    rows = K.prepare(v("v_fingerprints"))
    packed = rows.select(F.struct(*rows.columns).alias("x"))
    met = packed.withColumnRenamed("x", "l").join(packed.withColumnRenamed("x", "r"), F.col("r.id") == F.col("l.id") + 1)
    return met.select(F.col("l.id").alias("anchor"), F.col("r.id").alias("neighbour"), F.round(K.track_distance("l", "r"), 6).alias("distance"))


MUTUAL = """SELECT anchor, neighbour, round(distance, 6) AS distance FROM (SELECT neighbour AS anchor, anchor AS neighbour, distance, rank() OVER (PARTITION BY anchor ORDER BY distance) AS closer FROM fpairs WHERE distance <= 3.5) z
    WHERE closer <= 25 {} QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY distance, neighbour) <= 25"""


@R.query("k5_similar_tracks", MUTUAL.format("AND anchor % 50 = 0"), **PARTS)
def _(v):
    f = v("v_fingerprints")
    found = K.similar_tracks(f, f.where("track_id % 50 = 0").select(F.col("track_id").alias("id")), index=neighbour_index(f))
    return found.where("neighbour is not null").select("anchor", "neighbour", F.round("distance", 6).alias("distance"))


@R.query("k6_similar_tracks_all", MUTUAL.format(""), **PARTS)
def _(v):
    return K.similar_tracks_all(v("v_fingerprints")).select("anchor", "neighbour", F.round("distance", 6).alias("distance"))


@R.query("k7_upsert", "SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 145.0 ELSE bpm END AS bpm FROM v_fingerprints")
def _(v):
    f = v("v_fingerprints").select("track_id", "bpm")
    return K.upsert_fingerprints(f, f.where("track_id % 3 = 0").select("track_id", F.lit(145.0).alias("bpm")), "track_id")


@R.query("k11_bpm_deviation", "SELECT count(*) AS n, round(avg(abs(bpm - floor(bpm))), 9) AS mean_gap, round(max(abs(bpm - floor(bpm))), 9) AS max_gap FROM v_fingerprints WHERE bpm IS NOT NULL AND track_id % 2 = 0")
def _(v):
    f = v("v_fingerprints").select("track_id", "bpm")
    tags = f.where("track_id % 2 = 0").select("track_id", F.floor("bpm").cast("double").alias("tag_bpm"))
    return K.bpm_deviation(f, tags).select("n", F.round("mean_gap", 9).alias("mean_gap"), F.round("max_gap", 9).alias("max_gap"))
