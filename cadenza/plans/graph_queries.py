"""Registered queries of sources, graph, merging, lyrics, audio and streams, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio as K
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import lyrics as Y
from ..operators import merge as M
from ..operators import rules
from ..sources import files
from ..streaming import live, plays
from .registry import Registry, scratch
from .views import view

R = Registry()


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


@R.query("s1_library_round_trip", "SELECT id, path, title, play_count, album_id FROM v_linked")
def _(v):
    t = v("v_linked")
    folder = scratch(spark_of(t), "library")
    files.write_library({"tracks": t, "artists": v("v_artists")}, folder)
    return files.read_library(spark_of(t), folder, ("tracks", "artists"))["tracks"].select("id", "path", "title", "play_count", "album_id")


@R.query("s2_file_inventory", "SELECT replace(path, '.m4a', '.wma') AS path, CASE WHEN format = 'm4a' THEN 'wma' ELSE format END AS extension, format <> 'm4a' AS supported FROM v_tracks")
def _(v):
    t = v("v_tracks").select(F.replace("path", F.lit(".m4a"), F.lit(".wma")).alias("path"), F.col("date_added").alias("mtime"), F.col("file_size").alias("size"))
    bare = t.select(F.lit("/music/none").alias("path"), "mtime", "size").union(t.select(F.lit("/music/.hidden.mp3").alias("path"), "mtime", "size"))
    return files.file_inventory(t.union(bare)).select("path", "extension", "supported")


@R.query("s3_read_m3u", "SELECT album_id AS playlist_id, count(*) AS n, min(path) AS first FROM v_linked WHERE album_id IS NOT NULL GROUP BY ALL")
def _(v):
    members = v("v_linked").where("album_id is not null").select(F.col("album_id").alias("playlist_id"), F.col("id").alias("track_id"), F.col("id").alias("position"))
    folder = scratch(spark_of(members), "m3u")
    names = members.select("playlist_id", F.concat(F.lit("List "), F.col("playlist_id").cast("string")).alias("name")).distinct()
    files.export_m3u(members, v("v_tracks"), names, folder)
    found = files.read_m3u(spark_of(members), f"{folder}/*/*.txt")
    return found.groupBy(F.regexp_extract("file", r"List%20(\d+)/|List (\d+)/", 1).cast("long").alias("playlist_id")).agg(F.count("*").alias("n"), F.min("entry").alias("first"))


@R.query("s4_export_m3u", """SELECT playlist_id, '#EXTM3U' || chr(13) || chr(10) || string_agg('#EXTINF:' || CAST(CAST(floor(duration) AS BIGINT) AS VARCHAR) || ',' || artist || ' - ' || title || chr(13) || chr(10) || path, chr(13) || chr(10) ORDER BY position) AS text
    FROM v_playlist_tracks JOIN v_tracks ON track_id = id GROUP BY playlist_id""")
def _(v):
    return files.m3u_texts(v("v_playlist_tracks"), v("v_tracks"))


@R.query("s5_relation_json", "SELECT source_mbid AS id, count(*) AS releases FROM v_edges WHERE relation = 'appears on' GROUP BY ALL")
def _(v):
    docs = recordings(v).select("json")
    folder = scratch(spark_of(docs), "recordings")
    docs.union(docs.select(F.concat(F.lit("{"), "json"))).write.text(folder)
    found = files.read_relation_json(spark_of(docs), folder, "recording", lines=True)
    return found.where("document.releases is not null").select(F.col("document.id").alias("id"), F.size("document.releases").cast("long").alias("releases"))


@R.query("s6_known_artists", "SELECT name FROM v_artists")
def _(v):
    a = v("v_artists").select("name")
    folder = scratch(spark_of(a), "known")
    a.union(a.select(F.concat(F.lit("# "), "name"))).union(a.select(F.concat(F.lit("  "), "name"))).write.text(folder)
    return files.read_known_artists(spark_of(a), folder)


@R.query("s7_read_lyrics", "SELECT k AS id, CASE WHEN k % 4 = 0 THEN 'srt' ELSE 'lrc' END AS kind, p_name || chr(10) || '\"' AS text FROM v_base WHERE k % 5 <> 0")
def _(v):
    b, k = v("v_base"), F.col("k")
    folder = scratch(spark_of(b), "lyrics")
    ending = F.when(k % 5 == 0, ".txt").when(k % 4 == 0, ".SRT").otherwise(".lrc")
    row = F.struct(F.concat(F.lit("/lyrics/"), k.cast("string"), ending).alias("file"), F.concat("p_name", F.lit('\n"')).alias("text"))
    b.select(F.to_json(row).alias("json")).union(b.select(F.concat(F.lit("{"), "p_name"))).write.text(folder)
    tracks = b.select(k.alias("id"), F.concat(F.lit("/music/"), k.cast("string"), F.lit(".mp3")).alias("path"))
    return files.read_lyrics(spark_of(b), folder, tracks, lines=True)


def recordings(v) -> DataFrame:
    """Recording documents of the views' nodes and edges."""
    e, n = v("v_edges"), v("v_nodes")
    of = e.join(n.select(F.col("mbid").alias("target_mbid"), "title", "year"), "target_mbid")
    target = F.struct(F.col("target_mbid").alias("id"), "title", F.col("year").cast("string").alias("first-release-date"))
    rel = of.where("relation = 'remix of'").groupBy("source_mbid").agg(F.collect_list(F.struct(F.lit("remix").alias("type"), F.lit("backward").alias("direction"), target.alias("recording"))).alias("relations"))
    out = of.where("relation = 'appears on'").groupBy("source_mbid").agg(F.collect_list(F.struct(F.col("target_mbid").alias("id"), "title", F.col("year").cast("string").alias("date"))).alias("releases"))
    r = n.where("kind = 'recording'").withColumnRenamed("mbid", "source_mbid").join(rel, "source_mbid", "left").join(out, "source_mbid", "left")
    credit = F.array(F.struct(F.lit("A").alias("name"), F.lit(" & ").alias("joinphrase")), F.struct(F.lit("B").alias("name"), F.lit("").alias("joinphrase")))
    doc = F.struct(F.col("source_mbid").alias("id"), "title", F.col("year").cast("string").alias("first-release-date"), credit.alias("artist-credit"), "releases", "relations")
    return r.select(F.col("source_mbid").alias("seq"), F.to_json(doc).alias("json"))


@R.query("g1_recording_edges", "SELECT source_mbid, target_mbid, relation, target_kind FROM v_edges WHERE relation <> 'release of'")
def _(v):
    return G.recording_fragments(recordings(v))[1].select(*G.EDGE)


@R.query("g1_recording_nodes", "SELECT mbid, kind, title, 'A & B' AS artist, year FROM v_nodes WHERE kind = 'recording' UNION ALL SELECT DISTINCT mbid, kind, title, NULL, year FROM v_nodes JOIN v_edges ON mbid = target_mbid WHERE relation = 'appears on'")
def _(v):
    nodes = G.recording_fragments(recordings(v))[0]
    return G.merge_nodes(nodes).select("mbid", "kind", "title", "artist", "year")


@R.query("g2_release_edges", "SELECT mbid, 'L' AS label, 'Single' AS primary_type, target_mbid FROM v_nodes JOIN v_edges ON mbid = source_mbid WHERE relation = 'release of'")
def _(v):
    e = v("v_edges").where("relation = 'release of'")
    info = F.array(F.struct(F.struct(F.lit(None).cast("string").alias("name")).alias("label")), F.struct(F.struct(F.lit("L").alias("name")).alias("label")))
    doc = F.struct(F.col("source_mbid").alias("id"), F.lit("t").alias("title"), info.alias("label-info"), F.struct(F.col("target_mbid").alias("id"), F.lit("Single").alias("primary-type")).alias("release-group"))
    nodes, edges = G.release_fragments(e.select(F.col("source_mbid").alias("seq"), F.to_json(doc).alias("json")))
    return nodes.where("kind = 'release'").join(edges, F.col("mbid") == F.col("source_mbid")).select("mbid", "label", "primary_type", "target_mbid")


@R.query("g3_merge_nodes", "SELECT mbid, kind, title || '!' AS title, year FROM v_nodes")
def _(v):
    n = v("v_nodes")
    old = n.select(F.lit(1).alias("seq"), "mbid", "kind", "title", "year")
    new = n.select(F.lit(2).alias("seq"), "mbid", F.lit("unknown").alias("kind"), F.concat("title", F.lit("!")).alias("title"), F.lit(None).cast("int").alias("year"))
    return G.merge_nodes(old.union(new))


@R.query("g4_merge_edges", "SELECT source_mbid, target_mbid, relation, 'new' AS target_kind FROM v_edges")
def _(v):
    e = v("v_edges")
    return G.merge_edges(e.withColumn("seq", F.lit(1)).union(e.withColumn("target_kind", F.lit("new")).withColumn("seq", F.lit(2))))


MBID = "substring(md5(CAST(k AS VARCHAR)), 1, 8) || '-' || substring(md5(CAST(k AS VARCHAR)), 9, 4) || '-' || substring(md5(CAST(k AS VARCHAR)), 13, 4) || '-' || substring(md5(CAST(k AS VARCHAR)), 17, 4) || '-' || substring(md5(CAST(k AS VARCHAR)), 21, 12)"


@R.query("g5_library_anchors", f"SELECT {MBID} AS mbid, min(path) AS path FROM v_tracks WHERE k % 3 <> 0 AND NOT is_duplicate GROUP BY ALL")
def _(v):
    h = F.md5(F.col("k").cast("string").cast("binary"))
    uuid_ = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    json = F.when(F.col("k") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(uuid_.alias("musicBrainzTrackId"))))
    return G.library_anchors(v("v_tracks").withColumn("extended_metadata", json)).select("mbid", "path")


@R.query("g6_releases", "SELECT DISTINCT target_mbid AS mbid FROM v_edges WHERE target_kind = 'release'")
def _(v):
    return G.releases_to_enrich(v("v_edges"))


# The walk in whole numbers: parts p are on orders o, and are remixes of part q, the half of p.
WALK = {
    "walk_on": "SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem",
    "walk_of": "SELECT p_partkey AS p, CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS q FROM part WHERE p_partkey > 0",
    "walk_steps": """SELECT p_partkey AS a, 1 AS depth, 'p' || p AS source_mbid, 'o' || o AS target_mbid, 'appears on' AS relation FROM part JOIN walk_on ON p = p_partkey
        UNION ALL SELECT p, 1, 'p' || p, 'p' || q, 'remix of' FROM walk_of
        UNION ALL SELECT p_partkey, 2, 'o' || o, 'c' || o_custkey, 'release of' FROM part JOIN walk_on ON p = p_partkey JOIN orders ON o_orderkey = o
        UNION ALL SELECT w.p, 2, 'p' || q, 'o' || o, 'appears on' FROM walk_of w JOIN walk_on n ON n.p = q WHERE q <> w.p
        UNION ALL SELECT w.p, 2, 'p' || w.q, 'p' || x.q, 'remix of' FROM walk_of w JOIN walk_of x ON x.p = w.q WHERE w.q <> w.p""",
}


@R.query("g7_walk", "SELECT 'p' || a AS anchor, depth, source_mbid, target_mbid, relation FROM walk_steps", **WALK)
def _(v):
    anchors = v("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("mbid"))
    return G.walk(v("v_edges"), anchors, 2)


@R.query("g8_threads", "SELECT id, CASE WHEN id % 4 = 0 THEN 'no recording' WHEN id >= 10000000 THEN 'anchor missing' ELSE 'thread' END AS status, CASE WHEN id % 4 = 0 THEN 0 ELSE (SELECT count(*) FROM v_edges WHERE source_mbid = 'p' || CAST(id AS VARCHAR)) END AS n_steps FROM v_tracks")
def _(v):
    t = v("v_tracks").select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("mbid"))
    anchors = t.where("mbid is not null").select("mbid").distinct()
    return G.relation_threads(t, v("v_nodes"), G.walk(v("v_edges"), anchors, 1))


@R.query("g9_find_anchor", "SELECT mbid, title, year FROM v_nodes WHERE lower(title) LIKE '%ring%' ORDER BY mbid NOT IN (SELECT source_mbid FROM v_edges), kind <> 'recording', coalesce(year, 0), title, mbid LIMIT 1")
def _(v):
    return G.find_anchor(v("v_nodes"), v("v_edges"), "RING").select("mbid", "title", "year")


@R.query("g10_graph_stats", "SELECT (SELECT count(*) FROM v_nodes) AS n_nodes, (SELECT count(*) FROM v_edges) AS n_edges")
def _(v):
    return G.graph_stats(v("v_nodes"), v("v_edges"))


def losers(v):
    return v("v_artists").where("artist_id % 4 = 2").select(F.col("artist_id").alias("loser"), (F.col("artist_id") - 1).alias("winner"))


@R.query("m1_merge_artists", "SELECT DISTINCT track_id, CASE WHEN artist_id % 4 = 2 THEN artist_id - 1 ELSE artist_id END AS artist_id, role FROM v_track_artists")
def _(v):
    return M.merge_artists(v("v_artists"), v("v_track_artists"), v("v_album_artists"), losers(v))["track_artists"].select("track_id", "artist_id", "role")


@R.query("m2_merge_albums", "SELECT id, coalesce(w.title, album) AS album, coalesce(w.album_id, t.album_id) AS album_id FROM v_linked t LEFT JOIN v_albums w ON w.album_id = CASE WHEN t.album_id % 4 = 2 THEN t.album_id - 1 ELSE t.album_id END")
def _(v):
    mapping = v("v_albums").where("album_id % 4 = 2").select(F.col("album_id").alias("loser"), (F.col("album_id") - 1).alias("winner"))
    return M.merge_albums(v("v_albums"), v("v_linked"), v("v_album_artists"), mapping)["tracks"].select("id", "album", "album_id")


@R.query("m3_flatten_aliases", "SELECT CAST(artist_id AS VARCHAR) AS alias, CAST(artist_id - artist_id % 8 AS VARCHAR) AS canonical FROM v_artists WHERE artist_id % 8 <> 0")
def _(v):
    i = F.col("artist_id")
    return M.flatten_aliases(v("v_artists").where("artist_id % 8 <> 0").select(i.cast("string").alias("alias"), (i - 1).cast("string").alias("canonical")))


def counted_albums(v) -> DataFrame:
    return v("v_linked").where("album_id is not null").groupBy("album_id", F.col("album").alias("title")).agg(F.count("*").alias("n_tracks"))


@R.query("m1_merge_chains", "SELECT DISTINCT track_id, artist_id - artist_id % 16 + 1 AS artist_id, role FROM v_track_artists WHERE artist_id % 16 <> 0 UNION SELECT track_id, artist_id, role FROM v_track_artists WHERE artist_id % 16 = 0")
def _(v):
    # Artists of each sixteen are merged into the one before them: chains of fourteen.
    chains = v("v_artists").where("artist_id % 16 > 1").select(F.col("artist_id").alias("loser"), (F.col("artist_id") - 1).alias("winner"))
    return M.merge_artists(v("v_artists"), v("v_track_artists"), v("v_album_artists"), chains)["track_artists"].select("track_id", "artist_id", "role")


@R.query("m4_merge_candidates", """
    SELECT album_id, any_value(album) AS title, (SELECT name FROM v_album_artists x JOIN v_artists y ON x.artist_id = y.artist_id WHERE x.album_id = t.album_id AND role = 'primary' AND x.position = 0) AS artist, count(*) AS n_tracks
    FROM v_linked t WHERE album_id IS NOT NULL AND album_id <> 3 GROUP BY album_id""")
def _(v):
    return M.album_candidates(counted_albums(v), v("v_album_artists"), v("v_artists"), 3)


@R.query("m4_default_winner", "SELECT album_id, count(*) AS n_tracks FROM v_linked WHERE album = 'Brand#3' GROUP BY ALL")
def _(v):
    return M.default_winner(counted_albums(v), "Brand#3").select("album_id", "n_tracks")


@R.query("m4_artist_candidates", """
    SELECT name, count(*) AS n_tracks FROM v_artists JOIN v_track_artists USING (artist_id) JOIN v_tracks ON id = track_id WHERE role = 'artist' AND name <> 'Supplier#000000003' GROUP BY name""")
def _(v):
    return M.name_candidates(C.artist_counts(v("v_tracks"), v("v_artists"), v("v_track_artists")), "Supplier#000000003")


@R.query("m4_genre_candidates", "SELECT genre AS name, count(*) AS n_tracks FROM v_tracks WHERE genre NOT IN ('', 'ECONOMY') GROUP BY genre")
def _(v):
    return M.name_candidates(C.genre_counts(v("v_tracks")), "ECONOMY", "genre")


@R.query("m5_reconcile_pins", "SELECT artist_id AS pin_id, name AS value FROM v_artists WHERE artist_id % 3 = 0 OR artist_id % 4 <> 2")
def _(v):
    a = v("v_artists")
    pins = a.select(F.col("artist_id").alias("pin_id"), F.when(F.col("artist_id") % 3 != 0, F.col("artist_id")).alias("entity_id"), F.when(F.col("artist_id") % 3 == 0, F.col("name")).otherwise("old").alias("value"))
    return M.reconcile_pins(pins, losers(v), a.select(F.col("artist_id").alias("entity_id"), "name")).select("pin_id", "value")


LINES = """SELECT doc_id, i, line FROM (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents) a) b"""


@R.query("y1_lrc_lines", r"SELECT doc_id AS id, CAST(i * 0.125 AS DOUBLE) AS start, CAST(lead(i) OVER (PARTITION BY doc_id ORDER BY i) * 0.125 AS DOUBLE) AS end, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM doc_lines", doc_lines=LINES)
def _(v):
    rows = v("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    i = F.col("i")  # a line for each eighth of a second, which a stamp's three decimals hold exactly
    stamp = F.format_string("[%02d:%02d.%03d]", F.floor(i / 480), F.floor(i % 480 / 8), (i % 8 * 125).cast("long"))
    texts = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(stamp, "line").alias("l")))), lambda x: x["l"]), "\r\n").alias("text"))
    return Y.lrc_lines(texts)


@R.query("y2_srt_lines", "SELECT k AS id, CAST(p_size AS DOUBLE) AS start, p_size + 1.5 AS end, p_name || chr(10) || 'x' AS line FROM v_base")
def _(v):
    block = F.format_string("1\r\n00:00:%02d,000 --> 00:00:%02d,500\r\n%s\r\nx\r\n\r\n2\r\nshort", F.col("p_size"), F.col("p_size") + 1, F.col("p_name"))
    return Y.srt_lines(v("v_base").select(F.col("k").alias("id"), block.alias("text")))


@R.query("y3_best_lyrics", "SELECT k AS id, CASE CAST(k % 4 AS INT) WHEN 0 THEN 'lrc' WHEN 1 THEN 'embedded' WHEN 2 THEN 'embedded' ELSE 'online' END AS source, p_name AS line FROM v_base")
def _(v):
    b = v("v_base").select(F.col("k").alias("id"), "p_name")
    plain = lambda n: b.where(f"id % 4 = {n}").select("id", F.col("p_name").alias("text"))
    timed = lambda n: b.where(f"id % 4 = {n}").select("id", F.concat(F.lit("[00:01.5]"), "p_name").alias("text"))
    return Y.best_lyrics(timed(0), plain(0), timed(1).union(plain(2)), plain(3).union(plain(1))).select("id", "source", "line")


def pcm(v) -> DataFrame:
    """Two seconds of sound for each vector: its values repeat as a wave."""
    return v("embeddings").select(F.col("vec_id").alias("track_id"), F.lit(8192.0).alias("sample_rate"), F.flatten(F.array_repeat(F.col("embedding"), 256)).alias("samples"))


@R.query("k8_audio_axes", "SELECT vec_id AS track_id, round(greatest(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding))), -60), 6) AS rms_loudness_db FROM embeddings WHERE embedding IS NOT NULL")
def _(v):
    return K.audio_axes(pcm(v).where("samples is not null")).select("track_id", F.round("rms_loudness_db", 6).alias("rms_loudness_db"))


@R.query("k9_beat_regularity")
def _(v):
    return K.beat_regularity(pcm(v))


@R.query("k10_estimate_bpm")
def _(v):
    return K.estimate_bpm(pcm(v))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of player events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    n = view(spark, sf_dir, "part").count()
    return raw.select("event_id", "ts", (F.col("event_id") % n).alias("track_id"), F.when(F.col("event_type") == "purchase", "eof").otherwise("user").alias("stop_reason"), (F.col("event_type") == "click").alias("favourite"))


def streamed(name: str, sql: str):
    def add(work):
        R.query(name, sql)(lambda v: None)
        R.queries[name] = work
        return work

    return add


@streamed("r1_play_counts", "SELECT track_id, CAST(count(*) AS BIGINT) AS plays, max(ts) AS last_played FROM v_plays WHERE stop_reason = 'eof' GROUP BY ALL")
def _(spark, sf_dir):
    folder = scratch(spark, "plays")
    plays.run_play_counts(events(spark, sf_dir), f"{folder}/out", f"{folder}/state")
    return plays.counted_plays(spark, f"{folder}/out").withColumn("last_played", F.col("last_played").cast("timestamp_ntz"))


@streamed("r2_scrobble_feed", "SELECT event_id, artist, title, CASE WHEN album <> 'Unknown Album' THEN album END AS album, CAST(floor(duration) AS BIGINT) AS seconds, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM v_plays JOIN v_tracks ON track_id = id WHERE stop_reason = 'eof' AND duration >= 30")
def _(spark, sf_dir):
    folder = scratch(spark, "scrobbles")
    plays.to_batches(plays.scrobble_feed(events(spark, sf_dir), view(spark, sf_dir, "v_tracks")), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@streamed("r3_favourites", "SELECT track_id, arg_max(favourite, (ts, event_id)) AS is_favorite FROM v_plays GROUP BY ALL")
def _(spark, sf_dir):
    folder = scratch(spark, "favourites")
    plays.to_batches(events(spark, sf_dir), f"{folder}/out", f"{folder}/state", plays.favourite_changes)
    return plays.latest_favourites(spark, f"{folder}/out")


OFTEN = {"rules": [{"field": "play_count", "condition": "greaterThanOrEqual", "value": "7"}]}
LIVE = {"Favorites": rules.DEFAULT_PLAYLISTS["Favorites"], "Often": OFTEN, "Most Played": {**rules.DEFAULT_PLAYLISTS["Most Played"], "limit": 40}, "Frozen": {"rules": [], "autoUpdate": False}}


def followed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of live playlists after the whole stream of plays: each batch's tracks alone meet the rules."""
    folder, now = scratch(spark, "live"), dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
    live.start(view(spark, sf_dir, "v_tracks"), LIVE, now, folder, 8)
    follow = lambda counts, n: live.apply_changes(spark, folder, live.played(spark, folder, counts), LIVE, now, n)
    plays.run_play_counts(events(spark, sf_dir), f"{folder}/out", f"{folder}/state", then=follow)
    return folder


AFTER = "SELECT v_tracks.*, play_count + coalesce(plays, 0) AS now FROM v_tracks LEFT JOIN (SELECT track_id, count(*) AS plays FROM v_plays WHERE stop_reason = 'eof' GROUP BY ALL) c ON id = track_id WHERE NOT is_duplicate"


@streamed("r4_live_playlists", f"""
    WITH t AS ({AFTER}) SELECT 'Favorites' AS playlist, count(*) AS n FROM t WHERE is_favorite UNION ALL SELECT 'Often', count(*) FROM t WHERE now >= 7
    UNION ALL SELECT 'Most Played', least(40, count(*)) FROM t WHERE now >= 5""")
def _(spark, sf_dir):
    return live.counts(spark, followed(spark, sf_dir), LIVE)


@streamed("r4_live_members", f"SELECT 'Most Played' AS playlist, CAST(row_number() OVER (ORDER BY now DESC, id) - 1 AS INT) AS position, id FROM ({AFTER}) t WHERE now >= 5 QUALIFY position < 40")
def _(spark, sf_dir):
    return live.members(spark, followed(spark, sf_dir), LIVE)
