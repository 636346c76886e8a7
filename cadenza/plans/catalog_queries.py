"""Registered queries of the catalogue operators and scalar functions, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import catalog as C
from ..operators.rules import DEFAULT_PLAYLISTS
from ..operators.tables import with_positions
from .registry import Registry

R = Registry()

ID = "SELECT id FROM v_linked WHERE {}"


@R.query("f01_track_defaults", """
    SELECT id, title, CASE WHEN artist = '' THEN 'Unknown Artist' ELSE artist END AS artist, CASE WHEN genre = '' THEN 'Unknown Genre' ELSE genre END AS genre, composer, year, format FROM v_tracks""")
def _(v):
    return S.with_track_defaults(v("v_tracks")).select("id", "title", "artist", "genre", "composer", "year", "format")


@R.query("f02_artist_name_key", r"""
    SELECT id, trim(regexp_replace(replace(replace(replace(regexp_replace(lower(artist), '\b([a-z])\.? *', '\1', 'g'), ' - ', '-'), '- ', '-'), ' -', '-'), '\s+', ' ', 'g')) AS key FROM v_tracks""")
def _(v):
    return v("v_tracks").select("id", S.normalize_artist_name(F.col("artist")).alias("key"))


@R.query("f03_album_title_key", "SELECT id, trim(replace(replace(replace(lower('The ' || album || ' - ' || title), ' - ', ' '), '  ', ' '), 'the ', '')) AS key FROM v_tracks")
def _(v):
    return v("v_tracks").select("id", S.normalize_album_title(F.concat(F.lit("The "), "album", F.lit(" - "), "title")).alias("key"))


@R.query("f04_entity_key", r"SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(source || ' ' || coalesce(text, ''))), '^\s+|\s+$', '', 'g'), '^the ', '') AS key FROM documents")
def _(v):
    return v("documents").select("doc_id", T.fold_entity_name(F.concat("source", F.lit(" "), F.coalesce("text", F.lit("")))).alias("key"))


@R.query("f05_years", r"""
    SELECT o_orderkey, nullif(regexp_extract('on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\b((?:19|20)\d{2})\b', 1), '') AS tag_year,
        CAST(year(o_orderdate) AS INT) AS mb_year, CAST(year(o_orderdate) AS INT) AS head_year, CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, substring(CAST(year(o_orderdate) AS VARCHAR), 1, 3) || '0s' AS decade_text FROM orders""")
def _(v):
    d = F.col("o_orderdate").cast("date").cast("string")
    return v("orders").select("o_orderkey", S.year_from_date(F.concat(F.lit("on "), d)).alias("tag_year"), S.year_from_mb_date(d).alias("mb_year"), S.leading_year(d).alias("head_year"), S.decade_int(d).alias("decade"), S.decade_text(d).alias("decade_text"))


@R.query("f08_rating_and_duration", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_quantity <= 0 THEN NULL WHEN l_quantity <= 5 THEN l_quantity WHEN l_quantity <= 31 THEN 1 ELSE 2 END AS INT) AS rating,
        CASE WHEN l_quantity - 25 < 0 THEN 0.0 ELSE l_quantity - 25 END AS duration FROM lineitem""")
def _(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.normalize_rating(F.col("l_quantity")).alias("rating"), S.sanitize_duration(F.col("l_quantity") - 25).alias("duration"))


@R.query("f10_quality", """
    SELECT id, format = 'flac' AS lossless, CAST(CASE WHEN format = 'flac' THEN 1000 WHEN format = 'mp3' THEN CASE WHEN bitrate >= 320 THEN 800 WHEN bitrate >= 256 THEN 600 WHEN bitrate >= 192 THEN 400 ELSE 200 END
            ELSE CASE WHEN bitrate >= 256 THEN 700 WHEN bitrate >= 192 THEN 500 ELSE 300 END END + 50
        + CASE WHEN artist <> 'Unknown Artist' THEN 50 ELSE 0 END + CASE WHEN album <> 'Unknown Album' THEN 50 ELSE 0 END + CASE WHEN album_artist IS NOT NULL THEN 25 ELSE 0 END
        + CASE WHEN track_number IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN year <> 'Unknown Year' THEN 25 ELSE 0 END AS INT) AS score FROM v_tracks""")
def _(v):
    t = v("v_tracks")
    return t.select("id", S.is_lossless(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.col("format")).alias("lossless"), S.quality_score(t).cast("int").alias("score"))


@R.query("f12_duplicate_key", "SELECT id, lower(trim(title)) || '|' || lower(trim(artist)) || '|' || lower(trim(album)) || '|' || trim(year) || '|' || CAST(CAST(floor(duration / 2 + 0.5) * 2 AS BIGINT) AS VARCHAR) AS key FROM v_tracks")
def _(v):
    return v("v_tracks").select("id", S.duplicate_key(*[F.col(c) for c in ("title", "artist", "album", "year", "duration")]).alias("key"))


@R.query("f13_mix_version", """
    SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Club Mix' WHEN 2 THEN 'radio edit' WHEN 3 THEN 'Quick Remix' ELSE 'dub' END AS version,
        CASE id % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'extended' WHEN 2 THEN 'radioEdit' WHEN 3 THEN 'remix' ELSE 'other' END AS class FROM v_tracks""")
def _(v):
    n = F.col("id") % 5
    tail = F.when(n == 0, " (Dee Ooh La)").when(n == 1, " [Club Mix]").when(n == 2, " (Dee (x) Ooh) (radio edit)").when(n == 3, " (Quick Remix)").otherwise(" ( dub )")
    t = v("v_tracks").select("id", T.mix_version(F.concat("title", tail)).alias("version"))
    return t.withColumn("class", S.mix_class(F.col("version")))


@R.query("f15_genre_family", """
    SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'dance' WHEN 1 THEN 'rock' WHEN 2 THEN 'pop' WHEN 3 THEN 'hiphop' WHEN 4 THEN 'jazzBlues' END AS family FROM part""")
def _(v):
    n = F.col("p_partkey") % 6
    tag = F.when(n == 0, "Happy Hardcore Rock").when(n == 1, "Pop/Rock*").when(n == 2, "Synthpop").when(n == 3, "Trap").when(n == 4, "Swing").otherwise("Unknown Genre")
    return v("part").select("p_partkey", S.genre_family(tag).alias("family"))


@R.query("f16_extended_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(v):
    return v("events").select("event_id", S.extended_field(F.col("props"), "k").alias("k"))


@R.query("f17_valid_mbid", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) END AS mbid
    FROM (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part) d""")
def _(v):
    h = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return v("part").select("p_partkey", S.valid_mbid(F.when(F.col("p_partkey") % 3 == 0, F.substring(uuid, 1, 30)).otherwise(F.concat(F.lit(" "), uuid))).alias("mbid"))


@R.query("f18_relation_label", """
    SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'remix of' ELSE 'has remix' END WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cover of' ELSE 'covered by' END
        ELSE event_type || CASE WHEN event_id % 2 = 0 THEN ' (←)' ELSE '' END END AS label FROM events""")
def _(v):
    kind = F.when(F.col("event_type") == "view", "Remix").when(F.col("event_type") == "click", "cover").otherwise(F.col("event_type"))
    return v("events").select("event_id", S.relation_label(kind, F.when(F.col("event_id") % 2 == 0, "backward")).alias("label"))


@R.query("f20_parse_duration", "SELECT p_partkey, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN CAST(3600 * (p_partkey % 7) + 60 * (p_partkey % 60) + p_size AS BIGINT) WHEN 1 THEN CAST(60 * (p_partkey % 60) + p_size AS BIGINT) END AS seconds FROM part")
def _(v):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    minutes = (k % 60).cast("string")
    text = F.when(k % 3 == 0, F.concat_ws(":", (k % 7).cast("string"), minutes, size)).when(k % 3 == 1, F.concat_ws(":", minutes, size)).otherwise("1:x")
    return v("part").select("p_partkey", S.parse_duration(text).alias("seconds"))


@R.query("f21_hide_duplicates", "SELECT id FROM v_tracks WHERE NOT is_duplicate")
def _(v):
    return S.hide_duplicates(v("v_tracks")).select("id")


NAME = "Supplier#000000003"


@R.query("j1_tracks_by_artist", f"SELECT DISTINCT t.id, t.title FROM v_linked t JOIN v_track_artists ON t.id = track_id JOIN v_artists USING (artist_id) WHERE name = '{NAME}' OR normalized_name = lower('{NAME}')")
def _(v):
    return C.tracks_by_artist(v("v_linked"), v("v_artists"), v("v_track_artists"), NAME).select("id", "title")


@R.query("j2_tracks_by_album", "SELECT id, coalesce(disc_number, 1) AS disc, coalesce(track_number, 0) AS track FROM v_linked WHERE album = 'Brand#3'")
def _(v):
    return C.tracks_by_album(v("v_linked"), "Brand#3", hide_duplicates=False).select("id", F.coalesce("disc_number", F.lit(1)).alias("disc"), F.coalesce("track_number", F.lit(0)).alias("track"))


@R.query("j2_album_of_artist", "SELECT id, album_artist FROM v_linked WHERE album = 'Brand#3' AND album_artist = 'Supplier#000000003' AND NOT is_duplicate")
def _(v):
    return C.tracks_by_album(v("v_linked"), "Brand#3", "Supplier#000000003").select("id", "album_artist")


@R.query("j3_tracks_by_genre_and_year", "SELECT id FROM v_linked WHERE genre = 'ECONOMY' AND year = '1971'")
def _(v):
    return C.tracks_by_year(C.tracks_by_genre(v("v_linked"), "ECONOMY"), "1971").select("id")


@R.query("j4_tracks_by_decade", "SELECT id, year, album FROM v_linked WHERE year >= '1970' AND year <= '1979' AND year NOT IN ('', 'Unknown Year')")
def _(v):
    return C.tracks_by_decade(v("v_linked"), 1970, by_album=True).select("id", "year", "album")


@R.query("j5_artist_tracklist", f"SELECT DISTINCT t.id, t.album FROM v_linked t JOIN v_track_artists ON t.id = track_id JOIN v_artists USING (artist_id) WHERE name = '{NAME}' AND role = 'artist' AND NOT is_duplicate")
def _(v):
    return C.artist_tracklist(v("v_linked"), v("v_artists"), v("v_track_artists"), NAME).select("id", "album")


@R.query("j6_tracks_of_entities", "SELECT DISTINCT t.id FROM v_linked t JOIN v_track_artists ON t.id = track_id WHERE artist_id IN (2, 5, 7)")
def _(v):
    return C.tracks_of_entities(v("v_linked"), v("v_track_artists"), "artist_id", (2, 5, 7)).select("id")


@R.query("j7_playlist_tracks", "SELECT playlist_id, position, id, title, p.date_added FROM v_playlist_tracks p JOIN v_tracks t ON track_id = id")
def _(v):
    return C.playlist_tracks_ordered(v("v_playlist_tracks"), v("v_tracks")).select("playlist_id", "position", "id", "title", "date_added")


PINS = """SELECT CAST(k AS BIGINT) AS pin_id, CASE CAST(k % 6 AS INT) WHEN 0 THEN 'artist' WHEN 1 THEN 'album' WHEN 2 THEN 'genre' WHEN 3 THEN 'year' WHEN 4 THEN 'decade' ELSE 'playlist' END AS kind,
    CASE CAST(k % 6 AS INT) WHEN 0 THEN s1 WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN CAST(1960 + p_size AS VARCHAR(10)) WHEN 4 THEN substring(CAST(1960 + p_size AS VARCHAR(10)), 1, 3) || '0s' ELSE CAST(k AS VARCHAR(20)) END AS value
    FROM v_base"""


def pins(v):
    base = v("v_base")
    kind = F.get(F.array(*[F.lit(x) for x in ("artist", "album", "genre", "year", "decade", "playlist")]), (F.col("k") % 6).cast("int"))
    year = (F.col("p_size") + 1960).cast("string")
    value = F.when(kind == "artist", F.col("s1")).when(kind == "album", F.col("p_brand")).when(kind == "genre", F.col("p_type")).when(kind == "year", year).when(kind == "decade", F.concat(F.substring(year, 1, 3), F.lit("0s"))).otherwise(F.col("k").cast("string"))
    return base.select(F.col("k").cast("long").alias("pin_id"), kind.alias("kind"), value.alias("value"))


@R.query("j8_pinned_tracks", """
    SELECT DISTINCT pin_id, id FROM (
        SELECT pin_id, track_id AS id FROM pins JOIN v_artists ON value = name JOIN v_track_artists USING (artist_id) WHERE kind = 'artist' AND role = 'artist'
        UNION ALL SELECT pin_id, id FROM pins JOIN v_linked ON (kind = 'album' AND value = album) OR (kind = 'genre' AND value = genre) OR (kind = 'year' AND value = year) OR (kind = 'decade' AND year <> 'Unknown Year' AND value = substring(year, 1, 3) || '0s')
        UNION ALL SELECT pin_id, track_id FROM pins JOIN v_playlist_tracks ON kind = 'playlist' AND value = CAST(playlist_id AS VARCHAR)) u""", pins=PINS)
def _(v):
    return C.pinned_tracks(pins(v), v("v_linked"), v("v_track_artists"), v("v_artists"), v("v_playlist_tracks"))


@R.query("j8_smart_pins", """
    WITH f AS (SELECT id FROM v_linked WHERE NOT is_duplicate AND is_favorite), m AS (SELECT id FROM v_linked WHERE NOT is_duplicate AND play_count >= 5 ORDER BY play_count DESC, id LIMIT 25)
    SELECT CAST(1 AS BIGINT) AS pin_id, id FROM f UNION ALL SELECT 2, id FROM m UNION ALL SELECT 3, id FROM v_linked WHERE album = 'Brand#3'""")
def _(v):
    spark = v("v_linked").sparkSession
    pinned = spark.createDataFrame([(1, "smart", "Favorites"), (2, "smart", "Most Played"), (3, "album", "Brand#3"), (4, "smart", "Gone")], "pin_id long, kind string, value string")
    smart = {n: DEFAULT_PLAYLISTS[n] for n in ("Favorites", "Most Played")}
    return C.pinned_tracks(pinned, v("v_linked"), v("v_track_artists"), v("v_artists"), v("v_playlist_tracks"), smart, dt.datetime(2024, 3, 1, tzinfo=dt.UTC))


@R.query("j9_unanalysed", "SELECT id FROM v_tracks t WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM v_fingerprints f WHERE f.track_id = t.id)")
def _(v):
    return C.unanalysed_tracks(v("v_tracks"), v("v_fingerprints")).select("id")


for role, unknown in (("artist", "Unknown Artist"), ("album_artist", "Unknown Album Artist"), ("composer", "Unknown Composer")):

    @R.query(f"a1_{role}_counts", f"""
        SELECT CAST(artist_id AS BIGINT) AS artist_id, name, count(DISTINCT track_id) AS n_tracks FROM v_track_artists JOIN v_artists USING (artist_id) WHERE role = '{role}' GROUP BY ALL
        UNION ALL SELECT NULL, '{unknown}', count(*) FROM v_linked WHERE {role} IS NULL OR {role} IN ('', '{unknown}') HAVING count(*) > 0""")
    def _(v, role=role):
        return C.artist_counts(v("v_linked"), v("v_artists"), v("v_track_artists"), role)


@R.query("a2_album_counts", """
    SELECT album_id, title AS name, n_tracks FROM (SELECT album_id, count(*) AS n_tracks FROM v_linked WHERE NOT is_duplicate AND album_id IS NOT NULL GROUP BY album_id) c JOIN v_albums USING (album_id)
    UNION ALL SELECT NULL, 'Unknown Album', count(*) FROM v_linked WHERE NOT is_duplicate AND album = 'Unknown Album' HAVING count(*) > 0""")
def _(v):
    return C.album_counts(v("v_linked"), v("v_albums"))


@R.query("a3_genre_counts", "SELECT CASE WHEN genre = '' THEN 'Unknown Genre' ELSE genre END AS name, count(*) AS n_tracks FROM v_tracks GROUP BY ALL")
def _(v):
    return C.genre_counts(v("v_tracks"))


@R.query("a4_decade_counts", "SELECT CASE WHEN year = 'Unknown Year' THEN 'Unknown Decade' ELSE substring(year, 1, 3) || '0s' END AS name, count(*) AS n_tracks FROM v_tracks GROUP BY ALL")
def _(v):
    return C.decade_counts(v("v_tracks"))


@R.query("a5_year_counts", "SELECT year AS name, count(*) AS n_tracks FROM v_tracks GROUP BY ALL")
def _(v):
    return C.year_counts(v("v_tracks"))


@R.query("a6_decade_stats", "SELECT CAST(floor(CAST(year AS INT) / 10) * 10 AS INT) AS decade, count(*) AS n_tracks FROM v_tracks WHERE year <> 'Unknown Year' GROUP BY ALL")
def _(v):
    return C.decade_stats(v("v_tracks"))


@R.query("a7_album_entities", """
    SELECT a.album_id, a.title, coalesce((SELECT name FROM v_album_artists x JOIN v_artists USING (artist_id) WHERE x.album_id = a.album_id AND role = 'primary' ORDER BY x.position LIMIT 1), nullif(max(album_artist), ''), max(artist)) AS artist,
        count(*) AS n_tracks, sum(duration) AS duration FROM v_albums a JOIN v_linked t ON a.album_id = t.album_id WHERE NOT is_duplicate GROUP BY a.album_id, a.title""")
def _(v):
    return C.album_entities(v("v_linked"), v("v_albums"), v("v_album_artists"), v("v_artists"))


@R.query("a8_artist_entities", "SELECT artist_id, name, count(DISTINCT track_id) AS total_tracks FROM v_artists JOIN v_track_artists USING (artist_id) WHERE role = 'artist' GROUP BY ALL")
def _(v):
    stats = v("v_artists").join(v("v_track_artists").where("role = 'artist'").groupBy("artist_id").agg(F.count_distinct("track_id").alias("total_tracks")), "artist_id")
    return C.artist_entities(stats).select("artist_id", "name", "total_tracks")


@R.query("a9_library_totals", "SELECT count(*) AS n_tracks, sum(duration) AS duration, CAST(sum(file_size) AS BIGINT) AS file_size, count(DISTINCT album_id) AS n_albums, (SELECT count(DISTINCT artist_id) FROM v_track_artists) AS n_artists FROM v_linked")
def _(v):
    return C.library_totals(v("v_linked"), v("v_track_artists"))


@R.query("a10_format_counts", "SELECT lower(format) AS format, count(format) AS n_tracks FROM v_tracks GROUP BY ALL")
def _(v):
    return C.format_counts(v("v_tracks"))


@R.query("a11_folder_counts", "SELECT '/music/' || album AS folder, count(*) AS n_tracks FROM v_tracks GROUP BY ALL")
def _(v):
    return C.folder_counts(v("v_tracks"))


@R.query("a12_folder_tree", """
    SELECT '/music/' || album AS path, album AS name, '/music' AS parent, count(*) AS n_tracks, CAST(0 AS BIGINT) AS n_folders FROM v_tracks GROUP BY ALL
    UNION ALL SELECT '/music', 'music', NULL, 0, count(DISTINCT album) FROM v_tracks""")
def _(v):
    return C.folder_tree(v("v_tracks"), "/music")


@R.query("a13_playlist_counts", "SELECT CAST(o_orderkey AS BIGINT) AS playlist_id, count(track_id) AS n_tracks FROM orders LEFT JOIN v_playlist_tracks ON o_orderkey = playlist_id GROUP BY ALL")
def _(v):
    return C.playlist_counts(v("orders").select(F.col("o_orderkey").cast("long").alias("playlist_id")), v("v_playlist_tracks"))


@R.query("a14_pinned_counts", """
    SELECT pin_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tracks FROM pins LEFT JOIN (
        SELECT 'genre' AS kind, CASE WHEN genre = '' THEN 'Unknown Genre' ELSE genre END AS value, count(*) AS n FROM v_linked GROUP BY ALL
        UNION ALL SELECT 'year', year, count(*) FROM v_linked GROUP BY ALL
        UNION ALL SELECT 'playlist', CAST(playlist_id AS VARCHAR), count(*) FROM v_playlist_tracks GROUP BY ALL) c USING (kind, value) GROUP BY pin_id""", pins=PINS)
def _(v):
    t = v("v_linked")
    categories = C.genre_counts(t).select(F.lit("genre").alias("kind"), F.col("name").alias("value"), "n_tracks").union(C.year_counts(t).select(F.lit("year"), "name", "n_tracks"))
    lists = v("v_playlist_tracks").groupBy("playlist_id").agg(F.count("*").alias("n_tracks"))
    return C.pinned_counts(pins(v), categories, lists)


@R.query("a15_skipped_extensions", "SELECT event_type AS extension, count(*) AS n_files FROM events GROUP BY ALL ORDER BY n_files DESC, extension LIMIT 3")
def _(v):
    return C.skipped_extensions(v("events").select(F.col("event_type").alias("extension")))


@R.query("a16_distinct_values", "SELECT DISTINCT CASE WHEN genre = '' THEN 'Unknown Genre' ELSE genre END AS name FROM v_tracks")
def _(v):
    return C.distinct_values(C.genre_counts(v("v_tracks")), S.UNKNOWN_GENRE)


@R.query("a17_category_counts", "SELECT artist AS name, count(DISTINCT track_id) AS n_tracks FROM v_credits WHERE role = 'artist' GROUP BY ALL")
def _(v):
    return C.category_counts_from_tracks(v("v_credits").where("role = 'artist'"))


@R.query("t1_sort_albums", "SELECT album_id, title, CAST(row_number() OVER (ORDER BY lower(title) DESC, album_id DESC) - 1 AS BIGINT) AS position FROM v_albums")
def _(v):
    ordered = C.sort_albums(v("v_albums"), "album", ascending=False)
    return with_positions(ordered, F.lower("title").desc(), F.desc("album_id")).withColumn("position", F.col("position").cast("long"))


@R.query("t2_sort_tracks", "SELECT id, track_number FROM v_tracks ")
def _(v):
    return C.sort_tracks(v("v_tracks"), "track_number").select("id", "track_number")


@R.query("t3_discover", """
    WITH f AS (SELECT id, play_count FROM v_tracks WHERE NOT is_duplicate AND play_count = 0 AND id NOT IN (1, 2, 3) LIMIT 50),
    p AS (SELECT play_count, row_number() OVER (ORDER BY coalesce(last_played, -4611686018427387904), play_count, id) AS r FROM v_tracks WHERE NOT is_duplicate AND play_count > 0 AND id NOT IN (1, 2, 3)),
    u AS (SELECT play_count FROM f UNION ALL SELECT play_count FROM p WHERE r <= 50 - (SELECT count(*) FROM f))
    SELECT count(*) AS n, CAST(sum(play_count) AS BIGINT) AS plays FROM u""")
def _(v):
    return C.discover(v("v_tracks"), 50, exclude=(1, 2, 3), seed=7).agg(F.count("*").alias("n"), F.sum("play_count").alias("plays"))


@R.query("t4_tracks_in_order", "SELECT ordinal, id, title FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS id FROM lineitem) d JOIN v_tracks USING (id), LATERAL (SELECT o * 100000 + id AS ordinal) x")
def _(v):
    ids = v("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("id")).distinct().select((F.col("o") * 100000 + F.col("id")).alias("ordinal"), "id")
    return C.tracks_in_order(v("v_tracks"), ids).select("ordinal", "id", "title")
