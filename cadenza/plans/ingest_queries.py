"""Registered queries of the ingest operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ingest as N
from ..sources import buckets
from .registry import Registry, scratch

R = Registry()


@R.query("n1_split_credits", "SELECT track_id AS id, CAST(position AS INT) AS position, artist FROM v_credits WHERE role = 'artist' UNION ALL SELECT id, 0, 'Unknown Artist' FROM v_tracks WHERE artist = 'Unknown Artist'")
def _(v):
    return N.split_credits(v("v_tracks"), "artist")


@R.query("n1_split_known", """
    SELECT id, 0 AS position, CASE WHEN position(' feat. ' IN artist) > 0 THEN substring(artist, 1, position(' feat. ' IN artist) - 1) ELSE artist END AS artist FROM v_tracks
    UNION ALL SELECT id, 1, substring(artist, position(' feat. ' IN artist) + 7, 99) FROM v_tracks WHERE position(' feat. ' IN artist) > 0""")
def _(v):
    known = v("v_tracks").where("artist like '% & %'").select(F.col("artist").alias("name")).distinct()
    return N.split_credits(v("v_tracks"), "artist", known)


@R.query("n2_build_artists", """
    SELECT name, lower(name) AS normalized_name FROM (SELECT DISTINCT artist AS name FROM v_credits) d""")
def _(v):
    c = v("v_credits").select("track_id", F.lit(0).alias("stage"), "position", "artist")
    return N.build_artists(c).select("name", "normalized_name")


@R.query("n3_build_track_artists", "SELECT track_id, lower(artist) AS normalized_name, role, CAST(min(position) AS INT) AS position FROM v_credits GROUP BY ALL")
def _(v):
    artists = v("v_artists")
    made = N.build_track_artists(v("v_tracks"), artists)
    return made.join(artists, "artist_id").select("track_id", "normalized_name", "role", F.col("position").cast("int").alias("position"))


def credited(v):
    parts = N.split_credits(v("v_tracks"), "artist")
    return v("v_tracks").join(parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "artist"))), lambda x: x["artist"]).alias("credits")), "id")


# Tracks with album, album artist and names of the credit, as one row for each distinct (title, artist, names).
FOLD = {
    "tagged": """SELECT id, album AS title, CASE WHEN album_artist <> '' THEN lower(album_artist) WHEN compilation THEN 'various artists' WHEN names[1] <> 'unknown artist' THEN names[1] END AS artist, names
        FROM v_tracks JOIN (SELECT t.id AS track_id, coalesce(n, ['unknown artist']) AS names FROM v_tracks t LEFT JOIN (SELECT track_id, list(lower(artist) ORDER BY position) AS n FROM v_credits WHERE role = 'artist' GROUP BY track_id) c ON t.id = c.track_id) d ON id = track_id
        WHERE album <> 'Unknown Album'""",
    "folded": "SELECT title, artist, names, min(id) AS t FROM tagged GROUP BY ALL",
    "steps": """SELECT r.title, r.t, s.t AS earlier FROM folded r JOIN folded s ON r.title = s.title AND s.t < r.t AND (r.artist = s.artist OR list_contains(s.names, r.artist))
        UNION SELECT title, t, first FROM (SELECT title, t, artist, min(t) OVER (PARTITION BY title) AS first FROM folded) x WHERE artist IS NULL""",
    "placed": """SELECT title, artist, names, t, (WITH RECURSIVE r(x) AS (SELECT t UNION SELECT earlier FROM r JOIN steps ON steps.t = x) SELECT min(x) FROM r) AS made_by FROM folded""",
}


@R.query("n4_resolve_albums", "SELECT id, g.made_by, replace(lower(g.title), 'the ', '') AS normalized_title FROM tagged d JOIN placed g ON d.title = g.title AND d.artist IS NOT DISTINCT FROM g.artist AND d.names = g.names", **FOLD)
def _(v):
    links, albums, _ = N.resolve_albums(credited(v))
    return links.join(albums, "album_id").select("id", "made_by", "normalized_title")


@R.query("n5_album_artists", """
    SELECT made_by, name AS normalized_name, CASE WHEN row_number() OVER w = 1 THEN 'primary' ELSE 'featured' END AS role, CAST(row_number() OVER w - 1 AS INT) AS position
    FROM (SELECT made_by, name, min((t, i)) AS spot FROM (SELECT made_by, t, 0 AS i, artist AS name FROM placed WHERE artist IS NOT NULL UNION ALL SELECT made_by, t, unnest(range(1, len(names) + 1)), unnest(names) FROM placed) x GROUP BY ALL) y WINDOW w AS (PARTITION BY made_by ORDER BY spot)""", **FOLD)
def _(v):
    _, albums, members = N.resolve_albums(credited(v))
    return members.join(albums, "album_id").select("made_by", "normalized_name", "role", "position")


@R.query("n6_album_metadata", """
    SELECT album_id, arg_min(CASE WHEN year <> 'Unknown Year' THEN CAST(year AS INT) END, id) AS release_year, arg_min(CASE WHEN k % 5 = 2 THEN year || '-06' END, id) AS release_date,
        arg_min(composer_tag, id) AS label, CASE WHEN album_id % 2 = 0 THEN greatest(max(track_number), 7) END AS total_tracks, CASE WHEN album_id % 3 = 0 THEN greatest(max(disc_number), 1) END AS total_discs
    FROM v_linked WHERE album_id IS NOT NULL GROUP BY album_id""")
def _(v):
    i = F.col("album_id")
    t = v("v_linked").withColumns({"label": F.col("composer_tag"), "release_date": F.when(F.col("k") % 5 == 2, F.concat("year", F.lit("-06"))), "track_total": F.col("track_number"), "disc_total": F.col("disc_number")})
    old = v("v_albums").select("album_id", F.when(i % 2 == 0, 7).alias("total_tracks"), F.when(i % 3 == 0, 1).alias("total_discs"))
    return N.fill_album_metadata(t, old)


@R.query("n7_genres", "SELECT DISTINCT id AS track_id, trim(g) AS name FROM (SELECT id, unnest(regexp_split_to_array(genre, '[;/]')) AS g FROM v_tracks) d WHERE trim(g) <> ''")
def _(v):
    genres, links = N.build_genres(v("v_tracks"))
    return links.join(genres, "genre_id").select("track_id", "name")


@R.query("n8_regroup_compilations", """
    WITH t AS (SELECT id, CASE WHEN k % 3 = 0 THEN album_id + 1000 ELSE album_id END AS album_id, album AS dir, replace(lower(album), 'the ', '') AS key FROM v_linked WHERE NOT is_duplicate AND album_id IS NOT NULL),
    c AS (SELECT dir, key, album_id, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT dir, key, first(album_id ORDER BY n DESC, album_id) AS best FROM c GROUP BY dir, key HAVING count(*) > 1)
    SELECT id, best AS album_id FROM t JOIN b USING (dir, key)""")
def _(v):
    t = v("v_linked").withColumn("album_id", F.when(F.col("k") % 3 == 0, F.col("album_id") + 1000).otherwise(F.col("album_id")))
    return N.regroup_compilations(t, v("v_album_artists"))[0]


@R.query("n8_compilation_artists", """
    WITH t AS (SELECT id, CASE WHEN k % 3 = 0 THEN album_id + 1000 ELSE album_id END AS album_id, album AS dir FROM v_linked WHERE NOT is_duplicate AND album_id IS NOT NULL),
    c AS (SELECT dir, album_id, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT dir, first(album_id ORDER BY n DESC, album_id) AS best FROM c GROUP BY dir HAVING count(*) > 1),
    p AS (SELECT DISTINCT best AS album_id, artist_id FROM b JOIN c USING (dir) JOIN (SELECT album_id + x AS album_id, artist_id + x AS artist_id FROM v_album_artists, (VALUES (0), (1000)) s(x) WHERE role = 'primary') a ON a.album_id = c.album_id),
    m AS (SELECT album_id, artist_id, count(*) OVER (PARTITION BY album_id) AS several, row_number() OVER (PARTITION BY album_id ORDER BY artist_id) AS i FROM p)
    SELECT album_id, artist_id, CASE WHEN several > 1 THEN 'featured' ELSE 'primary' END AS role, CAST(CASE WHEN several > 1 THEN i ELSE 0 END AS INT) AS position FROM m
    UNION ALL SELECT DISTINCT album_id, CAST(NULL AS BIGINT), 'primary', CAST(0 AS INT) FROM m WHERE several > 1""")
def _(v):
    t = v("v_linked").withColumn("album_id", F.when(F.col("k") % 3 == 0, F.col("album_id") + 1000).otherwise(F.col("album_id")))
    # The second album of each folder has other artists than the first.
    shifted = F.explode(F.array(F.lit(0), F.lit(1000)))
    on = v("v_album_artists").withColumn("x", shifted).select((F.col("album_id") + F.col("x")).alias("album_id"), (F.col("artist_id") + F.col("x")).alias("artist_id"), "role", "position")
    return N.regroup_compilations(t, on)[1].withColumn("position", F.col("position").cast("int"))


@R.query("n9_artist_stats", """
    SELECT artist_id, (SELECT count(DISTINCT track_id) FROM v_track_artists x JOIN v_linked ON id = track_id WHERE x.artist_id = a.artist_id AND role = 'artist' AND NOT is_duplicate) AS total_tracks,
        (SELECT count(DISTINCT album_id) FROM v_album_artists y WHERE y.artist_id = a.artist_id) AS total_albums FROM v_artists a""")
def _(v):
    return N.entity_stats(v("v_linked"), v("v_artists"), v("v_albums"), v("v_track_artists"), v("v_album_artists"))[0]


@R.query("n9_album_stats", "SELECT a.album_id, count(id) AS total_tracks FROM v_albums a LEFT JOIN v_linked t ON t.album_id = a.album_id AND NOT is_duplicate GROUP BY ALL")
def _(v):
    return N.entity_stats(v("v_linked"), v("v_artists"), v("v_albums"), v("v_track_artists"), v("v_album_artists"))[1]


SCORED = """SELECT id, k, lower(title) || '|' || lower(artist) || '|' || lower(album) || '|' || year || '|' || CAST(CAST(floor(duration / 2 + 0.5) * 2 AS BIGINT) AS VARCHAR) AS key,
    CASE WHEN format = 'flac' THEN 1000 WHEN format = 'mp3' THEN CASE WHEN bitrate >= 320 THEN 800 WHEN bitrate >= 256 THEN 600 WHEN bitrate >= 192 THEN 400 ELSE 200 END ELSE CASE WHEN bitrate >= 256 THEN 700 WHEN bitrate >= 192 THEN 500 ELSE 300 END END
    + CASE WHEN album_artist IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN track_number IS NOT NULL THEN 25 ELSE 0 END AS score FROM v_tracks"""


@R.query("n10_mark_duplicates", """
    SELECT id, n > 1 AND best <> id AS is_duplicate, CASE WHEN n > 1 AND best <> id THEN best END AS primary_track_id, CASE WHEN n > 1 THEN sha256(key) END AS duplicate_group_id
    FROM (SELECT id, key, count(*) OVER (PARTITION BY key) AS n, first_value(id) OVER (PARTITION BY key ORDER BY score DESC, id) AS best FROM scored) d""", scored=SCORED)
def _(v):
    return N.mark_duplicates(v("v_tracks"))


@R.query("n11_duplicate_summary", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_groups FROM (SELECT count(*) AS n FROM scored GROUP BY key HAVING count(*) > 1) d", scored=SCORED)
def _(v):
    return N.duplicate_summary(N.mark_duplicates(v("v_tracks")))


@R.query("n12_scan_diff", """
    SELECT path, CASE WHEN k % 10 = 0 THEN 'deleted' WHEN k % 10 = 1 THEN 'modified' ELSE 'unchanged' END AS status FROM v_tracks
    UNION ALL SELECT '/music/new/' || CAST(id AS VARCHAR) || '.mp3', 'new' FROM v_tracks WHERE k % 7 = 0""")
def _(v):
    t = v("v_tracks").select("id", "k", "path", F.col("date_added").cast("double").alias("mtime"))
    found = t.where("k % 10 <> 0").select("path", (F.col("mtime") + F.when(F.col("k") % 10 == 1, 5.0).when(F.col("k") % 10 == 2, 1.0).otherwise(0.0)).alias("mtime"))
    new = t.where("k % 7 = 0").select(F.concat(F.lit("/music/new/"), F.col("id").cast("string"), F.lit(".mp3")).alias("path"), "mtime")
    return N.scan_diff(found.union(new), t)


@R.query("n13_tag_updates", """
    SELECT id, CASE WHEN k % 3 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN k % 5 = 0 THEN duration + 1 ELSE duration END AS duration, k % 3 = 0 OR k % 5 = 0 AS changed FROM v_tracks""")
def _(v):
    t = v("v_tracks").select("id", "k", "title", "duration")
    new = t.select("id", F.when(F.col("k") % 3 == 0, F.concat(F.lit("New "), "title")).when(F.col("k") % 3 == 1, "").alias("title"), F.when(F.col("k") % 5 == 0, F.col("duration") + 1).when(F.col("k") % 5 == 1, F.col("duration") + 0.05).when(F.col("k") % 5 == 2, 0.0).alias("duration"))
    return N.apply_tag_updates(t, new, ("title", "duration")).select("id", "title", "duration", "changed")


@R.query("n13_tags_written", """
    SELECT id, CASE WHEN k % 3 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN k % 5 = 0 THEN duration + 1 ELSE duration END AS duration FROM v_tracks""")
def _(v):
    t = v("v_tracks").select("id", "k", "title", "duration")
    spark, path = t.sparkSession, scratch(t.sparkSession, "tagged-tracks")
    buckets.create(t.drop("k"), path, "id", 16)
    new = t.where("k % 3 = 0 or k % 5 = 0").select("id", F.when(F.col("k") % 3 == 0, F.concat(F.lit("New "), "title")).alias("title"), F.when(F.col("k") % 5 == 0, F.col("duration") + 1).alias("duration"))
    N.write_tag_updates(spark, path, new, ("title", "duration"))
    return buckets.current(spark, path)


@R.query("n12_scan_written", """
    SELECT path, date_added + CASE WHEN k % 10 = 1 THEN 5.0 ELSE 0.0 END AS mtime, file_size AS size FROM v_tracks WHERE k % 10 <> 0
    UNION ALL SELECT '/music/new/' || CAST(id AS VARCHAR) || '.mp3', date_added, file_size FROM v_tracks WHERE k % 7 = 0""")
def _(v):
    t = v("v_tracks").select("id", "k", "path", F.col("date_added").cast("double").alias("mtime"), F.col("file_size").alias("size"))
    spark, path = t.sparkSession, scratch(t.sparkSession, "scanned-files")
    buckets.create(t.select("path", "mtime", "size"), path, "path", 16)
    found = t.where("k % 10 <> 0").select("path", (F.col("mtime") + F.when(F.col("k") % 10 == 1, 5.0).when(F.col("k") % 10 == 2, 1.0).otherwise(0.0)).alias("mtime"), "size")
    new = t.where("k % 7 = 0").select(F.concat(F.lit("/music/new/"), F.col("id").cast("string"), F.lit(".mp3")).alias("path"), "mtime", "size")
    N.write_scan(spark, path, found.union(new))
    return buckets.current(spark, path)


HASHED = """SELECT '/music/' || album AS folder, sha256(path || '|' || CAST(date_added AS VARCHAR) || '|' || CAST(file_size AS VARCHAR)) AS h FROM v_tracks"""
SUMS = "count(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS s{i}" for i in range(4))
SEAL = "sha256(concat_ws('|', n, s0, s1, s2, s3))"


@R.query("n14_folder_fingerprint", """
    SELECT folder, sha256(string_agg(h, '' ORDER BY path)) AS hash FROM (SELECT '/music/' || album AS folder, path, sha256(path || '|' || CAST(date_added AS VARCHAR) || '|' || CAST(file_size AS VARCHAR)) AS h FROM v_tracks) d GROUP BY ALL""")
def _(v):
    return N.folder_fingerprint(files_of(v))


@R.query("n14_tree_fingerprint", f"""
    SELECT folder, {SEAL} AS hash FROM (SELECT folder, {SUMS} FROM hashed_files GROUP BY folder UNION ALL SELECT '/music', {SUMS} FROM hashed_files) s""", hashed_files=HASHED)
def _(v):
    return N.tree_fingerprint(files_of(v))


def files_of(v):
    return v("v_tracks").select(S.parent_dir(F.col("path")).alias("folder"), "path", F.col("date_added").alias("mtime"), F.col("file_size").alias("size"))


@R.query("n15_folders_to_refresh", "SELECT DISTINCT p_brand AS folder FROM part WHERE p_size % 2 = 0 AND p_brand LIKE '%1%' OR p_brand LIKE '%2' ")
def _(v):
    brands = v("part").select(F.col("p_brand").alias("folder")).distinct()
    current = brands.select("folder", F.lit(10.0).alias("mtime"), F.lit("a").alias("hash"), F.lit(True).alias("available"))
    even = v("part").where("p_size % 2 = 0").select(F.col("p_brand").alias("folder")).distinct().withColumn("even", F.lit(True))
    stored = brands.join(even, "folder", "left").select("folder", F.when(F.col("folder").endswith("2"), 12.0).otherwise(10.5).alias("mtime"), F.when(F.col("even") & F.col("folder").contains("1"), "b").otherwise("a").alias("hash"))
    return N.folders_to_refresh(current, stored)


@R.query("n16_remove_tracks", """
    SELECT DISTINCT artist_id FROM v_track_artists x WHERE EXISTS (SELECT 1 FROM v_track_artists y JOIN v_tracks ON id = y.track_id WHERE y.artist_id = x.artist_id AND k % 10 <> 3)
        AND NOT EXISTS (SELECT 1 FROM v_track_artists y JOIN v_tracks ON id = y.track_id WHERE y.artist_id = x.artist_id AND k % 10 = 3)""")
def _(v):
    ids = v("v_tracks").where("k % 10 <> 3").select("id")
    return N.remove_tracks(v("v_tracks"), {"artist_id": v("v_track_artists")}, ids)["gone_artist_id"]


@R.query("n17_drop_orphans", """
    SELECT artist_id FROM v_artists a WHERE EXISTS (SELECT 1 FROM v_track_artists x JOIN v_linked ON id = x.track_id WHERE x.artist_id = a.artist_id AND k % 40 = 1)
        OR EXISTS (SELECT 1 FROM v_album_artists y WHERE y.artist_id = a.artist_id AND y.album_id IN (SELECT album_id FROM v_linked WHERE k % 40 = 1))""")
def _(v):
    return N.drop_orphans(v("v_linked").where("k % 40 = 1"), v("v_artists"), v("v_albums"), v("v_track_artists"), v("v_album_artists"))["artists"].select("artist_id")


@R.query("n18_pick_artwork", "SELECT album_id, arg_min('art' || CAST(id AS VARCHAR), id) AS artwork_ref FROM v_linked WHERE k % 4 = 2 AND album_id IS NOT NULL GROUP BY ALL")
def _(v):
    t = v("v_linked").where("album_id is not null").withColumn("artwork_ref", F.when(F.col("k") % 4 == 2, F.concat(F.lit("art"), F.col("id").cast("string"))))
    return N.pick_artwork(t, "album_id")


SHOWN = {n: (q + " AND NOT is_duplicate" if n == "tagged" else q) for n, q in FOLD.items()} | {
    "shown_credits": "SELECT v_credits.* FROM v_credits JOIN v_tracks ON id = track_id WHERE NOT is_duplicate",
    "members": "SELECT made_by, artist AS name FROM placed WHERE artist IS NOT NULL UNION SELECT made_by, unnest(names) FROM placed",
}


@R.query("n19_rebuild", """
    SELECT n.name, lower(n.name) AS normalized_name, coalesce(t.n, 0) AS total_tracks, coalesce(a.n, 0) AS total_albums
    FROM (SELECT artist AS name FROM shown_credits UNION SELECT 'Various Artists') n
    LEFT JOIN (SELECT lower(artist) AS key, count(DISTINCT track_id) AS n FROM shown_credits WHERE role = 'artist' GROUP BY 1) t ON t.key = lower(n.name)
    LEFT JOIN (SELECT name AS key, count(DISTINCT made_by) AS n FROM members GROUP BY 1) a ON a.key = lower(n.name)
    WHERE a.n IS NOT NULL OR lower(n.name) IN (SELECT lower(artist) FROM shown_credits)""", **SHOWN)
def _(v):
    return N.rebuild_associations(v("v_tracks"))["artists"].select("name", "normalized_name", "total_tracks", "total_albums")


@R.query("n19_album_artists", """
    SELECT made_by, name AS normalized_name, CASE WHEN row_number() OVER w = 1 THEN 'primary' ELSE 'featured' END AS role, CAST(row_number() OVER w - 1 AS INT) AS position
    FROM (SELECT made_by, name, min((t, i)) AS spot FROM (SELECT made_by, t, 0 AS i, artist AS name FROM placed WHERE artist IS NOT NULL UNION ALL SELECT made_by, t, unnest(range(1, len(names) + 1)), unnest(names) FROM placed) x GROUP BY ALL) y
    WINDOW w AS (PARTITION BY made_by ORDER BY spot) QUALIFY name <> 'unknown artist'""", **SHOWN)
def _(v):
    made = N.rebuild_associations(v("v_tracks"))
    named = made["album_artists"].join(made["artists"].select("artist_id", "normalized_name"), "artist_id").join(made["albums"].select("album_id", "made_by"), "album_id")
    return named.select("made_by", "normalized_name", "role", "position")


@R.query("n19_tracks", "SELECT d.id, g.made_by FROM tagged d JOIN placed g ON d.title = g.title AND d.artist IS NOT DISTINCT FROM g.artist AND d.names = g.names", **SHOWN)
def _(v):
    made = N.rebuild_associations(v("v_tracks"))
    return made["tracks"].join(made["albums"].select("album_id", "made_by"), "album_id").select("id", "made_by")


@R.query("n20_backlog", """
    SELECT artist_id, count(DISTINCT track_id) AS n_tracks FROM v_artists JOIN v_track_artists USING (artist_id) WHERE artist_id % 2 = 0 AND artist_id % 5 <> 1 OR artist_id % 3 = 0 AND artist_id % 5 > 2 GROUP BY ALL""")
def _(v):
    i, now = F.col("artist_id"), 1_700_000_000
    artists = v("v_artists").select("artist_id", F.when(i % 2 == 1, "x").alias("image_source"), F.when(i % 5 == 1, now - 100).when(i % 5 == 2, now - 8 * 86400).alias("image_tried"), F.when(i % 3 > 0, "x").alias("bio"), F.when(i % 5 <= 2, now - 5).alias("bio_tried"))
    return N.enrichment_backlog(artists, v("v_track_artists"), now).select("artist_id", "n_tracks")
