"""Library-shaped views over the driver's tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each view reads tables or earlier views.
VIEWS: dict[str, str] = {
    "v_base": """
        SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice, a.s_name AS s1, b.s_name AS s2
        FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) c
        JOIN supplier a ON a.s_suppkey = p_partkey % c.n JOIN supplier b ON b.s_suppkey = (p_partkey + 1) % c.n""",
    "v_rows": """
        SELECT k AS id, k, CASE WHEN k % 3 = 0 THEN 'mp3' ELSE 'm4a' END AS format, p_name, p_brand, p_type, p_size, p_retailprice, s1, s2 FROM v_base
        UNION ALL SELECT k + 10000000, k, 'flac', p_name, p_brand, p_type, p_size, p_retailprice, s1, s2 FROM v_base WHERE k % 4 = 0""",
    "v_plain": """
        SELECT id, k, p_name AS title,
            CASE WHEN k % 11 = 0 THEN 'Unknown Artist' WHEN k % 7 = 0 THEN s1 || ' feat. ' || s2 WHEN k % 7 = 1 THEN s1 || ' & ' || s2 ELSE s1 END AS artist,
            CASE WHEN k % 13 = 0 THEN 'Unknown Album' ELSE p_brand END AS album,
            CASE WHEN k % 17 = 0 THEN '' WHEN k % 5 = 0 THEN p_type || ';Live' ELSE p_type END AS genre,
            CASE WHEN k % 19 = 0 THEN 'Unknown Year' ELSE CAST(1960 + p_size AS VARCHAR(10)) END AS year,
            p_retailprice / 4 AS duration, format, CAST(128 + 64 * (k % 4) AS INT) AS bitrate, CAST(k % 9 AS INT) AS play_count, k % 6 = 0 AS is_favorite,
            CASE WHEN k % 23 = 0 THEN s2 END AS composer_tag, CASE WHEN k % 3 = 0 THEN s1 WHEN k % 3 = 1 THEN '' END AS album_artist,
            CASE WHEN k % 5 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + k % 2 AS INT) END AS disc_number, CASE WHEN k % 7 = 3 THEN CAST(NULL AS INT) ELSE CAST(k % 12 AS INT) END AS track_number,
            k % 29 = 0 AS compilation, CAST(1000 + k % 977 AS BIGINT) AS file_size, CASE WHEN k % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(1704067200 + k * 3600 AS BIGINT) END AS last_played,
            CAST(1704067200 + k * 3600 AS BIGINT) AS date_added
        FROM v_rows""",
    "v_tracks": """
        SELECT v_plain.*, '/music/' || album || '/' || title || '-' || CAST(id AS VARCHAR(20)) || '.' || format AS path,
            CASE WHEN composer_tag IS NULL THEN 'Unknown Composer' ELSE composer_tag END AS composer,
            k % 4 = 0 AND id < 10000000 AS is_duplicate
        FROM v_plain""",
    "v_credits": """
        SELECT id AS track_id, 'artist' AS role, 0 AS position, CASE WHEN position(' feat. ' IN artist) > 0 THEN substring(artist, 1, position(' feat. ' IN artist) - 1)
            WHEN position(' & ' IN artist) > 0 THEN substring(artist, 1, position(' & ' IN artist) - 1) ELSE artist END AS artist FROM v_tracks WHERE artist <> 'Unknown Artist'
        UNION ALL SELECT id, 'artist', 1, CASE WHEN position(' feat. ' IN artist) > 0 THEN substring(artist, position(' feat. ' IN artist) + 7, 99) ELSE substring(artist, position(' & ' IN artist) + 3, 99) END
            FROM v_tracks WHERE position(' feat. ' IN artist) > 0 OR position(' & ' IN artist) > 0
        UNION ALL SELECT id, 'composer', 0, composer FROM v_tracks WHERE composer <> 'Unknown Composer'
        UNION ALL SELECT id, 'album_artist', 0, album_artist FROM v_tracks WHERE album_artist <> ''""",
    "v_artists": "SELECT CAST(row_number() OVER (ORDER BY artist) AS BIGINT) AS artist_id, artist AS name, lower(artist) AS normalized_name FROM (SELECT DISTINCT artist FROM v_credits) d",
    "v_track_artists": "SELECT track_id, artist_id, role, position FROM v_credits JOIN v_artists ON artist = name",
    "v_albums": "SELECT CAST(row_number() OVER (ORDER BY album) AS BIGINT) AS album_id, album AS title FROM (SELECT DISTINCT album FROM v_tracks WHERE album <> 'Unknown Album') d",
    "v_linked": "SELECT v_tracks.*, album_id FROM v_tracks LEFT JOIN v_albums ON album = v_albums.title",
    "v_album_artists": """
        SELECT album_id, artist_id, CASE WHEN r = 1 THEN 'primary' ELSE 'featured' END AS role, CAST(r - 1 AS INT) AS position FROM (
            SELECT album_id, artist_id, row_number() OVER (PARTITION BY album_id ORDER BY n DESC, artist_id) AS r FROM (
                SELECT album_id, artist_id, count(*) AS n FROM v_linked JOIN v_track_artists ON id = track_id WHERE album_id IS NOT NULL AND role = 'artist' GROUP BY album_id, artist_id) x) y""",
    "v_playlist_tracks": """
        SELECT CAST(l_orderkey AS BIGINT) AS playlist_id, CAST(l_partkey AS BIGINT) AS track_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) - 1 AS INT) AS position, CAST(1704067200 AS BIGINT) AS date_added
        FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) d""",
    "v_plays": """
        SELECT event_id, ts, event_id % (SELECT count(*) FROM part) AS track_id, CASE WHEN event_type = 'purchase' THEN 'eof' ELSE 'user' END AS stop_reason, event_type = 'click' AS favourite FROM events""",
    "v_edges": """
        SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR(20)) AS source_mbid, 'o' || CAST(l_orderkey AS VARCHAR(20)) AS target_mbid, 'appears on' AS relation, 'release' AS target_kind FROM lineitem
        UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)), 'c' || CAST(o_custkey AS VARCHAR(20)), 'release of', 'release-group' FROM orders
        UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR(20)), 'p' || CAST(CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS VARCHAR(20)), 'remix of', 'recording' FROM part WHERE p_partkey > 0""",
    "v_nodes": """
        SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) AS mbid, 'recording' AS kind, p_name AS title, CAST(1960 + p_size AS INT) AS year FROM part
        UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)), 'release', o_orderpriority, CAST(year(o_orderdate) AS INT) FROM orders
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR(20)), 'release-group', c_name, CAST(NULL AS INT) FROM customer""",
}

def _e(i: int, spark: bool) -> str:
    return f"CAST(embedding[{i - spark}] AS DOUBLE)"


def fingerprint_view(spark: bool) -> str:
    """The one view that indexes an array, where engines count from 0 or from 1."""
    e = lambda i: _e(i, spark)
    return f"""
        SELECT t.id AS track_id, title, artist, genre, CASE WHEN year <> 'Unknown Year' THEN CAST(year AS INT) END AS year, duration AS duration_seconds,
            CASE WHEN k % 10 <> 0 THEN 120 + 100 * {e(2)} END AS bpm, CASE WHEN k % 10 <> 0 THEN 0.5 + {e(3)} END AS bpm_confidence, -12 + 10 * {e(1)} AS rms_loudness_db,
            6 + 5 * {e(4)} AS dynamic_range_db, 1300 + 1500 * {e(5)} AS spectral_brightness_hz, 0.3 + 0.3 * {e(6)} AS bass_ratio,
            CASE WHEN k % 8 <> 0 THEN 0.5 + {e(7)} END AS beat_regularity,
            CASE WHEN k % 5 = 1 THEN 'Radio Edit' WHEN k % 5 = 2 THEN 'Club Mix' WHEN k % 5 = 3 THEN 'Quick Remix' END AS mix_version
        FROM v_tracks t JOIN embeddings ON vec_id = t.id"""


def views_sql() -> dict[str, str]:
    return VIEWS | {"v_fingerprints": fingerprint_view(False)}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the views it uses in front, and with ``extra`` ones, for an engine that knows the tables only."""
    every = views_sql() | (extra or {})
    used: set[str] = set()

    def need(text: str) -> None:
        for name in every:
            if name in text and name not in used:
                used.add(name)
                need(every[name])

    need(sql)
    if not used:
        return sql
    rest = sql.strip()
    joined = ",\n" + rest[5:] if rest.startswith("WITH ") else "\n" + rest
    return "WITH " + ",\n".join(f"{n} AS ({every[n]})" for n in every if n in used) + joined


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _base(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """v_base with the suppliers' keys as columns of the parts: where a filter asks for s1, Spark orders the joins of the SQL so that each part meets each supplier."""
    counted = part.crossJoin(F.broadcast(supplier.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))))  # one row
    keyed = counted.select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", (F.col("p_partkey") % F.col("n")).alias("key1"), ((F.col("p_partkey") + 1) % F.col("n")).alias("key2"))
    named = lambda i: supplier.select(F.col("s_suppkey").alias(f"key{i}"), F.col("s_name").alias(f"s{i}"))
    return keyed.join(named(1), "key1").join(named(2), "key2").drop("key1", "key2")


def _rows(base: DataFrame) -> DataFrame:
    """v_rows in one pass over v_base."""
    k = F.col("k")
    ids = F.when(k % 4 == 0, F.array(k, k + 10000000)).otherwise(F.array(k))
    form = F.when(F.col("id") != k, "flac").when(k % 3 == 0, "mp3").otherwise("m4a")
    return base.select(F.explode(ids).alias("id"), "*").select("id", "k", form.alias("format"), *[c for c in base.columns if c != "k"])


def _credits(tracks: DataFrame) -> DataFrame:
    """v_credits in one pass over v_tracks."""
    artist, feat, both = F.col("artist"), F.position(F.lit(" feat. "), "artist"), F.position(F.lit(" & "), "artist")
    first = F.when(feat > 0, F.substring(artist, F.lit(1), feat - 1)).when(both > 0, F.substring(artist, F.lit(1), both - 1)).otherwise(artist)
    second = F.when(feat > 0, F.substring(artist, feat + 7, F.lit(99))).otherwise(F.substring(artist, both + 3, F.lit(99)))
    of = lambda where, role, position, name: F.when(where, F.struct(F.lit(role).alias("role"), F.lit(position).alias("position"), name.alias("artist")))
    credits = F.array_compact(F.array(
        of(artist != "Unknown Artist", "artist", 0, first), of((feat > 0) | (both > 0), "artist", 1, second),
        of(F.col("composer") != "Unknown Composer", "composer", 0, F.col("composer")), of(F.col("album_artist") != "", "album_artist", 0, F.col("album_artist"))))
    return tracks.select(F.col("id").alias("track_id"), F.inline(credits))


#: Views that Spark builds otherwise than by their SQL, to the same rows, and what they read.
BUILT = {"v_base": (_base, ("part", "supplier")), "v_rows": (_rows, ("v_base",)), "v_credits": (_credits, ("v_tracks",))}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame; nothing is registered in the session."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUILT:
        build, inputs = BUILT[name]
        return build(*[view(spark, sf_dir, x) for x in inputs])
    sql = VIEWS[name] if name in VIEWS else fingerprint_view(True)
    inputs = {x for x in (*TABLES, *VIEWS) if any(w == x for w in _tokens(sql)) and x != name}
    for x in sorted(inputs, key=len, reverse=True):
        sql = _replace(sql, x)
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in inputs})


def _tokens(sql: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()


def _replace(sql: str, name: str) -> str:
    """Table names after FROM and JOIN become parameters; column prefixes stay, under an alias of the same name."""
    import re

    def one(m: re.Match) -> str:
        alias = "" if re.match(r"\s+(?!JOIN|WHERE|ON|CROSS|LEFT|GROUP|UNION)[a-z]\b", m.string[m.end() :]) else f" {name}"
        return f"{m[1]} {{{name}}}{alias}"

    return re.sub(rf"\b(FROM|JOIN) {name}\b", one, sql)
