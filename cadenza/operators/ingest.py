"""From tags to a normalised library: credits, artists, albums, duplicates, statistics and upkeep."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import buckets
from .tables import kept

# What parts the names in a credit. The first always part; the others may belong to a name.
SURE = (" feat. ", " feat ", " featuring ", " ft. ", " ft ", ";", "、")
UNSURE = (" & ", " and ", " x ", " X ", " vs. ", " vs ", ", ", " with ", " / ", "/", "／")
UNSAFE = ("/",)
ROLES = ("artist", "composer", "album_artist")


def _split_all(c: Column, separators: tuple[str, ...]) -> Column:
    quoted = lambda s: "".join("\\" + x if x in ".&/" else x for x in s)
    for s in separators:
        c = F.regexp_replace(c, f"(?i){quoted(s)}", "\u0001")
    return F.split(c, "\u0001")


def _distinct_names(parts: Column, placeholder: str) -> Column:
    """Trimmed names in order of appearance, each normalised name once in its longest spelling; none left: the placeholder."""
    named = F.transform(F.filter(F.transform(parts, S.strip), lambda p: (p != "") & (p != placeholder)), lambda p: F.struct(S.normalize_artist_name(p).alias("key"), p.alias("name")))

    def put(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda k: k["key"] == x["key"])
        longer = F.transform(kept, lambda k: F.when((k["key"] == x["key"]) & (F.length(x["name"]) > F.length(k["name"])), x).otherwise(k))
        return F.when(known, longer).otherwise(F.concat(kept, F.array(x)))

    none = F.array().cast("array<struct<key:string,name:string>>")
    names = F.transform(F.aggregate(named, none, put), lambda k: k["name"])
    return F.when(F.size(names) == 0, F.array(F.lit(placeholder))).otherwise(names)


def credit_names(credits: DataFrame, known_artists: DataFrame | None = None, placeholder: str = S.UNKNOWN_ARTIST) -> DataFrame:
    """(credit, names: array) of distinct credits (credit); see split_credits."""
    if known_artists is not None:
        return _split_known(credits, known_artists, placeholder)
    return credits.withColumn("names", _distinct_names(_split_all(F.coalesce("credit", F.lit("")), SURE + tuple(s for s in UNSURE if s not in UNSAFE)), placeholder))


def split_credits(df: DataFrame, column: str, known_artists: DataFrame | None = None, placeholder: str = S.UNKNOWN_ARTIST, key: str = "id") -> DataFrame:
    """(key, position, artist): one row for each artist of a credit.

    Without ``known_artists`` (name) a credit parts at every separator but the bare slash. With it, a name of the list is kept
    whole, and between unsure separators the longest run that is a known name wins, from left to right. The work is done
    once for each distinct credit: runs grow by joins with the beginnings of the list's names, so the list is never sent to workers.
    """
    names = credit_names(df.select(F.col(column).alias("credit")).distinct(), known_artists, placeholder)
    exploded = names.select(F.col("credit").alias("of"), F.posexplode("names").alias("position", "artist"))
    rows = df.select(key, F.col(column).alias("credit"))
    return rows.join(exploded, F.col("credit").eqNullSafe(F.col("of"))).select(key, "position", "artist")


#: Any unsure separator, longer ones first where several begin at one place; what every run of several names has of them once normalised.
_UNSURE = "(?i)" + "|".join("".join("\\" + x if x in ".&/" else x for x in s) for s in sorted(UNSURE, key=len, reverse=True))
_TRACE = "&|and|x|vs|,|with|/|／"


def _run(pieces: Column, i: Column, j: Column) -> Column:
    """The text of names i to j of ``pieces``, names and separators in turn."""
    return F.array_join(F.slice(pieces, 2 * i + 1, 2 * (j - i) + 1), "")


def _known_runs(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, i, j) of the runs of two names or more of ``texts`` (text, pieces, n) that are among ``keys`` (key).

    A trie of the keys is kept as hashes of all their beginnings. From each name a run grows by one name at a time and only while it is the
    beginning of a key, so a credit of many names costs what its longest known beginnings do, not all its runs.
    """
    several = keys.where(F.col("key").rlike(_TRACE))
    trie = kept(several.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.xxhash64(F.substring("key", F.lit(1), n)))).alias("start")).distinct(), "trie")
    several = kept(several, "several")
    begun = lambda runs: kept(runs.where("j < n - 1").withColumn("start", F.xxhash64("key")).join(trie, "start", "left_semi").drop("start", "key"), "runs")
    i = F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("i")
    runs = texts.where("n > 1").select("text", "pieces", "n", i).withColumn("j", F.col("i"))
    runs = begun(runs.withColumn("key", S.normalize_artist_name(_run(F.col("pieces"), F.col("i"), F.col("j")))))
    found = []
    while not runs.isEmpty():
        longer = runs.withColumn("j", F.col("j") + 1)
        longer = longer.withColumn("key", S.normalize_artist_name(_run(F.col("pieces"), F.col("i"), F.col("j"))))
        found.append(longer.join(several, "key", "left_semi").select("text", "i", "j"))
        runs = begun(longer)
    none = texts.select("text", F.lit(0).alias("i"), F.lit(0).alias("j")).limit(0)
    return reduce(DataFrame.union, found) if found else none


def _split_known(credits: DataFrame, known_artists: DataFrame, placeholder: str) -> DataFrame:
    keys = kept(known_artists.select(S.normalize_artist_name(F.col("name")).alias("key")).where("key <> ''").distinct(), "known")
    text = F.coalesce("credit", F.lit(""))
    whole = credits.withColumn("key", S.normalize_artist_name(text)).join(keys, "key", "left_semi").select("credit", F.array(F.trim("credit")).alias("names"))
    parts = F.filter(F.transform(_split_all(text, SURE), S.strip), lambda p: p != "")
    parted = kept(credits.join(whole.select(F.col("credit").alias("of")), F.col("credit").eqNullSafe(F.col("of")), "left_anti").select("credit", F.posexplode_outer(parts).alias("at", "text")), "segments")
    names, seps = F.split("text", _UNSURE), F.regexp_extract_all("text", F.lit(_UNSURE), 0)
    pieces = F.flatten(F.zip_with(names, F.concat(seps, F.array(F.lit(""))), lambda a, s: F.array(a, s)))
    texts = kept(parted.where("text is not null").select("text").distinct().select("text", pieces.alias("pieces"), F.size(names).alias("n")), "texts")
    ends = _known_runs(texts, keys).groupBy("text", "i").agg(F.max("j").alias("j")).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("i", "j"))).alias("ends"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("names"))

    def take(done: Column, i: Column) -> Column:
        """The longest known run from a name on, or the name alone; names within a run that was taken are passed."""
        end = F.coalesce(F.try_element_at("ends", i), i)
        return F.when(i < done["next"], done).otherwise(F.struct((end + 1).alias("next"), F.concat(done["names"], F.array(_run(F.col("pieces"), i, end))).alias("names")))

    greedy = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, take)["names"]
    split = texts.join(ends, "text", "left").select("text", greedy.alias("found"))
    joined = parted.join(split, "text", "left").groupBy("credit").agg(F.collect_list(F.struct("at", F.coalesce("found", F.array().cast("array<string>")).alias("found"))).alias("all"))
    every = F.flatten(F.transform(F.array_sort("all"), lambda x: x["found"]))
    return whole.union(joined.select("credit", _distinct_names(every, placeholder).alias("names")))


def album_artist_of(tracks: DataFrame) -> Column:
    """Album artist tag, else "Various Artists" for compilations, else the first parsed artist (column first_artist), else null."""
    return F.coalesce(S.empty_to_null(F.col("album_artist")), F.when(F.col("compilation"), S.VARIOUS), F.when(F.col("first_artist") != S.UNKNOWN_ARTIST, F.col("first_artist")))


def _canonical(named: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``named`` (artist, ...) with its normalised name as ``key``; an alias (alias, canonical) takes its canonical name."""
    named = named.withColumn("key", S.normalize_artist_name(F.col("artist")))
    if aliases is None:
        return named
    to = aliases.select(F.col("alias").alias("key"), "canonical", S.normalize_artist_name(F.col("canonical")).alias("canonical_key"))
    return named.join(to, "key", "left").withColumn("artist", F.coalesce("canonical", "artist")).withColumn("key", F.coalesce("canonical_key", "key")).drop("canonical", "canonical_key")


def build_artists(credits: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(artist_id, name, normalized_name) from credits (track_id, stage, position, artist): the first spelling seen names the artist.

    ``aliases`` (alias, canonical: normalised and display name) rewrite names before. Ids are hashes of the normalised name.
    """
    return _named_artists(_canonical(credits.where(~F.col("artist").isin(*S.PLACEHOLDERS) & (F.trim("artist") != "")), aliases))


def _named_artists(named: DataFrame) -> DataFrame:
    out = named.groupBy("key").agg(F.min_by("artist", F.struct("track_id", "stage", "position")).alias("name"))
    return out.select(F.xxhash64("key").alias("artist_id"), "name", F.col("key").alias("normalized_name"))


def build_track_artists(tracks: DataFrame, artists: DataFrame, known_artists: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(track_id, artist_id, role, position) for the roles artist, composer and album_artist."""
    linked = _canonical(role_credits(tracks, known_artists), aliases).join(artists.select("artist_id", F.col("normalized_name").alias("key")), "key")
    return linked.groupBy("track_id", "artist_id", "role").agg(F.min("position").alias("position"))


def role_credits(tracks: DataFrame, known_artists: DataFrame | None = None) -> DataFrame:
    """(track_id, role, stage, position, artist) of all three roles; each distinct credit is split once, whatever roles it has.

    Null, empty and unknown tags give no row.
    """
    tags = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("stage"), F.col(r).alias("credit")) for n, r in enumerate(ROLES, 1)])
    rows = tracks.select(F.col("id").alias("track_id"), F.inline(tags)).where(F.col("credit").isNotNull() & ~F.col("credit").isin("", S.UNKNOWN_ARTIST, S.UNKNOWN_COMPOSER))
    names = credit_names(rows.select("credit").distinct(), known_artists)
    return rows.join(names, "credit").select("track_id", "role", "stage", F.posexplode("names").alias("position", "artist"))


#: Ranges of track ids into which the rows of one title and artist are dealt, so that a common pair spreads over tasks.
RANGES = 256


def _range_of(rows: DataFrame, column: str) -> Column:
    """The range of ``column`` a row is in, of RANGES about equally full ones over all rows."""
    cuts = rows.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 20000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def _first_albums(rows: DataFrame) -> DataFrame:
    """(title_key, track_id, made_by) of rows (title_key, track_id, artist_key, keys, range): the row that made the album each goes to.

    A row goes to the oldest album that lists its artist before it, and so to that of the oldest row that can be reached by steps
    from a row to an earlier one which names the former's artist; a row without an artist goes to the title's first. So the smallest row
    reached so far passes from row to row until nothing changes: the least of all earlier rows of an artist is taken within ranges of ids and over
    them, and each row then takes over what the row it has reached has reached, which halves the way.
    """
    start = rows.groupBy("title_key").agg(F.min("track_id").alias("first"))
    now = kept(rows.join(start, "title_key").select("title_key", "track_id", F.when(F.col("artist_key").isNull(), F.col("first")).otherwise(F.col("track_id")).alias("made_by")), "made-by")
    events = rows.select("title_key", "track_id", "range", F.explode("keys").alias("key"), "artist_key").withColumn("own", F.coalesce(F.col("key") == F.col("artist_key"), F.lit(False)))
    asked = events.groupBy("title_key", "key").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own and n > 1")
    events = kept(events.join(asked.select("title_key", "key"), ["title_key", "key"]).select("title_key", "key", "range", "track_id", "own"), "named")
    group = ["title_key", "key"]
    inside = Window.partitionBy(*group, "range").orderBy("track_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        told = kept(events.join(now, ["title_key", "track_id"]), "told")
        ranges = told.groupBy(*group, "range").agg(F.min("made_by").alias("least")).withColumn("least", F.min("least").over(before))
        reached = told.withColumn("near", F.min("made_by").over(inside)).where("own").join(ranges, [*group, "range"]).select("title_key", "track_id", F.least("near", "least").alias("reached"))
        step = now.join(reached, ["title_key", "track_id"], "left").select("title_key", "track_id", "made_by", F.least("made_by", "reached").alias("to"))
        ends = now.select("title_key", F.col("track_id").alias("to"), F.col("made_by").alias("end"))
        step = kept(step.join(ends, ["title_key", "to"]).select("title_key", "track_id", F.least("to", "end").alias("made_by"), (F.least("to", "end") < F.col("made_by")).alias("moved")), "made-by")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def resolve_albums(tracks: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(track -> album, albums, album artists) of tracks (id, album, album_artist, compilation, credits: array of names).

    A track joins the first album of its normalised title that lists its album artist, in whatever role, or any such album if it
    has none; else it makes one. ``aliases`` (alias: "title|artist", both normalised, the artist empty if none; title, artist) lead a
    merged album's tracks to the title and artist it was merged into. Order is that of track ids; an (artist, credits) that comes
    again goes where it went first. Albums have made_by, the track that made them, whose title they have and which their ids are hashes of;
    an album's first artist is primary, others are featured in the order in which they were named. See _first_albums() for how this is done without a pass
    in order: work is over distinct (artist, credits), and no title or artist is one task.
    """
    rows = tracks.where(F.col("album").isNotNull() & ~F.col("album").isin("", S.UNKNOWN_ALBUM)).withColumn("first_artist", F.get("credits", 0))
    rows = rows.select("id", F.col("album").alias("title"), album_artist_of(rows).alias("album_artist"), F.transform("credits", S.normalize_artist_name).alias("credit_keys"))
    artist_key = S.normalize_artist_name(F.col("album_artist"))
    if aliases is not None:
        to = aliases.select("alias", F.col("title").alias("new_title"), S.empty_to_null(F.col("artist")).alias("new_artist"))
        rows = rows.withColumn("alias", album_alias(F.col("title"), F.col("album_artist"))).join(to, "alias", "left")
        rows = rows.withColumn("album_artist", F.when(F.col("new_title").isNull(), F.col("album_artist")).otherwise(F.col("new_artist"))).withColumn("title", F.coalesce("new_title", "title"))
    keyed = rows.select("id", "title", "album_artist", "credit_keys", S.normalize_album_title(F.col("title")).alias("title_key"), artist_key.alias("artist_key"))
    distinct = keyed.groupBy("title_key", "artist_key", "credit_keys").agg(F.min("id").alias("track_id"), F.min_by("title", "id").alias("title"), F.min_by("album_artist", "id").alias("album_artist"))

    keys = F.array_distinct(F.filter(F.concat(F.array("artist_key"), "credit_keys"), lambda k: k.isNotNull()))
    rows = kept(distinct.select("title_key", "track_id", "artist_key", "credit_keys", "title", keys.alias("keys")), "distinct-albums")
    rows = kept(rows.withColumn("range", _range_of(rows, "track_id")), "ranged-albums")
    placed = kept(rows.join(_first_albums(rows), ["title_key", "track_id"]).withColumn("album_id", F.xxhash64("title_key", "made_by")), "placed-albums")
    where = placed.select("title_key", "artist_key", "credit_keys", "album_id")
    same = keyed.alias("t").join(where.alias("w"), (F.col("t.title_key") == F.col("w.title_key")) & F.col("t.artist_key").eqNullSafe(F.col("w.artist_key")) & (F.col("t.credit_keys") == F.col("w.credit_keys")))
    albums = placed.where("track_id = made_by").select("album_id", "title", F.col("title_key").alias("normalized_title"), "made_by")
    named = placed.select("album_id", "range", "track_id", F.posexplode("keys").alias("i", "normalized_name"))
    named = named.groupBy("album_id", "normalized_name").agg(F.min(F.struct("range", "track_id", "i")).alias("at")).select("album_id", "normalized_name", "at.range", "at")
    inside = F.row_number().over(Window.partitionBy("album_id", "range").orderBy("at"))
    sizes = named.groupBy("album_id", "range").agg(F.count("*").alias("n"))
    before = sizes.select("album_id", "range", (F.sum("n").over(Window.partitionBy("album_id").orderBy("range")) - F.col("n")).alias("before"))
    members = named.withColumn("inside", inside).join(before, ["album_id", "range"]).withColumn("position", (F.col("before") + F.col("inside") - 1).cast("int"))
    members = members.select("album_id", "normalized_name", F.when(F.col("position") == 0, "primary").otherwise("featured").alias("role"), "position")
    return same.select("t.id", "w.album_id"), albums, members


def album_alias(title: Column, artist: Column) -> Column:
    """Key of a merged album: normalised title and artist, the artist empty where there is none."""
    return F.concat_ws("|", S.normalize_album_title(title), F.coalesce(S.normalize_artist_name(artist), F.lit("")))


def fill_album_metadata(tracks: DataFrame, albums: DataFrame | None = None) -> DataFrame:
    """(album_id, release_year, release_date, label, total_tracks, total_discs): the first year that is a number, the first date and label.

    Totals are raised to the largest of the tracks', but only where the album (albums: album_id, total_tracks, total_discs) has one;
    without ``albums`` they are the largest of the tracks'.
    """
    year = S.leading_year(F.col("year"))
    wanted = {"label": "string", "release_date": "string", "track_total": "int", "disc_total": "int"}
    t = tracks.withColumns({n: F.lit(None).cast(k) for n, k in wanted.items() if n not in tracks.columns}).withColumn("y", year)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id")))
    found = t.where("album_id is not null").groupBy("album_id").agg(
        first("y").alias("release_year"), first("release_date").alias("release_date"), first("label").alias("label"), F.max("track_total").alias("total_tracks"), F.max("disc_total").alias("total_discs"))
    if albums is None:
        return found
    totals = ("total_tracks", "total_discs")
    old = albums.select("album_id", *[F.col(c).alias(f"old_{c}") for c in totals])
    return found.join(old, "album_id", "left").withColumns({c: F.when(F.col(f"old_{c}").isNotNull(), F.greatest(c, f"old_{c}")) for c in totals}).drop(*[f"old_{c}" for c in totals])


def build_genres(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genres, track_genres): names between ";" and "/", each once for a track."""
    links = tracks.select("id", F.explode(F.split("genre", "[;/]")).alias("name")).select(F.col("id").alias("track_id"), S.strip(F.col("name")).alias("name")).where("name <> ''").distinct()
    links = links.select("track_id", F.xxhash64("name").alias("genre_id"), "name")
    return links.select("genre_id", "name").distinct(), links.select("track_id", "genre_id")


def regroup_compilations(tracks: DataFrame, album_artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id -> album_id, artists of merged albums (album_id, artist_id or null for Various Artists, role, position)).

    Tracks of one folder and one normalised album title whose albums differ all move to the album with most of them (ties: lowest id).
    """
    t = S.hide_duplicates(tracks).where("album_id is not null").select("id", "album_id", S.parent_dir(F.col("path")).alias("dir"), S.normalize_album_title(F.col("album")).alias("key")).where("key <> ''")
    counts = t.groupBy("dir", "key", "album_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("dir", "key").agg(F.min_by("album_id", F.struct(-F.col("n"), "album_id")).alias("to"), F.count("*").alias("albums")).where("albums > 1")
    moved = t.join(best, ["dir", "key"]).select("id", F.col("album_id").alias("was"), F.col("to").alias("album_id"))
    merged = moved.select("was", "album_id").union(moved.select("album_id", "album_id")).distinct()
    primary = merged.join(album_artists.where("role = 'primary'").select(F.col("album_id").alias("was"), "artist_id"), "was").select("album_id", "artist_id").distinct()
    several = primary.groupBy("album_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("album_id").orderBy("artist_id")
    listed = primary.join(several, "album_id").withColumn("i", F.row_number().over(order))
    rows = listed.select("album_id", "artist_id", F.when(F.col("n") > 1, "featured").otherwise("primary").alias("role"), F.when(F.col("n") > 1, F.col("i")).otherwise(0).alias("position"))
    various = several.where("n > 1").select("album_id", F.lit(None).cast("long").alias("artist_id"), F.lit("primary").alias("role"), F.lit(0).alias("position"))
    return moved.select("id", "album_id"), rows.union(various)


def entity_stats(tracks: DataFrame, artists: DataFrame, albums: DataFrame, track_artists: DataFrame, album_artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artist_id, total_tracks, total_albums) and (album_id, total_tracks), zeros included; duplicates do not count."""
    shown = S.hide_duplicates(tracks)
    by_artist = track_artists.where("role = 'artist'").join(shown.select(F.col("id").alias("track_id")), "track_id", "left_semi").groupBy("artist_id").agg(F.count("*").alias("total_tracks"))
    on_albums = album_artists.groupBy("artist_id").agg(F.count_distinct("album_id").alias("total_albums"))
    by_album = shown.where("album_id is not null").groupBy("album_id").agg(F.count("*").alias("total_tracks"))
    return (
        artists.select("artist_id").join(by_artist, "artist_id", "left").join(on_albums, "artist_id", "left").fillna(0),
        albums.select("album_id").join(by_album, "album_id", "left").fillna(0),
    )


def mark_duplicates(tracks: DataFrame) -> DataFrame:
    """(id, is_duplicate, primary_track_id, duplicate_group_id) of every track.

    Tracks of one duplicate key are a group; its best copy (ties: lowest id) is primary. The best is found by a pre-aggregated
    maximum and sent back by a join, so a key that very many tracks share, as blank tags do, is no single task's window.
    """
    keyed = tracks.select("id", S.duplicate_key(*[F.col(c) for c in ("title", "artist", "album", "year", "duration")]).alias("key"), S.quality_score(tracks).alias("score"))
    groups = keyed.groupBy("key").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("primary"), F.count("*").alias("n")).where("n > 1")
    out = keyed.join(groups, "key", "left")
    other = F.col("primary").isNotNull() & (F.col("primary") != F.col("id"))
    return out.select("id", other.alias("is_duplicate"), F.when(other, F.col("primary")).alias("primary_track_id"), F.when(F.col("primary").isNotNull(), F.sha2("key", 256)).alias("duplicate_group_id"))


def duplicate_summary(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("is_duplicate").alias("n_duplicates"), F.count_distinct("duplicate_group_id").alias("n_groups"))


def scan_diff(inventory: DataFrame, tracks: DataFrame, hard: bool = False) -> DataFrame:
    """(path, status) of files (path, mtime) against tracks (path, mtime): new, modified (over one second), unchanged or deleted."""
    stored = tracks.select("path", F.col("mtime").alias("stored"), F.lit(True).alias("known"))
    found = inventory.select("path", "mtime", F.lit(True).alias("present"))
    modified = F.lit(True) if hard else F.coalesce(F.abs(F.col("mtime") - F.col("stored")) > 1, F.lit(False))
    status = F.when(F.col("known").isNull(), "new").when(F.col("present").isNull(), "deleted").when(modified, "modified").otherwise("unchanged")
    return found.join(stored, "path", "full_outer").select("path", status.alias("status"))


def apply_tag_updates(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``old`` with the non-empty values of ``new`` (id, ...), and whether a row changed; durations only if above 0 and 0.1 s off."""
    joined = old.join(new.select("id", *[F.col(c).alias(f"new_{c}") for c in columns]), "id", "left")
    out, changed = {}, F.lit(False)
    for c in columns:
        value, now = F.col(f"new_{c}"), F.col(c)
        if c == "duration":
            wins = (value > 0) & (F.abs(value - F.coalesce(now, F.lit(0.0))) > 0.1)
        else:
            wins = value.isNotNull() & ~value.eqNullSafe(now)
            wins = wins & (value != "") if dict(old.dtypes)[c] == "string" else wins
        wins = F.coalesce(wins, F.lit(False))
        out[c] = F.when(wins, value).otherwise(now)
        changed = changed | wins
    return joined.withColumn("changed", changed).withColumns(out).drop(*[f"new_{c}" for c in columns])


def write_tag_updates(spark: SparkSession, path: str, new: DataFrame, columns: tuple[str, ...]) -> int:
    """apply_tag_updates() on the stored tracks at ``path`` (sources.buckets); how many buckets were written again.

    Only the buckets that ``new`` (id, ...) falls in are read, and only those with a changed row are written; the same update again writes none.
    """
    return buckets.upsert(spark, path, new, lambda old, new: apply_tag_updates(old, new, columns))


def write_scan(spark: SparkSession, path: str, inventory: DataFrame, hard: bool = False) -> int:
    """Bring an inventory (path, mtime, size) into the stored files at ``path``, a sources.buckets table of those columns keyed by path.

    New and modified files (scan_diff()) are written and deleted ones taken out, in the buckets in which there are any.
    """

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        status = scan_diff(new, old, hard)
        both = old.select("path", F.col("mtime").alias("was_mtime"), F.col("size").alias("was_size")).join(new.select("path", "mtime", "size"), "path", "full_outer").join(status, "path")
        keep = F.col("status") == "unchanged"
        value = lambda c: F.when(keep, F.col(f"was_{c}")).otherwise(F.coalesce(c, f"was_{c}")).alias(c)
        return both.select("path", value("mtime"), value("size"), (~keep).alias("changed"), (F.col("status") == "deleted").alias("_deleted"))

    # A deletion shows in the inventory's absence only, so all files are compared; buckets without a change are not written.
    return buckets.upsert(spark, path, inventory, merged, every=True)


ARTWORK = ("jpg", "jpeg", "png", "webp", "heic", "gif", "bmp", "tif", "tiff")


#: Numbers of 15 hexadecimal digits that a file's hash is cut into, to be summed.
LANES = 4

#: Hashes of files that travel as one row to the hash of their folder.
PIECE = 128


def _is_known() -> Column:
    return S.extension(F.col("path")).isin(*S.SUPPORTED, *ARTWORK)


def _file_hash() -> Column:
    return F.sha2(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")), 256)


def file_sums(inventory: DataFrame) -> DataFrame:
    """(folder, n, s0, s1, ..) of the audio and image files (folder, path, mtime, size): their number, and sums of their hashes' parts.

    Sums of a folder are sums of its parts' sums, in any order and grouping: tasks send one row for a folder, however many files it has.
    """
    digest = inventory.where(_is_known()).select("folder", _file_hash().alias("h"))
    lane = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return digest.groupBy("folder").agg(F.count("*").alias("n"), *[F.sum(lane(i)).alias(f"s{i}") for i in range(LANES)])


def _sealed(sums: DataFrame) -> DataFrame:
    return sums.select("folder", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(LANES)]), 256).alias("hash"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (folder, path, h) in order as (folder, first, place, hashes): up to PIECE hashes of one folder, their first path and the piece's place in the task."""
    schema = pa.schema([("folder", pa.string()), ("first", pa.string()), ("place", pa.int64()), ("hashes", pa.binary())])
    held, place = None, 0
    for b in batches:
        done = []
        for folder, path, h in zip(*(b.column(c).to_pylist() for c in ("folder", "path", "h")), strict=True):
            if held is None or held["folder"] != folder or len(held["hashes"]) >= 32 * PIECE:
                done += [held] if held else []
                held, place = {"folder": folder, "first": path, "place": place, "hashes": bytearray()}, place + 1
            held["hashes"] += h or b""
        yield pa.RecordBatch.from_pylist(done, schema)
    if held:
        yield pa.RecordBatch.from_pylist([held], schema)


def _folder_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder, hash) of pieces in order: SHA-256 over the hexadecimal digits of all their hashes; null where there are none."""
    schema = pa.schema([("folder", pa.string()), ("hash", pa.string())])
    held = None
    for b in batches:
        done = []
        for folder, hashes in zip(b.column("folder").to_pylist(), b.column("hashes").to_pylist(), strict=True):
            if held is None or held[0] != folder:
                done += [held] if held else []
                held = (folder, None)
            if hashes:
                digest = held[1] or hashlib.sha256()
                digest.update(hashes.hex().encode())
                held = (folder, digest)
        yield _sealed_folders(done, schema)
    yield _sealed_folders([held] if held else [], schema)


def _sealed_folders(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"folder": f, "hash": d and d.hexdigest()} for f, d in done], schema)


def folder_fingerprint(inventory: DataFrame) -> DataFrame:
    """(folder, hash) over path, time and size of the audio and image files (folder, path, mtime, size) of a folder in order of path; null where it has none.

    Files are sorted and hashed in ranges of (folder, path), however many a folder has. Only the SHA-256 over their hashes goes through
    a folder from end to end: it takes them piece by piece, 32 bytes a file, and holds one digest.
    """
    # Other files stay as rows without a hash, so that folders of such alone are seen.
    order = ("folder", "path", "mtime", "size")
    ranges = inventory.select(*order).repartitionByRange("folder", "path").sortWithinPartitions(*order)
    hashed = ranges.select("folder", "path", F.when(_is_known(), F.unhex(_file_hash())).alias("h"))
    pieces = hashed.mapInArrow(_pieces, "folder string, first string, place long, hashes binary")
    return pieces.repartition("folder").sortWithinPartitions("folder", "first", "place").mapInArrow(_folder_hashes, "folder string, hash string")


def tree_fingerprint(inventory: DataFrame) -> DataFrame:
    """(folder, hash) of every folder and all above it, over the files in it and below: where two scans agree on a folder, nothing below it has changed.

    Files are summed by folder first, so only folders, not files, are spread over the folders above them.
    """
    own = file_sums(inventory)
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = own.withColumn("folder", F.explode(F.filter(above, lambda p: p != "")))
    return _sealed(spread.groupBy("folder").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(LANES)]))


def changed_subtrees(now: DataFrame, before: DataFrame) -> DataFrame:
    """(folder) of all tree_fingerprint()s that differ or that one scan alone has; below any other folder nothing is to be read again."""
    n, b = (t.select("folder", F.col("hash").alias(name)) for t, name in ((now, "now"), (before, "before")))
    return n.join(b, "folder", "full_outer").where(~F.col("now").eqNullSafe(F.col("before"))).select("folder")


def folders_to_refresh(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Folders (folder, mtime, hash, available) whose time moved by over a second, whose hash differs or is missing."""
    s = stored.select("folder", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    differs = (F.abs(F.col("mtime") - F.col("old_mtime")) > 1) | F.col("old_hash").isNull() | F.col("hash").isNull() | (F.col("hash") != F.col("old_hash"))
    return current.where("available").join(s, "folder", "left").where(F.coalesce(differs, F.lit(True))).select("folder")


def remove_tracks(tracks: DataFrame, bridges: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the tracks ``ids`` (id): "tracks", each bridge by the name of its entity column, and "gone_<entity>" ids.

    Gone are the entities that the tracks touched and that no other track keeps.
    """
    out = {"tracks": tracks.join(ids, "id", "left_anti")}
    dead = ids.select(F.col("id").alias("track_id"))
    for entity, bridge in bridges.items():
        kept = bridge.join(dead, "track_id", "left_anti")
        out[entity] = kept
        out[f"gone_{entity}"] = bridge.join(dead, "track_id", "left_semi").select(entity).distinct().join(kept, entity, "left_anti")
    return out


def drop_orphans(
    tracks: DataFrame, artists: DataFrame, albums: DataFrame, track_artists: DataFrame, album_artists: DataFrame, *, genres: DataFrame | None = None, track_genres: DataFrame | None = None,
    playlist_tracks: DataFrame | None = None, playlists: DataFrame | None = None, pins: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Bridges without their ends, artists in neither bridge, albums without tracks, genres without tracks, pins to what is gone - all left out.

    Tables that are not given are not returned. ``pins`` has any of artist_id, album_id and playlist_id; a null one points to nothing.
    """
    live = tracks.select(F.col("id").alias("track_id"))
    links = track_artists.join(live, "track_id", "left_semi")
    live_albums = albums.join(tracks.select("album_id").where("album_id is not null").distinct(), "album_id", "left_semi")
    on_albums = album_artists.join(live_albums.select("album_id"), "album_id", "left_semi")
    used = links.select("artist_id").union(on_albums.select("artist_id")).distinct()
    out = {"track_artists": links, "albums": live_albums, "album_artists": on_albums, "artists": artists.join(used, "artist_id", "left_semi")}
    if track_genres is not None:
        out["track_genres"] = track_genres.join(live, "track_id", "left_semi")
        if genres is not None:
            out["genres"] = genres.join(out["track_genres"].select("genre_id").distinct(), "genre_id", "left_semi")
    if playlist_tracks is not None:
        out["playlist_tracks"] = playlist_tracks.join(live, "track_id", "left_semi")
    if pins is not None:
        for entity, table in (("artist_id", out["artists"]), ("album_id", live_albums), ("playlist_id", playlists)):
            if entity in pins.columns and table is not None:
                known = table.select(F.col(entity).alias("known_id"))
                pins = pins.join(known, pins[entity] == F.col("known_id"), "left").where(f"{entity} is null or known_id is not null").drop("known_id")
        out["pins"] = pins
    return out


def deleted_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, deleted): rows that each table of ``after`` has lost."""
    each = [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit(sign).alias("sign"), "n") for n in after for t, sign in ((before, 1), (after, -1))]
    rows = each[0]
    for e in each[1:]:
        rows = rows.union(e)
    return rows.groupBy("name").agg(F.sum(F.col("sign") * F.col("n")).alias("deleted"))


def pick_artwork(tracks: DataFrame, entity: str) -> DataFrame:
    """(entity, artwork_ref): the first track's with artwork; references only, images are joined last."""
    return tracks.where("artwork_ref is not null").groupBy(entity).agg(F.min_by("artwork_ref", "id").alias("artwork_ref"))


def shown_artwork(tracks: DataFrame, album_art: DataFrame) -> DataFrame:
    """(id, artwork_ref) of every track: its album's of ``album_art`` (album_id, artwork_ref), else its own, else null."""
    of_album = album_art.select("album_id", F.col("artwork_ref").alias("album_ref"))
    return tracks.join(of_album, "album_id", "left").select("id", F.coalesce("album_ref", "artwork_ref").alias("artwork_ref"))


def enrichment_backlog(artists: DataFrame, track_artists: DataFrame, now: int) -> DataFrame:
    """Artists with tracks that lack an image or a biography and were not tried in the last seven days (epoch seconds), busiest first."""
    counts = track_artists.groupBy("artist_id").agg(F.count_distinct("track_id").alias("n_tracks"))
    due = lambda what, tried: F.col(what).isNull() & (F.col(tried).isNull() | (F.col(tried) < now - 7 * 86400))
    return artists.join(counts, "artist_id").where(due("image_source", "image_tried") | due("bio", "bio_tried")).orderBy(F.desc("n_tracks"), "artist_id")


def relink_pins(pins: DataFrame, artists: DataFrame, albums: DataFrame) -> DataFrame:
    """Pins (pin_id, artist_id, album_id, value) led to the artist or the album (lowest id) of their value's normalised name; others keep their ids."""
    to_artist = artists.select(F.col("normalized_name").alias("artist_key"), F.col("artist_id").alias("new_artist"))
    to_album = albums.groupBy(F.col("normalized_title").alias("album_key")).agg(F.min("album_id").alias("new_album"))
    keyed = pins.withColumn("artist_key", F.when(F.col("artist_id").isNotNull(), S.normalize_artist_name(F.col("value")))).withColumn("album_key", F.when(F.col("album_id").isNotNull(), S.normalize_album_title(F.col("value"))))
    both = keyed.join(to_artist, "artist_key", "left").join(to_album, "album_key", "left")
    return both.withColumn("artist_id", F.coalesce("new_artist", "artist_id")).withColumn("album_id", F.coalesce("new_album", "album_id")).select(*pins.columns)


def rebuild_associations(
    tracks: DataFrame, known_artists: DataFrame | None = None, aliases: DataFrame | None = None, album_aliases: DataFrame | None = None, pins: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Artists, links, albums and statistics of all tracks that are no duplicates, from the tags alone.

    Every distinct credit is split once and its rows are kept; artists, links and albums are derived from them. ``pins`` (pin_id,
    artist_id, album_id, value) are led to the new ids by name; what is left without an end is dropped.
    """
    shown = kept(S.hide_duplicates(tracks), "shown")
    parts = kept(_canonical(role_credits(shown, known_artists), aliases), "credits")
    named = parts.where("role = 'artist'").groupBy(F.col("track_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "artist"))), lambda x: x["artist"]).alias("credits"))
    credits = kept(shown.select("id", "album", "album_artist", "compilation").join(named, "id", "left").withColumn("credits", F.coalesce("credits", F.array(F.lit(S.UNKNOWN_ARTIST)))), "credited")
    links, albums, members = resolve_albums(credits, album_aliases)
    real = ~F.col("artist").isin(*S.PLACEHOLDERS) & (F.col("artist") != "")
    owners = credits.withColumn("first_artist", F.get("credits", 0))
    owners = _canonical(owners.select(F.col("id").alias("track_id"), F.lit(0).alias("stage"), F.lit(0).alias("position"), album_artist_of(owners).alias("artist")).where(real), aliases)
    columns = ("track_id", "stage", "position", "artist", "key")
    artists = kept(_named_artists(owners.select(*columns).union(parts.where(real).select(*columns))), "artists")
    ids = artists.select("artist_id", F.col("normalized_name").alias("key"))
    track_artists = kept(parts.join(ids, "key").groupBy("track_id", "artist_id", "role").agg(F.min("position").alias("position")), "track-artists")
    of_album = _canonical(members.withColumnRenamed("normalized_name", "artist"), aliases).join(ids, "key")
    best = F.min(F.struct((F.col("role") != "primary").alias("later"), "role", "position"))
    album_artists = kept(of_album.groupBy("album_id", "artist_id").agg(best.alias("best")).select("album_id", "artist_id", "best.role", "best.position"), "album-artists")
    linked = kept(shown.drop("album_id").join(links, "id", "left"), "linked")
    if pins is not None:
        pins = relink_pins(pins, artists, albums)
    out = drop_orphans(linked, artists, albums, track_artists, album_artists, pins=pins)
    by_artist, by_album = entity_stats(linked, out["artists"], out["albums"], out["track_artists"], out["album_artists"])
    return out | {"tracks": linked, "artists": out["artists"].join(by_artist, "artist_id"), "albums": out["albums"].join(by_album, "album_id")}
