"""Merging artists and albums by a mapping of losers to winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ingest import album_alias
from .tables import kept


def _moved(bridge: DataFrame, entity: str, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``bridge`` with losers replaced by winners; where both have a row of one key, the winner's own stays."""
    to = mapping.select(F.col("loser").alias(entity), "winner")
    both = bridge.join(to, entity, "left").withColumn("own", F.col("winner").isNull()).withColumn(entity, F.coalesce("winner", entity)).drop("winner")
    rest = [c for c in bridge.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(~F.col("own"), *rest)).alias("best")) if rest else both.select(*keys).distinct()
    return best.select(*[F.col(c) if c in keys else F.col(f"best.{c}") for c in bridge.columns])


def final_winners(mapping: DataFrame) -> DataFrame:
    """(loser, winner) of a mapping with every winner that is itself a loser replaced by its own, until none is.

    Each round follows a pointer to the pointer's own end, so a chain of n takes log2(n) rounds. Of several winners of a loser the smallest is
    taken; a row onto itself says nothing. Losers that lead back to themselves have no last winner: that is refused.
    """
    now = kept(mapping.select("loser", "winner").where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner")), "winners")
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        to = now.select(F.col("loser").alias("winner"), F.col("winner").alias("next"))
        step = kept(now.join(to, "winner", "left").select("loser", F.coalesce("next", "winner").alias("winner"), F.col("next").isNotNull().alias("moved")), "winners")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
    raise ValueError("a merge leads back to where it began")


def flatten_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, canonical) with every canonical that is itself an alias replaced by its own, until none is; cycles keep their last name."""
    now = aliases.select("alias", "canonical")
    for _ in range(32):
        step = now.join(now.select(F.col("alias").alias("canonical"), F.col("canonical").alias("to")), "canonical", "left")
        step = step.select("alias", F.when(F.col("to") != F.col("alias"), F.col("to")).otherwise(F.col("canonical")).alias("canonical"))
        if step.exceptAll(now).isEmpty():
            break
        now = kept(step, "aliases")
    return now


def merge_artists(
    artists: DataFrame, track_artists: DataFrame, album_artists: DataFrame, mapping: DataFrame, fill: tuple[str, ...] = (), renames: DataFrame | None = None, aliases: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Artists, both bridges and aliases after ``mapping`` (loser, winner); a winner's empty ``fill`` columns take the first loser's value.

    Chains of losers end at their last winner; a circle is refused. Losers that are placeholders are left alone. ``renames`` (winner, new_name) give artists new names: another artist of the new name is
    merged in, with those merged into it, and a name that has gone becomes an alias; an empty or an equal name changes nothing. Aliases
    (alias: normalised, canonical: display name) are those of losers and old names, and the known ``aliases`` of losers led to the winner's name.
    """
    named = artists.select("artist_id", "name", "normalized_name")
    real = final_winners(mapping.select("loser", "winner").join(artists.where(~F.col("name").isin(*S.PLACEHOLDERS)).select(F.col("artist_id").alias("loser")), "loser", "left_semi"))
    final = named.select(F.col("artist_id").alias("winner"), "name", F.col("normalized_name").alias("old_key"), F.col("normalized_name").alias("new_key"))
    if renames is not None:
        asked = renames.select("winner", S.strip(F.col("new_name")).alias("new_name")).where("new_name <> ''").join(real.select(F.col("loser").alias("winner")), "winner", "left_anti")
        final = final.join(asked, "winner", "left").withColumn("name", F.coalesce("new_name", "name")).withColumn("new_key", F.coalesce(S.normalize_artist_name(F.col("new_name")), "new_key")).drop("new_name")
        # Whoever has a new name after all renames is folded into the first that was given it; one that gave its own name up keeps apart.
        first = final.where("new_key <> old_key").groupBy("new_key").agg(F.min("winner").alias("into"))
        folded = final.join(real.select(F.col("loser").alias("winner")), "winner", "left_anti").join(first, "new_key").where("winner <> into").select("winner", "into")
        real = final_winners(real.union(folded))
    gone = real.join(named.select(F.col("artist_id").alias("loser"), F.col("normalized_name").alias("alias")), "loser").select("alias", "winner")
    known = gone.union(final.where("new_key <> old_key").select(F.col("old_key").alias("alias"), "winner"))
    if aliases is not None:
        moved = aliases.select("alias", S.normalize_artist_name(F.col("canonical")).alias("old_key")).join(known.select(F.col("alias").alias("old_key"), "winner"), "old_key").select("alias", "winner")
        known = known.union(moved)
    told = known.join(final.select("winner", F.col("name").alias("canonical"), "new_key"), "winner").where("alias <> new_key").select("alias", "canonical").distinct()
    if aliases is not None:
        told = told.union(aliases.select("alias", "canonical").join(told.select("alias"), "alias", "left_anti").join(final.where("new_key <> old_key").select(F.col("new_key").alias("alias")), "alias", "left_anti"))
    out = {
        "track_artists": _moved(track_artists, "artist_id", real, ["track_id", "artist_id", "role"]),
        "album_artists": _moved(album_artists, "artist_id", real, ["album_id", "artist_id", "role"]),
        "aliases": told,
    }
    left = artists.join(real.select(F.col("loser").alias("artist_id")), "artist_id", "left_anti")
    if renames is not None:
        to = final.select(F.col("winner").alias("artist_id"), F.col("name").alias("new_name"), "new_key")
        left = left.join(to, "artist_id").withColumn("name", F.col("new_name")).withColumn("normalized_name", F.col("new_key")).drop("new_name", "new_key")
    if fill:
        donors = real.join(artists.withColumnRenamed("artist_id", "loser"), "loser").groupBy(F.col("winner").alias("artist_id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("loser"))).alias(f"new_{c}") for c in fill])
        left = left.join(donors, "artist_id", "left").withColumns({c: F.coalesce(c, f"new_{c}") for c in fill}).drop(*[f"new_{c}" for c in fill])
    return out | {"artists": left}


def merge_albums(albums: DataFrame, tracks: DataFrame, album_artists: DataFrame, mapping: DataFrame, artists: DataFrame | None = None, renames: DataFrame | None = None) -> dict[str, DataFrame]:
    """Albums, tracks (album_id and album rewritten to the winner's) and album artists after ``mapping`` (loser, winner), whose chains end at their last winner.

    ``renames`` (winner, new_title) give winners, or albums on their own, a new title; an empty one changes nothing. With ``artists``
    (artist_id, name, normalized_name) the result has "aliases" (alias: normalised title and primary artist of a loser or an old title;
    title, artist of the album it leads to), as resolve_albums reads them.
    """
    real = final_winners(mapping)
    title = albums.select(F.col("album_id").alias("winner"), F.col("title").alias("old_title"), F.col("title").alias("winner_title"))
    if renames is not None:
        asked = renames.select("winner", S.empty_to_null(S.strip(F.col("new_title"))).alias("new_title")).join(real.select(F.col("loser").alias("winner")), "winner", "left_anti")
        title = title.join(asked, "winner", "left").withColumn("winner_title", F.coalesce("new_title", "winner_title")).drop("new_title")
    renamed = title.where("winner_title <> old_title").select("winner")
    to = real.union(real.select("winner", "winner")).union(renamed.select("winner", "winner")).distinct().join(title, "winner").select(F.col("loser").alias("album_id"), "winner", "winner_title")
    moved = tracks.join(to, "album_id", "left").withColumn("album", F.coalesce("winner_title", "album")).withColumn("album_id", F.coalesce("winner", "album_id")).drop("winner", "winner_title")
    left = albums.join(real.select(F.col("loser").alias("album_id")), "album_id", "left_anti")
    if renames is not None:
        left = left.join(title.select(F.col("winner").alias("album_id"), "winner_title"), "album_id").withColumn("title", F.col("winner_title")).drop("winner_title")
        if "normalized_title" in left.columns:
            left = left.withColumn("normalized_title", S.normalize_album_title(F.col("title")))
    out = {"albums": left, "tracks": moved, "album_artists": _moved(album_artists, "album_id", real, ["album_id", "artist_id", "role"])}
    if artists is not None:
        primary = album_artists.where("role = 'primary'").groupBy("album_id").agg(F.min_by("artist_id", "position").alias("artist_id")).join(artists.select("artist_id", F.col("name").alias("artist")), "artist_id").select("album_id", "artist")
        of_winner = title.join(primary.withColumnRenamed("album_id", "winner"), "winner", "left").select("winner", F.col("winner_title").alias("title"), "artist")
        was = albums.select("album_id", F.col("title").alias("was")).join(primary.withColumnRenamed("artist", "by"), "album_id", "left").select("album_id", album_alias(F.col("was"), F.col("by")).alias("alias"))
        gone = to.select("album_id", "winner").join(was, "album_id").join(of_winner, "winner")
        out["aliases"] = gone.where(F.col("alias") != album_alias(F.col("title"), F.col("artist"))).select("alias", "title", "artist").distinct()
    return out


def album_candidates(albums: DataFrame, album_artists: DataFrame, artists: DataFrame, winner: int | None = None) -> DataFrame:
    """(album_id, title, artist, n_tracks) of albums (album_id, title, n_tracks) with tracks, but for the ``winner``, by title: what may be merged into it.

    artist is the primary artist of lowest position, null where there is none.
    """
    first = album_artists.where("role = 'primary'").groupBy("album_id").agg(F.min_by("artist_id", F.struct("position", "artist_id")).alias("artist_id"))
    named = first.join(artists.select("artist_id", F.col("name").alias("artist")), "artist_id").select("album_id", "artist")
    shown = albums.where("n_tracks > 0") if winner is None else albums.where((F.col("n_tracks") > 0) & (F.col("album_id") != winner))
    return shown.join(named, "album_id", "left").select("album_id", "title", "artist", "n_tracks").orderBy(S.nocase(F.col("title")), "album_id")


def default_winner(albums: DataFrame, title: str) -> DataFrame:
    """The album (album_id, title, n_tracks) of exactly this title with most tracks (ties: lowest id), into which others are merged unless another is named."""
    return albums.where((F.col("title") == title) & (F.col("n_tracks") > 0)).orderBy(F.desc("n_tracks"), "album_id").limit(1)


def name_candidates(counts: DataFrame, name: str, kind: str = "artist") -> DataFrame:
    """Of category counts (name, n_tracks) of artists, album artists, composers or genres, those that may be merged into ``name``: all others but the placeholder."""
    placeholder = {"artist": S.UNKNOWN_ARTIST, "album_artist": S.UNKNOWN_ALBUM_ARTIST, "composer": S.UNKNOWN_COMPOSER, "genre": S.UNKNOWN_GENRE}[kind]
    return counts.where((F.col("name") != name) & (F.col("name") != placeholder)).select("name", "n_tracks").orderBy(S.nocase(F.col("name")), "name")


def reconcile_pins(pins: DataFrame, mapping: DataFrame, names: DataFrame) -> DataFrame:
    """Pins (pin_id, entity_id, value) without those of losers, named as ``names`` (entity_id, name); a pin by title alone stays while the title does."""
    rest = pins.join(mapping.select(F.col("loser").alias("entity_id")), "entity_id", "left_anti")
    named = rest.where("entity_id is not null").join(names, "entity_id", "left").select("pin_id", "entity_id", F.coalesce("name", "value").alias("value"))
    untied = rest.where("entity_id is null").join(names.select(F.col("name").alias("value")).distinct(), "value", "left_semi").select("pin_id", "entity_id", "value")
    return named.union(untied)
