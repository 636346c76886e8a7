"""Similar tracks: weighted distance over dataset-relative axes, kept where nearness is mutual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import neighbours
from .neighbours import LENGTH, UNKNOWN_YEAR_COST, W_BASS, W_BEAT, W_BRIGHTNESS, W_CONFIDENCE, W_DYNAMICS, W_FAMILY, W_LENGTH, W_LOUDNESS, W_MIX, W_TEMPO, W_YEAR, YEARS

AXES = {"loudness": "rms_loudness_db", "tempo": "bpm", "bass": "bass_ratio", "dynamics": "dynamic_range_db", "brightness": "spectral_brightness_hz", "beat": "beat_regularity"}
MIX_CLASSES = ("original", *(n for n, _ in S.MIX_MARKS), "other")
# Where the distance ends, and how many are kept.
CUTOFF, MUTUAL, LIMIT = 3.5, 25, 25


def axis_scales(fps: DataFrame) -> DataFrame:
    """One row: low_ and high_ of each axis."""
    return fps.agg(*[f(c).alias(f"{n}_{a}") for a, c in AXES.items() for n, f in (("low", F.min), ("high", F.max))])


def _scaled(axis: str) -> Column:
    c, low, high = F.col(AXES[axis]), F.col(f"low_{axis}"), F.col(f"high_{axis}")
    return F.when(c.isNotNull(), F.when(high > low, F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.5))


def filter_fingerprints(fps: DataFrame, year: tuple | None = None, seconds: tuple | None = None, mix: str | None = None, bpm: tuple | None = None, energy: tuple | None = None) -> DataFrame:
    """Rows within all the inclusive ranges that are given; a null never is."""
    out = fps
    for column, span in (("year", year), ("duration_seconds", seconds), ("bpm", bpm), ("energy", energy)):
        if span is not None:
            out = out.where(F.col(column).between(*span))
    return out if mix is None else out.where(S.mix_class(F.col("mix_version")) == mix)


def artist_key(fps: DataFrame) -> Column:
    own = S.empty_to_null(F.lower("artist"))
    return F.coalesce(S.empty_to_null(F.col("artist_id")), own) if "artist_id" in fps.columns else own


def artist_genre_majority(fps: DataFrame) -> DataFrame:
    """(artist_key, family): the family of over half of an artist's tagged tracks."""
    votes = fps.select(artist_key(fps).alias("artist_key"), S.genre_family(F.col("genre")).alias("family")).where("artist_key is not null and family is not null")
    counts = votes.groupBy("artist_key", "family").agg(F.count("*").alias("n"))
    best = counts.groupBy("artist_key").agg(F.sum("n").alias("all"), F.max_by("family", F.struct("n", -F.array_position(F.array(*[F.lit(f) for f in S.FAMILIES]), F.col("family")))).alias("family"), F.max("n").alias("n"))
    return best.where("n * 2 > all").select("artist_key", "family")


def prepare(fps: DataFrame) -> DataFrame:
    """(id, year, seconds, confidence, mix, family, and the scaled axes) of fingerprints, which are to be without duplicates."""
    family = artist_genre_majority(fps).withColumnRenamed("family", "artist_family")
    keyed = fps.withColumn("artist_key", artist_key(fps)).join(family, "artist_key", "left").crossJoin(F.broadcast(axis_scales(fps)))  # one row
    return keyed.select(
        F.col("track_id").alias("id"), "year", F.col("duration_seconds").alias("seconds"), F.col("bpm_confidence").alias("confidence"), S.mix_class(F.col("mix_version")).alias("mix"),
        F.coalesce(S.genre_family(F.col("genre")), F.col("artist_family")).alias("family"), *[_scaled(a).alias(a) for a in AXES],
    )


def track_distance(a: str, b: str) -> Column:
    """Distance of two prepared rows, structs named ``a`` and ``b``; what one of them lacks is neutral, an unknown year costs half."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    gap = lambda c: F.abs(x(c) - y(c))
    known = lambda e: F.coalesce(e, F.lit(0.0))
    sure = F.least(F.coalesce(x("confidence"), F.lit(1.0)), F.coalesce(y("confidence"), F.lit(1.0)))
    terms = [
        F.when(gap("year").isNull(), UNKNOWN_YEAR_COST).otherwise(W_YEAR * F.least(F.lit(1.0), gap("year") / YEARS)), known(W_TEMPO * sure * gap("tempo")),
        W_DYNAMICS * gap("dynamics"), W_BASS * gap("bass"), W_BRIGHTNESS * gap("brightness"), W_LOUDNESS * gap("loudness"), known(W_BEAT * gap("beat")),
        known(W_CONFIDENCE * gap("confidence")), F.when(x("mix") != y("mix"), W_MIX).otherwise(0.0), W_LENGTH * F.least(F.lit(1.0), gap("seconds") / LENGTH),
        F.coalesce(F.when(x("family") != y("family"), W_FAMILY), F.lit(0.0)),
    ]
    return reduce(lambda s, t: s + t, terms)


def points_of(rows: DataFrame) -> DataFrame:
    """Prepared rows as numbers, for neighbours.build(); rows that lack a needed axis are near nothing and go."""
    number = lambda c, names: F.when(F.col(c).isNotNull(), F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)))
    held = rows.where(" and ".join(f"{c} is not null" for c in ("id", "seconds", "loudness", "bass", "dynamics", "brightness")))
    return held.withColumns({"mix": number("mix", MIX_CLASSES), "family": number("family", S.FAMILIES)})


Index = tuple[DataFrame, DataFrame]


def build_neighbour_index(fps: DataFrame, cutoff: float = CUTOFF, mutual_k: int = MUTUAL, leaf_points: int = neighbours.LEAF_POINTS, folder: str | None = None) -> Index:
    """The stored index of fingerprints from which similar tracks of any anchors are read, in ``folder`` or in a new one; see neighbours.read()."""
    return neighbours.build(points_of(prepare(fps)), cutoff, mutual_k, leaf_points, folder)


def similar_tracks_all(fps: DataFrame, limit: int = LIMIT, cutoff: float = CUTOFF, mutual_k: int = MUTUAL, leaf_points: int = neighbours.LEAF_POINTS) -> DataFrame:
    """(anchor, place, neighbour, distance) for every track: up to ``limit`` within ``cutoff``, never padded.

    A candidate stays if fewer than ``mutual_k`` others are strictly closer to it than the anchor.
    """
    keeps, tracks = build_neighbour_index(fps, cutoff, mutual_k, leaf_points)
    return neighbours.ask(keeps, tracks, tracks, limit)


def similar_tracks(fps: DataFrame, anchors: DataFrame, limit: int = LIMIT, cutoff: float = CUTOFF, mutual_k: int = MUTUAL, index: Index | None = None) -> DataFrame:
    """(anchor, status, place, neighbour, distance) for ``anchors`` (id); an anchor without a fingerprint is "not analysed".

    With an ``index`` of the same fingerprints, cutoff and mutual_k (build_neighbour_index()) only the anchors' own ranges of it are read.
    """
    keeps, tracks = index or build_neighbour_index(fps, cutoff, mutual_k)
    found = neighbours.ask(keeps, tracks, anchors, limit)
    status = anchors.select(F.col("id").alias("anchor")).join(fps.select(F.col("track_id").alias("anchor"), F.lit("analysed").alias("status")).distinct(), "anchor", "left").fillna("not analysed", ["status"])
    return status.join(found, "anchor", "left").select("anchor", "status", "place", "neighbour", "distance")


def upsert_fingerprints(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``old`` with the rows of ``new``, which replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def bpm_deviation(estimates: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: n, mean and largest absolute difference of bpm where a tag (track_id, tag_bpm) exists."""
    gap = F.abs(F.col("bpm") - F.col("tag_bpm"))
    joined = estimates.join(tagged.where("tag_bpm is not null"), "track_id").where("bpm is not null")
    return joined.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))
