"""Mutual neighbours through the index of leaves and radii, against all pairs; how many pairs it compares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import neighbours, similar

NAMES = ("track_id", "title", "artist", "genre", "year", "duration_seconds", "bpm", "bpm_confidence", "rms_loudness_db", "dynamic_range_db", "spectral_brightness_hz", "bass_ratio", "beat_regularity", "mix_version", "artist_id")
SCHEMA = "track_id long, title string, artist string, genre string, year int, duration_seconds double, bpm double, bpm_confidence double, rms_loudness_db double, dynamic_range_db double, spectral_brightness_hz double, bass_ratio double, beat_regularity double, mix_version string, artist_id string"


def some(n, seed=3):
    rng = random.Random(seed)
    pick = rng.uniform
    return [(i, "t", rng.choice("ABC"), rng.choice([None, "Pop", "Rock", "Jazz"]), rng.choice([None, 1980, 1984, 1990, 1995, 2001]), pick(100, 500), rng.choice([None, pick(90, 150)]), rng.choice([None, pick(0, 1)]), pick(-20, -5), pick(2, 10),
             pick(500, 2000), pick(0.1, 0.6), rng.choice([None, pick(0, 1)]), rng.choice([None, "Club Mix", "Radio Edit"]), None) for i in range(n)]


def plain(df, limit, k, cutoff=3.5):
    packed = similar.prepare(df)
    x = packed.select(F.struct(*packed.columns).alias("x"))
    every = x.withColumnRenamed("x", "l").crossJoin(x.withColumnRenamed("x", "r")).where("l.id <> r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), similar.track_distance("l", "r").alias("d")).toPandas()
    near = every[every.d <= cutoff]
    near = near.assign(closer=near.groupby("a").d.rank(method="min"))
    kept = near[near.closer <= k].sort_values(["b", "d", "a"]).groupby("b").head(limit)
    return {(b, a): round(d, 9) for a, b, d in zip(kept.a, kept.b, kept.d, strict=True)}


@pytest.mark.parametrize("leaf_points", [16, 4096])
def test_index_equals_all_pairs_with_copies_and_gaps(spark, leaf_points):
    rows = some(150)
    # A group of copies larger than limit and mutual_k, with and without a year; a row that lacks a needed axis.
    rows += [(200 + i, *rows[0][1:]) for i in range(40)] + [(300 + i, *rows[1][1:4], None, *rows[1][5:]) for i in range(15)] + [(400, *rows[2][1:8], None, *rows[2][9:])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = similar.similar_tracks_all(df, limit=7, mutual_k=10, leaf_points=leaf_points).collect()
    assert {(r.anchor, r.neighbour): round(r.distance, 9) for r in got} == plain(df, 7, 10)
    assert all([p for _, p in sorted((r.distance, r.place) for r in got if r.anchor == a)] == list(range(1, 1 + sum(r.anchor == a for r in got))) for a in {r.anchor for r in got})


def test_stored_index_answers_given_anchors(spark):
    df = spark.createDataFrame(some(150, 5), SCHEMA)
    index = similar.build_neighbour_index(df, mutual_k=10, leaf_points=16)
    wanted = {p: d for p, d in plain(df, 7, 10).items() if p[0] < 9}
    anchors = spark.createDataFrame([(i,) for i in (*range(9), 999)], "id long")
    got = similar.similar_tracks(df, anchors, limit=7, mutual_k=10, index=index).collect()
    assert {(r.anchor, r.neighbour): round(r.distance, 9) for r in got if r.neighbour is not None} == wanted
    assert {r.anchor: r.status for r in got}[999] == "not analysed" and {r.anchor: r.status for r in got}[0] == "analysed"


def test_no_tracks_give_no_neighbours(spark):
    assert similar.similar_tracks_all(spark.createDataFrame([], SCHEMA)).count() == 0


def clustered(n, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 1, (40, len(neighbours.AXES)))
    x = centres[rng.integers(0, 40, n)] + rng.normal(0, 0.05, (n, len(neighbours.AXES)))
    x[:, neighbours.YEAR] = 1960 + np.floor(50 * np.abs(x[:, neighbours.YEAR]))
    x[:, neighbours.SECONDS] = 200 + 100 * x[:, neighbours.SECONDS]
    x[:, neighbours.MIX], x[:, neighbours.FAMILY] = rng.integers(1, 5, n), rng.integers(1, 7, n)
    x[rng.random(n) < 0.05, neighbours.YEAR] = np.nan
    x[rng.random(n) < 0.1, neighbours.BEAT] = np.nan
    x[rng.random(n) < 0.1, neighbours.FAMILY] = np.nan
    return x


def test_boxes_bound_all_distances():
    x = clustered(300)
    groups = neighbours.groups_of(x, 8)
    assert sorted(np.concatenate(groups).tolist()) == list(range(300)) and max(map(len, groups)) <= 8
    boxes = neighbours.Boxes.of(x, groups)
    for i in range(0, 300, 7):
        bound = boxes.nearest(x[i])
        assert all((neighbours.distances(x[i], x[g]) >= b - 1e-9).all() for g, b in zip(groups, bound, strict=True))


def compared(x):
    """Full distances over one leaf, as a share of all ordered pairs, once the nearest found are seen to be right."""
    n = len(x)
    leaf = neighbours.Leaf(np.arange(n), np.ones(n, int), x)
    for i in range(n):
        ids, _, far = leaf.nearest(i, x[i], 25, 3.5)
        if i % 50 == 0:
            d = neighbours.distances(x[i], x)
            d[i] = np.inf
            want = np.flatnonzero(d <= min(3.5, np.sort(d)[24]))
            assert sorted(ids.tolist()) == want.tolist() and sorted(far.tolist()) == sorted(d[want].tolist())
    return leaf.scored / n / n


def spread(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.clip(rng.normal(0.5, 0.17, (n, len(neighbours.AXES))), 0, 1)
    x[:, neighbours.YEAR], x[:, neighbours.SECONDS] = rng.integers(1960, 2011, n), rng.uniform(180, 300, n)
    x[:, neighbours.MIX], x[:, neighbours.FAMILY] = rng.integers(1, 5, n), np.nan
    x[rng.random(n) < 0.05, neighbours.YEAR] = np.nan
    x[rng.random(n) < 0.1, neighbours.BEAT] = np.nan
    return x


def test_share_of_pairs_compared_falls_as_tables_grow():
    small, large = compared(spread(1000)), compared(spread(4000))
    assert large < 0.6 * small and large < 0.05 and compared(clustered(2000)) < 0.05


def test_tree_places_points_as_it_was_cut():
    x = clustered(500)
    tree = neighbours.Tree(x, 40)
    leaf = tree.leaf_of(x)
    assert tree.leaves > 8 and np.bincount(leaf, minlength=tree.leaves).max() <= 40
