"""Every registered query against its SQL, and plan checks."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cadenza.operators import catalog as C
from cadenza.plans import registries, registry
from cadenza.plans.views import view, views_sql, with_views

QUERIES = {n: q for r in registries() for n, q in r.queries.items()}
SQL = {n: q for r in registries() for n, q in r.sql.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, float):
        v = round(v, 6)
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(views_sql()))
def test_views_agree(spark, sf_dir, duck, name):
    df = view(spark, sf_dir, name)
    assert (df.count(), sorted(df.columns)) == (len(duck.sql(with_views(f"select * from {name}")).df()), sorted(duck.sql(with_views(f"select * from {name}")).df().columns))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_albums_list_duplicates_too(spark, sf_dir):
    every = {(r.id, r.is_duplicate) for r in view(spark, sf_dir, "v_tracks").where("album = 'Brand#3'").select("id", "is_duplicate").collect()}
    assert {d for _, d in every} == {True, False}
    assert sorted(r.id for r in QUERIES["j2_tracks_by_album"](spark, sf_dir).collect()) == sorted(i for i, _ in every)


def test_similar_tracks_compare_no_product_of_all(spark, sf_dir):
    text = plan(QUERIES["k6_similar_tracks_all"](spark, sf_dir))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    text = plan(QUERIES["j4_tracks_by_decade"](spark, sf_dir))
    assert "p_retailprice" not in text
    text = plan(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49" in text


#: Queries over credits, in whose views each part once met each supplier.
OF_CREDITS = (
    "a8_artist_entities",
    "q4_match_entities",
    "a1_artist_counts",
    "a1_album_artist_counts",
    "a1_composer_counts",
    "a7_album_entities",
    "a9_library_totals",
    "j1_tracks_by_artist",
    "j5_artist_tracklist",
    "j6_tracks_of_entities",
    "m1_merge_artists",
    "m1_merge_chains",
    "m4_artist_candidates",
    "m3_flatten_aliases",
    "m4_merge_candidates",
    "m5_reconcile_pins",
    "n16_remove_tracks",
    "n17_drop_orphans",
    "n2_build_artists",
    "n8_compilation_artists",
    "n3_build_track_artists",
    "n9_artist_stats",
    "s6_known_artists",
    "n20_backlog",
    "s1_library_round_trip",
)


@pytest.mark.parametrize("name", OF_CREDITS)
def test_no_part_meets_every_supplier(spark, sf_dir, name, monkeypatch):
    asked = {}
    monkeypatch.setattr(registry, "view", lambda s, d, n: asked.setdefault(n, view(s, d, n)))
    QUERIES[name](spark, sf_dir)
    met = [line for df in asked.values() for line in plan(df).splitlines() if "NestedLoopJoin" in line or "CartesianProduct" in line]
    assert met and not any("Inner" in line or "Cartesian" in line or "s_suppkey" in line or "s_name" in line for line in met)  # only with the one row of their number


def test_pins_sort_no_shown_tracks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 3)
    t = spark.createDataFrame([(i, "A", "g", "1999") for i in range(10)], "id long, album string, genre string, year string")
    links = spark.createDataFrame([(1, 1, "artist"), (1, 1, "artist"), (None, 1, "artist"), (2, 1, "composer")], "track_id long, artist_id long, role string")
    who, lists = spark.createDataFrame([(1, "X")], "artist_id long, name string"), spark.createDataFrame([(7, 3), (7, 3)], "playlist_id long, track_id long")
    pins = spark.createDataFrame([(1, "genre", "g"), (1, "album", "A"), (1, "genre", "g"), (2, "artist", "X"), (3, "playlist", "7"), (None, "decade", "1990s"), (4, "genre", None), (5, "genre", "none")], "pin_id long, kind string, value string")
    found = C.pinned_tracks(pins, t, links, who, lists)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted([str((p, i)) for p in (1, None) for i in range(10)] + ["(2, 1)", "(2, None)", "(3, 3)"])
    # Under the union, what is shown for pins of one value goes through no exchange.
    first = plan(C.pinned_tracks(pins, t, links, who, lists)).split("Union\n", 1)[1].splitlines()
    shown = next(i for i, line in enumerate(first) if "explode(ids" in line)
    assert not any("Exchange" in line or "HashAggregate" in line for line in first[:shown])
