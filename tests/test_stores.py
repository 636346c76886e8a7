"""Stored tables and streams: buckets that are updated in place, plays that count once, playlists that follow, the search index."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import ingest, merge, rules, search
from cadenza.sources import buckets
from cadenza.streaming import live, plays

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


# --- buckets ---


def test_updates_write_touched_buckets_only_and_a_rerun_is_idle(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    old = spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(100)], "id long, title string, duration double")
    buckets.create(old, path, "id", 16)
    new = spark.createDataFrame([(3, "new", 3.0), (5, "t5", 5.05), (7, "", 9.0), (999, "nobody", 1.0)], "id long, title string, duration double")
    n = ingest.write_tag_updates(spark, path, new, ("title", "duration"))
    assert 1 <= n <= 2 and buckets.versions(spark, path) == [1, 2]
    got = {r.id: (r.title, r.duration) for r in buckets.current(spark, path).collect()}
    assert len(got) == 100 and got[3] == ("new", 3.0) and got[5] == ("t5", 5.0) and got[7] == ("t7", 9.0)
    assert ingest.write_tag_updates(spark, path, new, ("title", "duration")) == 0 and buckets.versions(spark, path) == [1, 2]
    assert buckets.vacuum(spark, path, 1) == 0 and buckets.versions(spark, path) == [2] and buckets.current(spark, path).count() == 100


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    buckets.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), path, "id", 4)
    (tmp_path / "t/manifest/2/_temporary").mkdir(parents=True)
    (tmp_path / "t/data/half/_bucket=1").mkdir(parents=True)
    assert rows_of(buckets.current(spark, path), "id", "x") == {(1, "a"), (2, "b")}
    assert buckets.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, None)], "id long, x string"), buckets.replace_rows) >= 1
    assert rows_of(buckets.current(spark, path), "id", "x") == {(1, "a"), (2, "c"), (3, None)}
    assert buckets.vacuum(spark, path, 1) >= 1 and rows_of(buckets.current(spark, path), "id", "x") == {(1, "a"), (2, "c"), (3, None)}


def test_a_scan_is_written_back(spark, tmp_path):
    path, schema = f"file://{tmp_path}/f", "path string, mtime double, size long"
    buckets.create(spark.createDataFrame([(f"/m/{i}", 10.0, i) for i in range(40)], schema), path, "path", 8)
    seen = [(f"/m/{i}", 10.0 + (5 if i == 4 else 0.5), i) for i in range(40) if i != 9] + [("/m/new", 1.0, 7)]
    found = spark.createDataFrame(seen, schema)
    assert 1 <= ingest.write_scan(spark, path, found) <= 3
    got = {r.path: (r.mtime, r.size) for r in buckets.current(spark, path).collect()}
    assert len(got) == 40 and "/m/9" not in got and got["/m/4"] == (15.0, 4) and got["/m/5"] == (10.0, 5) and got["/m/new"] == (1.0, 7)
    assert ingest.write_scan(spark, path, found) == 0


def test_an_empty_table_can_grow(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    buckets.create(spark.createDataFrame([], "id long, x string"), path, "id", 4)
    assert buckets.current(spark, path).count() == 0
    buckets.upsert(spark, path, spark.createDataFrame([(1, "a")], "id long, x string"), buckets.replace_rows)
    assert rows_of(buckets.current(spark, path), "id", "x") == {(1, "a")}


# --- plays ---

EVENT = "event_id long, ts timestamp, track_id long, stop_reason string, favourite boolean"


def at(hours, minutes=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours, minutes=minutes)


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, n, rows):
    spark.createDataFrame([(i, t, k, "eof", None) for i, t, k in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/x")
    for p in (folder / "x").glob("*.parquet"):
        p.rename(folder / f"{n:03d}-{p.name}")


def test_late_events_count_once_and_repeated_batches_change_nothing(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    run = lambda: plays.run_play_counts(stream(spark, src), out, f"{tmp_path}/state")
    add(spark, src, 0, [(1, at(0), 7), (1, at(0), 7), (2, at(50), 7), (3, at(50), 8), (None, at(1), 8), (None, at(1), 8), (11, None, 7)])
    run()
    # Event 1 comes again two days later than it may be remembered, 4 is as late but new, and comes twice.
    add(spark, src, 1, [(1, at(0), 7), (4, at(2), 7), (4, at(2), 7), (2, at(50), 7), (5, at(49, 30), 7), (11, None, 7)])
    run()
    add(spark, src, 2, [(4, at(2), 7), (6, at(60), 8), (9, at(1), None)])
    run()
    wanted = {(7, 5), (8, 4)}
    assert rows_of(plays.counted_plays(spark, out), "track_id", "plays") == wanted
    assert {r.track_id: r.last_played for r in plays.counted_plays(spark, out).collect()}[8] == at(60)
    again = spark.createDataFrame(spark.read.parquet(f"{out}/staged/1").drop("day").collect(), plays.HEARD)
    plays.ledger_batch(again, 1, out)
    assert rows_of(plays.counted_plays(spark, out), "track_id", "plays") == wanted
    run()
    assert rows_of(plays.counted_plays(spark, out), "track_id", "plays") == wanted


# --- live playlists ---

TRACK = "id long, title string, play_count int, is_favorite boolean, is_duplicate boolean, last_played long, year string"


def tracks(rng, ids):
    return [(i, rng.choice(["a", "b", "C", None]) and f"{rng.choice('abC')}{i % 5}", rng.randint(0, 12), rng.random() < 0.3, rng.random() < 0.1, rng.choice([None, 1_709_000_000, 1_709_200_000]), "1990") for i in ids]


LISTS = {
    "Favorites": rules.DEFAULT_PLAYLISTS["Favorites"], "Most": {**rules.DEFAULT_PLAYLISTS["Most Played"], "limit": 4}, "By title": {"matchType": "all", "rules": [{"field": "play_count", "condition": "lessThan", "value": "9"}], "limit": 3, "sortBy": "title", "sortAscending": False},
    "Recent": rules.DEFAULT_PLAYLISTS["Recently Played"], "Nothing": {"rules": [{"field": "title", "condition": "equals", "value": "zzz"}], "limit": 5}, "Frozen": {"rules": [], "autoUpdate": False},
}


def test_live_playlists_equal_full_evaluation_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "LEAST_RESERVE", 3)
    rng, path = random.Random(2), f"file://{tmp_path}/live"
    now = {r[0]: r for r in tracks(rng, range(60))}
    frame = lambda rows: spark.createDataFrame(list(rows), TRACK)
    live.start(frame(now.values()), LISTS, NOW, path, 4)

    def holds():
        full = frame(now.values())
        lists = live.live(LISTS)
        limited = {n: c for n, c in lists.items() if c.get("limit")}
        assert rows_of(live.counts(spark, path, LISTS), "playlist", "n") == rows_of(rules.evaluate_counts(full, lists, NOW), "playlist", "n")
        assert rows_of(live.members(spark, path, LISTS), "playlist", "position", "id") == rows_of(rules.evaluate_members(full, limited, NOW), "playlist", "position", "id")

    holds()
    evaluated = []
    for batch in range(4):
        ids = [*rng.sample(range(60), 3), 100 + batch] if batch != 3 else [i for i, r in now.items() if r[2] >= 8]
        changes = tracks(rng, ids) if batch != 3 else [(*now[i][:2], 0, *now[i][3:]) for i in ids]
        now |= {r[0]: r for r in changes}
        evaluated.append(live.apply_changes(spark, path, frame(changes), LISTS, NOW, batch))
        holds()
        if batch == 1:  # run again
            live.apply_changes(spark, path, frame(changes), LISTS, NOW, batch)
            holds()
    # Only what counts days from now is evaluated each time; a list that has lost more than its reserve is, once.
    assert all("Recent" in e for e in evaluated) and not any("Favorites" in e for e in evaluated)
    assert evaluated[0] == ["Recent"] and "Most" in evaluated[3]


def test_plays_of_a_batch_change_the_stored_tracks_once(spark, tmp_path):
    path = f"file://{tmp_path}/live"
    live.start(spark.createDataFrame([(1, "a", 4, False, False, None, "1990"), (2, "b", 0, False, False, None, "1990")], TRACK), LISTS, NOW, path, 2)
    counts = spark.createDataFrame([(1, 3, at(1)), (77, 1, at(1))], "track_id long, plays long, last_played timestamp")
    for _ in range(2):
        live.apply_changes(spark, path, live.played(spark, path, counts), LISTS, NOW, 0)
    assert rows_of(buckets.current(spark, f"{path}/tracks"), "id", "play_count") == {(1, 7), (2, 0)}
    assert dict(rows_of(live.counts(spark, path, LISTS), "playlist", "n"))["Most"] == 1


# --- merging ---


def test_chains_of_losers_end_at_the_last_winner(spark):
    mapping = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(5, 5), (1, 90)], "loser long, winner long")
    assert {r.winner for r in merge.final_winners(mapping).collect()} == {40} and merge.final_winners(mapping).count() == 39
    with pytest.raises(ValueError, match="leads back"):
        merge.final_winners(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "loser long, winner long"))
    artists = spark.createDataFrame([(i, f"N{i}", f"n{i}", None if i < 3 else f"img{i}") for i in (1, 2, 3)], "artist_id long, name string, normalized_name string, image string")
    bridge = spark.createDataFrame([(10, 1, "artist", 0), (11, 3, "artist", 0)], "track_id long, artist_id long, role string, position int")
    on = spark.createDataFrame([(1, 1, "primary", 0)], "album_id long, artist_id long, role string, position int")
    out = merge.merge_artists(artists, bridge, on, spark.createDataFrame([(1, 2), (2, 3)], "loser long, winner long"))
    assert rows_of(out["track_artists"], "track_id", "artist_id") == {(10, 3), (11, 3)} and rows_of(out["artists"], "artist_id") == {(3,)}
    assert rows_of(out["aliases"], "alias", "canonical") == {("n1", "N3"), ("n2", "N3")}
    albums = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "album_id long, title string")
    t = spark.createDataFrame([(1, 1, "A"), (2, 2, "B")], "id long, album_id long, album string")
    out = merge.merge_albums(albums, t, on, spark.createDataFrame([(1, 2), (2, 3)], "loser long, winner long"))
    assert rows_of(out["tracks"], "id", "album_id", "album") == {(1, 3, "C"), (2, 3, "C")}


def test_names_can_be_swapped(spark):
    artists = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "artist_id long, name string, normalized_name string")
    bridge = spark.createDataFrame([(10, 1, "artist", 0), (11, 2, "artist", 0), (12, 3, "artist", 0)], "track_id long, artist_id long, role string, position int")
    renames = spark.createDataFrame([(1, "B"), (2, "A"), (3, "b")], "winner long, new_name string")
    out = merge.merge_artists(artists, bridge, bridge.withColumnRenamed("track_id", "album_id"), spark.createDataFrame([], "loser long, winner long"), renames=renames)
    assert rows_of(out["artists"], "artist_id", "name") == {(1, "B"), (2, "A")} and rows_of(out["track_artists"], "track_id", "artist_id") == {(10, 1), (11, 2), (12, 1)}


# --- albums ---


@pytest.mark.parametrize("seed", range(3))
def test_a_common_title_spreads_and_folds_as_in_order(spark, seed, monkeypatch):
    monkeypatch.setattr(ingest, "RANGES", 8)
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    rows = [(i, "Hits", rng.choice([None, None, *names]), rng.random() < 0.1, [] if rng.random() < 0.1 else rng.sample(names, rng.randint(1, 3))) for i in range(150)]
    # A chain in which each album artist is named by the one before.
    rows += [(1000 + i, "Hits", f"c{i}", False, [f"c{i}", f"c{i + 1}"]) for i in range(20)]
    links, albums, members = ingest.resolve_albums(spark.createDataFrame(rows, "id long, album string, album_artist string, compilation boolean, credits array<string>"))
    seen, expected, known = [], {}, {}
    for i, _, tag, comp, credits in rows:
        artist = (tag or ("Various Artists" if comp else credits[0] if credits else None) or "").lower() or None
        if (again := (artist, tuple(credits))) in known:
            expected[i] = known[again]
            continue
        at = next((a for a in seen if artist is None or artist in a[1]), None)
        if at is None:
            at = (i, {artist: "primary"} if artist else {})
            seen.append(at)
        for n in credits:
            at[1].setdefault(n, "featured" if at[1] else "primary")
        expected[i] = known[again] = at[0]
    made = {r.album_id: r.made_by for r in albums.collect()}
    assert {r.id: made[r.album_id] for r in links.collect()} == expected
    assert rows_of(members.withColumn("of", F.create_map(*[x for a, m in made.items() for x in (F.lit(a), F.lit(m))])[F.col("album_id")]), "of", "normalized_name", "role", "position") == {(a, n, r, p) for a, m in seen for p, (n, r) in enumerate(m.items())}


# --- folders ---


def test_tree_fingerprints_point_at_what_changed(spark):
    rows = [(f"/m/{a}/{b}", f"/m/{a}/{b}/{i}.mp3", 1.0, i) for a in "xy" for b in "pq" for i in range(3)] + [("/m/x", "/m/x/cover.jpg", 2.0, 9)]
    schema = "folder string, path string, mtime double, size long"
    before = ingest.tree_fingerprint(spark.createDataFrame(rows, schema))
    same = ingest.tree_fingerprint(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema).repartition(5))
    assert ingest.changed_subtrees(same, before).count() == 0
    rows[0] = (*rows[0][:2], 1.5, rows[0][3])
    assert rows_of(ingest.changed_subtrees(ingest.tree_fingerprint(spark.createDataFrame(rows, schema)), before), "folder") == {("/m/x/p",), ("/m/x",), ("/m",)}


def test_folder_fingerprints_hash_all_files_in_order_of_path(spark):
    files = [(f"/m/{a}", f"/m/{a}/é{i}.{'mp3' if i % 9 else 'jpg'}", 10 * i, i) for a, n in (("x", 700), ("y", 1), ("z", 129)) for i in range(n)] + [(None, "b.mp3", 1, 2), (None, "a.mp3", 3, 4)]
    others = [("/m/x", "/m/x/notes.txt", 1, 1), ("/m/empty", "/m/empty/notes.txt", 1, 1), ("/m/none", None, None, None)]
    mixed = random.Random(2).sample(files + others, len(files + others))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = {(f, sha("".join(sha(f"{p}|{m}|{s}") for g, p, m, s in sorted(files, key=lambda r: r[1]) if g == f))) for f in {r[0] for r in files}}
    made = ingest.folder_fingerprint(spark.createDataFrame(mixed, "folder string, path string, mtime long, size long").repartition(5))
    assert rows_of(made, "folder", "hash") == expected | {("/m/empty", None), ("/m/none", None)} and made.count() == 6


# --- search ---


def test_short_lists_equal_the_head_of_the_full_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 2)
    rng = random.Random(4)
    words = ["rock", "rocket", "róck", "blue", "blues", "moon", "sun", "a.b", "night-train"]
    rows = [(i, " ".join(rng.choices(words, weights=[8, 3, 2, 6, 3, 5, 2, 1, 1], k=rng.randint(1, 30))), rng.choice(["x y", "moon", None])) for i in range(600)] + [(None, "rock", "x"), (601, None, None)]
    index = search.write_index(spark.createDataFrame(rows, "id long, title string, artist string"), f"file://{tmp_path}/i", ("title", "artist"))
    shown = spark.createDataFrame([(i,) for i in range(0, 600, 2)], "id long")
    for text in ("roc blu", "a.b", "moon sun rocket", "absent rock", "night-train"):
        full = [(r.id, round(r.score, 9)) for r in search.search(index, text).collect()]
        if text == "roc blu":
            assert [(r.id, round(r.score, 9)) for r in search.top(index, text, 7).collect()] == full[:7]
        assert full or text == "absent rock"
        assert [(r.id, round(r.score, 9)) for r in search.top(index, text, 5, shown).collect()] == [x for x in full if x[0] < 600 and x[0] % 2 == 0][:5], text
    trains = {i for i, t, _ in rows if i is not None and "night-train" in (t or "")}
    assert trains and {r.id for r in search.search(index, "night-train").collect()} >= trains
    assert {r.token: (r.docs, r.occurrences) for r in index.terms.collect()}["sun"] == (sum("sun" in (t or "").split() for _, t, _ in rows), sum((t or "").split().count("sun") for _, t, _ in rows))


def test_a_search_reads_the_ranges_it_names(spark, tmp_path):
    index = search.write_index(spark.createDataFrame([(i, f"w{i % 50} common") for i in range(500)], "id long, title string"), f"file://{tmp_path}/i", ("title",))
    plan = search._hits(index.postings, search.parse_query("w7 common"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "StringStartsWith(token,w7)" in plan
