"""Facts that operators must keep, on small rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions import text as T
from cadenza.operators import audio, graph, ingest, lyrics, merge, playlists, rules, search, similar, tables
from cadenza.streaming import plays


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(("version", "expected"), [("Extended Mix", "extended"), ("Club Mix", "extended"), ("Radio Edit", "radioEdit"), ("single version", "radioEdit"), ("D.O.N.S. Remix", "remix"), (None, "original"), ("", "original"), ("dub", "other")])
def test_mix_class(spark, version, expected):
    assert one(spark, S.mix_class, version) == expected


@pytest.mark.parametrize(("genre", "expected"), [
    ("Eurodance", "dance"), ("Euro House", "dance"), ("Electronic", "dance"), ("Happy Hardcore", "dance"), ("Dance,Música,Rock,Electrónica", "dance"), ("Pop/Rock*", "rock"),
    ("Pop", "pop"), ("Hip Hop", "hiphop"), ("Schlager", "schlager"), ("Classical", "classical"), (None, None), ("", None), ("Unknown Genre", None), ("Género desconocido", None)])
def test_genre_family(spark, genre, expected):
    assert one(spark, S.genre_family, genre) == expected


@pytest.mark.parametrize(("title", "expected"), [
    ("Another Night (House mix)", "House mix"), ("Can U Feel It (Dee Ooh La La La) (radio edit)", "radio edit"), ("Bar [Club Mix]", "Club Mix"), ("Tune (Quick Remix)", "Quick Remix"), ("Carry On", None),
    ("100% positiv", None), ("Track (Dee Ooh La La La)", None), ("Song (feat. Someone)", None), ("A (live (club) mix) (x)", "live club mix"), ("B (mix", None), ("C (a (b [c] (Dub)) d) e", "a b c Dub d"), ("D (x (club mix)", None), ("E) (Edit] [ Re-Edit )", "Re-Edit"), (None, None), ("", None), ("F (mixes)", None)])
def test_mix_version(spark, title, expected):
    assert one(spark, T.mix_version, title) == expected


@pytest.mark.parametrize(("name", "expected"), [("J. Cole", "jcole"), ("A Tribe Called Quest", "atribe called quest"), ("Jay - Z", "jay-z"), ("  The   Who ", "the who"), ("M.C. Sar", "mcsar")])
def test_artist_key(spark, name, expected):
    assert one(spark, S.normalize_artist_name, name) == expected


def test_years_and_durations(spark):
    assert one(spark, S.year_from_mb_date, "119930") == 1993 and one(spark, S.year_from_mb_date, "12") is None
    assert one(spark, S.year_from_date, "released 1899, 2004-01") == "2004" and one(spark, S.year_from_date, "x") is None
    assert [one(spark, S.parse_duration, t) for t in ("1:02:03", "2:05", "45", "a:1", "1:2:3:4", "")] == [3723, 125, 45, None, None, None]
    assert one(spark, S.leading_year, " 1999-05") == 1999 and one(spark, S.leading_year, "abcd") is None
    assert [one(spark, S.normalize_rating, r, "int") for r in (None, 0, 3, 31, 95, 159, 223, 255)] == [None, None, 3, 1, 2, 3, 4, 5]


def credits(spark, text, known=None):
    df = spark.createDataFrame([(1, text)], "id int, artist string")
    k = spark.createDataFrame([(n,) for n in known], "name string") if known else None
    return [r.artist for r in ingest.split_credits(df, "artist", k).orderBy("position").collect()]


@pytest.mark.parametrize(("text", "known", "expected"), [
    ("A feat. B", None, ["A", "B"]), ("A & B", None, ["A", "B"]), ("A & B", ["a & b"], ["A & B"]), ("A & B & C", ["A & B"], ["A & B", "C"]), ("AC/DC", None, ["AC/DC"]), ("AC/DC", ["AC/DC"], ["AC/DC"]),
    ("AC/DC", ["x"], ["AC", "DC"]), ("X, X", None, ["X"]), ("", None, ["Unknown Artist"]), (None, None, ["Unknown Artist"]), ("Q FT. R; S", None, ["Q", "R", "S"])])
def test_split_credits(spark, text, known, expected):
    assert credits(spark, text, known) == expected


def plain_normal(name):
    import re

    low = re.sub(r"\b([a-z])\.? *", r"\1", name.lower())
    for a, b in ((" - ", "-"), (" -", "-"), ("- ", "-")):
        low = low.replace(a, b)
    return re.sub(r"\s+", " ", low).strip()


def plain_split(text, known):
    """All runs of a credit against the list, the longest first."""
    import re

    if plain_normal(text) in known and plain_normal(text):
        return [text.strip(" ")]
    for s in ingest.SURE:
        text = re.sub(re.escape(s), "\x01", text, flags=re.I)
    out = []
    for part in filter(None, map(str.strip, text.split("\x01"))):
        names, seps, at, i = [], [], 0, 0
        order = sorted(ingest.UNSURE, key=len, reverse=True)
        while i < len(part):
            hit = next((s for s in order if part.lower().startswith(s.lower(), i)), None)
            if hit:
                names.append(part[at:i])
                seps.append(part[i : i + len(hit)])
                at = i + len(hit)
            i += len(hit) if hit else 1
        names.append(part[at:])
        run = lambda a, b: names[a] + "".join(seps[k - 1] + names[k] for k in range(a + 1, b + 1))
        i = 0
        while i < len(names):
            j = next((j for j in range(len(names) - 1, i, -1) if plain_normal(run(i, j)) in known), i)
            out.append(run(i, j))
            i = j + 1
    best = {}
    for n in filter(None, map(str.strip, out)):
        key = plain_normal(n)
        best[key] = n if key not in best or len(n) > len(best[key]) else best[key]
    best.pop(plain_normal(S.UNKNOWN_ARTIST), None)
    return list(best.values()) or [S.UNKNOWN_ARTIST]


def test_known_names_are_found_as_by_trying_all_runs(spark):
    rng = random.Random(8)
    words = ["a", "B", "j.", "Cole", "simon", "Garfunkel", "the", "AC", "DC", "x", "and", "- ", "Tyler"]
    seps = [" & ", " and ", " x ", ", ", "/", " / ", " vs. ", " with ", " feat. ", ";", " "]
    make = lambda n: "".join(rng.choice(words) + (rng.choice(seps) if i < n - 1 else "") for i in range(n))
    names = [make(rng.randint(1, 5)) for _ in range(150)]
    texts = list({make(rng.randint(1, 9)) for _ in range(200)} | {f"{a}{s}{b}" for a, b, s in zip(names, names[1:], seps * 20, strict=False)}) + ["", " & "]
    known = {plain_normal(n) for n in names} - {""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, artist string")
    got = {}
    for r in ingest.split_credits(df, "artist", spark.createDataFrame([(n,) for n in names], "name string")).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.artist)
    assert {texts[i]: n for i, n in got.items()} == {t: plain_split(t, known) for t in texts}


def test_duplicates(spark):
    rows = [(1, "T", 11.1, "mp3"), (2, "t ", 12.9, "flac"), (3, "T", 13.1, "mp3"), (4, "", 0.0, "mp3"), (5, "", 0.0, "mp3")]
    df = spark.createDataFrame([(i, t, "A", "B", "1990", d, f, 128) for i, t, d, f in rows], "id int, title string, artist string, album string, year string, duration double, format string, bitrate int")
    out = {r.id: (r.is_duplicate, r.primary_track_id) for r in ingest.mark_duplicates(df).collect()}
    assert out == {1: (True, 2), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, 4)}


def test_albums_fold_as_a_sequential_pass_does(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Greatest Hits", "The Hits", "Hits", "X"]), rng.choice([None, "", "A", "B"]), rng.random() < 0.1, rng.sample(["A", "B", "C", "D"], rng.randint(1, 3))) for i in range(300)]
    links, albums, members = ingest.resolve_albums(spark.createDataFrame(rows, "id long, album string, album_artist string, compilation boolean, credits array<string>"))
    got = {r.id: r.album_id for r in links.collect()}
    seen, expected, known = [], {}, {}
    norm = lambda t: t.lower().replace("the ", "").strip()
    for i, album, tag, comp, names in rows:
        artist = (tag or None) or ("Various Artists" if comp else names[0])
        if (again := (norm(album), artist, tuple(names))) in known:
            expected[i] = known[again]
            continue
        at = next((a for a in seen if a[0] == norm(album) and artist.lower() in a[1]), None)
        if at is None:
            at = (norm(album), {artist.lower(): "primary"})
            seen.append(at)
        for n in names:
            at[1].setdefault(n.lower(), "featured")
        expected[i] = known[again] = next(j for j, a in enumerate(seen) if a is at)
    assert len({(got[i], expected[i]) for i in got}) == len(set(got.values())) == len(set(expected.values())) == albums.count()
    made = {(r.album_id, r.normalized_name): r.role for r in members.collect()}
    assert all(made[(got[i], n)] == role for i in got for n, role in seen[expected[i]][1].items())


def test_scan_diff_boundary(spark):
    a = spark.createDataFrame([("a", 11.0), ("b", 11.1), ("c", 1.0)], "path string, mtime double")
    b = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", None), ("d", 1.0)], "path string, mtime double")
    assert {r.path: r.status for r in ingest.scan_diff(a, b).collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "deleted"}


NOW = dt.datetime(2024, 1, 10, tzinfo=dt.UTC)


@pytest.mark.parametrize(("field", "condition", "value", "expected"), [
    ("duration", "equals", "3", [2]), ("year", "greaterThan", "0", [1]), ("year", "lessThan", "2000", [1]), ("title", "contains", "a%c", [1]), ("title", "notContains", "b", [2, 3]),
    ("bitrate", "greaterThan", "nope", [1, 2, 3]), ("colour", "equals", "x", [1, 2, 3]), ("last_played", "greaterThan", "7days", [2]), ("last_played", "lessThan", "2024-01-02", [1]), ("is_favorite", "equals", "true", [3])])
def test_rules(spark, field, condition, value, expected):
    day = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    df = spark.createDataFrame([(1, "abC", 2.5, "1990", 128, day, False, False), (2, "x", 3.7, "Unknown Year", 64, day + 6 * 86400, False, False), (3, None, None, "", None, None, True, False)],
                               "id int, title string, duration double, year string, bitrate int, last_played long, is_favorite boolean, is_duplicate boolean")
    found = rules.evaluate(df, {"rules": [{"field": field, "condition": condition, "value": value}]}, NOW)
    assert sorted(r.id for r in found.collect()) == expected


def test_import_variants(spark):
    tracks = spark.createDataFrame([(1, "/Volumes/Disk/a b.mp3"), (2, "/music/x+y.mp3"), (3, "/m/one/Same.mp3"), (4, "/m/two/same.mp3"), (5, "/deep/Only.MP3")], "id long, path string")
    lines = ["file:///Volumes/Disk/a%20b.mp3", "smb://host/Disk/a b.mp3", "//Disk/a b.mp3", "x+y.mp3", "x%2By.mp3", "C:\\old\\same.mp3", "D:\\old\\only.mp3", "bad%zz.mp3"]
    entries = spark.createDataFrame([("l", "/music", i, e) for i, e in enumerate(lines)], "playlist string, base string, ordinal int, entry string")
    out = {r.ordinal: (r.track_id, r.how) for r in playlists.match_import(entries, tracks).collect()}
    assert out == {0: (1, "path"), 1: (1, "path"), 2: (1, "path"), 3: (2, "path"), 4: (2, "path"), 5: (None, None), 6: (5, "filename"), 7: (None, None)}


def fps(spark, rows):
    names = ("track_id", "title", "artist", "genre", "year", "duration_seconds", "bpm", "bpm_confidence", "rms_loudness_db", "dynamic_range_db", "spectral_brightness_hz", "bass_ratio", "beat_regularity", "mix_version", "artist_id")
    base = dict(zip(names, (0, "t", "A", None, 1995, 300.0, 130.0, 0.8, -12.0, 6.0, 1200.0, 0.3, None, None, None), strict=True))
    schema = "track_id long, title string, artist string, genre string, year int, duration_seconds double, bpm double, bpm_confidence double, rms_loudness_db double, dynamic_range_db double, spectral_brightness_hz double, bass_ratio double, beat_regularity double, mix_version string, artist_id string"
    return spark.createDataFrame([tuple((base | {"track_id": i} | r)[n] for n in names) for i, r in enumerate(rows)], schema)


def neighbours(spark, rows, **how):
    df = fps(spark, rows)
    return {r.neighbour: r.distance for r in similar.similar_tracks(df, df.where("track_id = 0").select(F.col("track_id").alias("id")), **how).collect()}


def test_hub_is_dropped(spark):
    rows = [{"bpm": 100.0}, {"bpm": 101.0}, {"bpm": 130.0}] + [{"bpm": 130 + 0.02 * i} for i in range(1, 31)]
    found = neighbours(spark, rows, limit=100)
    assert 1 in found and 2 not in found


def test_artist_majority_and_own_tag(spark):
    rows = [{"genre": "Pop", "artist": "P"}, {"genre": "Pop", "artist": "Q"}, {"artist": "D"}] + [{"genre": "Dance", "artist": "D"}] * 3 + [{"genre": "Pop", "artist": "d"}]
    found = neighbours(spark, rows)
    assert found[2] - found[1] == pytest.approx(2.0) and found[6] == pytest.approx(0.0)
    tied = neighbours(spark, [{"genre": "Pop", "artist": "P"}, {"artist": "M"}, {"genre": "Dance", "artist": "M"}, {"genre": "Pop", "artist": "M"}])
    assert tied[1] == pytest.approx(0.0)
    named = neighbours(spark, [{"genre": "Pop", "artist": "P"}, {"artist": "One", "artist_id": "m"}, {"genre": "Dance", "artist": "Two", "artist_id": "m"}])
    assert named[1] == pytest.approx(2.0)


def test_similar_all_equals_all_pairs(spark):
    rng = random.Random(3)
    pick = lambda a, b: rng.uniform(a, b)
    rows = [{"year": rng.choice([None, 1980, 1984, 1990, 1995, 2001]), "duration_seconds": pick(100, 500), "bpm": rng.choice([None, pick(90, 150)]), "rms_loudness_db": pick(-20, -5), "dynamic_range_db": pick(2, 10), "spectral_brightness_hz": pick(500, 2000),
             "bass_ratio": pick(0.1, 0.6), "beat_regularity": rng.choice([None, pick(0, 1)]), "mix_version": rng.choice([None, "Club Mix", "Radio Edit"]), "genre": rng.choice([None, "Pop", "Rock"]), "artist": rng.choice("ABC")} for _ in range(160)]
    df = fps(spark, rows)
    packed = similar.prepare(df)
    x = packed.select(F.struct(*packed.columns).alias("x"))
    every = x.withColumnRenamed("x", "l").crossJoin(x.withColumnRenamed("x", "r")).where("l.id <> r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), similar.track_distance("l", "r").alias("d")).toPandas()
    near = every[every.d <= 3.5]
    near = near.assign(closer=near.groupby("a").d.rank(method="min"))
    kept = near[near.closer <= 10].sort_values(["b", "d", "a"]).groupby("b").head(7)
    got = similar.similar_tracks_all(df, limit=7, mutual_k=10).collect()
    assert {(r.anchor, r.neighbour) for r in got} == set(zip(kept.b, kept.a, strict=True))
    asked = similar.similar_tracks(df, df.where("track_id < 20").select(F.col("track_id").alias("id")), limit=7, mutual_k=10).where("neighbour is not null").collect()
    assert {(r.anchor, r.neighbour) for r in asked} == {(a, b) for a, b in zip(kept.b, kept.a, strict=True) if a < 20}


def test_walks_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "x", "recording"), ("b", "a", "x", "recording"), ("rec", "rel", "appears on", "release"), ("rec", "mix", "remix of", "recording"), ("rel", "grp", "release of", "group")], "source_mbid string, target_mbid string, relation string, target_kind string")
    go = lambda m, d: graph.walk(edges, spark.createDataFrame([(m,)], "mbid string"), d)
    assert go("a", 10).count() == 2 and go("rec", 1).count() == 2
    assert {(r.depth, r.target_mbid) for r in go("rec", 2).collect()} == {(1, "rel"), (1, "mix"), (2, "grp")}


def test_merged_nodes_keep_what_was_known(spark):
    rows = [(1, "m", "release", "Maxi", None, None), (2, "m", "unknown", "Maxi", 1993, "Logic"), (3, "m", "release", "Maxi (Reissue)", None, None)]
    out = graph.merge_nodes(spark.createDataFrame(rows, "seq int, mbid string, kind string, title string, year int, label string")).first()
    assert (out.kind, out.title, out.year, out.label) == ("release", "Maxi (Reissue)", 1993, "Logic")


def test_aliases_flatten(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(20)]
    assert {r.canonical for r in merge.flatten_aliases(spark.createDataFrame(rows, "alias string, canonical string")).collect()} == {"n20"}


def test_search_ands_prefixes_and_phrases(spark, tmp_path):
    rows = [(1, "Héllo World"), (2, "world hello"), (3, "Hello there"), (4, None)]
    index = search.write_index(spark.createDataFrame(rows, "id int, title string"), f"file://{tmp_path}/index", ("title",))
    ids = lambda q: {r.id for r in search.search(index, q).collect()}
    assert ids("hel wor") == {1, 2} and ids('"hello-world"') == {1} and ids("hello.wor") == {1} and ids("h") == set() and ids("HELLO") == {1, 2, 3}


def test_lyrics(spark):
    text = "[ti:x]\r\n[00:10.5][00:01.50]<00:01>la  la\r\nplain\r\n[01:00]end"
    out = [(r.start, r.end, r.line) for r in lyrics.lrc_lines(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("start").collect()]
    assert out == [(1.5, 10.5, "la la"), (10.5, 60.0, "la la"), (60.0, None, "end")]
    srt = "1\n00:00:01,000 --> 00:00:02,500\nfirst\nsecond\n\n2\nshort\n\n3\nbad time\nx"
    assert [(r.start, r.end, r.line) for r in lyrics.srt_lines(spark.createDataFrame([(1, srt)], "id int, text string")).collect()] == [(1.0, 2.5, "first\nsecond")]


RATE = 11025.0


def clicks(bpm, seconds=30):
    x = np.zeros(int(RATE * seconds), np.float32)
    decay = np.exp(-np.arange(400) / 60) * np.sin(2 * np.pi * 1000 * np.arange(400) / RATE)
    for t in np.arange(0, seconds, 60 / bpm):
        a = int(t * RATE)
        x[a : a + 400] += decay[: len(x) - a][:400]
    return x


@pytest.mark.parametrize("bpm", [80, 90, 100, 120, 130, 140, 150, 160])
def test_tempo(bpm):
    found, sure = audio.tempo_of(clicks(bpm), RATE)
    assert abs(found - bpm) < 1.5 and sure > 0.3


def test_axes():
    t = np.arange(int(RATE * 5)) / RATE
    low, high = (np.sin(2 * np.pi * f * t).astype(np.float32) for f in (80, 3000))
    a, b = audio.axes_of(low, RATE), audio.axes_of(high, RATE)
    assert a[2] < 500 and a[3] > 0.7 and b[2] > 2000 and b[3] < 0.1
    assert audio.axes_of(0.1 * low, RATE)[0] == pytest.approx(a[0] - 20, abs=0.1) and a[1] < 2
    halves = low * np.where(t < 2.5, 0.05, 1.0).astype(np.float32)
    assert audio.axes_of(halves, RATE)[1] > 5
    assert audio.tempo_of(np.zeros(int(RATE * 10), np.float32), RATE) == (None, None) == audio.tempo_of(low[:256], RATE) and audio.axes_of(low[:256], RATE) == (None,) * 4


def test_steady_beats_are_more_regular():
    rng = np.random.default_rng(1)
    loose = np.zeros(int(RATE * 30), np.float32)
    for a in rng.integers(0, len(loose) - 400, 65):
        loose[a : a + 400] += np.exp(-np.arange(400) / 60)
    steady = audio.beat_of(clicks(130), RATE)
    assert steady > 0.3 and steady > audio.beat_of(loose, RATE)


def test_features_of_null_signals(spark):
    df = spark.createDataFrame([(1, RATE, None), (2, RATE, [0.0] * 10)], "track_id long, sample_rate double, samples array<float>")
    assert {tuple(r)[1:] for r in audio.audio_features(df).collect()} == {(None,) * 7}




def plain_flux(x, size, hop, bins, root):
    """The rise of each frame's inner bins over the frame before, one bin at a time; the first frame rises from nothing."""
    window = [0.5 * (1 - np.cos(2 * np.pi * i / size)) for i in range(size)]
    before, out = np.zeros(size // 2), []
    for a in range(0, len(x) - size + 1, hop):
        now = np.abs(np.fft.fft(np.array(x[a : a + size], float) * window))
        rises = [max(0.0, now[b] - before[b]) for b in range(1, bins + 1)]
        out.append(sum(r * r for r in rises) ** 0.5 if root else sum(rises))
        before = now
    return out


def plain_correlation(f, lag):
    c = [v - sum(f) / len(f) for v in f]
    return sum(c[i] * c[i + lag] for i in range(len(c) - lag))


@pytest.mark.parametrize("offset", [0.0, 0.3])
def test_audio_features_equal_plain_sums(offset):
    rng, rate = np.random.default_rng(3), 8000.0
    x = (0.2 * rng.standard_normal(int(rate * 6)) * (np.arange(int(rate * 6)) % 4400 < 900) + offset).astype(np.float32)
    weight = total = low = 0.0
    window = [0.5 * (1 - np.cos(2 * np.pi * i / 1024)) for i in range(1024)]
    for a in range(0, len(x) - 1023, 512):
        m = np.abs(np.fft.fft(x[a : a + 1024].astype(float) * window))
        for b in range(1, 512):
            weight, total, low = weight + b * rate / 1024 * m[b], total + m[b], low + (m[b] if b <= 26 else 0)  # 200 Hz is 25.6 bins
    loud, dynamics, centroid, bass = audio.axes_of(x, rate)
    levels = [20 * np.log10(max(1e-12, np.sqrt(np.mean(x[a : a + 400].astype(float) ** 2)))) for a in range(0, len(x) - 399, 400)]
    levels = [v for v in levels if v > -60]
    assert (centroid, bass) == (pytest.approx(weight / total, rel=1e-6), pytest.approx(low / total, rel=1e-6))
    assert dynamics == pytest.approx(np.std(levels), rel=1e-6) and loud == pytest.approx(20 * np.log10(np.sqrt(np.mean(x.astype(float) ** 2))), rel=1e-6)
    f = plain_flux(x, 2048, 1024, 1023, True)
    energy = plain_correlation(f, 0)
    assert audio.beat_of(x, rate) == pytest.approx(max(0, max(plain_correlation(f, lag) / energy for lag in range(7, len(f)))), rel=1e-6)
    for band, bins in ((None, 511), (250.0, 32)):
        f = plain_flux(x, 1024, 128, bins, False)
        raw = {lag: plain_correlation(f, lag) / (len(f) - lag) if lag else 0.0 for lag in range(19, 56)}
        score = {lag: raw[lag] * np.exp(-0.5 * (np.log2(3750 / lag / 128) / 0.9) ** 2) for lag in range(20, 55)}
        at = max(score, key=lambda lag: (score[lag], -lag))
        shift = 0.5 * (raw[at - 1] - raw[at + 1]) / (raw[at - 1] - 2 * raw[at] + raw[at + 1])
        bpm, sure = audio.tempo_of(x, rate, band=band)
        assert bpm == pytest.approx(3750 / (at + max(-1, min(1, shift))), rel=1e-6) and sure == pytest.approx(min(1, max(0, raw[at] / (plain_correlation(f, 0) / len(f)))), rel=1e-6)


def test_silence_has_no_tempo_and_no_beat():
    x = np.zeros(int(RATE * 10), np.float32)
    assert audio.beat_of(x, RATE) == 0.0 and audio.beat_of(x[:2048], RATE) is None and audio.axes_of(x, RATE) == (-60.0, 0.0, 0.0, 0.0)
    assert abs(audio.tempo_of(clicks(180), RATE)[0] - 180) < 5 and abs(audio.tempo_of(clicks(140), RATE, 70, 140)[0] - 140) < 5  # a peak at an end of the band


def test_late_favourite_does_not_win(spark, tmp_path):
    events = lambda rows: spark.createDataFrame(rows, "event_id long, ts timestamp, track_id long, stop_reason string, favourite boolean")
    day = lambda n: dt.datetime(2024, 1, n)
    plays.favourite_changes(events([(1, day(5), 7, "user", True), (2, day(4), 8, "user", False)])).write.parquet(f"{tmp_path}/out/batch=0")
    plays.favourite_changes(events([(3, day(1), 7, "user", False), (4, day(6), 8, "user", True)])).write.parquet(f"{tmp_path}/out/batch=1")
    assert {r.track_id: r.is_favorite for r in plays.latest_favourites(spark, f"{tmp_path}/out").collect()} == {7: True, 8: True}


def test_white_space_of_any_kind_is_trimmed(spark):
    df = spark.createDataFrame([(1, "T", 11.0), (2, "T\t", 11.0), (3, " t\n", 11.0)], "id int, title string, duration double").selectExpr("*", "'A' as artist", "'B' as album", "'1990' as year", "'mp3' as format", "128 as bitrate")
    assert ingest.mark_duplicates(df).where("duplicate_group_id is not null").count() == 3
    assert credits(spark, "A\t;\nB ") == ["A", "B"]


LIBRARY = [
    (1, "A feat. B", "One", None, None, False), (2, "B", "One", None, "C", False), (3, "A", "One ", "A", "", False), (4, "Old A", "Two", None, None, False), (5, "X", "Mix", "", None, True), (6, "Y", "Mix", None, None, True),
    (7, "Unknown Artist", "One", None, "Unknown Composer", False), (8, None, None, None, None, False), (9, "Z", "Gone", "Z", None, False)]


def test_rebuild_from_tags(spark):
    tracks = spark.createDataFrame([(*r, r[0] == 9) for r in LIBRARY], "id long, artist string, album string, album_artist string, composer string, compilation boolean, is_duplicate boolean")
    known = spark.createDataFrame([("old a", "A")], "alias string, canonical string")
    moved = spark.createDataFrame([("two|a", "One", "A")], "alias string, title string, artist string")
    pins = spark.createDataFrame([(1, 77, None, " a"), (2, 78, None, "Nobody"), (3, None, 5, "MIX"), (4, None, None, None)], "pin_id int, artist_id long, album_id long, value string")
    out = ingest.rebuild_associations(tracks, aliases=known, album_aliases=moved, pins=pins)
    artists = {r.name: r for r in out["artists"].collect()}
    # A leads tracks 1, 3 and, by its alias, 4; B is a guest of 1 and owns 2, whose album already lists it.
    assert {n: (r.total_tracks, r.total_albums) for n, r in artists.items()} == {"A": (3, 1), "B": (2, 1), "C": (0, 0), "X": (1, 1), "Y": (1, 1), "Various Artists": (0, 1)}
    album = {r.id: r.album_id for r in out["tracks"].collect()}
    assert album[1] == album[2] == album[3] == album[4] == album[7] and album[5] == album[6] != album[1] and album[8] is None and 9 not in album
    assert {(r.title, r.total_tracks) for r in out["albums"].collect()} == {("One", 5), ("Mix", 2)}
    names = {r.artist_id: n for n, r in artists.items()}
    assert {(r.track_id, names[r.artist_id], r.role, r.position) for r in out["track_artists"].collect()} == {
        (1, "A", "artist", 0), (1, "B", "artist", 1), (2, "B", "artist", 0), (2, "C", "composer", 0), (3, "A", "artist", 0), (3, "A", "album_artist", 0), (4, "A", "artist", 0), (5, "X", "artist", 0), (6, "Y", "artist", 0)}
    assert {(names[r.artist_id], r.role) for r in out["album_artists"].where(f"album_id = {album[5]}").collect()} == {("Various Artists", "primary"), ("X", "featured"), ("Y", "featured")}
    assert {r.pin_id: r.artist_id or r.album_id for r in out["pins"].collect()} == {1: artists["A"].artist_id, 3: album[5], 4: None}
    empty = ingest.rebuild_associations(tracks.where("false"))
    assert all(empty[t].count() == 0 for t in ("artists", "albums", "track_artists", "album_artists"))


def test_orphans_of_every_table(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    before = {
        "artists": make([(1, "a"), (2, "b")], "artist_id long, name string"), "albums": make([(1,), (2,)], "album_id long"), "track_artists": make([(1, 1), (9, 2)], "track_id long, artist_id long"),
        "album_artists": make([(1, 1), (2, 2)], "album_id long, artist_id long"), "genres": make([(1,), (2,)], "genre_id long"), "track_genres": make([(1, 1), (9, 2)], "track_id long, genre_id long"),
        "playlist_tracks": make([(5, 1), (5, 9)], "playlist_id long, track_id long"), "pins": make([(1, 1, None, None), (2, 2, None, None), (3, None, 2, None), (4, None, None, 5), (5, None, None, 6)], "pin_id int, artist_id long, album_id long, playlist_id long")}
    after = ingest.drop_orphans(make([(1, 1), (2, None)], "id long, album_id long"), playlists=make([(5,)], "playlist_id long"), **before)
    assert {r["name"]: r.deleted for r in ingest.deleted_counts(before, after).collect()} == {"artists": 1, "albums": 1, "track_artists": 1, "album_artists": 1, "genres": 1, "track_genres": 1, "playlist_tracks": 1, "pins": 3}
    assert {r.pin_id for r in after["pins"].collect()} == {1, 4}


def test_artwork_and_totals_of_albums(spark):
    t = spark.createDataFrame([(1, 1, "a", "1990", 9, None), (2, 1, None, "x", None, 2), (3, None, "c", None, 3, 3), (4, 2, "d", "1985-02", 4, 1)], "id int, album_id int, artwork_ref string, year string, track_total int, disc_total int")
    assert {r.id: r.artwork_ref for r in ingest.shown_artwork(t, spark.createDataFrame([(1, "cover")], "album_id int, artwork_ref string")).collect()} == {1: "cover", 2: "cover", 3: "c", 4: "d"}
    old = spark.createDataFrame([(1, 5, None), (2, 8, 1)], "album_id int, total_tracks int, total_discs int")
    assert {(r.album_id, r.release_year, r.total_tracks, r.total_discs) for r in ingest.fill_album_metadata(t, old).collect()} == {(1, 1990, 9, None), (2, 1985, 8, 1)}


def test_merging_with_new_names(spark):
    artists = spark.createDataFrame([(1, "Win", "win", None), (2, "Lose", "lose", "img"), (3, "Taken", "taken", None), (4, "Unknown Artist", "unknown artist", None)], "artist_id long, name string, normalized_name string, image string")
    bridge = spark.createDataFrame([(1, 1, "artist", 0), (1, 2, "artist", 1), (2, 3, "artist", 0)], "track_id long, artist_id long, role string, position int")
    on = spark.createDataFrame([(1, 1, "primary", 0), (2, 2, "primary", 0)], "album_id long, artist_id long, role string, position int")
    known = spark.createDataFrame([("older", "Lose"), ("kept", "Else"), ("taken", "Else")], "alias string, canonical string")
    mapping = spark.createDataFrame([(2, 1), (4, 1), (1, 1)], "loser long, winner long")
    out = merge.merge_artists(artists, bridge, on, mapping, ("image",), spark.createDataFrame([(1, " Taken\n"), (3, "")], "winner long, new_name string"), known)
    assert {tuple(r) for r in out["artists"].select("artist_id", "name", "normalized_name", "image").collect()} == {(1, "Taken", "taken", "img"), (4, "Unknown Artist", "unknown artist", None)}
    assert {tuple(r) for r in out["track_artists"].select("track_id", "artist_id", "position").collect()} == {(1, 1, 0), (2, 1, 0)}
    assert {tuple(r) for r in out["aliases"].collect()} == {("lose", "Taken"), ("win", "Taken"), ("older", "Taken"), ("kept", "Else")}
    albums = spark.createDataFrame([(1, "First"), (2, "Second"), (3, "Third")], "album_id long, title string")
    tracks = spark.createDataFrame([(1, 1, "First"), (2, 2, "Second"), (3, 3, "Third")], "id long, album_id long, album string")
    out = merge.merge_albums(albums, tracks, on, spark.createDataFrame([(2, 1)], "loser long, winner long"), artists, spark.createDataFrame([(1, "New"), (3, " ")], "winner long, new_title string"))
    assert {(r.id, r.album_id, r.album) for r in out["tracks"].collect()} == {(1, 1, "New"), (2, 1, "New"), (3, 3, "Third")}
    assert {tuple(r) for r in out["aliases"].collect()} == {("first|win", "New", "Win"), ("second|lose", "New", "Win")}
    assert {tuple(r) for r in out["albums"].select("album_id", "title").collect()} == {(1, "New"), (3, "Third")}


def test_positions_over_many_ranges(spark):
    df = spark.range(0, 1000, 1, 16).selectExpr("(id * 37) % 1000 as x")
    assert all(r.x == r.position for r in tables.with_positions(df, "x").collect()) and tables.with_positions(df.where("false"), "x").count() == 0
