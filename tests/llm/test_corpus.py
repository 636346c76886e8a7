"""Each operator against a plain version of its contract, on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from cadenza.llm import decontaminate, forest, mixing, pii, quality, sharding, simhash, substrings, tokens, warc

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=5, n=40):
    """Rows (doc_id, text) with near and exact copies, runs, accents, nulls and repeats."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["Æ", "İx", "x y", "the"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = base[i].split(" ")
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        base[(i + 1) % n] = " ".join(w)
    base[3] = base[2] + "\n" + base[6]
    base[5] = "run " * 40 + base[6]
    base[7] = "run " * 25 + "tail"
    base[9], base[10], base[11] = "", " \t\n ", "one"
    rows = list(enumerate(base))
    return [*rows, (n, None), (None, base[0]), (None, None), (2, base[2]), (n + 1, base[6].upper()), (n + 2, "z" * 5000 + " " + base[6])]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use within
        for c in ("k", "id", "fp", "size", "shard", "bucket", "words", "score", "slot"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def fingerprint(text, n=3):
    w = split(lower(text))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def test_simhash(spark):
    rows = corpus()
    fps = [fingerprint(t) for _, t in rows]
    of = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    expected = sorted([(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, of, strict=True)], key=str)
    assert collect(simhash.near_duplicates(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("limit", "radius"), [(4096, 2), (4096, 1), (3, 2), (3, 1), (20, 2)])
def test_shards_are_cut_until_trees_are_small(spark, monkeypatch, limit, radius):
    monkeypatch.setattr(simhash, "TREE_LIMIT", limit)
    rng = random.Random(1)
    fps = [7 ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2))) for _ in range(40)] + [7, 7 ^ 1 << 63, rng.getrandbits(64)]
    names = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    edges, links = simhash._close(spark.createDataFrame([(f,) for f in names], "fp long"), radius)
    edges = {(r.a, r.b) for r in edges.collect()}
    of = components(names, close)
    assert components(names, lambda a, b: (a, b) in edges or (b, a) in edges) == of
    counted = {r.fp: r.n for r in links.collect()}
    assert all(counted.get(f, 0) == sum(close(f, g) for g in names) - 1 for f in names)


def test_bk_tree():
    rng = random.Random(2)
    keys = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for k in keys:
        tree.add(k)
    for q in keys[:20]:
        assert {tree.keys[n] for _, n in tree.within(q, 2)} == {k for k in keys if (k ^ q).bit_count() <= 2}


@pytest.mark.parametrize("chunk", [1024, 3])
def test_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(8):
        base = [str(rng.randrange(10**6)) for _ in range(120)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(120)] = "new"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A B"), (3, rows[3][1]), (n + 4, rows[3][1])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split(lower(t))) else set() for _, t in rows]
    of = components(range(len(rows)), lambda i, j: (rows[i][1] or "") == (rows[j][1] or "") or bool(sets[i] | sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = sorted({min(rows[j][0] for j in range(len(rows)) if of[j] == c) for c in set(of)})
    out = simhash.drop_near_copies(frame(spark, rows))
    assert [r.doc_id for r in out.orderBy("doc_id").collect()] == kept
    assert out.columns == frame(spark, rows).columns
    assert simhash.drop_near_copies(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_whose_bits_are_far(spark, monkeypatch):
    rng, rows = random.Random(31), []
    word = lambda: str(rng.randrange(10**6))
    prints = lambda t: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5))
    while len(rows) < 8:
        base, line = [word() for _ in range(120)], [word() for _ in range(7)]
        a, b = (" ".join(base + line * n) for n in (2, 40))
        if (prints(a) ^ prints(b)).bit_count() > 20:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    # Eight of nine words, of which four shingles of five are shared, and texts that share no more than a line.
    rows += [(8, "a b c d e f g h"), (9, "a b c d e f g h i")] + [(10 + i, " ".join([word() for _ in range(60)] + line)) for i in range(6)]
    kept = [0, 2, 4, 6, 8, *range(10, 16)]
    assert [r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).orderBy("doc_id").collect()] == kept
    # The exact way finds all pairs by itself, also where shards are cut.
    monkeypatch.setattr(simhash, "CHUNK", 2)
    out = simhash.drop_near_copies(frame(spark, rows), radius=-1)
    assert [r.doc_id for r in out.orderBy("doc_id").collect()] == kept


def test_components_of_a_long_path_and_a_hub(spark):
    from cadenza.llm.graph import connected_components

    rng = random.Random(4)
    path = rng.sample(range(1000, 2000), 200)
    edges = list(zip(path, path[1:], strict=False)) + [(5, i) for i in range(6, 300)] + [(9, 9), (3000, 3001), (3001, 3000)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[p] == min(path) for p in path) and all(found[i] == 5 for i in range(5, 300)) and found[3001] == 3000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [
    "Mail Ann.Lee@ex-ample.co.uk, a@b, @x.y, a.b@c.d@e.f g%h@i.j.k", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.4 12.34.56.78.", "card 4111 1111 1111 1111 4111-1111-1111-1112 1 2", "4111  1111 1111 1111 5500000000000004x 12345678901234567890",
    "call +49 (0) 30.123-4567 or +1 or ++12 345 678 90+ 1 +1234567890123456", "", None, "é+12 345 6789é ü@x.org", "1" * 3000 + "." + "2" * 3000, "@" * 500 + "a" * 500 + "@b.c", "+1" * 300,
]


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_personal_data_base(spark):
    rng = random.Random(6)
    noise = ["".join(rng.choice("a1.@+- ()2é") for _ in range(60)) for _ in range(200)]
    rows = [*enumerate(TEXTS + noise), (None, TEXTS[0]), (0, TEXTS[0])]
    expected = []
    for i, t in rows:
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in plain_spans(t or ""))
        expected.append((i, hashlib.sha256(said.encode()).hexdigest(), said, said.count("card:")))
    found = pii.personal_data(frame(spark, rows))
    assert collect(found, "doc_id", "base_sha256", "spans", "n_card") == sorted(expected, key=str)
    assert pii.personal_data(frame(spark, rows).limit(0)).count() == 0


def test_terms_that_give_a_value_away(spark):
    rows = [(i, f"note {i} the of Zorblax wrote from zed@corp.example the of text{i}") for i in range(6)] + [(10 + i, f"the of plain words number{i}") for i in range(60)]
    out = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    text = dict(rows)
    for i in range(6):
        terms = [text[i][int(a) : int(z)] for kind, a, z in (s.split(":") for s in out[i].spans.split(",")) if kind == "term"]
        assert "Zorblax" in terms and "the" not in terms and f"text{i}" not in terms
    assert all(out[10 + i].spans == "" for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "Zorblax" not in clean[0] and "@" not in clean[0] and "[email]" in clean[0] and clean[10] == text[10]


def plain_terms(rows):
    """The term spans by brute force: company, support, strength and all occurrences, over distinct texts."""
    import math

    texts, words, near = {t or "" for _, t in rows}, {}, {}
    for t in texts:
        spans = plain_spans(t)
        free = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < z for _, a, z in spans)]
        words[t] = free
        near[t] = set()
        for kind, a, z in spans:
            value = (kind, t[a:z].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:z]))
            before, after = [m for m in free if m.start() < a][-10:], [m for m in free if m.start() >= z][:10]
            near[t] |= {(value, m[0].lower()) for m in before + after}
    n, telling = len(texts), set()
    for value, term in set().union(*near.values()):
        both = sum((value, term) in x for x in near.values())
        of_value = sum(any(v == value for v, _ in x) for x in near.values())
        of_term = sum(any(w.lower() == term for w in re.findall(r"[^\W\d_]+", t)) for t in texts)
        if both >= 3 and of_value < n and math.log(n * both / (of_value * of_term)) / math.log(n / of_value) >= 0.9 - 1e-12:
            telling.add((value, term))
    return {t: [(m.start(), m.end()) for m in words[t] if any((v, m[0].lower()) in telling for v, x in near[t] if x == m[0].lower())] for t in texts}


def test_terms_against_brute_force(spark):
    rng, rows = random.Random(61), []
    names = ["".join(rng.choice("abcdefg") for _ in range(40)) for _ in range(12)]
    for i in range(150):
        person = rng.randrange(4)
        body = " ".join(rng.choice(["the", "of", "wrote", "und", "Straße", *names[6:]]) for _ in range(rng.randint(0, 30)))
        value = [f"p{person}@corp.example", "10.0.0.7", "+49 30 1234567", "4111 1111 1111 1111"][person] if i % 3 else ""
        name = names[person if value else person + 6]
        who = name.upper() if i % 2 else name
        # Eight long words stand between a value and a name; the name stands again at the head.
        rows.append((i, f"{name if i % 5 else ''} {body} {value} " + " ".join("w" * 40 + "abcdefgh"[j] for j in range(8)) + f" {who} {body}"))
    rows += [(None, rows[1][1]), (1, rows[1][1]), (900, None), (901, "")]
    terms = plain_terms(rows)
    expected = sorted([(i, ",".join(f"term:{a}:{z}" for a, z in terms[t or ""])) for i, t in rows], key=str)
    found = [(r.doc_id, ",".join(x for x in r.spans.split(",") if x.startswith("term"))) for r in pii.personal_data(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == expected and any(x for _, x in expected)
    assert pii.sanitise(frame(spark, rows).limit(0)).count() == 0
    assert {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}[900] is None


def test_warc_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 30000
    html = ["<p>a</p>", "<p>a</p>", "", None, big, "b", big, "<p>a</p>"]
    rows = [(i + 1, f"http://x/{i}\r\nEvil: y", h) for i, h in enumerate(html)] + [(99, None, "\x00\r\n"), (None, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as hex", "2 as first")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        h = h or ""
        ref = first[h] if i != first[h] else None
        expected.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if ref is None else "revisit", ref))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collect(warc.round_trip(pages), *columns) == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_chunks_are_the_payload(spark, tmp_path):
    html = "0123456789é" * 40000
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    files = warc.write_warc(warc.record_roles(pages), path)
    chunks = sorted(warc.read_warc(spark, path, files).collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(c.data) for c in chunks).decode() == html and len(chunks) > 5
    done = b""
    for c in chunks:
        done += bytes(c.data)
        assert c.digest_so_far == base64.b32encode(hashlib.sha1(done).digest()).decode() and c.bytes_so_far == len(done)


def test_quality(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["ar", "be", "co", "du", "el"]) + str(rng.randrange(50)) for _ in range(40)) for _ in range(240)]
    bad = [" ".join(["spam!!"] * rng.randint(5, 60)) for _ in range(120)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 240)) for i, _ in rows] + [(None, 1), (9999, None)], "doc_id long, quality int")
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (None, "spam!!"), (0, good[0])])
    out = quality.score(docs, quality.fit(docs.selectExpr("doc_id", "text"), labels)).collect()
    assert len(out) == 364
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id < 360]
    assert np.mean([r.predicted == int(r.doc_id < 240) for r in held]) > 0.95
    assert {r.score for r in out if r.doc_id in (1000, 1001)} == {next(r.score for r in out if r.doc_id == 1000)}
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.score >= 0.5}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, empty)).count() == 364


def test_sharding(spark):
    rows = [*corpus(), *[(1000 + i, "same text") for i in range(300)], (5000, "y" * 20000)]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    loads = [sum(r.size for r in v) for v in by.values() if max(r.size for r in v) < 500]  # the others hold one large text
    assert len(loads) > 10 and max(loads) - min(loads) < 100
    assert sharding.shard_documents(frame(spark, rows).limit(0)).count() == 0


def test_stored_map_is_edited(spark, tmp_path):
    rows = [(i, "t" * (i % 50)) for i in range(2000)]
    path = f"file://{tmp_path}/map"
    place = lambda some, shards: {r.doc_id: (r.shard, r.virtual_slot, r.map_version, r.size) for r in sharding.shard_documents(frame(spark, some), shards, 256, map_path=path).collect()}
    first, again = place(rows, 4), place(rows, 4)
    assert {v[2] for v in first.values()} == {1} and {v[2] for v in again.values()} == {2}
    assert {d: v[0] for d, v in first.items()} == {d: v[0] for d, v in again.items()}
    grown = place(rows + [(i, "t" * (i % 50)) for i in range(2000, 2200)], 5)
    moved = sum(v[3] for d, v in first.items() if grown[d][0] != v[0])
    loads = [sum(v[3] for v in grown.values() if v[0] == k) for k in range(5)]
    assert {v[2] for v in grown.values()} == {3} and moved < 0.3 * sum(loads) and max(loads) - min(loads) < 0.05 * max(loads)
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, rows), 5, 128, map_path=path)


def test_a_map_outlives_a_lost_writer(spark, tmp_path):
    rows = [(i, "t" * (i % 50)) for i in range(400)]
    path = f"file://{tmp_path}/map"
    run = lambda: {r.map_version for r in sharding.shard_documents(frame(spark, rows), 4, 64, map_path=path).collect()}
    assert run() == {1}
    # One writer died while it wrote version 2, another when half of its files were moved.
    (tmp_path / "map/version=2/_temporary/0").mkdir(parents=True)
    assert run() == {2} and sharding.map_versions(spark, path) == [0, 1, 2]
    spark.read.parquet(f"{path}/version=2").limit(9).write.parquet(f"{path}/version=3")
    (tmp_path / "map/version=3/_SUCCESS").unlink()
    assert run() == {3} and sharding.latest_map(spark, path).count() == 64
    with pytest.raises(ValueError, match="already"):
        sharding.store_map(sharding.latest_map(spark, path), path, 3)


def test_growing_moves_about_a_shard(spark):
    rows = [(i, "t" * (i % 50)) for i in range(3000)]
    stats = sharding.slot_bytes(sharding.with_virtual_slot(frame(spark, rows), 512))
    v1 = sharding.rebalance(sharding.first_map(spark, 512, 4), stats, 4)
    v2 = sharding.rebalance(v1.select("version", "virtual_slot", "shard"), stats, 5)
    a, b = ({r.virtual_slot: r.shard for r in v.collect()} for v in (v1, v2))
    size = {r.virtual_slot: r.bytes for r in v2.collect()}
    moved, loads = sum(size[s] for s in a if a[s] != b[s]), [sum(size[s] for s in b if b[s] == k) for k in range(5)]
    assert {r.version for r in v2.collect()} == {2} and moved < 0.25 * sum(loads) and max(loads) - min(loads) < 0.02 * max(loads)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])) for i in range(3000)] + [(None, "a"), (7, "a"), (8, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 as position", "'t' as text")
    weights = {"a": 0.5, "b": 0.3, "c": 0.1, "": 0.1}
    out = sorted(mixing.mix_sources(docs, weights, block=4).collect(), key=lambda r: r.position)
    assert len(out) == len(rows) and len({r.position for r in out}) == len(rows) and out[-1].source == "zzz"
    blocks = sorted({(r.place, r.source, r.block, r.release, r.deadline) for r in out if r.place is not None})
    assert all(release <= place < deadline for place, _, _, release, deadline in blocks)
    ends = min(max(p for p, s, *_ in blocks if s == x) for x in weights)
    had = dict.fromkeys(weights, 0)
    for place, s, *_ in blocks:
        if place > ends:
            break
        had[s] += 1
        assert all(abs(had[x] - weights[x] * (place + 1)) < 1 for x in weights)
    ordered = mixing.order_by_mix(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_weights_hold_exactly(spark):
    assert mixing.whole_weights({"a": 0.1, "b": 0.35, "c": 1}) == {"a": 2, "b": 7, "c": 20}
    # Weights off any round period, over many periods, and a period that is longer than the corpus.
    for weights in ({"a": 0.6180339, "b": 0.2718281, "c": 0.11}, {"a": 387, "b": 141, "c": 14}):
        docs = spark.range(9000).selectExpr("id as doc_id", "case when id < 6000 then 'a' when id < 8800 then 'b' else 'c' end as source")
        out = sorted({(r.place, r.source) for r in mixing.mix_sources(docs, weights, block=2).collect()})
        total, had, last = sum(weights.values()), dict.fromkeys(weights, 0), {s: max(p for p, x in out if x == s) for s in weights}
        for place, s in out:
            if place > min(last.values()):
                break
            had[s] += 1
            assert all(abs(had[x] - w / total * (place + 1)) < 1 for x, w in weights.items())


def test_weights_hold_with_many_sources(spark):
    # 1,600 rows of one source and one each of 12,000 others, whose weights are 40 and 1.
    docs = spark.range(13600).selectExpr("id as doc_id", "case when id < 1600 then 'hot' else concat('s', id) end as source")
    out = mixing.mix_sources(docs).collect()
    assert len({r.position for r in out}) == len(out) == 13600
    assert all(r.release <= r.place < r.deadline for r in out)
    blocks = {r.block: r.place for r in out if r.source == "hot"}
    assert len(blocks) == 100 and all(abs(k - 40 / 12040 * place) < 1 for k, place in blocks.items())


def test_long_plan_is_written_in_pieces(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 7) as source")
    whole = collect(mixing.mix_sources(docs), "doc_id", "block", "position", "release", "deadline")
    monkeypatch.setattr(mixing, "BROADCAST_PLACES", 3)
    assert collect(mixing.mix_sources(docs), "doc_id", "block", "position", "release", "deadline") == whole


@pytest.mark.parametrize("weights", [{"a": 900, **{f"s{i}": 10 for i in range(10)}}, {"a": 1}, {"x": 7, "y": 5, "z": 1}, {"a": 333, "b": 333, "c": 334}])
def test_schedule_keeps_windows(weights):
    period = sum(weights.values())
    plan = list(mixing.pfair_places(weights))
    assert [p[4] for p in plan] == list(range(period)) and all(r <= place < d for _, _, r, d, place in plan)


def test_tokens(spark):
    pieces = ["a", "b", "c", "ab", "abc", "bcd", "d", "▁", "▁a", "▁abcd", "cc"]
    auto = tokens.Automaton(pieces)

    def greedy(w):
        n = i = 0
        while i < len(w):
            end = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
            n, i = (n + 1, end) if end else (n + len(w[i].encode()), i + 1)
        return n

    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("▁abcdé😀") for _ in range(rng.randint(0, 14)))
        assert auto.count(w) == greedy(w)
    some = tokens.Automaton(["abc", "ab", "x"])  # its single letters are no pieces
    assert some.count("ababcabx") == 4 and some.count("aab") == 2
    rows = [(0, "abc abcd é"), (1, None), (2, ""), (None, "a"), (3, "a" * 5000)]
    out = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(frame(spark, rows), pieces).collect()}
    assert out == {i: (len(split(t)), sum(greedy("▁" + w) for w in split(t))) for i, t in rows}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def nearly(w, x, window=10, slack=1):
    """Whether, at some offset, enough adjacent pairs of a window of ``x`` stand within ``slack`` of their places in ``w``."""
    size = min(window, len(x))
    pairs = [tuple(x[j : j + 2]) for j in range(max(len(x) - 1, 1))] if x else []
    there = {}
    for p in range(len(w)):
        there.setdefault(tuple(w[p : p + min(2, len(x))]), []).append(p)
    found = {}
    for at, pair in enumerate(pairs):
        for p in there.get(pair, []):
            for o in range(p - at - slack, p - at + slack + 1):
                found.setdefault(o, set()).add(at)
    need = max(size - 1 - 2 * slack, -(-(size - 1) // 2), 1)
    return any(len([a for a in ats if at <= a <= at + max(window - 2, 0)]) >= need for ats in found.values() for at in ats)


def test_decontamination(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 1, 2, 30])]
    items += [(50, items[0][1]), (51, None), (52, "..."), (53, "a a a a a a a a a a a a"), (None, "w1 w2 w3")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            src = rng.choice(items)[1] or ""
            part = WORD.findall(lower(src))
            a = rng.randint(0, max(0, len(part) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = part[a : a + rng.randint(8, 14)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(60, None), (61, ""), (62, "a A a " * 6), (None, items[1][1]), (0, docs[0][1]), (63, "-" + items[0][1].upper() + "-")]
    expected = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found, near = set(), set(), set()
        for i, it in items:
            x = WORD.findall(lower(it))
            if i is not None and nearly(w, x):
                near.add(i)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    if i is not None:
                        found.add(str(i))
        expected.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    assert any(e[6] > e[3] for e in expected)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as passage", "2 as n")
    out = decontaminate.contamination(frame(spark, docs), bench)
    assert collect(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near") == sorted(expected, key=str)
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(e[0]) for e in expected if not e[5]) and kept.columns == frame(spark, docs).columns
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, docs).limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [10, 12, 30])
def test_proximity(spark, n):
    words = [f"u{i}" for i in range(n)]
    texts = {1: words, 2: [*words[:5], "extra", *words[5:]], 3: words[:4] + words[5:], 4: [*words[:5], "other", *words[6:]], 5: list(reversed(words)), 6: words[::2], 7: [w for x in words for w in (x, "gap")]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    items, terms = decontaminate.test_terms(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    index = decontaminate.build_index(docs, terms)
    counted = decontaminate.term_counts(index, terms)
    assert {r.id for r in decontaminate.find_passages(decontaminate.look_up(index, counted)).collect()} == ({1} if n < 30 else {1, 2, 3, 4})
    assert {r.id for r in decontaminate.find_passages(decontaminate.look_up(index, counted, slack=1), slack=1).collect()} == {1, 2, 3, 4}


def test_forest(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    odd = [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [float("nan")] * 16), (2400, [1.0, None] * 8), (None, rows[0][1]), (2500, [1.0, 2.0]), (2600, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as v")
    out = forest.nearest(df, df.where("vec_id % 100 = 0"), candidates=300).collect()
    real = [*rows, (2600, rows[0][1])]
    ids, x = np.array([i for i, _ in real]), np.array([v for _, v in real])
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits += len(set(best) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()
    assert {r.query_id for r in out} == {int(i) for i in ids if i % 100 == 0}  # the short vector has no company
    few = df.where("vec_id < 4")
    assert few.count() == 5 and forest.nearest(few, few.where("vec_id = 0")).count() == 3
    assert forest.nearest(df.limit(0), df).count() == 0


def plain_passages(rows, size=13):
    key = lambda i: float("inf") if i is None else i
    first = {}
    words = [split(t) for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < key(i) for q in range(p, p + size)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_passages(spark):
    rows = corpus()
    rng = random.Random(12)
    words = ["a", "b", "c", "d"]
    for i in range(100, 130):  # few words: runs and repeats within and across documents
        rows.append((i, " ".join(rng.choice(words) for _ in range(60))))
    shared = " ".join(f"s{i}" for i in range(13))
    rows += [(200, "p q " + shared + " r"), (201, shared), (202, " ".join(f"s{i}" for i in range(12))), (203, "a " * 13), (204, "a " * 30 + "b"), (205, "c " + "a " * 12), (206, "c " + "a " * 40), (207, "a " * 12)]
    out = substrings.dedup_passages(frame(spark, rows))
    assert collect(out, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == plain_passages(rows)
    assert substrings.dedup_passages(frame(spark, rows).limit(0)).count() == 0


def test_passages_in_small_pieces(spark, monkeypatch):
    """Tasks that gather little, many buckets, and a passage that every document holds."""
    rng, held = random.Random(13), " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{rng.random()} {held} {rng.random()} " + " ".join(rng.choice("abc") for _ in range(30))) for i in range(60)] + [(5, held), (None, held), (None, "x " + held)]
    monkeypatch.setattr(substrings, "GATHER", 50)
    out = substrings.dedup_passages(frame(spark, rows), buckets=37)
    assert collect(out, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == plain_passages(rows)


@pytest.mark.parametrize("seed", range(12))
def test_anchors_depend_on_the_window_alone(seed):
    rng = random.Random(seed)
    names = substrings._Names()
    words = [str(i) for i in range(rng.choice([2, 3, 5, 50]))]
    for _ in range(150):
        window = [rng.choice(words) for _ in range(13)]
        if rng.random() < 0.5:  # runs, whole or cut by the window's ends
            a = rng.randrange(13)
            window[a : a + rng.randint(2, 13)] = [words[0]] * len(window[a : a + rng.randint(2, 13)])
            window = (window + [words[0]] * 13)[:13]
        keys = set()
        for _ in range(4):
            before, after = ([rng.choice(words)] * rng.randint(0, 6) + [rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(2))
            w = substrings.Words([" ".join(before + window + after).encode(), b"", b"x y"], names)
            starts, key = substrings.anchors(w, 13)
            keys.add(int(key[int(np.flatnonzero(starts == len(before))[0])]))
        assert len(keys) == 1
