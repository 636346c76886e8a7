"""Hard negatives, overlap join and centroid clustering against plain versions, on odd rows and over many shards and cells."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from cadenza.llm import clusters, negatives, overlap
from cadenza.llm.simhash import Groups

BAD = [(901, None, 1), (902, [1.0, None, 2.0, 0.5], 1), (903, [float("nan"), 0.0, 1.0, 1.0], 2), (904, [float("inf"), 0.0, 1.0, 1.0], 2), (905, [], 3)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as v", "'x' as rank", "'x' as cluster", "'x' as codes", "'x' as shard")


def some_vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims) * 0.3 + (i % 3) * 0.2], int(rng.integers(0, 10))) for i in range(n)]
    rows[5] = (5, rows[4][1], rows[4][2])  # ties
    rows[6] = (6, [0.0] * dims, 3)
    return rows


# --- hard negatives ---


def plain_negatives(rows, step=100, n_pos=5, n_neg=10):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (la, va) in kept.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, (label, v) in kept.items() if i != a and len(v) == len(va))
        for s, p, label in [x for x in scored if x[2] == la][:n_pos]:
            hits = [(i, -t) for t, i, other in scored if other != la and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "shard_rows"), [(64, 40), (7, 1000), (70, 25)])
def test_hard_negatives_equal_plain(spark, dims, shard_rows):
    rows = some_vectors(130, dims) + [(i, v, None if k % 2 else label) for k, (i, v, label) in enumerate(some_vectors(8, 4, 9), 300)] + [(None, [0.1] * dims, 1), (10, [0.5] * dims, 2), *BAD]
    got = negatives.hard_negatives(vectors(spark, rows), anchor_step=10, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows, 10)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors(spark, BAD)).count() == 0
    assert negatives.hard_negatives(vectors(spark, BAD).limit(0)).count() == 0


def test_intervals_hold_every_score_and_rule_most_rows_out():
    rng = np.random.default_rng(4)
    rows = rng.integers(-90, 90, (3000, 64))
    codes, pulls = negatives.encode(rows)
    shard = negatives.Shard(np.arange(3000), np.zeros(3000, int), rows, codes, pulls)
    query = rng.integers(-90, 90, 64)
    asked = negatives.Anchors(query[None])
    mid, slack, at = np.zeros(3000), np.zeros(3000), np.arange(3000)
    for level in range(negatives.LEVELS):
        low, high, mid, slack = shard.level(asked, 0, level, at, mid, slack)
        assert (low <= rows @ query).all() and (rows @ query <= high).all()
    [(best, score)] = shard.best(asked, 0, at, 5, [(-np.inf, np.inf)])
    assert score.tolist() == sorted((rows @ query).tolist(), reverse=True)[:5] and shard.scored < 300


# --- overlap join ---


def plain_sets(rows, percent=90):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_texts(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows, i = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 160))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w) + (" " + passage if family % 3 == 0 else "")))
            i += 1
    # Sizes of 9 and 10 that share 9 link at exactly 90 percent.
    nine = " ".join(words[:11])
    return [*rows, (i, nine), (i + 1, nine + " more"), (i + 2, ""), (i + 3, None), (i + 4, " \n"), (i + 5, "one"), (i + 6, "ONE"), (i + 7, "one two"), (None, rows[0][1]), (3, rows[0][1]), (3, rows[0][1]), (i + 8, "É é é é"), (i + 9, "x" * 9000 + " " + nine)]


@pytest.mark.parametrize("cells", [(256, 4096), (2, 3)])
def test_overlap_join_equals_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(overlap, "CELL_SETS", cells[0])
    monkeypatch.setattr(overlap, "LIGHT_SETS", cells[1])
    monkeypatch.setattr(overlap._parts, "__defaults__", (cells[0], overlap.CELL_SHINGLES))
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as k", "'x' as row", "'x' as size", "'x' as cell", "'x' as root")
    got = sorted((tuple(r) for r in overlap.similar_sets(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == plain_sets(rows)


def test_overlap_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.similar_sets(df).count() == 0
    assert overlap.similar_sets(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_what_all_pairs_have(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(5000, n, replace=False) for n in rng.integers(1, 300, 8)]
    sets = []
    for _ in range(60):
        b = base[rng.integers(len(base))]
        s = set(b.tolist())
        for x in rng.choice(b, min(len(b), rng.integers(0, 12)), replace=False).tolist():
            s.discard(x)
        s |= set(rng.integers(5000, 9000, rng.integers(0, 8)).tolist()) or {1}
        sets.append(np.array(sorted(s), np.uint64))
    sets = sorted({s.tobytes(): s for s in sets}.values(), key=len)
    groups, wanted, maybe = Groups(len(sets)), Groups(len(sets)), Groups(len(sets))
    overlap.search(sets, 90, groups)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                wanted.join(i, j)
    assert [groups.find(i) for i in range(len(sets))] == [wanted.find(i) for i in range(len(sets))]
    for i, j in overlap.may_link(np.array([len(s) for s in sets]), np.arange(len(sets)), [overlap.parity(s) for s in sets], 90):
        maybe.join(i, j)
    assert all(maybe.find(i) == maybe.find(wanted.find(i)) for i in range(len(sets)))


def test_merge_skip_counts_owners():
    lists = [[1, 4, 6], [1, 2, 6], [6], [3, 4, 6]]
    owners = [x for one in lists for x in one]
    ends = np.cumsum([0, *map(len, lists)]).tolist()
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    assert list(overlap.merge_skip(owners, spans, 2)) == [(1, 2), (4, 2), (6, 4)]
    assert list(overlap.merge_skip(owners, spans, 4)) == [(6, 4)] and list(overlap.merge_skip(owners, spans, 5)) == []


# --- clustering ---


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(centres)):
            if mine := [v for (_, v), c in zip(kept, of, strict=True) if c == j]:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = [(i, nearest(v), v) for i, v in kept]
    sums = {j: sum(far(v, centres[j]) for _, c, v in of if c == j) for j in range(len(centres))}
    return sorted(((i, c, far(v, centres[c]), sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, v in of), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(120, 8, 10), (5, 8, 3), (60, 1, 2), (90, 12, 0)])
def test_clusters_equal_plain(spark, n, k, rounds):
    rows = some_vectors(max(n, 7), 4)[:n] + [(3, [0.5, -0.25, 0.125, 1.0], 1), (None, [0.1, 0.2, 0.3, 0.4], 2), (7, [9.0] * 5, 1), *BAD]
    got = clusters.cluster(vectors(spark, rows).repartition(5), k=k, rounds=rounds, dims=4)
    assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == plain_clusters(rows, k, rounds, 4)


def test_clusters_of_nothing_and_of_equal_rows(spark):
    empty = clusters.cluster(vectors(spark, BAD), dims=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = clusters.cluster(vectors(spark, [(i, [0.5, 0.5], 1) for i in range(9)]), dims=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}


def test_tournament_gives_ties_to_the_smaller_number():
    rng = np.random.default_rng(0)
    centres = rng.integers(-3, 4, (9, 2))
    rows = np.array([(x, y) for x in range(-4, 5) for y in range(-4, 5)])
    won = clusters.Bisectors(centres).winners(rows)
    far = ((rows[:, None] - centres[None]) ** 2).sum(2)
    assert won.tolist() == far.argmin(1).tolist()


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(vectors(spark, [(1, [1e9, 0.0], 1)]), dims=2).count()
