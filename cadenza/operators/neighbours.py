"""Exact mutual neighbours: leaves of a tree over the axes, searched by bounds, and a stored table of who keeps whom."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import kept, scratch

#: Columns of a point, in the order of its numbers; null is NaN.
AXES = ("year", "seconds", "confidence", "mix", "family", "loudness", "tempo", "bass", "dynamics", "brightness", "beat")
YEAR, SECONDS, CONFIDENCE, MIX, FAMILY, LOUDNESS, TEMPO, BASS, DYNAMICS, BRIGHTNESS, BEAT = range(len(AXES))
# Weights of the distance.
W_YEAR, W_TEMPO, W_DYNAMICS, W_BASS, W_BRIGHTNESS, W_LOUDNESS, W_BEAT, W_CONFIDENCE, W_MIX, W_LENGTH, W_FAMILY = 3.0, 2.0, 1.5, 1.5, 1.5, 1.0, 3.0, 1.0, 1.0, 1.0, 2.0
YEARS, UNKNOWN_YEAR_COST, LENGTH = 5.0, 1.5, 120.0
#: Axes whose intervals bound a distance from below: (column, weight of one unit, largest cost).
BOUNDS = ((YEAR, W_YEAR / YEARS, W_YEAR), (SECONDS, W_LENGTH / LENGTH, W_LENGTH), (CONFIDENCE, W_CONFIDENCE, np.inf), (LOUDNESS, W_LOUDNESS, np.inf), (BASS, W_BASS, np.inf), (DYNAMICS, W_DYNAMICS, np.inf), (BRIGHTNESS, W_BRIGHTNESS, np.inf), (BEAT, W_BEAT, np.inf))
#: Points of a leaf that one task holds, about; leaves at most, so that their boxes can be sent to all tasks; points the tree is made of.
LEAF_POINTS, MOST_LEAVES, SAMPLE = 4096, 4096, 65536
#: Points of the boxes within a leaf, and those looked at before the first bound.
BOX_POINTS, FIRST_POINTS = 8, 32
#: Anchors that are named one by one to the scan of a stored table.
FEW_ANCHORS = 1000
SLACK = 1e-9


def distances(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of point ``x`` to each row of ``others``, term by term in the order of similar.track_distance()."""
    gap = np.abs(others - x)
    known = lambda v: np.where(np.isnan(v), 0.0, v)
    sure = np.minimum(np.nan_to_num(others[:, CONFIDENCE], nan=1.0), 1.0 if np.isnan(x[CONFIDENCE]) else x[CONFIDENCE])
    out = np.where(np.isnan(gap[:, YEAR]), UNKNOWN_YEAR_COST, W_YEAR * np.minimum(1.0, gap[:, YEAR] / YEARS))
    out = out + known(W_TEMPO * sure * gap[:, TEMPO])
    for c, w in ((DYNAMICS, W_DYNAMICS), (BASS, W_BASS), (BRIGHTNESS, W_BRIGHTNESS), (LOUDNESS, W_LOUDNESS)):
        out = out + w * gap[:, c]
    out = out + known(W_BEAT * gap[:, BEAT]) + known(W_CONFIDENCE * gap[:, CONFIDENCE]) + np.where(gap[:, MIX] != 0, W_MIX, 0.0)
    out = out + W_LENGTH * np.minimum(1.0, gap[:, SECONDS] / LENGTH)
    return out + np.where(gap[:, FAMILY] > 0, W_FAMILY, 0.0)


class Boxes:
    """Bounds of groups of points: intervals of the axes, what is missing in them, mix classes and families as bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, holes: np.ndarray, mixes: np.ndarray, families: np.ndarray) -> None:
        self.low, self.high, self.holes, self.mixes, self.families = low, high, holes, mixes, families

    @classmethod
    def of(cls, points: np.ndarray, groups: list[np.ndarray]) -> Boxes:
        starts = np.cumsum([0, *map(len, groups)])[:-1]
        rows = points[np.concatenate(groups)]
        least = lambda v: np.minimum.reduceat(np.where(np.isnan(v), np.inf, v), starts, axis=0)
        return cls(least(rows), -least(-rows), np.logical_or.reduceat(np.isnan(rows), starts, axis=0), *(np.bitwise_or.reduceat(bits(rows[:, c]), starts) for c in (MIX, FAMILY)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of ``x`` to any point of each box."""
        out = np.where(self.mixes & bits(x[MIX : MIX + 1]), 0.0, W_MIX)
        if not np.isnan(x[FAMILY]):
            out += np.where(self.holes[:, FAMILY] | (self.families & bits(x[FAMILY : FAMILY + 1]) > 0), 0.0, W_FAMILY)
        for c, unit, most in BOUNDS:
            if np.isnan(x[c]):
                out += UNKNOWN_YEAR_COST if c == YEAR else 0.0
                continue
            with np.errstate(invalid="ignore"):
                cost = np.minimum(unit * np.maximum(np.maximum(self.low[:, c] - x[c], x[c] - self.high[:, c]), 0.0), most)
            out += np.where(self.holes[:, c], np.minimum(cost, UNKNOWN_YEAR_COST if c == YEAR else 0.0), cost)
        return out


def bits(v: np.ndarray) -> np.ndarray:
    """1 << v of small whole numbers; NaN has no bit."""
    return np.where(np.isnan(v), 0, np.int64(1) << np.nan_to_num(v).astype(np.int64))


def split(points: np.ndarray, at: np.ndarray) -> tuple[int, float | None, np.ndarray] | None:
    """(column, value, which of ``at`` go left) of the best cut: mix classes first, then what lacks a year or beat, then the middle of the widest axis."""
    rows = points[at]
    if (mix := rows[:, MIX]).min() != mix.max():
        value = float(np.median(np.unique(mix))) if len(np.unique(mix)) > 2 else float(mix.max())
        return MIX, value, mix < value
    for c in (YEAR, BEAT):
        if (hole := np.isnan(rows[:, c])).any() and not hole.all():
            return c, None, hole
    spans = [(min(unit * float(np.ptp(v)), most), c) if (v := rows[:, c][~np.isnan(rows[:, c])]).size else (0.0, c) for c, unit, most in BOUNDS]
    width, c = max(spans)
    if width <= 0:
        return None
    v = np.nan_to_num(rows[:, c], nan=-np.inf)
    value = float(np.median(v))
    left = v < value
    if not left.any():
        value = float(v[v > value].min())
        left = v < value
    return c, value, left


def groups_of(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The points' numbers in groups of at most ``most`` (more only where all are alike in every axis that is cut)."""
    out, todo = [], [np.arange(len(points))] if len(points) else []
    while todo:
        at = todo.pop()
        cut = split(points, at) if len(at) > most else None
        if cut is None:
            out.append(at)
        else:
            todo += [at[cut[2]], at[~cut[2]]]
    return out


class Tree:
    """Cuts made on a sample, by which every point finds its leaf."""

    def __init__(self, points: np.ndarray, most: int) -> None:
        self.cuts: list[tuple[int, float | None, int, int]] = []
        self.leaves = 0
        self.root = self._grow(points, np.arange(len(points)), most)

    def _grow(self, points: np.ndarray, at: np.ndarray, most: int) -> int:
        cut = split(points, at) if len(at) > most else None
        if cut is None:
            self.leaves += 1
            return -self.leaves
        here = len(self.cuts)
        self.cuts.append((0, None, 0, 0))
        self.cuts[here] = (cut[0], cut[1], self._grow(points, at[cut[2]], most), self._grow(points, at[~cut[2]], most))
        return here

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                c, value, left, right = self.cuts[node]
                v = points[at, c]
                goes = np.isnan(v) if value is None else np.nan_to_num(v, nan=-np.inf) < value
                todo += [(left, at[goes]), (right, at[~goes])]
        return out


class Leaf:
    """The points of a leaf with small boxes of their own. ``scored`` counts full distances."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, points: np.ndarray) -> None:
        groups = groups_of(points, BOX_POINTS)
        order = np.concatenate(groups)
        self.ids, self.weights, self.points = ids[order], weights[order], points[order]
        self.size = np.array([len(g) for g in groups])
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]]
        self.boxes = Boxes.of(points, groups)
        self.scored = 0

    def _of(self, boxes: np.ndarray) -> np.ndarray:
        sizes = self.size[boxes]
        return np.repeat(self.begin[boxes] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())

    def _score(self, x: np.ndarray, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of those of ``at`` within ``radius``; terms are added up in two steps, after each of which points beyond it go."""
        gap = np.abs(self.points[at][:, (YEAR, MIX, BEAT)] - x[[YEAR, MIX, BEAT]])
        part = np.where(np.isnan(gap[:, 0]), UNKNOWN_YEAR_COST, W_YEAR * np.minimum(1.0, gap[:, 0] / YEARS)) + np.where(gap[:, 1] != 0, W_MIX, 0.0) + np.nan_to_num(W_BEAT * gap[:, 2])
        near = part <= radius + SLACK
        at, part = at[near], part[near]
        gap = np.abs(self.points[at][:, (DYNAMICS, BASS, BRIGHTNESS, LOUDNESS)] - x[[DYNAMICS, BASS, BRIGHTNESS, LOUDNESS]])
        at = at[part + gap @ np.array([W_DYNAMICS, W_BASS, W_BRIGHTNESS, W_LOUDNESS]) <= radius + SLACK]
        found = distances(x, self.points[at])
        self.scored += len(at)
        held = found <= radius
        return at[held], found[held]

    def nearest(self, name: int, x: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, weights, distances) of the points within ``radius`` that fewer than ``k`` others, equal ones counted as often as they stand, are closer than.

        Boxes are looked at from the nearest on, in steps that double, and the radius shrinks to the k-th distance found; it ends where no box is so near.
        """
        bound = self.boxes.nearest(x)
        order = np.argsort(bound, kind="stable")
        upto = np.cumsum(self.size[order])
        at, found, begin, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST_POINTS
        while begin < len(order) and bound[order[begin]] <= radius + SLACK:
            end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + step)) + 1
            boxes = order[begin:end]
            more, far = self._score(x, self._of(boxes[bound[boxes] <= radius + SLACK]), radius)
            times = self.weights[more] - (self.ids[more] == name)
            at, found = np.concatenate([at, more[times > 0]]), np.concatenate([found, far[times > 0]])
            rank = np.argsort(found, kind="stable")
            at, found = at[rank], found[rank]
            times = self.weights[at] - (self.ids[at] == name)
            full = int(np.searchsorted(np.cumsum(times), k))
            if full < len(at):
                radius = min(radius, float(found[full]))
                held = found <= radius
                at, found = at[held], found[held]
            begin, step = end, 2 * step
        return self.ids[at], self.weights[at] - (self.ids[at] == name), found


POINT = "id long, n long, leaf int, radius double, " + ", ".join(f"{a} double" for a in AXES)
NAMES = ["id", "n", "leaf", "radius", *AXES]


def _matrix(t: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_pandas().to_numpy(np.float64, na_value=np.nan) for a in AXES], 1) if t.num_rows else np.zeros((0, len(AXES)))


def _boxes(points: DataFrame, leaves: int) -> Boxes:
    """The boxes of all leaves: one row a leaf, of which there are MOST_LEAVES at most."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).cast("int"))).otherwise(F.lit(0).cast("long"))
    rows = points.groupBy("leaf").agg(*[F.min(a).alias(f"low_{a}") for a in AXES], *[F.max(a).alias(f"high_{a}") for a in AXES], *[F.max(F.col(a).isNull()).alias(f"hole_{a}") for a in AXES], F.bit_or(number("mix")).alias("mixes"), F.bit_or(number("family")).alias("families")).collect()
    low, high = np.full((leaves, len(AXES)), np.inf), np.full((leaves, len(AXES)), -np.inf)
    holes, mixes, families = np.zeros((leaves, len(AXES)), bool), np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
    for r in rows:
        i = r["leaf"]
        low[i] = [np.inf if r[f"low_{a}"] is None else r[f"low_{a}"] for a in AXES]
        high[i] = [-np.inf if r[f"high_{a}"] is None else r[f"high_{a}"] for a in AXES]
        holes[i] = [r[f"hole_{a}"] for a in AXES]
        mixes[i], families[i] = r["mixes"], r["families"]
    return Boxes(low, high, holes, mixes, families)


def _visits(asking: DataFrame, boxes: Boxes) -> DataFrame:
    """``asking`` (points), each once for every leaf but its own that may hold a point within its radius."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, own, radius = _matrix(b), b.column("leaf").to_numpy(), b.column("radius").to_numpy()
            rows, to = [], []
            for i in range(b.num_rows):
                goes = boxes.nearest(points[i]) <= radius[i] + SLACK
                goes[own[i]] = False
                found = np.flatnonzero(goes)
                rows.append(np.full(len(found), i))
                to.append(found)
            if rows:
                out = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()) if n == "leaf" else out.column(n) for n in NAMES], NAMES)

    return asking.select(*NAMES).mapInArrow(work, POINT)


NEAR = "id long, other long, n long, distance double"


def _past_leaves(points: DataFrame, visitors: DataFrame, leaves: int, k: int) -> DataFrame:
    """Leaf.nearest() of ``visitors`` at the leaf that each is for: (id, other, n, distance).

    A leaf's points sort before its visitors, so a task holds one leaf and lets visitors pass in batches.
    """
    both = points.select(F.lit(0).alias("kind"), *NAMES).union(visitors.select(F.lit(1).alias("kind"), *NAMES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leaf, now = [], None, None
        for b in batches:
            leaves_of, kinds = b.column("leaf").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((leaves_of[1:] != leaves_of[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if a == z:
                    continue
                if leaves_of[a] != now:
                    held, leaf, now = [], None, leaves_of[a]
                part = b.slice(a, z - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if leaf is None and held:
                    t, held = pa.Table.from_batches(held), []
                    leaf = Leaf(t.column("id").to_numpy(), t.column("n").to_numpy(), _matrix(t))
                if leaf is not None:
                    names = part.column("id").to_pylist()
                    found = [leaf.nearest(i, x, k, r) for i, x, r in zip(names, _matrix(part), part.column("radius").to_pylist(), strict=True)]
                    ids = np.repeat(np.array(names, np.int64), [len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], ["id", "other", "n", "distance"])

    return both.repartition(max(1, leaves), "leaf").sortWithinPartitions("leaf", "kind").mapInArrow(work, NEAR)


def _ranked(near: DataFrame) -> DataFrame:
    """``near`` with ``closer``, how many others are strictly closer to id, and ``upto``, how many are as close or closer."""
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("n").over(Window.partitionBy("id", "distance"))
    return near.withColumn("upto", upto).withColumn("closer", F.col("upto") - ties)


def build(rows: DataFrame, cutoff: float, mutual_k: int, leaf_points: int = LEAF_POINTS, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(keeps, tracks) of prepared ``rows`` (id and AXES, none but year, confidence, family, tempo and beat null), stored in ``folder``.

    keeps (anchor, neighbour, distance): points of which the neighbour has fewer than ``mutual_k`` others strictly closer than the anchor, within ``cutoff``; it
    is stored by ranges of anchor, so that file statistics let given anchors read their own. Rows that are alike in every axis are
    one point, named by their smallest id; tracks are (id, point).

    A tree whose cuts a bounded sample gives deals points to leaves. A first pass looks for each point's nearest in its own leaf, which bounds how far
    the ``mutual_k``-th can be; a second asks the other leaves that have a box so near. Whatever is closer to a point than one within the
    cutoff is itself within it, so this is exact. Sent back are the nearest alone, from each leaf visited.
    """
    folder = folder or scratch(rows.sparkSession, "neighbours")
    cols = [F.col(a).cast("double").alias(a) for a in AXES]
    rows = kept(rows.select("id", *cols), "rows")
    points = kept(rows.groupBy(*AXES).agg(F.min("id").alias("id"), F.count("*").alias("n")), "alike")
    same = F.xxhash64(*AXES)
    match = [F.col(f"x.{a}").eqNullSafe(F.col(f"y.{a}")) for a in AXES]
    tracks = rows.withColumn("h", same).alias("x").join(points.withColumn("h", same).alias("y"), [F.col("x.h") == F.col("y.h"), *match]).select(F.col("x.id").alias("id"), F.col("y.id").alias("point"))
    tracks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/tracks")
    total = points.count()
    sample = np.array([list(r) for r in points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(*AXES).collect()], np.float64).reshape(-1, len(AXES))
    wanted = min(MOST_LEAVES, max(1, -(-total // leaf_points)))
    tree = Tree(sample, max(1, -(-len(sample) // wanted)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(tree.leaf_of(_matrix(b)), pa.int32()), b.column("radius"), *(b.column(a) for a in AXES)], NAMES)

    placed = kept(points.select("id", "n", F.lit(0).alias("leaf"), F.lit(float(cutoff)).alias("radius"), *AXES).mapInArrow(place, POINT), "placed")
    first = kept(_past_leaves(placed, placed, tree.leaves, mutual_k), "own-leaf")
    second = None
    if tree.leaves > 1:
        reach = _ranked(first).groupBy("id").agg(F.min(F.when(F.col("upto") >= mutual_k, F.col("distance"))).alias("reach"))
        bounded = placed.join(reach, "id", "left").withColumn("radius", F.coalesce("reach", "radius")).select(*NAMES)
        second = _past_leaves(placed, _visits(bounded, _boxes(placed, tree.leaves)), tree.leaves, mutual_k)
    every = first if second is None else first.union(second)
    keeps = _ranked(every).where(F.col("closer") < mutual_k).select(F.col("other").alias("anchor"), F.col("id").alias("neighbour"), "distance")
    keeps.repartitionByRange("anchor").sortWithinPartitions("anchor", "distance").write.mode("overwrite").parquet(f"{folder}/keeps")
    return read(rows.sparkSession, folder)


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(keeps, tracks) as build() has stored them."""
    return spark.read.parquet(f"{folder}/keeps"), spark.read.parquet(f"{folder}/tracks")


def ask(keeps: DataFrame, tracks: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(anchor, place, neighbour, distance): for each of ``anchors`` (id), the first ``limit`` tracks that keep it, nearest first, ties by id."""
    asking = kept(tracks.join(anchors.select("id").distinct(), "id", "left_semi"), "asking")
    own = asking.select(F.col("point").alias("anchor")).distinct()
    ends = own.agg(F.min("anchor").alias("low"), F.max("anchor").alias("high"), F.count("*").alias("n")).first()
    few = [r["anchor"] for r in own.collect()] if ends["n"] <= FEW_ANCHORS else None
    asked = keeps.where(F.col("anchor").isin(few)) if few is not None else keeps.where(F.col("anchor").between(ends["low"], ends["high"]))
    found = asked.join(own, "anchor", "left_semi").select(F.col("anchor").alias("point"), F.col("neighbour").alias("other"), "distance")
    # One more than asked for is enough: a track is no neighbour of its own.
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("distance", "other"))).where(F.col("rank") <= limit + 1)
    # Points become tracks again, of those alike the first ones.
    firsts = tracks.join(best.select(F.col("other").alias("point")).distinct(), "point", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("id"))).where(F.col("n") <= limit + 1)
    spread = best.join(firsts.select(F.col("point").alias("other"), F.col("id").alias("neighbour")), "other").withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("distance", "neighbour"))).where(F.col("rank") <= limit + 1)
    met = asking.select(F.col("id").alias("anchor"), "point").join(spread, "point").where("anchor <> neighbour")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("distance", "neighbour"))).where(F.col("place") <= limit).select("anchor", "place", "neighbour", "distance")
