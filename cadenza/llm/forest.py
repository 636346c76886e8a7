"""Nearest neighbours through a forest of sorted hash strings (prefix trees kept as sorted arrays)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

TREES = 96
#: Bits of a hash string: the longest prefix that two rows can share.
BITS = 32
#: Rows of an index shard, about, and queries that visit it together.
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Candidates that a query takes from a shard, at least.
CANDIDATES = 2600
SEED = 42


def planes(dims: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Normals of the hyperplanes whose sides are the hash bits, the same on every machine."""
    return np.random.default_rng(SEED).standard_normal((dims, trees * bits))


def hash_strings(rows: np.ndarray, normals: np.ndarray, centre: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(tree, row) hash strings as whole numbers of ``bits`` bits, the first bit the highest."""
    sides = ((rows - centre) @ normals > 0).reshape(len(rows), trees, bits)
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return (sides * weights).sum(2, dtype=np.uint64).T.copy()


class Forest:
    """For each tree the rows' hash strings in ascending order: a prefix is a stretch of the array."""

    def __init__(self, rows: np.ndarray, normals: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.centre = rows.mean(0)
        self.normals, self.trees, self.bits, self.n = normals, trees, bits, len(rows)
        strings = hash_strings(rows, normals, self.centre, trees, bits)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, 1)

    def stretches(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, tree, length) begin and end of the rows that share the query's first ``length`` bits, for lengths 0 to bits."""
        own = hash_strings(queries, self.normals, self.centre, self.trees, self.bits)
        low = np.empty((len(queries), self.trees, self.bits + 1), np.int32)
        high = np.empty_like(low)
        for length in range(self.bits + 1):
            rest = np.uint64(self.bits - length)
            first = (own >> rest) << rest
            last = first + ((np.uint64(1) << rest) - np.uint64(1))
            for t in range(self.trees):
                low[:, t, length] = np.searchsorted(self.strings[t], first[t], "left")
                high[:, t, length] = np.searchsorted(self.strings[t], last[t], "right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        """Rows found by one query: all trees descend to the longest prefix that is there, then ascend together, a bit at a time, until ``least`` rows are found."""
        found = np.zeros(self.n, bool)
        sums = (high - low).sum(0)
        for length in range(int(np.flatnonzero(sums >= min(least, self.n))[-1]), -1, -1):
            for t in range(self.trees):
                found[self.order[t, low[t, length] : high[t, length]]] = True
            if np.count_nonzero(found) >= least or length == 0:
                break
        return np.flatnonzero(found)


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; a vec_id that repeats counts once, with the least of its vectors."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return good.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v.cast("array<double>")).alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` to each of ``queries`` (both vec_id, embedding): query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision on the original vectors; the nearest comes first, ties go to the
    smaller vec_id; a query's own vec_id is left out. Every vector is indexed: rows are dealt to shards of about
    SHARD_ROWS, each of which makes its forest, and queries visit all shards in blocks of QUERY_BLOCK. In a shard a query takes
    at least ``candidates`` rows (all of a smaller shard) and keeps its best ``k``; the best of all shards are the result.
    The recall that this gives is measured in the tests and stated in the README.

    Rows whose vec_id or vector is null, whose vector is empty, zero, or holds a null, NaN or infinity take no part; vectors
    meet only vectors of their own length. Fewer than ``k`` other rows give fewer ranks; an empty table gives none.
    """
    rows = save(_clean(vectors).withColumn("dims", F.size("v")), "vectors")
    asked = save(_clean(queries).withColumn("dims", F.size("v")), "queries")
    n_shards, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, SHARD_ROWS), (asked, QUERY_BLOCK)))
    cell = lambda shard, block: F.struct("dims", shard.cast("int").alias("shard"), block.cast("int").alias("block")).alias("cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", upto(n_blocks)).select(cell(F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)), F.col("block")), "vec_id", "v")
    right = asked.withColumn("shard", upto(n_shards)).select(cell(F.col("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        ids, names = mine.column("vec_id").to_numpy(), theirs.column("vec_id").to_numpy()
        points, asks = (np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (mine, theirs))
        forest = Forest(points, planes(points.shape[1], trees, bits), trees, bits)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(asks), 128):
            low, high = forest.stretches(asks[begin : begin + 128])
            for i in range(len(low)):
                q = begin + i
                found = forest.candidates(low[i], high[i], candidates)
                found = found[ids[found] != names[q]]
                score = np.sqrt(((points[found] - asks[q]) ** 2).sum(1))
                best = np.lexsort((ids[found], score))[:k]
                out.append((np.full(len(best), names[q]), ids[found][best], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
