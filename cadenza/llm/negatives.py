"""Hard negatives by whole-number inner products, found through rotated one-bit codes with exact intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import finite, scaled
from .common import save

SEED = 42
#: Codes of a vector: each is of what the ones before it leave, under a rotation of its own.
LEVELS = 5
#: Bits to which an anchor's rotated components are rounded for the popcounts.
PLANES = 8
#: Rows of a shard, about: it is held by one task while anchors stream past it.
SHARD_ROWS = 4096


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, level: int) -> np.ndarray:
    """An orthogonal matrix of its own for each level, kept once made."""
    if (dims, level) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dims, level]).standard_normal((dims, dims)))
        _ROTATIONS[dims, level] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return _ROTATIONS[dims, level]


def _words(bits: np.ndarray) -> np.ndarray:
    """(n, words) of 64 bits each of (n, dims) booleans."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def encode(rows: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, levels, words) and alignments (n, levels) of vectors: the inner product of what a level codes with its code as a unit vector."""
    n, dims = rows.shape
    rest = rows.astype(np.float64)
    codes, pulls = [], np.empty((n, levels))
    for level in range(levels):
        turned = rest @ rotation(dims, level)
        code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dims)
        pulls[:, level] = (turned * code).sum(1)
        codes.append(_words(turned > 0))
        rest = (turned - pulls[:, level : level + 1] * code) @ rotation(dims, level).T
    return np.stack(codes, 1), pulls


class Anchors:
    """Anchors made ready for popcounts: at each level their rotated components, rounded to PLANES bits, as masks of bits of equal weight."""

    def __init__(self, rows: np.ndarray, levels: int = LEVELS) -> None:
        self.rows, self.dims = rows, rows.shape[1]
        self.norms = np.linalg.norm(rows.astype(np.float64), axis=1)
        self.least, self.step, self.error, self.sums = (np.empty((len(rows), levels)) for _ in range(4))
        self.masks = np.empty((len(rows), levels, PLANES, -(-self.dims // 64)), np.uint64)
        for level in range(levels):
            turned = rows @ rotation(self.dims, level)
            least = turned.min(1)
            step = np.maximum((turned.max(1) - least) / (2**PLANES - 1), 1e-300)
            whole = np.rint((turned - least[:, None]) / step[:, None]).astype(np.int64)
            self.error[:, level] = np.linalg.norm(turned - (least[:, None] + step[:, None] * whole), axis=1)
            self.least[:, level], self.step[:, level], self.sums[:, level] = least, step, whole.sum(1)
            for p in range(PLANES):
                self.masks[:, level, p] = _words((whole >> p & 1).astype(bool))


class Shard:
    """The coded rows of a shard; answers by whole-number scores of the rows whose intervals leave a doubt. ``scored`` counts those."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, codes: np.ndarray, pulls: np.ndarray) -> None:
        self.ids, self.labels, self.rows, self.pulls = ids, labels, rows, pulls
        self.codes = codes.transpose(1, 2, 0).copy()  # (level, word, row)
        squares = (rows.astype(np.float64) ** 2).sum(1)
        self.norms = np.sqrt(squares)
        #: Length of what is left of a row after each level, rounded up.
        self.rest = np.sqrt(np.maximum(squares[:, None] - np.cumsum(pulls**2, axis=1), 0) + 1e-9 * squares[:, None])
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        self.scored = 0

    def level(self, asked: Anchors, i: int, level: int, at: np.ndarray, mid: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, mid, slack) of anchor ``i``'s scores of rows ``at``, one level on from the ``mid`` and ``slack`` of the level before.

        Popcounts give the inner product s of the anchor with the code, up to its rounding, whose length bounds the error. What the code
        leaves of the row is orthogonal to it; by Cauchy and Schwarz its product with the anchor is at most its length times
        that of the anchor's part orthogonal to the code.
        """
        code = self.codes[level][:, at]
        counts = np.zeros(len(at))
        for p in range(PLANES):
            for word in range(len(code)):
                counts += np.bitwise_count(code[word] & asked.masks[i, level, p, word]) * np.float64(1 << p)
        error, norm = asked.error[i, level], asked.norms[i]
        s = (asked.least[i, level] * (2 * self.ones[level, at] - asked.dims) + asked.step[i, level] * (2 * counts - asked.sums[i, level])) / math.sqrt(asked.dims)
        pull = self.pulls[at, level]
        mid, slack = mid + pull * s, slack + np.abs(pull) * error
        across = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(s) - error, 0) ** 2, 0))
        half = slack + self.rest[at, level] * across + 1e-9 * norm * self.norms[at] + 1e-6
        return np.ceil(mid - half), np.floor(mid + half), mid, slack

    def best(self, asked: Anchors, i: int, at: np.ndarray, k: int, spans: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``spans`` (low, high): (row, score) of the first ``k`` of rows ``at`` whose score with anchor ``i`` is in it, highest first, ties by id."""
        lower, upper = np.full(len(at), -np.inf), np.full(len(at), np.inf)
        mid, slack = np.zeros(len(at)), np.zeros(len(at))
        for level in range(len(self.codes)):
            if not len(at):
                break
            a, b, mid, slack = self.level(asked, i, level, at, mid, slack)
            lower, upper = np.maximum(lower, a), np.minimum(upper, b)
            stays = np.zeros(len(at), bool)
            for low, high in spans:
                sure = lower[(lower >= low) & (upper <= high)]
                bar = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
                stays |= (upper >= max(low, bar)) & (lower <= high)
            at, lower, upper, mid, slack = at[stays], lower[stays], upper[stays], mid[stays], slack[stays]
        score = self.rows[at] @ asked.rows[i]
        self.scored += len(at)
        order = np.lexsort((self.ids[at], -score))
        at, score = at[order], score[order]
        held = [np.flatnonzero((score >= low) & (score <= high))[:k] for low, high in spans]
        return [(at[h], score[h]) for h in held]


def coded_vectors(vectors: DataFrame, scale: int = 256, levels: int = LEVELS) -> DataFrame:
    """(vec_id, label, dims, v, codes, pulls) of the rows that take part: whole-number vectors, their codes and stored alignments."""
    v, label = F.col("embedding"), F.col("label").cast("int")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    good = vectors.where(finite(v) & (F.size(v) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    whole = good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled(v, scale).alias("v"))
    whole = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", F.size("row.v").alias("dims"), "row.v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("dims").to_numpy()
            for dims in np.unique(size).tolist():
                t = b.filter(pa.array(size == dims))
                codes, pulls = encode(np.array(t.column("v").flatten(), np.int64).reshape(t.num_rows, dims), levels)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1) * levels, pa.int32()), pa.array(pulls.ravel()))
                yield pa.RecordBatch.from_arrays([t.column("vec_id"), t.column("label"), t.column("dims"), t.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), lists], ["vec_id", "label", "dims", "v", "codes", "pulls"])

    return whole.mapInArrow(work, "vec_id long, label int, dims int, v array<int>, codes binary, pulls array<double>")


def _past_shards(rows: DataFrame, anchors: DataFrame, shard_rows: int, answer: object, schema: str) -> DataFrame:
    """``answer(shard, anchors batch)`` for each shard of ``rows`` and all ``anchors`` of its vectors' length.

    Rows are shuffled once. Sorting puts a shard's rows before its anchors, so a task holds one shard and lets anchors pass in batches.
    """
    n = max(1, -(-rows.count() // shard_rows))
    wide = anchors.columns[5:]  # what anchors carry besides the columns of rows
    blank = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in wide]
    left = rows.select("dims", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "label", "v", "codes", "pulls", *blank)
    right = anchors.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "label", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<double>").alias("pulls"), *wide)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, now = [], None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("dims", "shard", "kind")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == z:
                    continue
                dims, number, kind = keys[a].tolist()
                if (dims, number) != now:
                    held, shard, now = [], None, (dims, number)
                part = b.slice(a, z - a)
                if kind == 0:
                    held.append(part)
                elif held or shard:
                    if shard is None:
                        t = pa.Table.from_batches(held).combine_chunks()
                        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint64)
                        pulls = np.array(t.column("pulls").combine_chunks().flatten()).reshape(t.num_rows, -1)
                        rows_of = np.array(t.column("v").combine_chunks().flatten(), np.int64).reshape(t.num_rows, dims)
                        shard, held = Shard(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), rows_of, codes.reshape(t.num_rows, pulls.shape[1], -1), pulls), []
                    yield answer(shard, part)

    return left.union(right).repartition(2 * n, "dims", "shard").sortWithinPartitions("dims", "shard", "kind").mapInArrow(work, schema)


def _asked(part: pa.RecordBatch, levels: int) -> tuple[list[int], list[int], Anchors]:
    dims = part.column("dims")[0].as_py()
    return part.column("vec_id").to_pylist(), part.column("label").to_pylist(), Anchors(np.array(part.column("v").flatten(), np.int64).reshape(-1, dims), levels)


def hard_negatives(vectors: DataFrame, anchor_step: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, levels: int = LEVELS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) mined from ``vectors`` (vec_id, embedding, label).

    Components become floor(``scale`` * x); where vec_id is divisible by 7 the label becomes (label + 1) % 10. A row's score is its whole-number
    inner product with the anchor; higher scores come first, ties by smaller vec_id. Anchors are rows whose vec_id is divisible by
    ``anchor_step``; an anchor's positives are its first ``n_positives`` other rows of its label. For each, the first ``n_negatives``
    rows of other labels whose score is from ``low`` to ``high`` percent of the positive's are returned, ranked from 1.

    Each row is stored with ``levels`` one-bit codes, each a sign pattern under a rotation of its own of what the codes before leave,
    and its alignments with them. An anchor's popcounts against the codes give an estimate, and lengths of what is left an interval that holds
    the score without fail; rows whose intervals rule them out go, level by level, and the rest are scored in whole numbers. So the
    result is exact. Anchors stream past shards of about ``shard_rows`` rows; a shard gives at most as many rows as are asked for.

    Rows whose vec_id, label or vector is null, whose vector is empty or holds a null, NaN or infinity take no part. A vec_id that
    repeats counts once, with the least of its labels and vectors. Vectors meet only those of their own length. Anchors without
    positives, and positives without negatives (as all of negative score are), give no rows; an empty table gives none.
    """
    rows = save(coded_vectors(vectors, scale, levels), "coded-vectors")
    anchors = rows.where(F.col("vec_id") % anchor_step == 0).select("dims", "vec_id", "label", "v", "codes")

    def same(shard: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        names, labels, asked = _asked(part, levels)
        for i, (name, label) in enumerate(zip(names, labels, strict=True)):
            [(at, score)] = shard.best(asked, i, np.flatnonzero((shard.labels == label) & (shard.ids != name)), n_positives, [(-np.inf, np.inf)])
            out += [(name, j, s) for j, s in zip(shard.ids[at].tolist(), score.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], ["anchor_id", "positive_id", "positive_score"])

    found = _past_shards(rows, anchors, shard_rows, same, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = save(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n_positives).drop("n"), "positives")
    lists = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    def other(shard: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int, int]] = []
        names, labels, asked = _asked(part, levels)
        for i, (name, label, wanted) in enumerate(zip(names, labels, part.column("positives").to_pylist(), strict=True)):
            spans = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in wanted]
            open_ = [(p, span) for p, span in zip(wanted, spans, strict=True) if span[0] <= span[1]]
            for (p, _), (at, score) in zip(open_, shard.best(asked, i, np.flatnonzero(shard.labels != label), n_negatives, [span for _, span in open_]), strict=True):
                out += [(name, p["positive_id"], p["positive_score"], j, x) for j, x in zip(shard.ids[at].tolist(), score.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 5)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    asked = anchors.join(lists, "vec_id").select("dims", "vec_id", "label", "v", "codes", "positives")
    found = _past_shards(rows, asked, shard_rows, other, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
