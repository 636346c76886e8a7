"""Quality classifier: naive Bayes log-count ratios times n-gram indicators, under a linear support vector machine."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features are hashed n-grams: as many weights, whatever the corpus, so the model's size is fixed (2 MB).
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on, about; all others are scored only.
SAMPLE = 12_000
WORDS_KEPT = 500_000
_PIECE = re.compile(rb"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+|\n")
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def _shape(text: bytes) -> list[int]:
    """Features of the whole text, as words that no text has: how much of it repeats, shouts, is not letters, or is short."""
    words = text.split()
    n = len(words)
    if not n:
        return [zlib.crc32(b"\0empty")]
    upper = sum(w.isupper() for w in words) / n
    odd = sum(not (w[0] >= 128 or w[:1].isalpha()) or not (w[-1] >= 128 or w[-1:].isalpha() or w[-1:] in b".,") for w in words) / n
    distinct = len(set(words)) / n ** 0.9
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lines = text.split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    grade = lambda x: int(x * 20 + 0.5) if x < 0.1 else int(x * 10) + 2
    found = [("upper", grade(upper)), ("odd", grade(odd)), ("distinct", grade(min(distinct, 2))), ("twice", grade(twice)), ("lines", grade(repeated)), ("words", n.bit_length()), ("per line", (n // len(lines)).bit_length())]
    return [zlib.crc32(f"\0{name} {x}".encode()) for name, x in found]


def features(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct hashed features of a text: pieces (words, or signs in a row), pairs of neighbours, and its shape."""
    pieces = np.fromiter((hashes[w] for w in _PIECE.findall(text)), np.uint64)
    pairs = (pieces[:-1] * _M[0] + pieces[1:]) * _M[1] >> np.uint64(40)
    single = pieces * _M[1] >> np.uint64(40)
    shape = np.array(_shape(text), np.uint64) * _M[0] >> np.uint64(40)
    return np.unique(np.concatenate([single, pairs, shape]) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """weights: of the indicators, log-count ratio times support-vector weight; slope and shift turn a margin into a score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(len(found), 1) ** 0.5 + self.bias

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30)))


def _dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the least hinge loss (L1 loss, L2 penalty), one dual variable at a time in random order."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    values = [ratio[x] / max(len(x), 1) ** 0.5 for x in rows]
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], quality: np.ndarray, smooth: float = 1.0, cost: float = 0.3, blend: float = 0.5, rounds: int = 20, seed: int = 42) -> Model:
    """Fit on feature rows and 0/1 labels; one class alone, or no rows, gives a constant score of its share."""
    good = quality == 1
    share = (good.sum() + 1) / (len(good) + 2)
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(side)]), minlength=BUCKETS) + smooth for side in (good, ~good)]
    ratio = np.log(counts[0] / (good.sum() + 2 * smooth)) - np.log(counts[1] / ((~good).sum() + 2 * smooth))
    ratio[counts[0] + counts[1] <= 2 * smooth] = 0
    y = np.where(good, 1.0, -1.0)
    balance = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    w, bias = _dual_descent(rows, y, ratio, cost * balance, rounds, seed)
    weights = ratio * ((1 - blend) * np.abs(w[ratio != 0]).mean() + blend * w)
    model = Model(weights, bias, 1.0, 0.0)
    margins = np.array([model.margin(x) for x in rows])
    slope, shift = _logistic(margins, good)
    return Model(weights, model.bias, slope, shift)


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the labels, by Newton's method on scaled margins."""
    scale = margins.std() or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how: float) -> Model:
    """Fit on about ``sample`` rows (all, if fewer) of ``docs`` that have a label and are not held out.

    Held out are rows whose crc32(doc_id as text) mod 3 is 1. The sample takes doc_ids of small hash and is a
    stated bound on what reaches the driver: its labels and features. A doc_id labelled twice takes its larger label.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    limit = int(2**63 * min(1.0, sample / max(n, 1))) - 1
    taken = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= limit)
    if n > 2 * sample:
        taken = taken.limit(2 * sample)  # of twice the rows that the hash takes on average: bounds the broadcast

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            found = [features(t, hashes).tobytes() for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(found, pa.binary())], ["quality", "found"])

    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(work, "quality int, found binary").toArrow()
    found = [np.frombuffer(x, np.int32) for x in rows.column("found").to_pylist()]
    quality = rows.column("quality").to_numpy() if rows.num_rows else np.zeros(0, int)
    order = sorted(range(len(found)), key=lambda i: (found[i].tobytes(), quality[i]))  # rows come in any order
    return fit_rows([found[i] for i in order], quality[order], **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, held_out, score (0 to 1, higher: quality likelier), predicted (score >= 0.5).

    The text alone is scored, whole; null and empty texts score alike. Rows without a doc_id are not held out. Repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = _Hashes(), shared.value
        for b in batches:
            scores = [float(m.score(features(t, hashes))) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how: float) -> DataFrame:
    """``docs``, all columns, without the rows whose score is below ``threshold``; the score is computed row by row, without a join."""
    model = fit(docs, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = _Hashes(), shared.value
        for b in batches:
            yield b.filter(pa.array([bool(m.score(features(t, hashes)) >= threshold) for t in _texts(b)], pa.bool_()))

    return docs.mapInArrow(work, schema)
