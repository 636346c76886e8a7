"""Removal of repeated passages by recompression.

Equal stretches of words are parsed into equal symbols, whatever surrounds them, in rounds: each round names runs of one
token or pairs of neighbours by their content alone, so the names agree on all machines without a dictionary. Symbols that
two documents share show where passages may repeat; only there are the windows of words named and compared.

Between the rounds and the comparison, Spark shuffles packed rows (a bucket, many names), not a row per symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_last, maybe_in, save

#: Words beyond what decides a symbol that its key covers too, on each side.
MARGIN = 1
WORDS_KEPT = 250_000
#: Bytes of text whose names one bucket holds, about; the number of buckets grows with the corpus.
BUCKET_BYTES = 32 << 20
#: Names that a task gathers before it packs and sends them.
GATHER = 500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_P, _Q = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64(2**64 - 1)


def _times(constant: np.uint64, n: int) -> np.uint64:
    return np.uint64((int(constant) * n) & (2**64 - 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Names(dict):
    """64-bit names of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = name = xxhash.xxh64_intdigest(word)
        return name


class Words:
    """The words of several texts by name, in one array, a barrier after each text."""

    def __init__(self, texts: list[bytes], names: _Names) -> None:
        flat: list[bytes] = []
        sizes = []
        for t in texts:
            words = t.split()
            flat += words
            flat.append(b" ")
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.names = np.fromiter(map(names.__getitem__, flat), np.uint64, len(flat))
        self.text = np.repeat(np.arange(len(sizes)), self.sizes + 1)
        self.barriers = np.cumsum(self.sizes + 1) - 1
        self.place = np.arange(len(flat)) - np.repeat(self.barriers - self.sizes, self.sizes + 1)

    def window_starts(self, size: int) -> np.ndarray:
        """Where windows of ``size`` words of one text start."""
        return np.flatnonzero(self.place <= (self.sizes - size)[self.text])

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Names of the windows at ``starts``."""
        total = np.zeros(len(starts), np.uint64)
        for j in range(size):
            total = total * _P + self.names[starts + j]
        return _mix(total + _times(_A, size))

    def checks(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Second names, of 32 bits, of the windows at ``starts``."""
        total = np.zeros(len(starts), np.uint64)
        for j in range(size):
            total = (total ^ self.names[starts + j]) * _Q
        return (_mix(total) >> np.uint64(32)).astype(np.uint32)


def recompress(names: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, low, high) of the symbols that cover the words after ``rounds`` rounds, in order.

    First, each maximal run of equal words becomes one symbol, named by the word and the length. Then each round deals
    all symbols to a left and a right side by a bit of their names, and every left symbol followed by a right one becomes
    one symbol named by the two. The words from low to before high decide a symbol: wherever they stand, they are parsed to it,
    with the same low and high beside it. A low below 0, or a high beyond the last word, says that the end of the array decides too.
    """
    n = len(names)
    start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n]
    symbol = np.where(end - start > 1, _mix(names[start] * _P + (end - start).astype(np.uint64)), names[start])
    low, high = start - 1, end + 1
    for r in range(1, rounds + 1):
        right = (_mix(symbol + _times(_A, r)) >> np.uint64(63)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:])
        # A symbol that stays alone does so by its neighbour on the side where it could have joined.
        before, after = np.r_[np.full(min(len(symbol), 1), -1), low[:-1]], np.r_[high[1:], np.full(min(len(symbol), 1), n + 1)]
        alone_low, alone_high = np.where(right, np.minimum(low, before), low), np.where(right, high, np.maximum(high, after))
        alone_low[at], alone_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        symbol[at] = _mix(symbol[at] * _P + symbol[at + 1] + _times(_C, r))
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, low, high = symbol[keep], alone_low[keep], alone_high[keep]
    return symbol, low, high


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of ``size`` words start, and the key of each window's anchor.

    The anchor is the symbol of smallest key among those that the window's own words decide, with MARGIN words on either side;
    its key is the name of all these words. So windows of equal words have equal anchors wherever they stand, and neighbouring windows
    mostly share theirs. A window that decides no symbol is its own anchor.
    """
    names = words.names
    _, low, high = recompress(names)
    low, high = low - MARGIN, high + MARGIN
    inside = (low >= 0) & (high <= len(names)) & (high - low <= size)
    low, high = low[inside], high[inside]
    key = np.zeros(len(low), np.uint64)
    for j in range(int((high - low).max()) if len(low) else 0):
        more = low + j < high
        key[more] = key[more] * _P + names[low[more] + j]
    key = _mix(key + (high - low).astype(np.uint64) * _A) >> np.uint64(1)
    order = np.argsort(key)[::-1]  # where two begin at one word, the smaller key is written last
    low, high, key = low[order], high[order], key[order]
    best = np.full(len(names), _LAST)
    for j in range(size):
        fits = (low >= j) & (high - low + j <= size)
        here = np.full(len(names), _LAST)
        here[low[fits] - j] = key[fits]
        best = np.minimum(best, here)
    starts = words.window_starts(size)
    best = best[starts]
    own = np.flatnonzero(best == _LAST)
    best[own] = words.windows(starts[own], size) | np.uint64(1 << 63)
    return starts, best


# --- packed rows ---


def _planes(values: np.ndarray) -> bytes:
    """Values byte by byte, equal bytes of all side by side: what is alike packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def _stretches(*sorted_by: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    if not len(sorted_by[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([v[1:] != v[:-1] for v in sorted_by])])


def _packed(bucket: np.ndarray, known: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket, of entries that are ``known`` to repeat and of others."""
    order = np.lexsort((columns["id"], known, bucket))
    bucket, known = bucket[order], known[order]
    begin = _stretches(bucket, known)
    parts = list(zip(begin.tolist(), np.r_[begin[1:], len(bucket)].tolist(), strict=True))
    arrays = [pa.array([_planes(v[a:z]) for a, z in parts], pa.binary()) for v in (v[order] for v in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array(known[begin], pa.bool_()), *arrays], ["bucket", "known", *columns])


def _by_id(ids: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each id, with the values of its entries."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begin = _stretches(ids)
    ends = np.r_[begin, len(ids)]

    def cut(values: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(values[order])
        return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])

    return pa.RecordBatch.from_arrays([pa.array(ids[begin], pa.int64()), *(cut(v) for v in columns.values())], ["id", *columns])


def _met(made: Iterator[dict[str, np.ndarray]], name: tuple[str, ...], buckets: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows of entries that share a ``name`` with others, gathered over batches.

    Of equal names that a task has gathered, only those of the smallest id go to their bucket, so a name that very many documents
    hold is not one bucket's work; the others are known to repeat: with ``cut`` those after the smallest id, else all.
    """

    def pack(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        e = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        order = np.lexsort((e["id"], *(e[c] for c in reversed(name))))
        e = {c: v[order] for c, v in e.items()}
        if not cut:
            once = _stretches(e["id"], *(e[c] for c in name))
            e = {c: v[once] for c, v in e.items()}
        begin = _stretches(*(e[c] for c in name))
        sizes = np.diff(np.r_[begin, len(e["id"])])
        later = e["id"] > np.repeat(e["id"][begin], sizes)
        several = later if cut or not len(begin) else np.repeat(np.maximum.reduceat(later, begin), sizes)
        sent, told = np.flatnonzero(~later), np.flatnonzero(several)
        to = np.r_[(e[name[0]][sent] % np.uint64(buckets)).astype(np.int32), _id_bucket(e["id"][told], buckets)]
        known = np.arange(len(to)) >= len(sent)
        return _packed(to, known, {c: v[np.r_[sent, told]] for c, v in e.items()})

    held, n = [], 0
    for e in made:
        held.append(e)
        n += len(e["id"])
        if n >= GATHER:
            yield pack(held)
            held, n = [], 0
    if n:
        yield pack(held)


def _unpack(rows: list[dict], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([_values(r[c], kind) for r in rows]) for c, kind in kinds.items()}


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The packed rows of each bucket, of batches sorted by bucket."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0]["bucket"] != r["bucket"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _repeats(batches: Iterator[pa.RecordBatch], name: tuple[str, ...], kinds: dict[str, type], back: tuple[str, ...], buckets: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows, by bucket of id, of the entries whose name another document has (``cut``: one of smaller id)."""
    held, n = [], 0
    for rows in _buckets(batches):
        known = [r for r in rows if r["known"]]
        found = [_unpack(known, kinds)] if known else []
        if others := [r for r in rows if not r["known"]]:
            e = _unpack(others, kinds)
            order = np.lexsort((e["id"], *(e[c] for c in reversed(name))))
            e = {c: v[order] for c, v in e.items()}
            begin = _stretches(*(e[c] for c in name))
            sizes = np.diff(np.r_[begin, len(order)])
            later = e["id"] > np.repeat(e["id"][begin], sizes)
            hit = later if cut else np.repeat(np.maximum.reduceat(later, begin), sizes)
            found.append({c: v[hit] for c, v in e.items()})
        held += [{c: e[c] for c in ("id", *back)} for e in found]
        n += sum(len(e["id"]) for e in found)
        if n >= GATHER:
            yield _to_ids(held, buckets)
            held, n = [], 0
    if n:
        yield _to_ids(held, buckets)


def _to_ids(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    e = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    return _packed(_id_bucket(e["id"], buckets), np.ones(len(e["id"]), bool), e)


def _id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64) + _A) % np.uint64(buckets)).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[pa.RecordBatch]:
    """One row for each id, with the values of all its entries, of packed rows sorted by bucket of id."""
    for rows in _buckets(batches):
        e = _unpack(rows, kinds)
        yield _by_id(e.pop("id"), e)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def dedup_passages(docs: DataFrame, size: int = 13, buckets: int | None = None, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Each word covered by a window of ``size`` (13 or more) consecutive words that also starts in a document of smaller doc_id
    is removed; windows are judged on the input. kept_text is what stays, one space between words (null without ``texts``).

    Steps: (1) anchors of all documents meet by key, and those of two documents or more go back to their
    documents; (2) documents name the windows of those anchors, in 96 bits, which meet by name; (3) windows with a smaller
    document go back, are compared with the words by a second name, and the words under them are cut. Rows of the shuffles are packed by
    bucket; a task holds the names of one bucket at a time, and the number of buckets grows with the bytes of the corpus. Documents meet
    their anchors and windows by doc_id in joins, and only those that have some are shuffled.

    Null and empty texts have no words. Rows without a doc_id count as later than all others, and rows of one doc_id do
    not remove each other's words. Repeated rows get equal results; an empty table gives none; other columns are not read.
    """
    if size < 13:
        raise ValueError("an anchor is sure to be shared by many windows of 13 words or more only")
    if buckets is None:
        held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    rows = docs.select(id_or_last().alias("id"), "text")
    key_kinds = {"id": np.int64, "key": np.uint64}
    window_kinds = {"id": np.int64, "window": np.uint64, "check": np.uint32, "pos": np.uint32}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()

        def made() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                words, ids = Words(_texts(b), names), b.column("id").to_numpy()
                starts, key = anchors(words, size)
                text = words.text[starts]
                change = _stretches(text, key)
                yield {"id": ids[text[change]], "key": key[change]}

        yield from _met(made(), ("key",), buckets, cut=False)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()

        def made() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                words, ids = Words(_texts(b), names), b.column("id").to_numpy()
                starts, key = anchors(words, size)
                asked = [np.frombuffer(k, np.uint64) for k in b.column("key").to_pylist()]
                # A key is asked for by its document: both in one number.
                of = _mix(np.repeat(np.arange(len(asked)), list(map(len, asked))).astype(np.uint64) + _A)
                hit = starts[np.isin(key ^ _mix(words.text[starts].astype(np.uint64) + _A), np.concatenate([np.zeros(0, np.uint64), *asked]) ^ of)]
                yield {"id": ids[words.text[hit]], "window": words.windows(hit, size), "check": words.checks(hit, size), "pos": words.place[hit].astype(np.uint32)}

        yield from _met(made(), ("window", "check"), buckets, cut=True)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for b in batches:
            found, checks, out = b.column("pos").to_pylist(), b.column("check").to_pylist(), []
            some = [i for i, c in enumerate(found) if c]
            every = _texts(b)
            words = Words([every[i] for i in some], names)
            first = words.barriers - words.sizes
            for i, text in enumerate(every):
                split = stays = text.split()
                if found[i]:
                    j = some.index(i) if len(some) < 8 else int(np.searchsorted(some, i))
                    at, check = np.frombuffer(found[i], np.uint32).astype(np.int64), np.frombuffer(checks[i], np.uint32)
                    fits = at <= len(split) - size
                    at, check = at[fits], check[fits]
                    at = np.unique(at[words.checks(first[j] + at, size) == check])
                    edges = np.zeros(len(split) + 1, np.int64)
                    edges[at] += 1
                    edges[at + size] -= 1
                    stays = [split[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                text = b" ".join(stays)
                out.append((len(split), len(split) - len(stays), hashlib.sha256(text).hexdigest(), text if texts else None))
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    def repeats(found: DataFrame, name: tuple[str, ...], kinds: dict[str, type], back: tuple[str, ...], cut: bool) -> DataFrame:
        """(id, values of ``back``): a row for each document with entries that repeat."""
        sent = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
        columns = ", ".join(f"{c} binary" for c in back)
        told = sent(found).mapInArrow(lambda b: _repeats(b, name, kinds, back, buckets, cut), f"bucket int, known boolean, id binary, {columns}")
        return sent(told).mapInArrow(lambda b: _gathered(b, {"id": np.int64} | {c: kinds[c] for c in back}), f"id long, {columns}")

    found = rows.mapInArrow(keys, "bucket int, known boolean, id binary, key binary")
    met = save(repeats(found, ("key",), key_kinds, ("key",), False), "met-anchors")
    test = maybe_in(met.select(F.xxhash64("id")))(F.xxhash64("id"))
    held = rows.where(test)  # one shuffle by id serves both joins
    found = held.join(met, "id").mapInArrow(windows, "bucket int, known boolean, id binary, window binary, check binary, pos binary")
    cuts = repeats(found, ("window", "check"), window_kinds, ("pos", "check"), True)
    none = F.lit(None).cast("binary")
    whole = rows.where(~test).withColumns({"pos": none, "check": none})
    parts = held.join(cuts, "id", "left")
    return whole.union(parts).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text", "pos", "check").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
