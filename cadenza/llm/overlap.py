"""Jaccard join of shingle sets by T-occurrence search over inverted lists (DivideSkip)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, maybe_in, save, text_key
from .graph import connected_components
from .simhash import BROADCAST_HALVES, ORDER_BUCKETS, SEED, Groups, _open_halves, _runs, _texts, shingle_hashes

#: Sets of one class in a cell, at most, and shingles of them, about: more are dealt to several cells.
CELL_SETS = 256
CELL_SHINGLES = 1 << 22
#: The same where only sizes and parity bits are compared.
LIGHT_SETS, LIGHT_SHINGLES = 4096, 1 << 28
#: Cost of a probe against that of a merge step, by which lists are called long (the published heuristic's constant).
MU = 0.0085


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest i with ``100 i >= percent (a + b - i)``."""
    return -(-percent * (a + b) // (100 + percent))


def least_size(n: int, percent: int) -> int:
    """The smallest size of a set that can link with one of size ``n``."""
    return -(-percent * n // 100)


def merge_skip(owners: list[int], lists: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """(owner, count) of the owners that are on at least ``least`` of ``lists``, stretches of the sorted ``owners``.

    A heap holds each list's head. Heads that are equal are counted; if they are too few, so many more are popped that what is left could not
    reach ``least`` before the next head, and all popped lists skip to it by binary search.
    """
    heap = [(owners[a], a, z) for a, z in lists]
    heapq.heapify(heap)
    while len(heap) >= least:
        owner, popped = heap[0][0], []
        while heap and heap[0][0] == owner:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield owner, len(popped)
            moved = ((a + 1, z) for _, a, z in popped)
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            to = heap[0][0]
            moved = ((bisect_left(owners, to, a, z), z) for _, a, z in popped)
        for a, z in moved:
            if a < z:
                heapq.heappush(heap, (owners[a], a, z))


def search(sets: list[np.ndarray], percent: int, groups: Groups) -> None:
    """Joins in ``groups`` all of ``sets`` (each distinct numbers, ascending by size) that link.

    Each set asks the inverted lists of those before it. Of its lists, the L longest are set apart; a candidate must be on T - L of the others,
    which are heap-merged, and is then looked up in the long ones by binary search. Candidates that are already in the set's group are not looked up.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    places = np.sort(local.astype(np.int64) * m + np.repeat(np.arange(m), size))  # (list, owner) as one number
    owners = (places % m).tolist()
    for i in range(1, m):
        n = int(size[i])
        low = int(np.searchsorted(size[:i], least_size(n, percent)))
        if low == i:
            continue
        mine = local[starts[i] : starts[i + 1]].astype(np.int64) * m
        begin, end = np.searchsorted(places, mine + low), np.searchsorted(places, mine + i)
        length = end - begin
        held = np.flatnonzero(length)
        need = least_overlap(n, int(size[low]), percent)
        if len(held) < need:
            continue
        held = held[np.argsort(length[held], kind="stable")]
        n_long = min(need - 1, int(need / (MU * math.log2(max(2, length[held[-1]])) + 1)))
        short, long_ = held[: len(held) - n_long], mine[held[len(held) - n_long :]]
        for j, count in merge_skip(owners, list(zip(begin[short].tolist(), end[short].tolist(), strict=True)), need - n_long):
            enough = least_overlap(n, int(size[j]), percent)
            if count + n_long < enough or groups.find(i) == groups.find(j):
                continue
            at = np.searchsorted(places, long_ + j)
            count += int(np.count_nonzero(places[np.minimum(at, len(places) - 1)] == long_ + j))
            if count >= enough:
                groups.join(i, j)


def _set_of(text: bytes, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n))


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _marked(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, row, k, size, shard, counts) of each row: its handle, its set's key and size, and its set's least shingle; k is null for an empty set.

    A task ends with a row of ``counts`` alone: in how many of its rows are the shingles of each of ORDER_BUCKETS buckets of hashes.
    """
    names = ["doc_id", "row", "k", "size", "shard", "counts"]
    lists = pa.list_(pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for b in batches:
            keys, sizes, shards, buckets = [], [], [], [np.zeros(0, np.int64)]
            for t in _texts(b):
                h = _set_of(t, shingle_words)
                buckets.append((h % np.uint64(ORDER_BUCKETS)).astype(np.int64))
                keys.append(_key(h) - 2**63 if len(h) else None)
                sizes.append(len(h))
                shards.append(int((h * np.uint64(0x9E3779B97F4A7C15)).min()) - 2**63 if len(h) else None)
            counts += np.bincount(np.concatenate(buckets), minlength=ORDER_BUCKETS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *(pa.array(c, pa.int64()) for c in (keys, sizes, shards)), pa.nulls(b.num_rows, lists)], names)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array([counts], lists)], names)

    return _read(docs).mapInArrow(work, "doc_id long, row long, k long, size long, shard long, counts array<long>")


def _common(marked: DataFrame) -> np.ndarray:
    """The counts of all tasks together: only an order, by which common shingles come last."""
    out = np.zeros(ORDER_BUCKETS, np.int64)
    for r in marked.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row is a handle by which a row is found again in another pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(id_or_last(), text_key()).alias("row"), "text")


def parity(found: np.ndarray) -> np.ndarray:
    """A set as about as many bits as it has members, rounded up to a power of two: each is whether an odd number of members falls on it.

    Two sets' bits differ in no more places than members are in one set alone; half of the bits can be folded onto the other half.
    """
    n = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    return np.packbits(np.bincount((found % np.uint64(n)).astype(np.int64), minlength=n) & 1, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray) -> np.ndarray:
    """(rows, words) of parity bits at half their number (of 64 bits: as they are)."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:] if half else bits


def may_link(sizes: np.ndarray, roots: np.ndarray, bits: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), at least a tree for each group, of sets ascending by size that sizes and parity bits do not rule out and whose roots differ."""
    lows = np.searchsorted(sizes, -(-percent * sizes // 100))
    open_ = np.flatnonzero(lows < np.arange(len(sizes))).tolist()
    if not open_ or (roots == roots[0]).all():
        return
    groups = Groups(len(sizes))
    words = np.array([len(b) for b in bits])
    at_width = {w: (np.flatnonzero(words == w), np.stack([bits[i] for i in np.flatnonzero(words == w)])) for w in np.unique(words).tolist()}
    none = np.zeros(0, np.int64)
    for i in open_:
        own = bits[i][None]
        for w in (words[i] >> n for n in range(int(words[i] // words[lows[i]]).bit_length())):
            own = own if own.shape[1] == w else fold(own)
            at, rows = at_width.get(w, (none, none))
            a, z = np.searchsorted(at, [lows[i], i])
            if a == z:
                continue
            differ = np.bitwise_count(rows[a:z] ^ own).sum(1, dtype=np.int64)
            both = sizes[at[a:z]] + sizes[i]
            near = (differ <= both - 2 * -(-percent * both // (100 + percent))) & (roots[at[a:z]] != roots[i])
            for j in at[a:z][near].tolist():
                if groups.find(i) != groups.find(j):
                    groups.join(i, j)
                    yield i, j


def _prefixes(docs: DataFrame, wanted: DataFrame, common: np.ndarray, shingle_words: int, percent: int) -> DataFrame:
    """(row, keys, bits): the first shingles of the sets of ``wanted`` (row), in one order for all, of which any two that link share one; parity bits.

    They share at least ``least_size`` of either one's n, so one of the first n - least_size + 1 of each, in any order; the rarest come first.
    """
    asked = maybe_in(wanted.select("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, bits = [], []
            for t in _texts(b):
                h = _set_of(t, shingle_words)
                n = len(h) - least_size(len(h), percent) + 1 if len(h) else 0
                keys.append(h[np.lexsort((h, common[(h % np.uint64(ORDER_BUCKETS)).astype(np.int64)]))[:n]].view(np.int64))
                bits.append(parity(h).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column("row"), lists, pa.array(bits, pa.binary())], ["row", "keys", "bits"])

    return _read(docs).where(asked(F.col("row"))).mapInArrow(work, "row long, keys array<long>, bits binary")


def _candidates(met: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(k, shard) of the sets of ``met`` (shard, k, root, size) that may link with one of another root: shard is the group that all it may link with are in.

    Only sizes and parity bits of sets (``bits``: k, bits) are compared here, and no set that could link is lost.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["cell"]):
            order = np.lexsort((cell.column("k").to_numpy(), cell.column("size").to_numpy()))
            names, sizes, roots = (cell.column(c).to_numpy()[order] for c in ("k", "size", "root"))
            held = [np.frombuffer(x, np.uint64) for x in cell.column("bits").take(order).to_pylist()]
            edges = list(may_link(sizes, roots, held, percent))
            yield pa.RecordBatch.from_arrays([pa.array([names[e[i]] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    cells = _cells(met, LIGHT_SETS, LIGHT_SHINGLES).join(bits, "k")
    edges = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, b long")
    return connected_components(save(edges.where("a <> b"), "overlap-maybe")).select(F.col("node").alias("k"), F.col("root").alias("shard"))


def _linked(docs: DataFrame, texts: DataFrame, met: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect the sets meeting in a cell of ``met`` (k, cell) as their links do.

    A set is made where its text is read, and only sets that meet others are shuffled, with all bits of their shingles' hashes.
    """
    wanted = save(met.groupBy("k").agg(F.collect_set("cell").alias("cells")).join(texts.select("k", "row"), "k"), "overlap-wanted")
    asked = maybe_in(wanted.select("row"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([_set_of(t, shingle_words).tobytes() for t in _texts(b)], pa.binary())], ["row", "shingles"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["cell"]):
            names, first = np.unique(cell.column("k").to_numpy(), return_index=True)
            held = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").take(first).to_pylist()]
            order = sorted(range(len(held)), key=lambda i: len(held[i]))
            if len(held) < 2:
                continue
            groups, names = Groups(len(held)), names[order]
            search([held[i] for i in order], percent, groups)
            edges = [(names[i], names[j]) for i in range(len(held)) if (j := groups.find(i)) != i]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    made = _read(docs).where(asked(F.col("row"))).mapInArrow(sets, "row long, shingles binary")
    spread = made.join(wanted, "row").dropDuplicates(["row"]).select("k", "shingles", F.explode("cells").alias("cell"))
    return save(spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, b long"), "overlap-edges")


def _parts(sets: Column, shingles: Column, most_sets: int = CELL_SETS, most_shingles: int = CELL_SHINGLES) -> Column:
    """How many cells so many sets with so many shingles take."""
    return F.greatest(F.ceil(sets / most_sets), F.ceil(shingles / most_shingles), F.lit(1)).cast("long")


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("k", F.lit(1)), F.col(n))


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _cells(met: DataFrame, *most: int) -> DataFrame:
    """(k, cell) so that every two sets of a shard of ``met`` (shard, k, root, size) with different roots share a cell.

    The largest class of a shard, all of one root, needs no comparison within itself: its sets are dealt to cells once, and only the
    rest go to all of those and, where they are many, to each other's.
    """
    classes = met.groupBy("shard", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sums = classes.groupBy("shard").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("n_main"), F.max_by("shingles", "n").alias("main_shingles"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    counts = sums.select("shard", "main", _parts(F.col("n_main"), F.col("main_shingles"), *most).alias("mains"), _parts(F.col("n") - F.col("n_main"), F.col("shingles") - F.col("main_shingles"), *most).alias("others"))
    both = met.join(save(counts, "overlap-counts"), "shard")
    name = lambda kind, a, b: F.xxhash64("shard", F.lit(kind), a, b)
    mains = both.where("root = main").withColumn("part", _part("mains"))
    mains = mains.select("k", F.explode(F.transform(_upto("others"), lambda d: name(0, F.col("part"), d))).alias("cell"))
    rest = both.where("root <> main").withColumn("part", _part("others"))
    with_mains = F.transform(_upto("mains"), lambda c: name(0, c, F.col("part")))
    with_others = F.when(F.col("others") > 1, F.transform(_upto("others"), lambda d: name(1, F.least(d, "part"), F.greatest(d, "part")))).otherwise(F.array().cast("array<long>"))
    return mains.union(rest.select("k", F.explode(F.concat(with_mains, with_others)).alias("cell")))


def similar_sets(docs: DataFrame, shingle_words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    A document's set holds its distinct runs of ``shingle_words`` words, A-Z lower-cased (fewer words: the whole sequence). Two documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id that links reach. Equal sets are one before
    anything is compared, so a group of copies of any size is one set.

    First, sets with the same least shingle meet and those that link are joined: most copies. Then all sets of different groups that share a
    shingle of their prefixes, as any two that link do, meet by sizes and parity bits alone, which rule nearly all others out without fail;
    what is left meets in cells with whole sets, where search() decides. A cell holds at most two times CELL_SETS sets or
    CELL_SHINGLES shingles (or one set that is larger); more are dealt to several, so that every two still meet.

    Empty and null texts, and those without words, have n_shingles 0, link with nothing and are their own component. Rows without doc_id
    keep null, take part in links, and their component_id is null only where no linked row has an id. Repeated rows give
    repeated results; an empty table gives none; other columns are not read. Shingles are compared by 64-bit hashes, and so are whole sets when
    equal ones become one.
    """
    every = save(_marked(docs, shingle_words), "overlap-marked")
    common, marked = _common(every), every.where("counts is null").drop("counts")
    texts = marked.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("shard").alias("shard"))
    texts = save(texts, "overlap-texts")
    several = texts.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("k").alias("least")).where("n > 1")
    several = save(several.select("shard", "least", _parts(F.col("n"), F.col("shingles")).alias("parts")), "overlap-shards")
    # A shard's smallest set is in all its parts; what parts keep asunder otherwise is left to the second step.
    met = texts.select("k", "shard").join(several, "shard").withColumn("part", F.explode(F.when(F.col("k") == F.col("least"), _upto("parts")).otherwise(F.array(_part("parts")))))
    first = _linked(docs, texts, met.select("k", F.xxhash64("shard", "part").alias("cell")), shingle_words, percent)
    linked = save(connected_components(first).withColumnRenamed("node", "k"), "overlap-first")
    rooted = texts.join(linked, "k", "left").select("k", F.coalesce("root", "k").alias("root"), "row", "size")
    prefixes = _prefixes(docs, texts, common, shingle_words, percent).join(rooted, "row").dropDuplicates(["row"])
    rooted = save(prefixes.select("k", "root", "size", "keys", "bits"), "overlap-prefixes")
    # Most shingles are in one group only: those go first, by half of their bits, before anything wide is shuffled.
    halves = save(_open_halves(rooted), "overlap-halves")
    small = halves.count() <= BROADCAST_HALVES
    keyed = rooted.select("k", "root", "size", F.explode("keys").alias("key")).withColumn("half", F.shiftright("key", 32))
    keyed = keyed.join(F.broadcast(halves) if small else halves, "half", "left_semi")
    # Sizes of sets that link differ by less than a step of 100 / percent: they are in one step or in two neighbouring ones.
    step = F.floor(F.log("size") / (-math.log(percent / 100) * (1 + 1e-9))).cast("int")
    keyed = keyed.select("k", "root", "size", "key", F.posexplode(F.array(step, step + 1)).alias("lower", "step"))
    keyed = save(keyed.select("k", "root", "size", "lower", F.xxhash64("key", "step").alias("shard")), "overlap-keys")
    mark = F.xxhash64("k", F.lit(2))
    mixed = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("lower").alias("lower"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("k").alias("least"), F.max("k").alias("most"), F.bit_xor("k").alias("all"), F.bit_xor(mark).alias("mark"))
    # A shard with sets of the lower step alone is one that they have already; shards of the same sets are one.
    same = mixed.where("low <> high and lower = 0").groupBy("n", "least", "most", "all", "mark").agg(F.min("shard").alias("shard"))
    met = save(keyed.join(same.select("shard"), "shard").select("shard", "k", "root", "size").distinct(), "overlap-met")
    groups = _candidates(met, rooted.select("k", "root", "size", "bits"), percent)
    met = save(groups.join(rooted.select("k", "root", "size"), "k").select("shard", "k", "root", "size"), "overlap-candidates")
    edges = first.union(_linked(docs, texts, _cells(met), shingle_words, percent))
    roots = save(connected_components(edges).withColumnRenamed("node", "k"), "overlap-roots")
    grouped = save(texts.select("k", "id").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "overlap-groups")
    ids = save(grouped.groupBy("root").agg(F.min("id").alias("component_id")), "overlap-ids")
    known = save(grouped.join(ids, "root").select("k", "component_id"), "overlap-known")
    found = marked.where("k is not null").join(known, "k").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.union(marked.where("k is null").select("doc_id", "size", "doc_id"))
