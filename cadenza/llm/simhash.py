"""SimHash near-duplicates: fingerprints, shard-wise BK-trees, exact links and components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_last, maybe_in, save, text_key
from .graph import connected_components

SEED = 42
#: Parts into which a shard's free bits are cut: two fingerprints that differ in at most PARTS - 1 bits agree on one of them.
PARTS = 3
#: A shard of more fingerprints than this is cut again by its free bits.
TREE_LIMIT = 4096
#: Cuts of a shard, at most: the last leaves 20 bits free, and so no more than a million fingerprints to a tree.
CUTS = 3
#: Documents of a chunk where shards are cut in chunks, each pair of which is compared in one task.
CHUNK = 1024
#: Buckets of shingle hashes that are counted to tell common shingles from rare ones.
ORDER_BUCKETS = 1 << 16
#: Halves of shingle hashes are broadcast only up to this many; beyond it the join shuffles.
BROADCAST_HALVES = 1_000_000


class BKTree:
    """Burkhard-Keller tree over 64-bit integers: a child hangs on its Hamming distance to its parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        """Insert ``key`` and return its node; a key that is there already has one node."""
        if not self.keys:
            self.keys.append(key)
            self.children.append({})
            return 0
        at = 0
        while d := (self.keys[at] ^ key).bit_count():
            if d not in self.children[at]:
                self.children[at][d] = len(self.keys)
                self.keys.append(key)
                self.children.append({})
                return len(self.keys) - 1
            at = self.children[at][d]
        return at

    def within(self, key: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of all keys within ``radius``; only edges of length d - radius to d + radius are followed."""
        found, todo = [], [0] if self.keys else []
        while todo:
            at = todo.pop()
            d = (self.keys[at] ^ key).bit_count()
            if d <= radius:
                found.append((d, at))
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


class Groups:
    """Disjoint sets of 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``n`` words, A-Z lower-cased, one space between words; fewer words are one shingle."""
    words = text.lower().split()  # of bytes: both know ASCII only, and white space is 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    spans = zip((ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is 1 in over half of the hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp: long) of each row; the fingerprint of a text without words, or of none, is zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, shingle_words)) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _signed(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray | pa.ChunkedArray]]:
    """The rows of each shard, one shard at a time, of batches sorted by the first of ``names``; single rows are left out."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = t.column(names[0]).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        if len(starts):
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if z - a > 1:
                    yield t.slice(a, z - a)
            rest = t.slice(int(starts[-1]))
    if rest is not None and rest.num_rows > 1:
        yield rest


def _cut(fixed: int) -> list[int]:
    """The bits that are not ``fixed``, in PARTS parts of about equal width."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [sum(1 << b for b in free[len(free) * j // PARTS : len(free) * (j + 1) // PARTS]) for j in range(PARTS)]


def _long(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def _close(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(edges, links) of distinct fingerprints: edges (a, b) connect all within ``radius`` (at most 2) bits of each other, links (fp, n) count for each how many those are.

    A shard holds the fingerprints that agree on a part of the bits; where they are more than TREE_LIMIT, it is cut by parts of the
    bits that it leaves free, CUTS times at most. A pair may meet in several shards and is counted in the first.
    """
    if radius >= PARTS:
        raise ValueError("shards by parts of the bits find pairs that differ in two bits at most")
    # A way is the parts by which a shard was cut: (all its bits, the parts before each, on which a pair of this way differs).
    ways: list[tuple[int, list[int]]] = [(0, [])]
    todo, leaves, first = prints.select("fp", F.lit(0).alias("way")), [], 0
    for cut in range(1, CUTS + 1):
        last, branches = len(ways), []
        for way in range(first, last):
            fixed, earlier = ways[way]
            parts = _cut(fixed)
            for j in range(PARTS):
                ways.append((fixed | parts[j], earlier + parts[:j]))
            branches.append([F.struct(F.lit(last + PARTS * (way - first) + j).alias("way"), F.lit(_long(fixed | parts[j])).alias("bits")) for j in range(PARTS)])
        choice = F.element_at(F.array(*[F.array(*b) for b in branches]), F.col("way") - first + 1)
        spread = todo.select("fp", F.explode(choice).alias("to")).select("fp", "to.way", F.xxhash64("to.way", F.col("fp").bitwiseAND(F.col("to.bits"))).alias("shard"))
        large = None if cut == CUTS else save(spread.groupBy("shard").count().where(F.col("count") > TREE_LIMIT).select("shard"), "large-shards")
        if large is None or large.isEmpty():
            leaves.append(spread)
            break
        leaves.append(spread.join(large, "shard", "left_anti").select("fp", "way", "shard"))
        todo = save(spread.join(large, "shard", "left_semi").select("fp", "way"), "cut-shards")
        first = last

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(n, pa.int64())], ["a", "b", "n"])

        for shard in _runs(batches, ["shard"]):
            fps = np.sort(shard.column("fp").to_numpy().view(np.uint64)).tolist()
            earlier = ways[shard.column("way")[0].as_py()][1]
            tree, groups, links = BKTree(), Groups(len(fps)), [0] * len(fps)
            for i, fp in enumerate(fps):
                for _, j in tree.within(fp, radius):
                    groups.join(i, j)
                    if all((fp ^ fps[j]) & part for part in earlier):
                        links[i] += 1
                        links[j] += 1
                tree.add(fp)
            for i, fp in enumerate(fps):
                if (j := groups.find(i)) != i or links[i]:
                    a.append(fp)
                    b.append(fps[j])
                    n.append(links[i])
            if len(a) > 10000:
                yield made()
                a, b, n = [], [], []
        yield made()

    spread = functools.reduce(DataFrame.union, leaves)
    found = save(spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(trees, "a long, b long, n long"), "links")
    return found.where("a <> b").select("a", "b"), found.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of each row of ``docs`` (doc_id, text).

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id that links reach. Distinct
    fingerprints are dealt to shards by three parts of their bits, one of which two linked fingerprints share; each
    shard's BK-tree is built where the shard's rows are, so no tree of the corpus is broadcast. Shards too
    large for a tree (TREE_LIMIT) are cut further. n_links counts the other distinct fingerprints within the radius.

    Null and empty texts have fingerprint zero and are linked like others. Rows without a doc_id keep null, take
    part in links, and their component_id is null only where no linked row has an id. Repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    """
    marked = save(fingerprints(docs, shingle_words), "fingerprints")
    prints = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    edges, links = _close(prints.select("fp"), radius)
    roots = save(connected_components(edges), "roots")
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = save(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    known = save(save(known, "known").join(ids, "root").join(links, "fp", "left").select("fp", "component_id", F.coalesce("n", F.lit(0)).alias("n_links")), "components")
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# --- near copies by words: the same trees, over shards of documents that share shingles, with exact similarity ---


def _sketches(docs: DataFrame, shingle_words: int, shards: int) -> DataFrame:
    """(id, k, fp, shard keys) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = np.random.default_rng(SEED).integers(0, 2**64, shards, np.uint64) | np.uint64(1)
        for b in batches:
            fps, keys = [], []
            for t in _texts(b):
                h = shingle_hashes(t, shingle_words)
                fps.append(fingerprint(h))
                keys.append([int(((h ^ (h >> np.uint64(29))) * m).min()) ^ int(m) for m in mixers] if len(h) else [])
            flat = _signed([x for k in keys for x in k])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), _signed(fps), lists], ["id", "k", "fp", "shards"])

    return docs.select(id_or_last().alias("id"), text_key().alias("k"), "text").mapInArrow(work, "id long, k long, fp long, shards array<long>")


def _pack(hashes: np.ndarray) -> bytes:
    """A set of hashes by their upper 40 bits, in order, equal bytes of neighbours side by side."""
    return np.unique(hashes).view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(5, -1).T
    return wide.view(np.uint64).ravel()


def _similar(shard: pa.Table, radius: int | None, similarity: float) -> list[tuple[int, int]]:
    """Edges (k, k) that connect the documents of a shard as all pairs within ``radius`` bits (None: all pairs) whose shingle sets have Jaccard ``similarity`` do.

    Sets have their true sizes, and hashes that agree in 40 bits count as shared: no link is lost, and of pairs that lack one shared
    shingle about one in 2^40 / (size size) would be taken for a link.
    """
    names = shard.column("k").to_numpy()
    _, first = np.unique(names, return_index=True)
    names, n = names[first], len(first)
    if n < 2:
        return []
    sets = [_unpack(s) for s in shard.column("shingles").take(first).to_pylist()]
    size = np.array([len(s) for s in sets])
    every, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)[:-1]]
    mark, groups = np.zeros(len(every), np.int64), Groups(n)

    def join_close(i: int, found: np.ndarray) -> None:
        """Joins i to those of ``found``, all below i, to which it is similar."""
        least = np.minimum(size[found], size[i])
        found = found[(size[found] > 0) & (least >= similarity * (size[found] + size[i] - least) - 1e-9)]
        own = groups.find(i)
        found = found[[groups.find(j) != own for j in found.tolist()]] if len(found) else found
        if not len(found) or not size[i]:
            return
        mine = local[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        theirs = np.concatenate([local[starts[j] : starts[j] + size[j]] for j in found.tolist()])
        both = np.add.reduceat(mark[theirs], np.r_[0, np.cumsum(size[found])[:-1]])
        mark[mine] = 0
        for j in found[both >= similarity * (size[found] + size[i] - both) - 1e-9].tolist():
            groups.join(i, j)

    if radius is None:
        for i in range(1, n):
            join_close(i, np.arange(i))
    else:
        prints, tree, at = shard.column("fp").to_numpy().view(np.uint64)[first].tolist(), BKTree(), []
        for i in range(n):
            join_close(i, np.array([j for _, node in tree.within(prints[i], radius) for j in at[node]], np.int64))
            node = tree.add(prints[i])
            if node == len(at):
                at.append([])
            at[node].append(i)
    return [(int(names[i]), int(names[j])) for i in range(n) if (j := groups.find(i)) != i]


def _commonness(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """In how many rows the shingles of each of ORDER_BUCKETS buckets of hashes are: only an order, by which common shingles come last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ORDER_BUCKETS, np.int64)
        for b in batches:
            for t in _texts(b):
                n += np.bincount((np.unique(shingle_hashes(t, shingle_words)) % np.uint64(ORDER_BUCKETS)).astype(np.int64), minlength=ORDER_BUCKETS) if t else 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(ORDER_BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _prefixes(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(k, size, keys) of each row: the first shingles of its set of ``size``, in one order for all, of which any two sets of ``similarity`` share one.

    Such sets share at least ``similarity`` of either one's n shingles, so the first that they share is in each among
    the first n - ceil(similarity n) + 1. That holds in any order; the rarest come first, so that few sets meet.
    """
    common = _commonness(docs, shingle_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size = [], []
            for t in _texts(b):
                h = np.unique(shingle_hashes(t, shingle_words))
                size.append(len(h))
                first = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                keys.append(h[np.lexsort((h, common[(h % np.uint64(ORDER_BUCKETS)).astype(np.int64)]))[:first]].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(size, pa.int64()), lists], ["k", "size", "keys"])

    return docs.select(text_key().alias("k"), "text").mapInArrow(work, "k long, size long, keys array<long>")


def _open_halves(rooted: DataFrame) -> DataFrame:
    """(half) of the keys of ``rooted`` (k, root, keys) by upper 32 bits, where texts of different groups have them.

    A key's half and 32 bits of its root travel as one number, once per batch.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            root = np.repeat(b.column("root").to_numpy(), np.diff(keys.offsets.to_numpy())).view(np.uint64)
            half = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32) << np.uint64(32)
            mixed = (root ^ (root >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(half | mixed).view(np.int64))], ["packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *parts])) >> 32
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(every[1:][every[1:] == every[:-1]]))], ["half"])

    packed = rooted.select("root", "keys").mapInArrow(pack, "packed long")
    return packed.repartition(F.shiftright("packed", 32)).mapInArrow(work, "half long")


def _linked(docs: DataFrame, texts: DataFrame, met: DataFrame, shingle_words: int, similarity: float, radius: int | None) -> DataFrame:
    """Edges (a, b) of the texts that meet in a cell of ``met`` (k, cell), compared by _similar(); ``docs`` has id, k and text.

    The shingle set of a text is made where the text is read, and only sets of texts that meet others are shuffled.
    """
    wanted = save(met.groupBy("k").agg(F.collect_set("cell").alias("cells")).join(texts.select("k", "id", "fp"), "k"), "wanted")
    asked = maybe_in(wanted.select(F.xxhash64("id", "k")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_pack(shingle_hashes(t, shingle_words)) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(found, pa.binary())], ["id", "k", "shingles"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _runs(batches, ["cell"]):
            if edges := _similar(shard, radius, similarity):
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    made = docs.where(asked(F.xxhash64("id", "k"))).mapInArrow(sets, "id long, k long, shingles binary")
    cut = made.join(wanted, ["id", "k"]).dropDuplicates(["id", "k"]).select("k", "fp", "shingles", F.explode("cells").alias("cell"))
    return save(cut.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, b long"), "near-edges")


def _chunk(n: str) -> Column:
    """Which of the chunks of a shard of ``n`` texts a text k belongs to."""
    return F.pmod(F.xxhash64("k", F.lit(1)), F.ceil(F.col(n) / CHUNK))


def _chunks(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CHUNK) - 1)


def near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 20, shards: int = 3) -> DataFrame:
    """(id, k, root_id, root_k, n_rows) of each distinct document of ``docs`` (doc_id, text): its group's smallest document.

    Two documents link if their sets of ``shingle_words``-word shingles have Jaccard similarity ``similarity`` or more.
    A similarity of 0.8 turns over about eight of 64 bits, too many for shards by bit blocks; so a document goes to a
    shard for each of its ``shards`` smallest shingle hashes (a pair at 0.8 shares one of three with probability 0.99). In a
    shard a BK-tree follows edges within ``radius`` bits, and the shingle sets of what it finds are compared exactly; a shard of over CHUNK
    texts is cut into chunks, each with the shard's smallest text. That finds most
    links; the rest are found exactly: all texts of different groups that share a shingle of their prefixes (_prefixes())
    and are of a size, as any two that are similar do and are, are compared whatever their bits. Of over CHUNK such texts, each two
    chunks meet in one task. Equal texts are one document before that.

    id is doc_id, or NO_ID where that is null; k is the text's key; n_rows counts equal rows. Null texts are empty,
    and texts without words are copies of each other only if equal. An empty table gives none; other columns are not read.
    """
    read = docs.select(id_or_last().alias("id"), text_key().alias("k"), "text")
    marked = save(_sketches(docs, shingle_words, shards), "sketches")
    texts = save(marked.groupBy("k").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("shards").alias("shards")), "texts")
    spread = texts.select("k", F.explode(F.array_distinct("shards")).alias("shard"))
    counts = save(spread.groupBy("shard").agg(F.count("*").alias("n"), F.min("k").alias("least")).where("n > 1"), "shared-shards")
    # A shard's smallest text is in all its chunks; what chunks keep apart otherwise is left to the second way.
    met = spread.join(counts, "shard").withColumn("chunk", F.explode(F.when(F.col("k") == F.col("least"), _chunks("n")).otherwise(F.array(_chunk("n")))))
    first = _linked(read, texts, met.select("k", F.xxhash64("shard", "chunk").alias("cell")), shingle_words, similarity, radius)
    linked = save(connected_components(first).withColumnRenamed("node", "k"), "near-first")
    # What the shards or the radius have missed: texts that share a shingle of their prefixes and are not yet in one group.
    prefixes = _prefixes(docs, shingle_words, similarity).groupBy("k").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    rooted = save(prefixes.join(linked, "k", "left").select("k", F.coalesce("root", "k").alias("root"), "size", "keys"), "prefixes")
    # Most shingles are in one group only: those go first, by half of their bits, before anything wide is shuffled.
    halves = save(_open_halves(rooted), "open-halves")
    small = halves.count() <= BROADCAST_HALVES
    keyed = rooted.select("k", "root", "size", F.explode("keys").alias("key")).withColumn("half", F.shiftright("key", 32))
    keyed = keyed.join(F.broadcast(halves) if small else halves, "half", "left_semi")
    # Sizes of similar sets differ by less than a step of 1 / similarity: they are in one step or in two neighbouring ones.
    step = F.floor(F.log("size") / (-math.log(similarity) * (1 + 1e-9))).cast("int")
    keyed = keyed.select("k", "root", "key", F.posexplode(F.array(step, step + 1)).alias("lower", "step"))
    keyed = save(keyed.select("k", "root", "lower", F.xxhash64("key", "step").alias("shard")), "open-keys")
    mark = F.xxhash64("k", F.lit(2))
    mixed = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("lower").alias("lower"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("k").alias("least"), F.max("k").alias("most"), F.bit_xor("k").alias("all"), F.bit_xor(mark).alias("mark"))
    # A shard with texts of the lower step alone is one that they have already; shards of the same texts are one.
    mixed = mixed.where("low <> high and lower = 0")
    same = mixed.groupBy("n", "least", "most", "all", "mark").agg(F.min("shard").alias("shard"), F.min("low").alias("low"))
    met = save(keyed.select("k", "shard").distinct().join(same.select("shard", "n", "low"), "shard"), "open-shards")
    # Shards whose smallest groups are one meet in one cell, so that a text goes there once; where those are too many, each shard has cells of its own.
    homes = met.select("k", "low").distinct()
    sizes = save(homes.groupBy("low").agg((F.count("*") <= CHUNK).alias("together")), "homes")
    apart = met.join(sizes.where("not together"), "low").withColumn("chunk", _chunk("n"))
    pairs = F.transform(_chunks("n"), lambda j: F.xxhash64("shard", F.least(j, "chunk"), F.greatest(j, "chunk")))
    cells = homes.join(sizes.where("together"), "low").select("k", F.xxhash64("low").alias("cell")).union(apart.select("k", F.explode(pairs).alias("cell")))
    second = _linked(read, texts, cells, shingle_words, similarity, None)
    edges = first.union(second)
    roots = save(connected_components(edges).withColumnRenamed("node", "k"), "near-roots")
    grouped = save(texts.select("k", "id").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "near-groups")
    best = save(grouped.groupBy("root").agg(F.min(F.struct("id", "k")).alias("best")), "near-best")
    rows = marked.groupBy("id", "k").agg(F.count("*").alias("n_rows"))
    known = save(grouped.join(best, "root").select("k", F.col("best.id").alias("root_id"), F.col("best.k").alias("root_k")), "near-known")
    return save(rows, "near-rows").join(known, "k").select("id", "k", "root_id", "root_k", "n_rows")


def drop_near_copies(docs: DataFrame, **how: object) -> DataFrame:
    """``docs`` with one document of each group of near_copies(): the one of smallest doc_id (ties: smallest text key).

    Keeps all columns as they are; helper columns are named so that they cannot clash with them. Of equal rows one stays.
    """
    of = near_copies(docs, **how)
    keys = ["†id", "†k"]
    of = save(of.select(F.col("id").alias("†id"), F.col("k").alias("†k"), ((F.col("id") == F.col("root_id")) & (F.col("k") == F.col("root_k"))).alias("†stays"), "n_rows"), "near-copies")
    # Rows that are neither dropped nor repeated, most of them, pass without a join.
    held = of.where("not `†stays` or n_rows > 1")
    asked = maybe_in(held.select(F.xxhash64(*keys)))
    marked = docs.withColumns({"†id": id_or_last(), "†k": text_key()}).withColumn("†asked", asked(F.xxhash64(*keys)))
    dropped, repeated = (save(held.where(c).select(keys), name) for c, name in (("not `†stays`", "dropped"), ("`†stays`", "repeated")))
    joined = marked.where("`†asked`").join(dropped, keys, "left_anti")
    if not repeated.isEmpty():
        again = joined.join(repeated, keys, "left_semi").dropDuplicates(keys)
        joined = joined.join(repeated, keys, "left_anti").unionByName(again)
    return marked.where("not `†asked`").unionByName(joined).drop(*keys, "†asked")
