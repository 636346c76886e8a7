"""Full-text search: a stored index in ranges of tokens, ranked by BM25, with bounds by which a short list ends early."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text import fold_entity_name, plain, strip_diacritics
from .tables import kept

COLUMNS = ("title", "artist", "album", "album_artist", "composer", "genre", "year")
# The usual BM25 constants, and the signs that make a word a phrase.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SPECIAL = set('"*^:()[]{}~-')
SPLIT = r"[^\p{L}\p{N}]+"
#: Places of a word are its column and position in one number.
COLUMN_STEP = 1 << 40
#: Rows of a block, about, and blocks that a short list reads first.
BLOCK_ROWS, FIRST_BLOCKS = 65536, 64
PARTS = ("postings", "terms", "blocks", "totals")


class Index(NamedTuple):
    """postings (token, block, id, tf, length, places), by ranges of token and block; terms (token, docs, occurrences); blocks (token, block, docs, most); totals (docs, mean), one row.

    ``most`` is the largest part of a score, without its weight, that the token has in the block.
    """

    postings: DataFrame
    terms: DataFrame
    blocks: DataFrame
    totals: DataFrame


def tokens_of(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "id") -> DataFrame:
    """(id, length, words) of each row: for each column an array of its words without case and diacritics; length is the number of all."""
    words = [F.coalesce(F.filter(F.split(strip_diacritics(F.col(c).cast("string")), SPLIT), lambda w: w != ""), F.array().cast("array<string>")) for c in columns]
    split = rows.select(F.col(key).alias("id"), F.array(*words).alias("words")).where("id is not null")
    return split.select("id", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("length"), "words")


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def write_index(rows: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS, key: str = "id") -> Index:
    """Store the index of ``rows`` (one row for each key) in ``folder`` and read it back.

    Texts are folded once and kept; a row's words meet its postings in the row's own task. Postings are dealt by ranges of token and block, so
    that file statistics let a search read the ranges it names. A block holds rows of about one length, as short rows score highest.
    """
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/tokens"
    tokens_of(rows, columns, key).where("length > 0").write.mode("overwrite").parquet(path)
    words = spark.read.parquet(path)
    totals = words.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    parts = max(1, -(-spark.read.parquet(f"{folder}/totals").first()["docs"] // BLOCK_ROWS))
    block = F.floor(F.log2(F.col("length") + 1) * 4) * parts + F.pmod(F.xxhash64("id"), F.lit(parts))
    spread = words.select("id", "length", block.cast("long").alias("block"), F.posexplode("words").alias("col", "w")).select("id", "length", "block", "col", F.posexplode("w").alias("pos", "token"))
    # Dealt by ranges first, a token's words of a row are together and are grouped without another shuffle.
    spread = spread.select("token", "block", "id", "length", (F.col("col").cast("long") * COLUMN_STEP + F.col("pos")).alias("place")).repartitionByRange("token", "block")
    postings = spread.groupBy("token", "block", "id").agg(F.first("length").alias("length"), F.count("*").alias("tf"), F.collect_list("place").alias("places"))
    postings.sortWithinPartitions("token", "block", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    mean = F.broadcast(spark.read.parquet(f"{folder}/totals").select("mean"))  # one row
    blocks = postings.crossJoin(mean).groupBy("token", "block").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.max(_saturated(F.col("tf"), F.col("length"), F.col("mean"))).alias("most"))
    blocks.repartitionByRange("token").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{folder}/blocks")
    terms = spark.read.parquet(f"{folder}/blocks").groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))
    terms.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{folder}/terms")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder.rstrip('/')}/{part}") for part in PARTS))


def parse_query(text: str) -> list[list[tuple[list[str], bool]]]:
    """AND of ORs of (words, whether the last is a prefix). Fewer than two characters find nothing."""
    if len(text.strip()) < 2:
        return []
    terms = []
    for part in text.split(" "):
        words = "".join(c if c.isalnum() else " " for c in plain(part)).split()
        if words:
            exact = bool(SPECIAL & set(part))
            terms.append([(words, not exact)] if exact or "." not in part else [(words, False), (words, True)])
    return terms


Terms = list[list[tuple[list[str], bool]]]


def _is(word: str, prefix: bool) -> Column:
    return F.col("token").startswith(word) if prefix else F.col("token") == word


def _named(terms: Terms) -> Column:
    """Whether a token is one that the query names: all that is read of the index."""
    return reduce(lambda a, b: a | b, [_is(w, p and i == len(words) - 1) for ors in terms for words, p in ors for i, w in enumerate(words)])


def _occurrences(words: list[str], prefix: bool) -> Column:
    """How often a row, a group of its named postings, has the phrase."""
    if len(words) == 1:
        return F.coalesce(F.sum(F.when(_is(words[0], prefix), F.col("tf"))), F.lit(0))
    places = [F.flatten(F.collect_list(F.when(_is(w, prefix and i == len(words) - 1), F.col("places")))) for i, w in enumerate(words)]
    return F.size(reduce(F.array_intersect, [_shifted(p, i) for i, p in enumerate(places)])).cast("long")


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _hits(postings: DataFrame, terms: Terms) -> DataFrame:
    """(id, length, n0, n1, ..) of the rows of the named postings: how often each has each term."""
    counts = [F.greatest(*c).alias(f"n{i}") if len(c) > 1 else c[0].alias(f"n{i}") for i, c in enumerate([_occurrences(w, p) for w, p in ors] for ors in terms)]
    return postings.where(_named(terms)).groupBy("id").agg(F.first("length").alias("length"), *counts)


def _all_of(terms: Terms) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in range(len(terms))])


def _weight(docs: Column, holds: Column) -> Column:
    return F.greatest(F.log((docs - holds + 0.5) / (holds + 0.5)), F.lit(LEAST_IDF))


def _scored(hits: DataFrame, holds: DataFrame, totals: DataFrame, terms: Terms) -> DataFrame:
    """(id, score) of rows that have all terms; ``holds`` (h0, h1, ..) and ``totals`` are a row each."""
    wide = hits.where(_all_of(terms)).crossJoin(F.broadcast(holds)).crossJoin(F.broadcast(totals))
    return wide.select("id", reduce(lambda a, b: a + b, [_weight(F.col("docs"), F.col(f"h{i}")) * _saturated(F.col(f"n{i}"), F.col("length"), F.col("mean")) for i in range(len(terms))]).alias("score"))


def _holds(hits: DataFrame, terms: Terms) -> DataFrame:
    return hits.agg(*[F.count(F.when(F.col(f"n{i}") > 0, F.col("length"))).alias(f"h{i}") for i in range(len(terms))])


def search(index: Index, text: str) -> DataFrame:
    """(id, score), best first: rows that hold every word of ``text`` (as beginnings, or as phrases), ranked by BM25; ties by id.

    The index is read once, in the ranges of the tokens that ``text`` names.
    """
    terms = parse_query(text)
    if not terms:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = kept(_hits(index.postings, terms), "hits")
    return _scored(hits, _holds(hits, terms), index.totals, terms).orderBy(F.desc("score"), "id")


def top(index: Index, text: str, limit: int, shown: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows of search(), of those in ``shown`` (id) where given, without scoring the blocks that cannot have one.

    How many rows hold a term comes from the dictionary where the term is one token, else from a count of its rows. A block's bound is the sum of its terms' largest parts (of a phrase,
    the least of its words'). The FIRST_BLOCKS of highest bound give a score that ``limit`` rows reach; of the rest, only blocks whose bound reaches it are read.
    """
    terms = parse_query(text)
    if not terms:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    named = _named(terms)
    single = [ors[0][0][0] if len(ors) == 1 and len(ors[0][0]) == 1 else None for ors in terms]
    known = index.terms.where(named).agg(*[F.count(F.when(_is(w, ors[0][1]), 1)).alias(f"k{i}") for i, (w, ors) in enumerate(zip(single, terms, strict=True)) if w], *[F.max(F.when(_is(w, ors[0][1]), F.col("docs"))).alias(f"d{i}") for i, (w, ors) in enumerate(zip(single, terms, strict=True)) if w]).first() if any(single) else {}
    counted = {i: known[f"d{i}"] or 0 for i, w in enumerate(single) if w and known[f"k{i}"] <= 1}
    rest = [i for i in range(len(terms)) if i not in counted]
    if rest:
        asked = [terms[i] for i in rest]
        counted |= dict(zip(rest, _holds(_hits(index.postings, asked), asked).first(), strict=True))
    docs = index.totals.first()
    weights = [_weight(F.lit(docs["docs"]), F.lit(counted[i])) for i in range(len(terms))]
    most = lambda w, p: F.coalesce(F.sum(F.when(_is(w, p), F.col("most"))), F.lit(0.0))
    phrase = lambda words, p: F.least(*parts) if len(parts := [most(w, p and i == len(words) - 1) for i, w in enumerate(words)]) > 1 else parts[0]
    ceilings = [F.greatest(*c) if len(c := [phrase(w, p) for w, p in ors]) > 1 else c[0] for ors in terms]
    bounds = index.blocks.where(named).groupBy("block").agg(*[c.alias(f"c{i}") for i, c in enumerate(ceilings)]).where(reduce(lambda a, b: a & b, [F.col(f"c{i}") > 0 for i in range(len(terms))]))
    bounds = kept(bounds.select("block", reduce(lambda a, b: a + b, [w * F.col(f"c{i}") for i, w in enumerate(weights)]).alias("bound")), "bounds")
    holds = index.totals.select(*[F.lit(counted[i]).alias(f"h{i}") for i in range(len(terms))])

    def scored(postings: DataFrame) -> DataFrame:
        found = _scored(_hits(postings, terms), holds, index.totals, terms)
        return found if shown is None else found.join(shown.select("id").distinct(), "id", "left_semi")

    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    if not first:
        return scored(index.postings.limit(0))
    best = kept(scored(index.postings.where(F.col("block").isin(first))).orderBy(F.desc("score"), "id").limit(limit), "best")
    bar = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest = bounds.where(~F.col("block").isin(first))
    if bar["n"] >= limit:
        rest = rest.where(F.col("bound") >= F.lit(bar["least"]) * (1 - 1e-12))
    late = scored(index.postings.join(rest.select("block"), "block", "left_semi"))
    return best.union(late).orderBy(F.desc("score"), "id").limit(limit)


def search_for_playlist(index: Index, tracks: DataFrame, text: str, members: DataFrame, limit: int = 200) -> DataFrame:
    """The best ``limit`` hits among tracks that are no duplicates and no members (id) yet."""
    shown = S.hide_duplicates(tracks).select("id").join(members, "id", "left_anti")
    return top(index, text, limit, shown)


def match_entities(names: DataFrame, text: str) -> DataFrame:
    """Names (name) that contain ``text`` when both are folded; an empty text matches all."""
    wanted = plain(text).strip().removeprefix("the ")
    return names.where(fold_entity_name(F.col("name")).contains(wanted)) if wanted else names
