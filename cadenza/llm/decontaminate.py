"""Benchmark decontamination through a positional inverted index, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, save, text_key

#: Upper-case letters are kept by the split and lowered after it, word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of the test set are broadcast only up to this many; beyond it the join shuffles.
BROADCAST_TERMS = 200_000


def lower_ascii(c: Column) -> Column:
    """A-Z lowered, other letters as they are; ``lower`` does it for texts of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    w = _pieces(text)
    return (F.size(w) - (w[0] == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.transform(_pieces(text), lower_ascii), lambda w: w != "")


def test_terms(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, terms) of a test set (item_id, text).

    items: passage, words, item_ids - one row for each distinct word sequence, so that repeated items cost one search.
    terms: passage, at, word, after - each two adjacent words of a passage; for a passage of one word, that word and null.
    Items without words have no rows.
    """
    items = benchmark.select(F.col("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = save(items.groupBy("words").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids")).withColumn("passage", F.xxhash64("words")), "items")
    at = items.select("passage", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"), "words")
    terms = at.select("passage", "n", "at", "word", F.get("words", F.col("at") + 1).alias("after")).where("after is not null or n = 1")
    return items, save(terms, "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``docs`` for the terms of a test set: (term, id, k, pos), stored in the shared folder.

    A term is two adjacent words (or one word, where a test passage has no more); pos is the place of its first
    word. Each task stores the postings of its own documents ordered by term, so the tokens of the corpus are never shuffled.
    """
    known = terms.select("word", "after").distinct().withColumn("term", F.xxhash64("word", "after"))
    small = known.count() <= BROADCAST_TERMS
    both, single = known.where("after is not null"), known.where("after is null").select("word", F.col("term").alias("term"))
    words = docs.select(id_or_last().alias("id"), text_key().alias("k"), _pieces(F.col("text")).alias("words"))
    words = words.select("id", "k", F.posexplode("words").alias("pos", "raw"), "words")
    words = words.select("id", "k", "pos", lower_ascii(F.col("raw")).alias("word"), F.get("words", F.col("pos") + 1).alias("next"))
    # The next word is lowered only where the first is one of the test set's.
    first = known.select("word").distinct()
    near = words.join(F.broadcast(first) if small else first, "word", "left_semi").withColumn("after", lower_ascii(F.col("next")))
    found = near.join(F.broadcast(both) if small else both, ["word", "after"]).select("term", "id", "k", "pos")
    if not single.isEmpty():
        found = found.union(words.join(F.broadcast(single) if small else single, "word").select("term", "id", "k", "pos"))
    return save(found.sortWithinPartitions("term"), "postings")


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` as passage, n, at, term, n_postings: a row for each place of a passage, with the length of its term's list."""
    counts = index.groupBy("term").agg(F.count("*").alias("n_postings"))
    keyed = terms.select("passage", "n", "at", F.xxhash64("word", "after").alias("term"))
    return save(keyed.join(counts, "term", "left").fillna(0, ["n_postings"]), "counted-terms")


def look_up(index: DataFrame, counted: DataFrame, window: int = 10, slack: int = 0) -> DataFrame:
    """(id, k, passage, n, at, pos): the postings that can belong to a match of up to ``slack``, stored in the shared folder.

    ``counted`` is term_counts() of the test set. The lists of each window's rarest terms are read first: their postings, less the
    term's place in the passage, are the offsets at which the passage could lie. Only in documents with such offsets
    are the other terms of those passages looked up, and only what lies within 2 x slack of an offset is kept.
    The 2 x slack + 1 rarest terms of a window open the search, as at most 2 x slack of its terms may be missing.
    """
    size = F.least(F.col("n"), F.lit(window))
    frame = Window.partitionBy("passage").orderBy("at").rowsBetween(0, max(window - 2, 0))
    rare = counted.withColumn("rare", F.slice(F.array_sort(F.collect_list(F.struct("n_postings", "at", "term")).over(frame)), 1, 2 * slack + 1))
    rare = rare.where(F.col("at") + F.greatest(size - 1, F.lit(1)) <= F.greatest(F.col("n") - 1, F.lit(1)))
    anchors = rare.select("passage", F.explode("rare").alias("r")).where("r.n_postings > 0").select("passage", F.col("r.at").alias("at"), F.col("r.term").alias("term")).distinct()
    anchors = save(anchors, "anchors")
    opening = F.broadcast(anchors) if anchors.count() <= BROADCAST_TERMS else anchors
    place = ["id", "k", "passage", "offset"]
    opened = save(index.join(opening, "term").select("id", "k", "passage", (F.col("pos") - F.col("at")).alias("offset")).distinct(), "opened")
    inside = index.join(opened.select("id", "k", "passage").distinct(), ["id", "k"])
    hits = inside.join(counted.select("passage", "n", "at", "term"), ["passage", "term"]).withColumn("offset", F.col("pos") - F.col("at"))
    near = opened
    if slack:
        near = opened.withColumn("offset", F.explode(F.sequence(F.col("offset") - 2 * slack, F.col("offset") + 2 * slack))).distinct()
    return save(hits.join(near, place, "left_semi").select("id", "k", "passage", "n", "at", "pos"), "hits")


def find_passages(hits: DataFrame, window: int = 10, slack: int = 0) -> DataFrame:
    """(id, k, passage, start, end): stretches of documents that windows of passages match; end is exclusive.

    ``hits`` is look_up() with the same window and the same slack or a larger one. A window is ``window`` (2 or more) consecutive
    words of a passage, all of a shorter one. 0 as ``slack`` asks for the exact phrase. Above it, proximity: at an offset, a
    term may stand up to that many words off its place, and of a window's terms (adjacent word pairs) all but 2 x slack must
    be there, half of them at least. So up to ``slack`` words that are put in, left out or replaced leave a window of ten words found.
    """
    size = F.least(F.col("n"), F.lit(window))
    place = ["id", "k", "passage", "offset"]
    away = F.explode(F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda d: F.col("pos") - F.col("at") + d))
    there = hits.select("id", "k", "passage", "n", "at", "pos", away.alias("offset")).groupBy(*place, "at").agg(F.max("n").alias("n"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    ahead = Window.partitionBy(*place).orderBy("at").rangeBetween(0, max(window - 2, 0))
    seen = there.select("id", "k", "passage", "n", "start", F.count("*").over(ahead).alias("found"), F.max("last").over(ahead).alias("last"))
    enough = F.greatest(size - 1 - 2 * slack, F.ceil((size - 1) / 2), F.lit(1))
    return seen.where(F.col("found") >= enough).select("id", "k", "passage", "start", (F.col("last") + F.when(F.col("n") == 1, 1).otherwise(2)).alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of digits, ASCII letters (A-Z lowered) and characters beyond ASCII. A word is hit if it lies in an
    occurrence of a window of any benchmark item; n_items counts items with such windows, and items_sha256 is taken
    of their ids, sorted as strings and comma-joined (of the empty string if none). n_near counts items with a window
    that lies in the text exactly or nearly, by find_passages() with ``slack``; it decides nothing else.

    Null and empty texts have no words and no hits; items without words match nothing; items with equal words are found
    together; a null item_id is counted by no document. Rows with equal doc_id and text share their result, and rows
    without a doc_id keep null. Empty tables give empty or clean results; other columns are not read.
    """
    items, terms = test_terms(benchmark)
    index = build_index(docs, terms)
    hits = look_up(index, term_counts(index, terms), window, slack)
    spans = save(find_passages(hits, window), "spans")
    nearly = find_passages(hits, window, slack).select("id", "k", "passage").distinct().join(items.select("passage", "item_ids"), "passage")
    nearly = save(nearly.groupBy("id", "k").agg(F.size(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("n_near")), "near-items")
    so_far = F.max("end").over(Window.partitionBy("id", "k").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(so_far, F.col("start"))), F.lit(0))
    words = spans.select("id", "k", "start", "end").distinct().withColumn("fresh", fresh).groupBy("id", "k").agg(F.sum("fresh").alias("n_hit"))
    ids = spans.select("id", "k", "passage").distinct().join(items.select("passage", "item_ids"), "passage").groupBy("id", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"))
    found = save(words.join(ids, ["id", "k"]), "contaminated")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_last().alias("id"), text_key().alias("k"), n_words(F.col("text")).alias("n_words")).join(found, ["id", "k"], "left").join(nearly, ["id", "k"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that contamination() finds contaminated; all columns stay as they are."""
    items, terms = test_terms(benchmark)
    index = build_index(docs, terms)
    spans = save(find_passages(look_up(index, term_counts(index, terms), window), window).select(F.col("id").alias("†id"), F.col("k").alias("†k")).distinct(), "contaminated")
    return docs.withColumns({"†id": id_or_last(), "†k": text_key()}).join(spans, ["†id", "†k"], "left_anti").drop("†id", "†k")
