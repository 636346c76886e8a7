"""Relation graph: nodes and edges from JSON documents, merging, and bounded breadth-first walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import kept, with_positions

_ARTIST = "struct<id:string,name:string>"
_TARGET = "struct<id:string,title:string,`first-release-date`:string,date:string,name:string>"
RECORDING = (
    f"id string, title string, `first-release-date` string, `artist-credit` array<struct<name:string,joinphrase:string,artist:{_ARTIST}>>, "
    "releases array<struct<id:string,title:string,date:string,status:string>>, "
    f"relations array<struct<type:string,direction:string,`target-type`:string,recording:{_TARGET},work:{_TARGET},release:{_TARGET},artist:{_TARGET}>>"
)
RELEASE = (
    "id string, title string, date string, `label-info` array<struct<`catalog-number`:string,label:struct<id:string,name:string>>>, "
    "`release-group` struct<id:string,title:string,`primary-type`:string,`first-release-date`:string>"
)
NODE = ("mbid", "kind", "title", "artist", "year", "label", "primary_type")
EDGE = ("source_mbid", "target_mbid", "relation", "target_kind")


def _node(df: DataFrame, mbid: Column, kind: Column | str, title: Column, artist: Column | None = None, year: Column | None = None, label: Column | None = None, primary: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("seq", mbid.alias("mbid"), kind.alias("kind"), title.alias("title"), (none if artist is None else artist).alias("artist"), (none.cast("int") if year is None else year).alias("year"), (none if label is None else label).alias("label"), (none if primary is None else primary).alias("primary_type")).where("mbid is not null")


def _edge(df: DataFrame, source: Column, target: Column, relation: Column, kind: Column) -> DataFrame:
    return df.select("seq", source.alias("source_mbid"), target.alias("target_mbid"), relation.alias("relation"), kind.alias("target_kind")).where("target_mbid is not null")


def recording_fragments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with seq, of recordings (seq, json): the recording, its releases, and what it is related to. Broken JSON gives none."""
    d = docs.select("seq", F.from_json("json", RECORDING).alias("d")).where("d.id is not null")
    credit = F.aggregate("d.artist-credit", F.lit(""), lambda a, c: F.concat(a, F.coalesce(c["name"], c["artist"]["name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit(""))))
    own = _node(d, F.col("d.id"), "recording", F.col("d.title"), S.empty_to_null(F.trim(credit)), S.year_from_mb_date(F.col("d.first-release-date")))
    r = d.select("seq", "d.id", F.explode("d.releases").alias("r"))
    t = d.select("seq", "d.id", F.explode("d.relations").alias("x"))
    # The first kind of target that a relation has, in this order.
    kinds = ("recording", "work", "release", "artist")
    t = t.withColumn("kind", reduce(lambda c, k: c.when(F.col(f"x.{k}.id").isNotNull(), k), kinds, F.when(F.lit(False), "")))
    of = lambda n: reduce(lambda c, k: c.when(F.col("kind") == k, F.col(f"x.{k}.{n}")), kinds, F.when(F.lit(False), ""))
    nodes = own.union(_node(r, F.col("r.id"), "release", F.col("r.title"), year=S.year_from_mb_date(F.col("r.date"))))
    nodes = nodes.union(_node(t, of("id"), F.col("kind"), F.coalesce(of("title"), of("name")), year=S.year_from_mb_date(F.coalesce(of("first-release-date"), of("date")))))
    edges = _edge(r, F.col("id"), F.col("r.id"), F.lit("appears on"), F.lit("release")).union(_edge(t, F.col("id"), of("id"), S.relation_label(F.col("x.type"), F.col("x.direction")), F.col("kind")))
    return nodes, edges


def release_fragments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with seq, of releases (seq, json): the release with label and type, and its group."""
    d = docs.select("seq", F.from_json("json", RELEASE).alias("d")).where("d.id is not null")
    label = F.get(F.filter(F.transform("d.label-info", lambda i: i["label"]["name"]), lambda n: n.isNotNull()), 0)
    group = lambda n: F.col(f"d.release-group.{n}")
    nodes = _node(d, F.col("d.id"), "release", F.col("d.title"), year=S.year_from_mb_date(F.col("d.date")), label=label, primary=group("primary-type"))
    nodes = nodes.union(_node(d, group("id"), "release-group", group("title"), year=S.year_from_mb_date(group("first-release-date")), primary=group("primary-type")))
    return nodes, _edge(d, F.col("d.id"), group("id"), F.lit("release of"), F.lit("release-group"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each mbid of nodes (seq, ...): by field the latest that is not null; a kind "unknown" yields to any other."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    kind = F.coalesce(F.max_by("kind", F.when(F.col("kind") != "unknown", F.col("seq"))), F.lit("unknown"))
    return nodes.groupBy("mbid").agg(kind.alias("kind"), *[known(c).alias(c) for c in NODE[2:] if c in nodes.columns])


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE[:3]).agg(F.max_by("target_kind", "seq").alias("target_kind"))


def library_anchors(tracks: DataFrame) -> DataFrame:
    """(mbid, path, title, artist): the recordings that tracks name in their extended metadata, each with its first path."""
    mbid = S.valid_mbid(S.extended_field(F.col("extended_metadata"), "musicBrainzTrackId"))
    named = S.hide_duplicates(tracks).select(mbid.alias("mbid"), "path", "title", "artist").where("mbid is not null")
    return named.groupBy("mbid").agg(F.min("path").alias("path"), F.min_by("title", "path").alias("title"), F.min_by("artist", "path").alias("artist"))


def releases_to_enrich(edges: DataFrame) -> DataFrame:
    return edges.where("target_kind = 'release'").select(F.col("target_mbid").alias("mbid")).distinct()


#: Anchors that walk together, a bit each; edges of a node that one join row meets, at most.
WORD, HUB = 63, 4096


def _words(anchors: DataFrame, slim: DataFrame) -> DataFrame:
    """(anchor, word, bit): anchors in the order of their least neighbour, so that those of a word share what they reach, WORD to a word."""
    near = slim.groupBy(F.col("source_mbid").alias("anchor")).agg(F.min("target_mbid").alias("near"))
    placed = with_positions(anchors.select(F.col("mbid").alias("anchor")).where("anchor is not null").distinct().join(near, "anchor", "left"), F.coalesce("near", F.lit("")), F.col("anchor"))
    return placed.select("anchor", F.floor(F.col("position") / WORD).alias("word"), (F.col("position") % WORD).cast("int").alias("bit"))


def _bit(c: Column | str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c) if isinstance(c, str) else c)


def reach(edges: DataFrame, anchors: DataFrame, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(steps, words): steps (word, depth, source_mbid, target_mbid, relation, bits) of all anchors at once, words (anchor, word, bit) that say whose bit is whose.

    A row of the frontier is a node with the bits of the WORD anchors that have newly come to it, so a node that many anchors meet is joined
    with its edges once for all of them. Nodes of over HUB edges meet them in parts.
    """
    slim = kept(edges.select("source_mbid", "target_mbid", "relation").distinct(), "edges")
    words = kept(_words(anchors, slim), "words")
    hubs = slim.groupBy(F.col("source_mbid").alias("node")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
    parted = slim.join(hubs.withColumnRenamed("node", "source_mbid"), "source_mbid", "left")
    parted = kept(parted.select("source_mbid", "target_mbid", "relation", F.pmod(F.xxhash64("target_mbid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "parted")
    hubs = kept(hubs, "hubs")
    frontier = kept(words.groupBy(F.col("anchor").alias("node"), "word").agg(F.bit_or(_bit("bit")).alias("bits")), "frontier")
    seen, steps = frontier, []
    for depth in range(1, max_depth + 1):
        spread = frontier.join(hubs, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        step = spread.join(parted.withColumnRenamed("source_mbid", "node"), ["node", "part"]).select("word", F.lit(depth).alias("depth"), F.col("node").alias("source_mbid"), "target_mbid", "relation", "bits")
        step = kept(step, "steps")
        steps.append(step)
        if depth < max_depth:
            met = step.groupBy(F.col("target_mbid").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
            new = met.join(seen.withColumnRenamed("bits", "had"), ["node", "word"], "left").select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits"))
            frontier = kept(new.where("bits <> 0"), "frontier")
            seen = kept(seen.union(frontier).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "seen")
    none = slim.select(F.lit(0).cast("long").alias("word"), F.lit(0).alias("depth"), "source_mbid", "target_mbid", "relation", F.lit(0).cast("long").alias("bits")).limit(0)
    return (reduce(DataFrame.union, steps) if steps else none), words


def walk(edges: DataFrame, anchors: DataFrame, max_depth: int = 2) -> DataFrame:
    """(anchor, depth, source_mbid, target_mbid, relation): steps from each of ``anchors`` (mbid), breadth first.

    A node is expanded once, at the depth where it is first met, and all its edges are steps; so cycles end. Anchors walk together (reach());
    only the result has a row for each of them.
    """
    steps, words = reach(edges, anchors, max_depth)
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0))
    return steps.withColumn("bit", each).join(words, ["word", "bit"]).select("anchor", "depth", "source_mbid", "target_mbid", "relation")


def relation_threads(tracks: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, status, n_steps) of tracks (id, mbid): no mbid, anchor missing from the graph, or a thread of steps."""
    counts = steps.groupBy(F.col("anchor").alias("mbid")).agg(F.count("*").alias("n_steps"))
    known = nodes.select("mbid", F.lit(True).alias("known"))
    joined = tracks.select("id", "mbid").join(known, "mbid", "left").join(counts, "mbid", "left")
    status = F.when(F.col("mbid").isNull(), "no recording").when(F.col("known").isNull(), "anchor missing").otherwise("thread")
    return joined.select("id", status.alias("status"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def find_anchor(nodes: DataFrame, edges: DataFrame, text: str, by_year: bool = False) -> DataFrame:
    """The node whose title holds ``text``: with edges first, then recordings, then by year and title; ``by_year``: all of them, by year and title."""
    hits = nodes.where(F.lower("title").contains(text.lower()))
    if by_year:
        return hits.orderBy(F.coalesce("year", F.lit(0)), "title", "mbid")
    degree = edges.groupBy(F.col("source_mbid").alias("mbid")).agg(F.count("*").alias("degree"))
    return hits.join(degree, "mbid", "left").orderBy(F.col("degree").isNull(), F.col("kind") != "recording", F.coalesce("year", F.lit(0)), "title", "mbid").limit(1).drop("degree")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))  # one row each
