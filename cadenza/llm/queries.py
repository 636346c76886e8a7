"""The corpus operators as registered queries, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clusters, decontaminate, forest, mixing, negatives, overlap, pii, quality, sharding, simhash, substrings, tokens, warc
from .common import small_batches, table


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substrings.dedup_passages(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op4_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_linear_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return overlap.similar_sets(table(spark, sf_dir, "documents"))


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_disclosure": op2_disclosure,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_nb_svm": op4_nb_svm,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_pfair": op6_pfair,
    "op7_linear_match": op7_linear_match,
    "op8_positional_index": op8_positional_index,
    "op9_prefix_forest": op9_prefix_forest,
    "op10_recompression": op10_recompression,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_overlap_join": op12_overlap_join,
    "op13_bisector_clusters": op13_bisector_clusters,
}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _rounds(n: int) -> str:
    """The rounds of the clustering as common table expressions c0 (start), d1, c1, d2, ..: distances, then moved centroids."""
    out = ""
    for i in range(1, n + 2):
        out += f"""
        d{i} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(distance := CAST(list_sum(list_transform(v, lambda x, j: (x - w[j]) * (x - w[j]))) AS BIGINT), cluster := cluster)) AS best FROM kept, c{i - 1} GROUP BY vec_id, v),"""
        out += "" if i > n else f"""
        c{i} AS MATERIALIZED (SELECT cluster, coalesce(m, w) AS w FROM c{i - 1} LEFT JOIN (
            SELECT cluster, list(CAST(floor_of AS BIGINT) ORDER BY j) AS m FROM (
                SELECT best.cluster AS cluster, j, (sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of FROM d{i}, range(1, 65) r(j) GROUP BY 1, 2) GROUP BY cluster) USING (cluster)),"""
    return out

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
              FROM e a, e o WHERE a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND len(a.v) = len(o.v)),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_overlap_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 3], ' ')) AS g FROM d, range(0, greatest(len(w) - 2, 1)) r(i) WHERE len(w) > 0),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op13_bisector_clusters": f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS w FROM kept QUALIFY cluster < 8),{_rounds(10)}
        last AS (SELECT vec_id, best.cluster AS cluster, best.distance AS distance FROM d11)
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(w, ',')) AS centroid_sha256 FROM last JOIN c10 USING (cluster)""",
    "op8_positional_index": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g
               FROM b, range(0, greatest(len(w) - 9, 1)) r(i) WHERE len(w) > 0),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) s, range(0, len(w)) r(i) WHERE i + n <= len(w)),
        h AS (SELECT dw.doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
        p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(0, h.n) r(j) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id),
        ip AS (SELECT DISTINCT item_id, len(w) AS n, i AS spot, w[i + 1] AS a, coalesce(w[i + 2], '') AS b FROM b, range(0, greatest(len(w) - 1, 1)) r(i) WHERE len(w) > 0),
        dp AS (SELECT doc_id, i AS pos, w[i + 1] AS a, coalesce(w[i + 2], '') AS b FROM d, range(0, len(w)) r(i)),
        near AS (SELECT DISTINCT doc_id, item_id, n, spot, pos - spot + o AS off FROM ip JOIN dp ON ip.a = dp.a AND (ip.b = dp.b OR n = 1), range(-1, 2) s(o)),
        seen AS (SELECT doc_id, item_id, least(n, 10) - 1 AS pairs, count(*) OVER (PARTITION BY doc_id, item_id, off ORDER BY spot RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS found FROM near),
        m AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM seen WHERE found >= greatest(pairs - 2, ceil(pairs / 2), 1) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_recompression": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g FROM d, range(0, len(w) - 12) r(i)),
        cut AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j + 1 AS p FROM cut, range(0, 13) r(j)),
        words AS (SELECT d.doc_id, p, w[p] AS word FROM d, range(1, len(w) + 1) r(p)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_pfair": """
        WITH RECURSIVE c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
        w2 AS (SELECT s, CAST(floor(sqrt(n)) AS BIGINT) AS w FROM c),
        q AS (SELECT CAST(sum(w) AS BIGINT) AS q FROM w2),
        l AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws FROM w2),
        e(place, done, pick) AS (
            SELECT -1, list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM l
            UNION ALL SELECT place + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p FROM (
                SELECT place, done, list_min(list_filter(list_transform(done, lambda d, i: CASE WHEN d < ws[i] AND (d * q) // ws[i] <= place + 1 THEN
                    {'due': ((d + 1) * q + ws[i] - 1) // ws[i], 'alone': CASE WHEN ((d + 1) * q) % ws[i] <> 0 THEN -1 ELSE 0 END, 'i': CAST(i AS BIGINT)} END), lambda x: x IS NOT NULL)).i AS p
                FROM e, l, q WHERE place < q - 1) x),
        plan AS (SELECT names[pick] AS source, ws[pick] AS w, row_number() OVER (PARTITION BY pick ORDER BY place) - 1 AS turn, place FROM e, l WHERE place >= 0),
        d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id % 1024, doc_id) - 1 AS number FROM documents)
        SELECT doc_id, x.source AS source, number // 16 AS block, CAST((turn * q) // w + cycle * q AS BIGINT) AS release, CAST(((turn + 1) * q + w - 1) // w + cycle * q AS BIGINT) AS deadline,
            CAST(place + cycle * q AS BIGINT) AS place, CAST((place + cycle * q) * 16 + number % 16 AS BIGINT) AS position
        FROM (SELECT d.*, number // 16 // w AS cycle, number // 16 % w AS t FROM d JOIN w2 ON source = s) x JOIN plan p ON p.source = x.source AND p.turn = x.t, q""",
    "op3_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p""",
}
