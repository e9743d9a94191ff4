"""The registered queries of this subpackage: opN_<name>, each an operator on its whole table under its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import centroids, conversations, licenses, mixing, near_dedup, neighbours, pieces, pii, pitman_yor, quality, tokens, transport, warc
from pagequarry.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_digest(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(table(spark, sf_dir, "documents"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tag", "dup", "copies", "skey")


def op11_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_nearest_vectors": op2_nearest_vectors,
        "op3_token_counts": op3_token_counts,
        "op4_quality_perplexity": op4_quality_perplexity,
        "op5_transport_streams": op5_transport_streams,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_warc_archives": op7_warc_archives,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_pii_spans": op9_pii_spans,
        "op10_source_mix": op10_source_mix,
        "op11_pitman_yor_scores": op11_pitman_yor_scores,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_conversation_repair": op13_conversation_repair,
    }


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """op12 in SQL: all distances, round by round."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS j, x FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT v.r, min(row({far}, c.j)) AS b FROM v, c{n} c GROUP BY v.r)")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT AS m
  FROM (SELECT b[2] AS j, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{n} JOIN v USING (r), generate_series(1, 64) g(i) GROUP BY 1, 2)) GROUP BY j)""")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN s{n} s USING (j))")
    return f"""WITH {', '.join(parts)} SELECT v.vec_id, c.j AS cluster, b[1]::BIGINT AS distance, (sum(b[1]) OVER (PARTITION BY c.j))::BIGINT AS cluster_inertia,
  (sum(b[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.j = b[2]"""


#: op6 in SQL: pairs that share a shingle, counted whole; smallest ids passed on over links until nothing changes. Documents
#: with equal sets go as one, so that a group of copies isn't expanded into pairs.
_DUPLICATES_SQL = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS s FROM w),
r AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM d WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
u AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM r),
p AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, c) AS (SELECT id, id FROM r UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.id),
m AS MATERIALIZED (SELECT id, min(c) AS c FROM c GROUP BY id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id, coalesce(d.doc_id = coalesce(m.c, d.doc_id), true) AS kept
FROM d LEFT JOIN r ON r.s = d.s LEFT JOIN m ON m.id = r.id"""

#: op7 in SQL: SHA-1 in hexadecimal digits, five of them four letters of base32.
_ARCHIVES_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(x, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END::BIGINT AS refers_to, 0::INTEGER AS n_problems
FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": _DUPLICATES_SQL, "op7_warc_archives": _ARCHIVES_SQL, "op12_centroid_clusters": _clusters_sql()}
