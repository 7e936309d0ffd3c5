"""Queries of vector search, of clustering and of main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.main_text import main_text
from strandline.llm.multi_index import top_k
from strandline.llm.rotated_bits import hard_negatives
from strandline.llm.shallot_means import shallot_means
from strandline.plans.runtime import table


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten codes nearest to that of every 50th vector, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 50 == 0).drop("radius")


def op12_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, against all vectors; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_shallot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds."""
    return shallot_means(table(spark, sf_dir, "embeddings"))


MULTI_INDEX_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
q AS (SELECT vec_id AS query_id, s AS qs FROM c WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id AS id, len(list_filter(range(1, 65), lambda i: s[i] <> qs[i]))::BIGINT AS distance
      FROM q JOIN c ON c.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, id, distance FROM r WHERE rank <= 10
"""

ROTATED_BITS_SQL = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id AS anchor_id, label AS own, c AS ac FROM v WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT anchor_id, own, vec_id, label, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * ac[i]))::BIGINT AS score
      FROM a JOIN v ON vec_id <> anchor_id AND len(c) = len(ac)),
p AS (SELECT * FROM (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY anchor_id, own ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own) WHERE place <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.own, place ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND label <> p.own
       AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def means_sql(rounds: int = 10, k: int = 8) -> str:
    """Plain rounds, one after another: every distance is measured."""
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1)::INTEGER AS cluster, x AS c FROM v
      QUALIFY cluster < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, min((d, cluster)) AS m FROM (
      SELECT rid, cluster, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v, c{r}) GROUP BY rid)"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (SELECT m[2] AS cluster, i, sum(x[i]) AS s, count(*) AS n
      FROM a{r} JOIN v USING (rid), unnest(range(1, 65)) AS u(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(f, c) AS c FROM c{r} LEFT JOIN (
      SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS f FROM s{r} GROUP BY cluster) USING (cluster))"""
            )
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} ON cluster = m[2]
"""
    )


QUERIES = {"op5_main_text": op5_main_text, "op10_multi_index": op10_multi_index, "op12_rotated_bits": op12_rotated_bits, "op13_shallot_means": op13_shallot_means}
ORACLE_SQL = {"op10_multi_index": MULTI_INDEX_SQL, "op12_rotated_bits": ROTATED_BITS_SQL, "op13_shallot_means": means_sql()}
