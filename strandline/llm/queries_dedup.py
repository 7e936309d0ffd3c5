"""Queries of the near-duplicate and repeated-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.minhash_bayes import near_duplicate_classes
from strandline.llm.suffix_levels import remove_repeats
from strandline.plans.runtime import table


def op1_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets reach a similarity of 0.85."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"), shingle_words=3, percent=85, rows=8)


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 200-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op1_minhash_bayes": op1_minhash_bayes, "op4_suffix_levels": op4_suffix_levels}

MINHASH_BAYES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(
  CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id) AS component_id, coalesce(m.least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""

SUFFIX_LEVELS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
again AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM g SEMI JOIN again USING (k)),
isle AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS grp FROM r),
spans AS (SELECT rid, grp, min(i) AS a, max(i) + 200 AS b FROM isle GROUP BY rid, grp),
cut AS (SELECT rid, grp, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY grp), 0) AS last FROM spans),
kept AS (SELECT rid, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY grp) || substr(any_value(h), 2 * max(b) + 1) AS kept,
                sum(b - a) AS removed, count(*) AS n FROM cut JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

ORACLE_SQL = {"op1_minhash_bayes": MINHASH_BAYES_SQL, "op4_suffix_levels": SUFFIX_LEVELS_SQL}
