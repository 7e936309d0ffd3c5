"""Queries of the rules and models that judge documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.byte_gru import identify
from strandline.llm.host_rules import host_verdicts
from strandline.llm.pii_bootstrap import KINDS, personal_data
from strandline.llm.pu_quality import quality_scores
from strandline.plans.runtime import table


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every document, with the verdict on its source."""
    return host_verdicts(table(spark, sf_dir, "documents"))


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of the ids, by checksum, is held out of training."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "lang", "text")
    return identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",") for c in ("base", "spans")}
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a third of the ids, by checksum, is held out of training."""

    def held_out(doc_id: Column) -> Column:
        return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))

    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_scores(docs, labels, lambda i: ~held_out(i), keep=["doc_id", "held_out"])


HOST_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
            FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n,
             count(*) FILTER (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > n_words) AS k
      FROM b GROUP BY source),
mu AS (SELECT sum(k) / sum(n) AS mean_rate, count(*) AS nh, sum(n) AS total FROM h),
va AS (SELECT mean_rate, mean_rate * (1 - mean_rate) AS chance, nh, total,
              (SELECT sum(n * pow(k / n - mean_rate, 2)) / sum(n) FROM h) AS s FROM mu),
st AS (SELECT mean_rate, CASE WHEN mean_rate > 0 AND mean_rate < 1
         THEN greatest(chance / greatest(s - chance * nh / total, chance / 1000) - 1, 1.0) END AS strength FROM va),
prior AS (SELECT coalesce(mean_rate * strength, coalesce(mean_rate, 0) + 0.5) AS a,
                 coalesce((1 - mean_rate) * strength, 1.5 - coalesce(mean_rate, 0)) AS b FROM st),
r AS (SELECT source, (k + a) / (n + a + b) AS rate FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.6 AS kept, round(rate, 6) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

QUERIES = {"op6_byte_gru": op6_byte_gru, "op7_pii_bootstrap": op7_pii_bootstrap, "op8_host_rules": op8_host_rules, "op11_pu_quality": op11_pu_quality}
ORACLE_SQL = {"op8_host_rules": HOST_RULES_SQL}
