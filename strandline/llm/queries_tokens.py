"""Queries of mixing, chat formatting and tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.chat_parts import format_chat, read_back, text_part
from strandline.llm.temperature_mix import temperature_mix
from strandline.llm.unigram_pieces import byte_range, decode_pieces, default_model, encode_pieces
from strandline.plans.runtime import table


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: which one is taken in which pass, and at what token of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return temperature_mix(docs).select("doc_id", "source", "mix_pass", "mix_start")


TEMPERATURE_MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, coalesce(doc_id::VARCHAR, '') AS i,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
t AS (SELECT k, sum(n)::BIGINT AS total FROM d GROUP BY k),
g AS (SELECT sum(total)::DOUBLE AS whole, count(*) FILTER (total > 0) AS ns FROM t),
p AS (SELECT total::DOUBLE AS total, total / whole AS share, whole, ns FROM t, g WHERE total > 0),
lo AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1,
         CASE WHEN h >= want THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= want THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, lo, hi, max(0.99 * ln(ns)) AS want, ln(sum(pow(share, (lo + hi) / 2)))
               - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2))) / sum(pow(share, (lo + hi) / 2)) AS h
        FROM lo, p WHERE step < 40 GROUP BY step, lo, hi)),
full_h AS (SELECT -sum(share * ln(share)) AS h, max(0.99 * ln(ns)) AS want FROM p),
a1 AS (SELECT CASE WHEN h >= want THEN 1.0 ELSE (SELECT lo FROM lo WHERE step = 40) END AS alpha FROM full_h),
up AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN r <= 3.0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN r <= 3.0 THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT step, lo, hi, max(pow(share, (lo + hi) / 2) / total) / sum(pow(share, (lo + hi) / 2)) * max(whole) AS r
        FROM up, p WHERE step < 40 GROUP BY step, lo, hi)),
r1 AS (SELECT max(pow(share, alpha) / total) / sum(pow(share, alpha)) * max(whole) AS r,
              max(1.0 / total) / count(*) * max(whole) AS r0, max(alpha) AS alpha FROM p, a1),
al AS (SELECT round(CASE WHEN r <= 3.0 THEN alpha WHEN r0 <= 3.0 THEN alpha
                         ELSE greatest(alpha, (SELECT hi FROM up WHERE step = 40)) END, 6) AS alpha FROM r1),
z AS (SELECT sum(pow(share, alpha)) AS norm FROM p, al),
due AS (SELECT k, total, whole, CASE WHEN total = 0 THEN 0.0 WHEN alpha = 1 THEN total ELSE pow(total / whole, alpha) / norm * whole END AS due,
               greatest(ceil(total / greatest(1048576, floor(sqrt(whole)))), 1)::BIGINT AS nb FROM t, g, al, z),
whole_due AS (SELECT *, round(due / greatest(total, 1)) * total AS of_passes, round(due) AS of_tokens FROM due),
q0 AS (SELECT k, total, nb, (CASE WHEN abs(due - of_passes) <= due * 1e-12 THEN of_passes WHEN abs(due - of_tokens) <= due * 1e-12 THEN of_tokens
                                  ELSE floor(due) END)::BIGINT AS quota FROM whole_due),
q AS (SELECT *, greatest(ceil(quota / greatest(total, 1)), 1)::BIGINT AS passes FROM q0),
b AS (SELECT d.*, total, quota, passes, ('0x' || substr(md5('17:b:' || d.k || ':' || i), 1, 15))::BIGINT % nb AS blk FROM d JOIN q USING (k)),
s AS (SELECT k, blk, sum(n)::BIGINT AS n, any_value(passes) AS passes, any_value(total) AS total FROM b GROUP BY k, blk),
sp AS (SELECT *, unnest(range(0, passes)) AS pass FROM s),
st AS (SELECT k, blk, pass, pass * total + coalesce(sum(n) OVER (PARTITION BY k, pass
         ORDER BY ('0x' || substr(md5('17:o:' || pass || ':' || k || ':' || blk), 1, 15))::BIGINT, blk
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sp),
f AS (SELECT doc_id, source, pass, quota, b.n, start - b.n + sum(b.n) OVER (PARTITION BY b.k, b.blk, pass
         ORDER BY ('0x' || substr(md5('17:d:' || pass || ':' || b.k || ':' || i), 1, 15))::BIGINT, i, b.n
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first
      FROM b JOIN st ON b.k = st.k AND b.blk = st.blk)
SELECT doc_id, source, pass::INTEGER AS mix_pass, first::BIGINT AS mix_start FROM f WHERE first + n <= quota
"""


def op3_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns and learned texts, read back from the formatted string."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(control).alias("text"))
    rows = turns.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    read = read_back(format_chat(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_PARTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
         sum(23 + length(regexp_replace(role, '([<\[\\])', '\1x', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1x', 'g'))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
       sha256(learned) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM g
"""


def chat_media_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of all conversations whose users send an image, a recording or a document after each text, with expanded tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    kind = F.element_at(F.array(*map(F.lit, ("image", "audio", "document"))), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    ref = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    none = F.lit(None).cast("string")
    media = F.struct(kind.alias("kind"), none.alias("text"), ref.alias("ref"), F.pmod(n, F.lit(5)).cast("long").alias("units"))
    parts = F.when(F.col("role") == "user", F.concat(text_part(F.col("text")), F.array(media))).otherwise(text_part(F.col("text")))
    out = format_chat(turns.withColumn("parts", parts)).select("conv_id", "n_expanded", F.explode("attachments").alias("a"))
    return out.select("conv_id", F.col("a.number").alias("number"), F.col("a.turn").alias("turn"), F.col("a.kind").alias("kind"), F.col("a.ref").alias("ref"), F.col("a.n_tokens").alias("n_tokens"), "n_expanded")


CHAT_MEDIA_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
m AS (SELECT conv_id, pos, ['image', 'audio', 'document'][1 + length(text) % 3] AS kind, length(text) % 5 AS units,
             coalesce(conv_id::VARCHAR, '') || '/' || coalesce(turn::VARCHAR, '') AS ref FROM n WHERE role = 'user'),
x AS (SELECT *, 2 + units * CASE kind WHEN 'image' THEN 256 WHEN 'audio' THEN 25 ELSE 512 END AS n_tokens FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::INTEGER AS number, pos::INTEGER AS turn, kind, ref,
       n_tokens::BIGINT AS n_tokens, sum(n_tokens) OVER (PARTITION BY conv_id)::BIGINT AS n_expanded FROM x
"""


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, their number, the byte pieces among them, and whether they decode to the text."""
    model = default_model(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    decoded = decode_pieces(encode_pieces(docs, model, keep_text=False), model)
    byte_ids = F.filter("ids", lambda x: x.between(*map(F.lit, byte_range(model))))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.size(byte_ids).cast("long").alias("n_byte_ids"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("text_sha256").eqNullSafe(F.sha2("decoded", 256)).alias("exact"),
        "ids",
    )


QUERIES = {"op3_chat_parts": op3_chat_parts, "chat_media_parts": chat_media_parts, "op2_temperature_mix": op2_temperature_mix, "op9_unigram_pieces": op9_unigram_pieces}
ORACLE_SQL = {"op3_chat_parts": CHAT_PARTS_SQL, "chat_media_parts": CHAT_MEDIA_SQL, "op2_temperature_mix": TEMPERATURE_MIX_SQL}
