"""Queries over recordings in chunks, and their SQL over the whole waveforms.

A recording is made of sixteen vectors in the order of their ids, so it crosses the borders of its chunks many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import recordings
from strandline.plans.runtime import table

#: Samples of a chunk: no multiple of the vectors, frames or hops below.
LENGTH, FRAME, HOP, VECTORS = 100, 48, 20, 16


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / VECTORS).alias("rec"))
    whole = rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("y"))
    return recordings.chunked(whole, "rec", "y", LENGTH)


def recording_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping frames of each recording: how many samples, and their sum."""
    framed = recordings.frames(_chunks(spark, sf_dir), FRAME, HOP, LENGTH)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return framed.select("id", "frame", F.size("samples").alias("n"), (F.round(total, 6) + 0.0).alias("total"))


def recording_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated ratio of each recording, from quantiles of its frames' energies."""
    return recordings.snr_estimates(_chunks(spark, sf_dir), LENGTH, 8).select("id", F.round("snr_db", 5).alias("snr_db"))


def recording_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings.moments(_chunks(spark, sf_dir))
    return found.select("id", F.col("n").cast("long").alias("n"), (F.round("mean", 8) + 0.0).alias("mean"), F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the values of events by kind, found by selection."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    found = recordings.quantiles(rows, [0.0, 0.1, 0.5, 0.9, 1.0], "event_type", "value", most=64, buckets=16)
    return found.select(F.col("id").alias("event_type"), "q", F.round("value", 6).alias("value"))


QUERIES = {q.__name__: q for q in (recording_frames, recording_snr, recording_moments, value_quantiles)}

_REC = """WITH w AS (SELECT vec_id // 16 AS id, flatten(list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY vec_id)) AS y FROM embeddings GROUP BY 1)
"""
ORACLE_SQL = {
    "recording_frames": _REC + "SELECT id, f AS frame, 48::INTEGER AS n, round(list_sum(y[20 * f + 1:20 * f + 48]), 6) + 0.0 AS total FROM (SELECT id, y, unnest(range(0, (len(y) - 48) // 20 + 1)) AS f FROM w WHERE len(y) >= 48)",
    "recording_snr": _REC
    + """, f AS (SELECT id, unnest(list_transform(range(0, len(y) - 8, 8), lambda i: list_sum(list_transform(y[i + 1:i + 8], lambda x: x * x)))) AS e FROM w),
q AS (SELECT id, count(*) AS n, quantile_cont(e, 0.9) AS hi, quantile_cont(e, 0.1) AS lo FROM f WHERE e > 0 GROUP BY id)
SELECT id, round(CASE WHEN n > 4 THEN greatest(3.0, least(30.0, 10 * log10(hi / (lo + 1e-9)))) ELSE 15.0 END, 5) AS snr_db FROM q""",
    "recording_moments": _REC + "SELECT id, len(y)::BIGINT AS n, round(list_sum(y) / len(y), 8) + 0.0 AS mean, round(sqrt(list_sum(list_transform(y, lambda x: x * x)) / len(y)), 6) AS rms, round(list_max(list_transform(y, lambda x: abs(x))), 6) AS peak FROM w",
    "value_quantiles": "SELECT event_type, q, round(v, 6) AS value FROM (SELECT event_type, unnest([0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]) AS q, unnest(quantile_cont(value, [0.0, 0.1, 0.5, 0.9, 1.0])) AS v FROM events GROUP BY event_type)",
}
