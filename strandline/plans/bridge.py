"""A manifest of acoustic records made from ``events`` by fixed formulas.

The tables at hand hold no acoustic records. This view gives each event the fields of one, with answers of
a model in all the shapes that the rules tell apart. ``BRIDGE_SQL`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.runtime import table

NOISE = {"signup": "white", "purchase": "pink", "view": "hvac", "click": "cafe"}


def _tenths(x: Column) -> Column:
    """Tenths as a decimal text."""
    a = F.abs(x)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(a / 10).cast("string"), F.lit("."), (a % 10).cast("string"))


def response_text(k: Column, noise: Column) -> Column:
    guess = F.when(k % 6 == 1, "").when(k % 6 == 2, "white").when(k % 6 == 3, F.concat(noise, F.lit(" noise"))).when(k % 6 == 4, "Pink").otherwise(noise)
    kind = F.when(k % 3 == 0, "highpass").when(k % 3 == 1, "dereverb").otherwise("equalizer")
    first = F.concat(
        F.lit('{"type": "'), kind, F.lit('", "reduction_db": '), _tenths(k * 4), F.lit(', "gain_db": '), _tenths((k - 50) * 5),
        F.lit(', "low_hz": '), (k * 5).cast("string"), F.lit(', "high_hz": '), (7600 - k * 80).cast("string"), F.lit("}"),
    )
    second = F.when(k % 4 == 3, ', {"type": "spectral_subtraction", "reduction_db": 14}').otherwise("")
    actions = F.when(k % 19 == 0, "").when(k % 23 == 0, '"boost"').otherwise(F.concat(first, second))
    rationale = F.when(k % 17 == 0, "").otherwise(', "rationale": "measured"')
    confidence = F.concat(F.floor(k / 80).cast("string"), F.lit("."), F.lpad(((k % 80) * 125).cast("string"), 4, "0"))
    body = F.concat(
        F.lit('{"diagnosis": {"noise_type": "'), guess, F.lit('", "reverb": '), F.when(k % 3 == 0, "true").otherwise("false"),
        F.lit('}, "actions": ['), actions, F.lit("]"), rationale, F.lit(', "confidence": '), confidence, F.lit("}"),
    )
    return F.when(k % 13 == 0, "not-json").otherwise(body)


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"))
    k, names = F.col("k"), F.create_map(*[F.lit(x) for kv in NOISE.items() for x in kv])
    noise = F.coalesce(F.element_at(names, F.col("event_type")), F.lit("unknown"))
    rows = events.select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("sample_id"),
        "event_id",
        "k",
        F.when(k % 10 == 0, "eval").when(k % 10 == 1, "test").when(k % 10 <= 4, "train").otherwise("unassigned").alias("split"),
        noise.alias("noise_type"),
        F.when(k % 11 != 0, F.round(F.col("value") - 20, 2)).alias("snr_db"),
        F.when(k % 4 == 1, 0.0).when(k % 4 > 1, k / 200.0).alias("reverb_rt60"),
        F.when(k % 5 == 0, F.array(F.lit(300.0), F.lit(3400.0))).alias("bandlimit_hz"),
        F.when(k % 25 == 24, 100).when(k % 3 == 0, 8000).when(k % 3 == 1, 16000).otherwise(48000).cast("long").alias("sample_rate"),
        F.when(k % 7 != 0, F.round(F.col("value") / 10, 3)).alias("duration_seconds"),
    )
    return rows.withColumn("response", response_text(k, F.col("noise_type")))


CONTEXT_SQL = r"""
e AS (SELECT event_id, event_type, value, regexp_extract(props, '"k": *(\d+)', 1)::INTEGER AS k FROM events),
b0 AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS sample_id, event_id, k,
  CASE WHEN k % 10 = 0 THEN 'eval' WHEN k % 10 = 1 THEN 'test' WHEN k % 10 <= 4 THEN 'train' ELSE 'unassigned' END AS split,
  CASE event_type WHEN 'signup' THEN 'white' WHEN 'purchase' THEN 'pink' WHEN 'view' THEN 'hvac' WHEN 'click' THEN 'cafe' ELSE 'unknown' END AS noise_type,
  CASE WHEN k % 11 <> 0 THEN round(value - 20, 2) END AS snr_db,
  CASE WHEN k % 4 = 1 THEN 0.0 WHEN k % 4 > 1 THEN k / 200.0 END::DOUBLE AS reverb_rt60,
  k % 5 = 0 AS banded,
  CASE WHEN k % 25 = 24 THEN 100 WHEN k % 3 = 0 THEN 8000 WHEN k % 3 = 1 THEN 16000 ELSE 48000 END::BIGINT AS sample_rate,
  CASE WHEN k % 7 <> 0 THEN round(value / 10, 3) END AS duration_seconds FROM e),
"""
RULES_SQL = r"""b AS (SELECT *, k % 13 <> 0 AS ok,
  CASE k % 6 WHEN 1 THEN '' WHEN 2 THEN 'white' WHEN 3 THEN noise_type || ' noise' WHEN 4 THEN 'pink' ELSE noise_type END AS guess,
  CASE k % 3 WHEN 0 THEN 'highpass' WHEN 1 THEN 'dereverb' ELSE 'equalizer' END AS kind,
  CASE WHEN k % 19 = 0 THEN 0 WHEN k % 23 = 0 THEN -1 WHEN k % 4 = 3 THEN 2 ELSE 1 END AS n_act,
  k * 4 / 10.0 AS red, (k - 50) * 5 / 10.0 AS gain, k * 5 AS low, 7600 - k * 80 AS high, k * 125 / 10000.0 AS conf FROM b0),
c AS (SELECT *,
  CASE WHEN NOT ok THEN 0.0 WHEN k % 17 = 0 THEN 0.75 WHEN n_act = 0 THEN 0.5 WHEN conf > 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS format,
  CASE WHEN NOT ok THEN 0.0 ELSE (CASE WHEN guess = noise_type THEN 1.0 WHEN contains(guess, noise_type) OR contains(noise_type, guess) THEN 0.75 ELSE 0.0 END)
       * CASE WHEN (reverb_rt60 <> 0) <> (k % 3 = 0) THEN 0.75 ELSE 1.0 END END::DOUBLE AS diagnosis,
  CASE WHEN NOT ok OR n_act <= 0 THEN 0.0 ELSE
       ((red <= 24)::INT + (gain BETWEEN -24 AND 6)::INT + (low <= 20000)::INT + (high BETWEEN 20 AND 24000)::INT + (low < high)::INT + (n_act = 2)::INT)
       / (5.0 + (n_act = 2)::INT) END::DOUBLE AS parameter_bounds,
  CASE WHEN NOT ok THEN 0.0 ELSE greatest(0.0, 1.0
       - 0.5 * (noise_type IN ('white', 'pink', 'cafe', 'hvac') AND n_act <= 0)::INT
       - 0.25 * (coalesce(reverb_rt60 <> 0, false) AND NOT (n_act > 0 AND kind = 'dereverb'))::INT
       - 0.25 * (banded AND NOT (n_act > 0 AND kind = 'equalizer'))::INT
       - 0.25 * (n_act > 0 AND kind = 'highpass' AND low > 300)::INT) END::DOUBLE AS consistency,
  CASE WHEN NOT ok THEN 0.0 WHEN n_act <= 0 THEN 1.0 ELSE greatest(0.0, 1.0
       - (CASE WHEN red > 18 THEN least(0.5, (red - 18) / 24) ELSE 0 END)
       - 0.25 * (abs(gain) > 18)::INT - 0.25 * (kind = 'highpass' AND low > 180)::INT
       - (CASE WHEN red + 14 * (n_act = 2)::INT > 30 THEN least(0.5, (red + 14 * (n_act = 2)::INT - 30) / 30) ELSE 0 END)
       - 0.25 * coalesce(snr_db >= 20 AND red + 14 * (n_act = 2)::INT > 12, false)::INT) END::DOUBLE AS overprocessing FROM b),
s AS (SELECT *, round_even((format + diagnosis + parameter_bounds + consistency + overprocessing) / 5, 6) AS total FROM c)
"""
BRIDGE_SQL = CONTEXT_SQL + RULES_SQL
