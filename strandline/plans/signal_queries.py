"""Queries of waveform kernels, utilities and configurations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dsp, waveforms
from strandline.operators import closed_loop, degradation, runs
from strandline.plans.bridge import bridge
from strandline.plans.runtime import table


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("y"))


def wave_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", F.round(waveforms.rms(F.col("y")), 6).alias("rms"), F.round(waveforms.peak(F.col("y")), 6).alias("peak"))


def wave_zcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", waveforms.sign_changes(F.col("y")).alias("changes"))


def wave_dc_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = waveforms.remove_dc(F.col("y"))
    return _waves(spark, sf_dir).select("vec_id", F.round(waveforms.power(y), 5).alias("power"), (F.round(y[0].cast("double"), 4) + 0.0).alias("first"))


def wave_gain_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = waveforms.gain(F.col("y"), 4.0)
    return _waves(spark, sf_dir).select("vec_id", F.round(waveforms.total(y), 4).alias("total"), F.size(F.filter(y, lambda x: F.abs(x) == 1)).alias("n_clipped"))


def wave_frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = waveforms.frame_energies(F.col("y"), 8)
    return _waves(spark, sf_dir).select("vec_id", F.size(e).alias("n"), F.round(F.array_max(e), 6).alias("most"))


def wave_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = waveforms.pooled(F.col("y"), 10)
    return _waves(spark, sf_dir).select("vec_id", F.size(p).alias("n"), F.round(F.element_at(p, -1), 6).alias("last"))


def snr_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", F.round(waveforms.snr_estimate(F.col("y"), 8), 5).alias("snr_db"))


def snr_mix_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector mixed with the next one as noise, at 10 dB; the last one has none."""
    rows = _waves(spark, sf_dir)
    noise = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("noise"))
    mixed = waveforms.mix(F.col("y"), F.col("noise"), F.lit(10.0))
    return rows.join(noise, "vec_id").select("vec_id", F.round(waveforms.power(mixed), 5).alias("power"))


def _per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics of each user's events, some of them null."""
    v, u = F.col("value"), F.col("user_id")
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(v), 3).alias("m"), F.count("*").alias("n"))
    m, n = F.col("m"), F.col("n")
    metrics = F.struct(
        F.when(u % 3 != 0, m / 10 - 2).alias("si_sdr"), F.when(u % 4 != 0, n / 12.0).alias("stoi"), F.when(u % 5 != 0, 1 + m / 30).alias("pesq"),
        F.when(u % 7 != 0, 1 + n / 4.0).alias("dnsmos"), F.when(u % 2 == 0, m / 100).alias("wer"), F.lit(0.5).alias("speaker_similarity"),
    )
    return sums.select("user_id", metrics.alias("metrics"), "m", "n")


def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_user(spark, sf_dir).select("user_id", F.round(closed_loop.utility(F.col("metrics")), 6).alias("utility"))


def closed_loop_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of three attempts by user, each with one metric moved."""
    before = F.col("metrics")

    def attempt(by: float):
        return before.withField("speaker_similarity", F.lit(0.5) + by * (F.col("user_id") % 5 - 2))

    loop = closed_loop.decide(before, F.array(attempt(-0.1), attempt(0.05), attempt(0.2)), 2, 0.001)
    return _per_user(spark, sf_dir).select("user_id", loop.alias("loop")).select("user_id", "loop.decision", "loop.n_attempts", F.round("loop.utility_gain", 6).alias("utility_gain"), F.array_join("loop.steps", ",").alias("steps"))


def parse_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = F.concat(F.when(k % 3 == 0, "重度谱减 ").when(k % 3 == 1, "轻度谱减 ").otherwise(""), F.when(k % 4 == 0, F.concat(F.lit("衰减 "), k.cast("string"), F.lit(" dB"))).otherwise(""))
    return bridge(spark, sf_dir).select("sample_id", waveforms.strength(text).alias("strength"))


def degradation_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = degradation.sample_configs(table(spark, sf_dir, "customer"), "c_custkey")
    return rows.select(F.col("item").alias("c_custkey"), "copy", "noise_type", "snr_db", "reverb_rt60", F.size("bandlimit_hz").alias("n_band"))


def feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.transform("bandlimit_hz", lambda x: x.cast("int"))
    line = degradation.feature_text(F.col("noise_type"), F.col("snr_db"), F.col("reverb_rt60"), band)
    return bridge(spark, sf_dir).select("sample_id", line.alias("features"))


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last checkpoint among names made from orders."""
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, "run/checkpoint-best").otherwise(F.concat(F.lit("run/checkpoint-"), key.cast("string")))
    return degradation.latest_checkpoint(table(spark, sf_dir, "orders").select(name.alias("path")))


def preference_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("snr_db"), F.col("k")
    loss = degradation.preference_loss(-k / 10.0, -k / 8.0, -v / 100, -v / 90, 0.1, 0.1)
    return bridge(spark, sf_dir).select("sample_id", F.round(loss, 6).alias("loss"))


def spectral_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy that is left, and the first and the middle sample, after half of the frequencies have gone."""
    rows = _waves(spark, sf_dir).select("vec_id", dsp.spectral_gate(F.col("y"), 0.5).alias("y"))
    return rows.select("vec_id", F.size("y").alias("n"), F.round(waveforms.power(F.col("y")), 5).alias("power"), (F.round(F.col("y")[0].cast("double"), 4) + 0.0).alias("first"), (F.round(F.col("y")[32].cast("double"), 4) + 0.0).alias("middle"))


def pink_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", dsp.noise(F.col("vec_id"), F.size("y"), "pink").alias("y"))


def bandlimit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", dsp.band_limit(F.col("y"), 300, 3400).alias("y"))


def wave_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _waves(spark, sf_dir).select("vec_id", dsp.features(F.col("y")).alias("f")).select("vec_id", "f.*")
    return found.withColumn("spectral_centroid_hz", F.round("spectral_centroid_hz", 4))


def spectral_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", dsp.spectral_subtraction(F.col("y"), 1.0, size=16, hop=4).alias("y"))


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, degradation.NOISES)), (F.col("label") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", dsp.degrade(F.col("embedding"), F.col("vec_id"), kind, F.lit(12.0), F.lit(0.001), F.lit(300.0), F.lit(3400.0)).alias("y"))


def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as losses, users as runs."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return runs.loss_series(rows).withColumn("mean_loss", F.round("mean_loss", 6))


def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = waveforms.tone(200.0 + F.col("n_nationkey") * 10, 0.01)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(y).alias("n"), (F.round(waveforms.total(y), 4) + 0.0).alias("total"))


def audio_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = waveforms.tone(200.0 + F.col("n_nationkey") * 100, 0.2)
    return table(spark, sf_dir, "nation").select("n_nationkey", dsp.describe(y).alias("description"))


QUERIES = {
    f.__name__: f
    for f in (
        wave_rms, wave_zcr, wave_dc_remove, wave_gain_clip, wave_frame_energy, wave_pool, snr_estimate, snr_mix_power, utility_score, closed_loop_decision, parse_strength,
        degradation_config, feature_text, latest_checkpoint, preference_loss, spectral_gate, pink_noise, bandlimit, wave_features, spectral_subtraction, degraded, loss_series, tones, audio_descriptions,
    )
}

_Y = "WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings)\n"
_U = """WITH u AS (SELECT user_id, round(avg(value), 3) AS m, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN 0.25 ELSE 0 END AS w1, CASE WHEN user_id % 4 <> 0 THEN 0.2 ELSE 0 END AS w2,
  CASE WHEN user_id % 5 <> 0 THEN 0.15 ELSE 0 END AS w3, CASE WHEN user_id % 7 <> 0 THEN 0.15 ELSE 0 END AS w4, CASE WHEN user_id % 2 = 0 THEN 0.15 ELSE 0 END AS w5,
  1 / (1 + exp(-(m / 10 - 2) / 6)) AS a1, least(1.0, n / 12.0) AS a2, least(1.0, greatest(0.0, (m / 30) / 3.5)) AS a3, least(1.0, (n / 4.0) / 4) AS a4,
  1 - least(1.0, greatest(0.0, m / 100)) AS a5 FROM u),
k AS (SELECT user_id, w1 * a1 + w2 * a2 + w3 * a3 + w4 * a4 + w5 * a5 AS top, w1 + w2 + w3 + w4 + w5 + 0.1 AS w FROM c)
"""


def _move(by: float) -> str:
    return f"0.1 * (least(1.0, greatest(0.0, 0.5 + {by} * (user_id % 5 - 2))) - 0.5) / w"


def _u(name: str) -> str:
    return f"('0x' || substr(md5('42:{name}:' || c_custkey || ':' || copy), 1, 12))::BIGINT::DOUBLE / 281474976710656"


def _bridge(body: str) -> str:
    from strandline.plans.bridge import BRIDGE_SQL

    return f"WITH {BRIDGE_SQL}\n{body}"


#: Magnitudes and parts of the transform of 64 samples, by the sum that defines it.
_DFT = _Y + """, t AS (SELECT vec_id, y, unnest(range(0, 33)) AS k FROM w),
x AS (SELECT vec_id, k, list_sum(list_transform(range(0, 64), lambda n: y[n + 1] * cos(2 * pi() * k * n / 64))) AS re,
  -list_sum(list_transform(range(0, 64), lambda n: y[n + 1] * sin(2 * pi() * k * n / 64))) AS im FROM t),
m AS (SELECT *, sqrt(re * re + im * im) AS mag, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS twice FROM x),
g AS (SELECT m.*, mag >= q AS kept FROM m JOIN (SELECT vec_id, quantile_cont(mag, 0.5) AS q FROM m GROUP BY vec_id) USING (vec_id))
"""

ORACLE_SQL = {
    "spectral_gate": _DFT
    + """SELECT vec_id, 64::INTEGER AS n, round(sum(twice * mag * mag) FILTER (kept) / 64 / 64, 5) AS power, round(sum(twice * re) FILTER (kept) / 64, 4) + 0.0 AS first,
  round(sum(twice * re * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) FILTER (kept) / 64, 4) + 0.0 AS middle FROM g GROUP BY vec_id""",
    "wave_features": _Y
    + """, t AS (SELECT vec_id, y, unnest(range(0, 1025)) AS k FROM w),
h AS (SELECT vec_id, y, k, list_transform(range(0, 64), lambda n: y[n + 1] * (0.5 - 0.5 * cos(2 * pi() * (n + 1024) / 2048))) AS z FROM t),
x AS (SELECT vec_id, k, list_sum(list_transform(range(0, 64), lambda n: z[n + 1] * cos(2 * pi() * ((k * (n + 1024)) % 2048) / 2048))) AS re,
  list_sum(list_transform(range(0, 64), lambda n: z[n + 1] * sin(2 * pi() * ((k * (n + 1024)) % 2048) / 2048))) AS im FROM h),
m AS (SELECT vec_id, k, sqrt(re * re + im * im) AS mag FROM x),
f AS (SELECT vec_id, exp(avg(ln(greatest(mag * mag, 1e-10)))) / avg(greatest(mag * mag, 1e-10)) AS flat, sum(k * 16000.0 / 2048 * mag) / sum(mag) AS centre FROM m GROUP BY vec_id)
SELECT vec_id, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / 64), 6) AS rms, round(flat, 6) AS spectral_flatness, round(round(centre, 6), 4) AS spectral_centroid_hz,
  round(len(list_filter(range(2, 65), lambda i: (y[i] < 0) <> (y[i - 1] < 0))) / 63, 6) AS zero_crossing_rate, round(64 / 16000, 6) AS duration_seconds FROM w JOIN f USING (vec_id)""",
    "wave_rms": _Y + "SELECT vec_id, round(sqrt(list_sum(list_transform(y, lambda x: x * x)) / len(y)), 6) AS rms, round(list_max(list_transform(y, lambda x: abs(x))), 6) AS peak FROM w",
    "wave_zcr": _Y + "SELECT vec_id, len(list_filter(range(2, len(y) + 1), lambda i: (y[i] < 0) <> (y[i - 1] < 0)))::INTEGER AS changes FROM w",
    "wave_dc_remove": _Y
    + ", m AS (SELECT vec_id, y, list_sum(y) / len(y) AS m FROM w) SELECT vec_id, round(list_sum(list_transform(y, lambda x: (x - m) * (x - m))) / len(y), 5) AS power, round(y[1] - m, 4) + 0.0 AS first FROM m",
    "wave_gain_clip": _Y
    + "SELECT vec_id, round(list_sum(list_transform(y, lambda x: greatest(-1.0, least(1.0, x * 4)))), 4) AS total, len(list_filter(y, lambda x: abs(x * 4) >= 1))::INTEGER AS n_clipped FROM w",
    "wave_frame_energy": _Y
    + ", f AS (SELECT vec_id, list_transform(range(0, len(y) - 8, 8), lambda i: list_sum(list_transform(y[i + 1:i + 8], lambda x: x * x))) AS e FROM w) SELECT vec_id, len(e)::INTEGER AS n, round(list_max(e), 6) AS most FROM f",
    "wave_pool": _Y + "SELECT vec_id, ((len(y) + 9) // 10)::INTEGER AS n, round(list_avg(y[10 * ((len(y) - 1) // 10) + 1:len(y)]), 6) AS last FROM w",
    "snr_estimate": _Y
    + ", f AS (SELECT vec_id, unnest(list_transform(range(0, len(y) - 8, 8), lambda i: list_sum(list_transform(y[i + 1:i + 8], lambda x: x * x)))) AS e FROM w), q AS (SELECT vec_id, count(*) AS n, quantile_cont(e, 0.9) AS hi, quantile_cont(e, 0.1) AS lo FROM f WHERE e > 0 GROUP BY vec_id) SELECT vec_id, round(CASE WHEN n > 4 THEN greatest(3.0, least(30.0, 10 * log10(hi / (lo + 1e-9)))) ELSE 15.0 END, 5) AS snr_db FROM q",
    "snr_mix_power": _Y
    + ", p AS (SELECT a.vec_id, a.y AS s, b.y AS n FROM w a JOIN w b ON b.vec_id = a.vec_id + 1), g AS (SELECT *, sqrt((list_sum(list_transform(s, lambda x: x * x)) / len(s)) / ((list_sum(list_transform(n, lambda x: x * x)) / len(n) + 1e-12) * 10)) AS g FROM p) SELECT vec_id, round(list_sum(list_transform(range(1, len(s) + 1), lambda i: pow(s[i] + g * n[i], 2))) / len(s), 5) AS power FROM g",
    "utility_score": _U + "SELECT user_id, round((top + 0.05) / w, 6) AS utility FROM k",
    "closed_loop_decision": _U
    + f", g AS (SELECT user_id, {_move(-0.1)} AS g1, {_move(0.05)} AS g2, {_move(0.2)} AS g3 FROM k) SELECT user_id, CASE WHEN g1 >= 0.001 OR g2 >= 0.001 OR g3 >= 0.001 THEN 'accept' ELSE 'rollback' END AS decision, CASE WHEN g1 >= 0.001 THEN 1 WHEN g2 >= 0.001 THEN 2 ELSE 3 END AS n_attempts, round(CASE WHEN g1 >= 0.001 THEN g1 WHEN g2 >= 0.001 THEN g2 ELSE g3 END, 6) + 0.0 AS utility_gain, CASE WHEN g1 >= 0.001 THEN 'accept' WHEN g2 >= 0.001 THEN 'revise,accept' WHEN g3 >= 0.001 THEN 'revise,revise,accept' ELSE 'revise,revise,rollback' END AS steps FROM g",
    "parse_strength": _bridge("SELECT sample_id, CASE WHEN k % 4 = 0 THEN greatest(0.5, least(2.0, k / 15.0)) WHEN k % 3 = 0 THEN 1.6 WHEN k % 3 = 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS strength FROM b"),
    "degradation_config": f"SELECT c_custkey, copy::INTEGER AS copy, ['white', 'pink', 'hvac', 'cafe'][(floor({_u('noise')} * 4) + 1)::INTEGER] AS noise_type, round(5 + 20 * ({_u('snr')}), 1) AS snr_db, CASE WHEN {_u('reverb')} < 0.5 THEN round(0.1 + 0.5 * ({_u('rt60')}), 2) END AS reverb_rt60, CASE WHEN {_u('band')} < 0.2 THEN 2 END AS n_band FROM (SELECT c_custkey, unnest(range(0, 3)) AS copy FROM customer)",
    "feature_text": _bridge(
        "SELECT sample_id, 'noise_type=' || noise_type || '; snr_db=' || coalesce(snr_db::VARCHAR, 'unknown') || '; reverb_rt60=' || coalesce(reverb_rt60::VARCHAR, 'none') || '; bandlimit_hz=' || CASE WHEN banded THEN '[300, 3400]' ELSE 'none' END AS features FROM b"
    ),
    "latest_checkpoint": "SELECT 'run/checkpoint-' || max(o_orderkey) AS path FROM orders WHERE o_orderkey % 7 <> 0",
    "loss_series": "SELECT user_id AS run, count(*) AS optimizer_steps, arg_min(value, event_id) AS initial_loss, arg_max(value, event_id) AS final_loss, round(avg(value), 6) AS mean_loss, true AS all_losses_finite FROM events GROUP BY user_id",
    "tones": "SELECT n_nationkey, 160 AS n, round(list_sum(list_transform(range(0, 160), lambda i: 0.08 * sin(2 * pi() * (200.0 + n_nationkey * 10) * i / 16000))), 4) + 0.0 AS total FROM nation",
    "preference_loss": _bridge(
        "SELECT sample_id, round(0.9 * ln(1 + exp(-m)) + 0.1 * ln(1 + exp(m)), 6) AS loss FROM (SELECT sample_id, 0.1 * ((-k / 10.0::DOUBLE + snr_db / 100) - (-k / 8.0::DOUBLE + snr_db / 90)) AS m FROM b)"
    ),
}
