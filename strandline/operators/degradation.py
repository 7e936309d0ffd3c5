"""Degradation configurations drawn by hash, their text form, and group statistics of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISES = ("white", "pink", "hvac", "cafe")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample_configs(items: DataFrame, id_col: str, per_item: int = 3, seed: int = 42) -> DataFrame:
    """``per_item`` configurations for each item: noise, ratio, and sometimes reverberation and band limits."""
    rows = items.select(F.col(id_col).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))).alias("copy"))

    def u(name: str) -> Column:
        return uniform(F.lit(str(seed)), F.lit(name), F.col("item").cast("string"), F.col("copy").cast("string"))

    return rows.select(
        "item",
        "copy",
        F.element_at(F.array(*map(F.lit, NOISES)), (F.floor(u("noise") * 4) + 1).cast("int")).alias("noise_type"),
        F.round(5 + 20 * u("snr"), 1).alias("snr_db"),
        F.when(u("reverb") < 0.5, F.round(0.1 + 0.5 * u("rt60"), 2)).alias("reverb_rt60"),
        F.when(u("band") < 0.2, F.array(F.lit(300), F.lit(3400))).alias("bandlimit_hz"),
    )


def feature_text(noise: Column, snr: Column, rt60: Column, bandlimit: Column) -> Column:
    """The configuration as one line of text."""

    def say(x: Column, missing: str) -> Column:
        return F.coalesce(x.cast("string"), F.lit(missing))

    band = F.concat(F.lit("["), F.array_join(F.transform(bandlimit, lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.concat(F.lit("noise_type="), say(noise, "unknown"), F.lit("; snr_db="), say(snr, "unknown"), F.lit("; reverb_rt60="), say(rt60, "none"), F.lit("; bandlimit_hz="), say(band, "none"))


def group_advantages(rows: DataFrame, group_col: str, reward_col: str = "total", epsilon: float = 1e-4) -> DataFrame:
    """Rewards relative to their group: less its mean, over its deviation.

    Groups are aggregated with map-side combination and joined back, so no task holds a whole group.
    """
    own = F.col(group_col)
    stats = rows.groupBy(own.alias("__group")).agg(F.avg(reward_col).alias("__mean"), F.coalesce(F.stddev_samp(reward_col), F.lit(0.0)).alias("__deviation"))
    joined = rows.join(stats, own.eqNullSafe(F.col("__group")))
    return joined.withColumn("advantage", (F.col(reward_col) - F.col("__mean")) / (F.col("__deviation") + epsilon)).drop("__group", "__mean", "__deviation")


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0) -> Column:
    """The conservative preference loss of four log-probabilities."""
    margin = beta * ((chosen - ref_chosen) - (rejected - ref_rejected))
    return (1 - smoothing) * F.log1p(F.exp(-margin)) + smoothing * F.log1p(F.exp(margin))


def latest_checkpoint(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """One row: the checkpoint with the largest number; names without one are passed over."""
    step = F.regexp_extract(path_col, r"checkpoint-(\d+)$", 1)
    return paths.filter(step != "").agg(F.max_by(path_col, step.cast("long")).alias(path_col))
