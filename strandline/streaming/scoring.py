"""Scoring of answers as they arrive, with Structured Streaming. All rules are the same columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.rewards import score

ANSWERS = "sample_id string, response string, noise_type string, snr_db double, reverb_rt60 double, bandlimit_hz array<double>, at timestamp"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """A stream of answers from JSON files that are put into a folder."""
    return spark.readStream.schema(ANSWERS).json(path)


def scored(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Scored answers, the first of each id within the watermark."""
    return score(stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sample_id"]))


def window_means(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Mean total and share of valid answers by window; late rows beyond the watermark are left out."""
    rows = score(stream.withWatermark("at", delay))
    return rows.groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.avg("total").alias("total"), F.avg(F.col("valid_json").cast("double")).alias("valid_json_rate"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To Parquet, once for all files that are there; a restart goes on from ``checkpoint``."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
